"""Text in, documents out: encoders, the retriever, judges, experiments and the command line."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import lodestar
from lodestar import cli
from lodestar.functions import encoders, judges
from lodestar.functions.stemmer import stem
from lodestar.operators import metrics
from lodestar.plans.experiments import ExperimentRunner, quick_experiment, seed_all, timeit
from lodestar.plans.retriever import Retriever
from lodestar.sources import tables

TEXTS = ["People walk their dogs in the park.", "A dog runs in the park.", "The cook bakes bread at night.", "Bread and butter for breakfast.", "Rain fell on the quiet harbour.", "A boat left the harbour in the rain."]


@pytest.fixture(scope="module")
def retriever(spark):
    return Retriever(spark).index(TEXTS, k_graph=2)


def test_search_before_index(spark):
    fresh = Retriever(spark, "hashing")
    assert fresh.encoder is not None and fresh.corpus_embeddings is None and fresh.corpus_graph is None and fresh.distance_matrix is None
    with pytest.raises(RuntimeError):
        fresh.search("a query", metric="geodesic")


def test_index_and_search(spark, retriever):
    assert retriever.corpus_embeddings.count() == 6 and retriever.corpus_graph.count() > 0 and retriever.distance_matrix.count() == 36
    for metric in ("cosine", "geodesic"):
        found = retriever.search("bread for the cook", top_k=3, metric=metric)
        assert len(found) == 3 and all(isinstance(i, int) for i in found) and set(found[:2]) == {2, 3}
    assert retriever.search("bread for the cook", 2) == retriever.search("bread for the cook", 5, top_k=2)
    with pytest.raises(ValueError):
        retriever.search("x", metric="invalid")
    many = retriever.search(spark.createDataFrame([(7, "dog park"), (8, "rain harbour")], "qid long, text string"), 2)
    rows = {(r["qid"], r["vec_id"]) for r in many.collect()}
    assert rows == {(7, 0), (7, 1), (8, 4), (8, 5)} or {q for q, _ in rows} == {7, 8} and (7, 1) in rows


def test_hashing_encoder_equals_a_plain_version(spark):
    import hashlib

    rows = spark.createDataFrame([(0, "One two two", 5), (1, None, 6), (2, "", 7)], "doc_id long, text string, embedding int")
    out = {r["doc_id"]: r["embedding"] for r in encoders.HashingEncoder(dim=32).encode(rows).collect()}
    want = np.zeros(32)
    for w in ("one", "two", "two"):
        h = hashlib.md5(w.encode()).hexdigest()
        want[int(h[:8], 16) % 32] += 1 - 2 * (int(h[8], 16) % 2)
    assert out[0] == pytest.approx((want / np.linalg.norm(want)).tolist()) and out[1] == out[2] == [0.0] * 32
    assert encoders.HashingEncoder().encode(rows.limit(0)).count() == 0
    raw = encoders.load_encoder("hashing", mode="mono", normalize=False, dim=32).encode(rows)
    assert raw.where("doc_id = 0").first()["embedding"] == want.tolist()
    vectors = spark.createDataFrame([(0, [3.0, 4.0])], "doc_id long, v array<double>")
    assert encoders.ColumnEncoder("v").encode(vectors).first()["embedding"] == pytest.approx([0.6, 0.8])
    with pytest.raises(ValueError):
        encoders.HashingEncoder(mode="other")


def test_unregistered_default(monkeypatch):
    monkeypatch.setattr(encoders, "registry", {"encoder": {}})
    with pytest.raises(RuntimeError):
        encoders.load_encoder("x")


def test_exports():
    assert lodestar.Retriever is Retriever and "registry" in lodestar.__all__
    with pytest.raises(AttributeError):
        lodestar.other


@pytest.mark.parametrize("word, want", [w.split(":") for w in "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop falling:fall hissing:hiss filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration digitizer:digit conformabli:conform radicalli:radic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope formaliti:formal triplicate:triplic formative:form formalize:formal electrical:electr goodness:good revival:reviv allowance:allow inference:infer airliner:airlin adjustable:adjust defensible:defens irritant:irrit replacement:replac adoption:adopt communism:commun activate:activ effective:effect probate:probat rate:rate cease:ceas controll:control roll:roll generalizations:gener oscillators:oscil".split()])
def test_stems(word, want):
    assert stem(word) == want


def plain_common(x, y):
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, u in enumerate(x):
        for j, v in enumerate(y):
            t[i + 1][j + 1] = t[i][j] + 1 if u == v else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_length_equals_a_plain_version():
    r = np.random.default_rng(0)
    for _ in range(200):
        x, y = ([str(v) for v in r.integers(0, 6, r.integers(0, 90))] for _ in range(2))
        assert metrics.common_length(x, y) == plain_common(x, y)


def test_rouge_l(spark):
    rows = spark.createDataFrame([(0, "the cats were running", "a cat runs home"), (1, None, "x"), (2, "same words here", "same words here")], "id long, answer string, reference string")
    got = {r["id"]: r["score"] for r in metrics.rouge_l(rows).collect()}
    assert got == pytest.approx({0: 0.0 if stem("cats") != "cat" else 2 * plain_common(["the", stem("cats"), stem("were"), stem("running")], ["a", "cat", stem("runs"), stem("home")]) / 8, 1: 0.0, 2: 1.0})
    assert {r["id"]: r["score"] for r in metrics.rouge_l(rows, stemming=False).collect()} == {0: 0.0, 1: 0.0, 2: 1.0}


def test_rare_and_ensembles(spark):
    rows = spark.createDataFrame([(0, "q", ["evidence and", "reason"], None), (1, "q", ["same words"], "same words"), (2, "q", [], None)], "id long, query string, docs array<string>, reference string")
    two = [judges.KeywordJudge(), judges.KeywordJudge(("reason",))]
    assert {r["id"]: r["score"] for r in judges.rare(rows).collect()} == {0: 0.5, 1: 1.0, 2: 0.0}
    for policy, want in (("mean", 0.75), ("majority", 0.5), ("max", 1.0), ("min", 0.5)):
        assert judges.judge_ensemble(rows, two, policy).where("id = 0").first()["score"] == want
    assert judges.judge_ensemble(rows, two).where("id = 0").first()["details"] == {"KEYWORD": 1.0}
    with pytest.raises(ValueError):
        judges.judge_ensemble(rows, two, "other")
    pairs = spark.createDataFrame([(0, "q", ["nothing"], ["a fact"])], "id long, query string, gt_docs array<string>, new_docs array<string>")
    assert tuple(judges.sud(pairs).first()) == (0, 0.25, 0.0, 0.25)


def test_more_metrics(spark):
    run = spark.createDataFrame([(1, 10, 3.0), (1, 11, 2.0), (1, 12, 1.0), (2, 10, 1.0)], "qid long, doc_id long, score double")
    qrels = spark.createDataFrame([(1, 10, 1), (1, 12, 2), (1, 99, 1), (2, 77, 1), (3, 1, 1)], "qid long, doc_id long, rel int")
    assert metrics.mean_average_precision(run, qrels).first()["map"] == pytest.approx(((1 + 2 / 3) / 3 + 0) / 2)
    q = spark.createDataFrame([(1, [10.0, 0.0])], "qid long, qvec array<double>")
    d = spark.createDataFrame([(5, [0.1, 0.0]), (6, [50.0, 50.0])], "vec_id long, embedding array<double>")
    row = metrics.evaluate_vectors(q, d, spark.createDataFrame([(1, 5, 1)], "qid long, doc_id long, rel int"), 1).first()
    assert (row["ndcg"], row["recall"]) == (1.0, 1.0)
    j = spark.createDataFrame([(0, "a", 0.0), (1, "b", 0.5), (2, "a", 1.0)], "pos long, name string, score double")
    assert tuple(metrics.meta_judgments(j).first()) == (0.5, {"a": 1.0, "b": 0.5})


def test_pagerank_rerank_equals_a_plain_version(spark):
    from lodestar.operators import graph

    candidates = spark.createDataFrame([(1, 1, 0, 0.9), (1, 2, 1, 0.5), (1, 3, 2, -0.2)], "qid long, rank int, vec_id long, score double")
    adj = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (2, 0, 1.0), (2, 1, 3.0), (0, 9, 5.0)], "src long, dst long, w double")
    a = np.array([[0, 1, 0], [0, 0, 2], [1, 3, 0]], float)
    a /= a.sum(axis=1, keepdims=True) + 1e-12
    prior = np.maximum([0.9, 0.5, -0.2], 1e-6)
    prior /= prior.sum()
    p = prior
    for _ in range(20):
        p = 0.8 * prior + 0.2 * a.T @ p
    got = {r["vec_id"]: (r["rank"], r["score"]) for r in graph.pagerank_rerank(candidates, adj, 3).collect()}
    assert {i: s for i, (_, s) in got.items()} == pytest.approx(dict(enumerate(p.tolist())), abs=1e-12)
    assert [got[i][0] for i in np.argsort(-p)] == [1, 2, 3]


def test_quick_experiment(spark):
    corpus = tables.in_memory(spark, TEXTS)
    queries = spark.createDataFrame([(1, "dogs in the park"), (2, "bread at breakfast")], "qid long, text string")
    qrels = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (2, 2, 1), (2, 3, 1)], "qid long, doc_id long, rel int")
    for geometric in (False, True):
        out = quick_experiment(corpus, queries, qrels, k=5, geometric=geometric)
        assert 0.5 < out["ndcg_10"] <= 1 and 0 < out["map"] <= 1 and out["recall_100"] == 1 and out["config"]["trainer"]["geodesic"] is geometric


def test_runner(spark, tmp_path):
    class Own(ExperimentRunner):
        def run(self):
            if self.config.get("bad"):
                raise RuntimeError("bad")
            self.save_results([{"a": 1}], "results.json")
            self.save_dataframe(spark.createDataFrame([(1, [2, 3])], "a int, b array<int>"), "rows")

    own = Own("own", str(tmp_path))
    with pytest.raises(RuntimeError):
        own.save_results([], "early.json")
    folder = own.start({"x": 1})
    assert json.load(open(f"{folder}/config.json")) == {"x": 1} and json.load(open(f"{folder}/results.json")) == [{"a": 1}]
    assert spark.read.option("header", True).csv(f"file://{folder}/rows").first()["b"] == "[2,3]" and "done" in open(f"{folder}/run.log").read()
    with pytest.raises(RuntimeError):
        own.start({"bad": 1})
    assert "bad" in open(f"{own.run_dir}/run.log").read()
    timed = timeit(sum)
    assert timed([1, 2]) == 3 and timed.seconds >= 0
    seed_all(1)
    first = np.random.random()
    seed_all(1)
    assert np.random.random() == first


def test_vectors_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1.0, 2.0])], "doc_id long, embedding array<double>")
    assert tables.save_vectors(rows, f"file://{tmp_path}/v") == (1, 2) and tables.load_vectors(spark, f"file://{tmp_path}/v").count() == 1
    tables.save_json(rows, f"file://{tmp_path}/j")
    tables.save_csv(rows.select("doc_id"), f"file://{tmp_path}/c")
    assert spark.read.json(f"file://{tmp_path}/j").count() == spark.read.option("header", True).csv(f"file://{tmp_path}/c").count() == 1


def test_command_line(spark, tmp_path, capsys):
    corpus = tmp_path / "corpus.txt"
    corpus.write_text("\n".join(TEXTS) + "\n")
    assert cli.main(["encode", "hashing", "one text", "another", "-o", f"file://{tmp_path}/e"]) == 0
    assert "Embeddings shape: (2, 256)" in capsys.readouterr().out
    assert cli.main(["search", "hashing", f"file://{corpus}", "--k", "2", "--query", "bread for the cook", "--top", "2"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["query"] == "bread for the cook" and set(out["results"]) == {TEXTS[2], TEXTS[3]}
    assert cli.main(["audit", "hashing", f"file://{corpus}", "--k", "2"]) == 0
    assert "Edges with curvature computed: " in capsys.readouterr().out
    lines = tmp_path / "q.jsonl"
    lines.write_text('{"query": "q", "docs": ["a fact"]}\n\n{"query": "q", "docs": ["same words"], "reference": "same words"}\n')
    assert cli.main(["eval", f"file://{lines}"]) == 0
    assert json.loads(capsys.readouterr().out) == {"metric": "RARE", "mean": 0.625, "n": 2}
    assert cli.main(["eval", f"file://{lines}", "--metric", "other"]) == 1
    with pytest.raises(KeyError):
        cli.main(["eval", f"file://{lines}", "--metric", "sud"])
    capsys.readouterr()
    assert cli.main(["report-save", "hashing", f"file://{corpus}", "--k", "2", "--name", "r", "--outdir", f"file://{tmp_path}"]) == 0
    assert any(x.startswith("r_") for x in os.listdir(tmp_path))
