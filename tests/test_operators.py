"""Hand-worked values of the operators."""

import hashlib
import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions.joins import join_keys

from lodestar.functions.judges import make_judges
from lodestar.functions.registry import Registry
from lodestar.operators import graph, knn, metrics, soft
from lodestar.plans.config import ExperimentConfig, TrainerConfig
from lodestar.plans.retriever import GeoIndex
from lodestar.sources import tables

UNIT = [(0, [1.0, 0.0]), (1, [0.8, 0.6]), (2, [0.0, 1.0]), (3, [-0.6, 0.8]), (4, [-1.0, 0.0])]


@pytest.fixture
def vectors(spark):
    return spark.createDataFrame(UNIT, "vec_id long, embedding array<double>")


def values(df, *keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def close(got, want, tolerance=1e-5):
    return got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=tolerance) for k in want)


def test_forman_and_node_curvature(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (1, 2, 4.0), (2, 3, 0.25)], "src long, dst long, weight double")
    kappa = graph.forman_curvature(edges)
    assert close(values(kappa, "src", "dst", value="kappa"), {(0, 1): -0.8, (0, 2): -2.809524, (1, 2): -6.438095, (2, 3): 0.297619})
    nodes = spark.range(5)
    assert close(values(graph.node_curvature(kappa, nodes), "id", value="kappa_avg"), {(0,): -1.804762, (1,): -3.619048, (2,): -2.983333, (3,): 0.297619, (4,): 0.0})


def test_hubs_and_hot_keys(spark):
    rows = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(600)], "k long, x long")
    keys = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"))
    want = sorted(map(tuple, rows.join(keys.drop("n"), "k").collect()))
    for total in (600, 600_000, 10**9):  # all keys hot, some, none
        assert sorted(map(tuple, join_keys(rows, keys, "k", total).collect())) == want


def brute_transport(cost, n):
    from itertools import permutations

    return min(sum(cost[i][p[i]] for i in range(n)) for p in permutations(range(n))) / n


def test_transport():
    r = np.random.default_rng(0)
    for _ in range(40):
        n = int(r.integers(1, 6))
        cost = r.integers(0, 9, (n, n)).astype(float)
        assert graph.transport(cost, np.full(n, 1 / n), np.full(n, 1 / n)) == pytest.approx(brute_transport(cost, n), abs=1e-9)
    cost = np.array([[0.0, 1, 2], [1, 0, 1]])
    assert graph.transport(cost, np.array([0.5, 0.5]), np.array([0.2, 0.3, 0.5])) == pytest.approx(0.8)


def test_transport_curvature(spark):
    triangle = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0)], "src long, dst long, weight double")
    # Lazy walks with half their mass at home: (1/2, 1/4, 1/4) to (1/4, 1/2, 1/4) moves a quarter by one.
    assert close(values(graph.curvature(triangle, "ollivier"), "src", "dst", value="kappa"), {(0, 1): 0.75, (0, 2): 0.75, (1, 2): 0.75})
    path = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    # 1 has (1/4, 1/2, 1/4, 0) and 2 has (0, 1/4, 1/2, 1/4): cost 1; 0 has (1/2, 1/2): cost 1/2.
    assert close(values(graph.curvature(path, "ricci_ollivier"), "src", "dst", value="kappa"), {(0, 1): 0.5, (1, 2): 0.0, (2, 3): 0.5})
    with pytest.warns(UserWarning):
        assert close(values(graph.curvature(path, "auto"), "src", "dst", value="kappa"), values(graph.forman_curvature(path), "src", "dst", value="kappa"))


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [1.0, 0.0, 0.0]), (6, [0.8, 0.2, 0.0]), (None, [1.0, 0.0]), (7, [None, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert set(values(knn.knn_edges(table, 3), "src", "dst", value="weight")) == {(0, 1), (5, 6)}


def test_zero_weight_edges(spark):
    edges = spark.createDataFrame([(0, 1, 0.0), (1, 2, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    assert values(graph.forman_curvature(edges), "src", "dst", value="kappa") == {(1, 2): float("-inf"), (2, 3): 0.5}


def test_knn_graph(vectors):
    assert close(values(knn.knn_edges(vectors, 1), "src", "dst", value="weight"), {(0, 1): 0.2, (2, 3): 0.2, (3, 4): 0.4})
    two = {(0, 1): 0.2, (0, 2): 1.0, (1, 2): 0.4, (2, 3): 0.2, (2, 4): 1.0, (3, 4): 0.4}
    assert close(values(knn.knn_edges(vectors, 2), "src", "dst", value="weight"), two)
    assert close(values(knn.knn_edges(vectors, 2, block=2), "src", "dst", value="weight"), two)
    assert knn.knn_edges(vectors, 2, "euclidean").where("src = 2 and dst = 4").first()["weight"] == pytest.approx(1.414214)
    with pytest.raises(ValueError):
        knn.knn_edges(vectors, 2, "other")


def test_searches(spark, vectors):
    query = spark.createDataFrame([(7, [0.6, 0.8])], "qid long, qvec array<double>")
    for k, want in ((1, [(1, 0.04), (0, 0.24)]), (2, [(1, 0.04), (0, 0.24), (2, 0.44), (3, 0.64), (4, 1.04)])):
        index = GeoIndex(vectors, k)
        got = [(r["vec_id"], r["dist"]) for r in index.search(query, 10, "geodesic", connect_k=1).orderBy("rank").collect()]
        assert [i for i, _ in got] == [i for i, _ in want] and all(math.isclose(a[1], b[1], abs_tol=1e-9) for a, b in zip(got, want))
    assert [r["vec_id"] for r in index.search(query, 10).orderBy("rank").collect()] == [1, 2, 0, 3, 4]
    assert index.search(query, 0).count() == 0
    near = values(index.search(query, 10), "vec_id", value="rank")
    assert values(index.search(query, 10, "mix", alpha=0.0, mix_kappa=0.5), "vec_id", value="rank") == near  # alpha decides
    assert values(index.search(query, 10, "mix", mix_kappa=0.5), "vec_id", value="rank") != near
    for bad in ({"metric": "other"}, {"alpha": 1.5}, {"k": -1}):
        with pytest.raises(ValueError):
            index.search(query, **bad)


def test_pagerank(spark):
    adj = spark.createDataFrame([(1, 0, 1, 1.0), (1, 0, 2, 1.0), (1, 1, 0, 1.0), (1, 2, 1, 1.0)], "qid long, src long, dst long, w double")
    prior = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.3), (1, 2, 0.2)], "qid long, node long, p double")
    assert close(values(graph.personalized_pagerank(adj, prior), "node", value="p"), {(0,): 0.465573770, (1,): 0.327868852, (2,): 0.206557377}, 1e-8)


def test_heat_kernel(spark):
    a = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 2.0), (2, 1, 2.0)], "i long, j long, v double")
    for options, want in (({"t": 1.0, "steps": 5}, (0.184474993, 0.289922457, 0.068984145)), ({"t": 0.1, "steps": 5, "normalize": False}, (1.164123682, 1.500051776, 0.828195588))):
        d = values(soft.heat_kernel_distances(a, spark.range(3), **options), "i", "j", value="d")
        assert [d[0, 1], d[0, 2], d[1, 2]] == pytest.approx(want, abs=1e-7)


def test_matrix_forman(spark):
    full = {(0, 1): 1.0, (0, 2): 4.0, (1, 2): 1.0, (2, 3): 0.25}
    a = spark.createDataFrame([(i, j, v) for (x, y), v in full.items() for i, j in ((x, y), (y, x))], "i long, j long, v double")
    got = values(soft.matrix_forman(a), "i", "j", value="kappa")
    assert close(got, {(0, 1): -2.3, (1, 0): -1.3, (0, 2): -1.438095, (2, 0): -1.938095, (1, 2): -1.309524, (2, 1): -2.809524, (2, 3): -2.452381, (3, 2): 0.547619})
    got = values(soft.matrix_forman(a, "documented"), "i", "j", value="kappa")
    assert got[0, 1] == pytest.approx(-1.3) and got[0, 2] == pytest.approx(1.061905, abs=1e-5) and got[2, 3] == pytest.approx(1.047619, abs=1e-5)


def test_soft_knn(vectors):
    assert soft.gamma_of(vectors, 2) == pytest.approx(1.038740429)
    a = values(soft.soft_knn(vectors, 2), "i", "j", value="a")
    assert a[0, 1] == pytest.approx(1.773327, abs=1e-5) and a[2, 4] == pytest.approx(0.21611, abs=1e-5) and a[4, 3] == pytest.approx(1.65201, abs=1e-5)
    with pytest.raises(ValueError):
        soft.soft_knn(vectors, 1)


def test_soft_diagnostics(vectors):
    graph_, gamma = soft.soft_knn(vectors, 2), soft.gamma_of(vectors, 2)
    row = soft.diagnostics(graph_, 2, gamma).first()
    assert row["entropy"] == pytest.approx(0.662552005, abs=1e-7) and row["effective_degree"] == pytest.approx(1.712759080, abs=1e-7)
    assert row["status"] == "suboptimal" and row["actual_degree"] == pytest.approx(2, abs=1e-6)
    again = soft.distribution_metrics(graph_).first()
    assert (again["entropy"], again["effective_degree"]) == (row["entropy"], row["effective_degree"])


def test_order_statistics(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 3))
    x[20:25] = x[0]  # distances of zero don't count
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    shares = [0.0, 0.2, 0.5, 1.0]
    assert soft.order_statistics(rows, shares) == pytest.approx(np.quantile(d[d > 0], shares).tolist(), rel=1e-12)


def test_soft_knn_over_several_blocks_equals_a_plain_version(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(30, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = values(soft.soft_knn(rows, 3, 2.0), "i", "j", value="a")
    plain = knn.block_distances
    monkeypatch.setattr(soft, "block_distances", lambda e, what, schema: plain(e, what, schema, 7))
    assert close(values(soft.soft_knn(rows, 3, 2.0), "i", "j", value="a"), whole, 1e-12)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    p = np.exp(-d / 2) * (1 - np.eye(30))
    a = 3 * p / p.sum(axis=1, keepdims=True)
    a *= a >= np.sort(a, axis=1)[:, [-3]]
    a = (a + a.T) / 2
    a *= 3 / (a.sum(axis=1, keepdims=True) + 1e-8)
    assert close(whole, {(i, j): a[i, j] for i, j in zip(*map(list, np.nonzero(a)))}, 1e-9)


def test_geometric_loss_equals_a_plain_version(spark):
    r = np.random.default_rng(3)
    q, p, n = r.normal(size=(3, 4)), r.normal(size=(3, 4)), r.normal(size=(3, 2, 4))
    batch = spark.createDataFrame([(i, q[i].tolist(), p[i].tolist(), n[i].tolist()) for i in range(3)], "id long, q array<double>, p array<double>, n array<array<double>>")
    got = soft.geometric_loss(batch, 3, 0.5, 0.2, 0.1, 1.0, 4).first()
    x = np.concatenate([q, p, n.reshape(6, 4)])
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    gamma = np.quantile(d2[d2 > 0], 0.2) / np.log(3)
    z = np.exp(-d2 / gamma) * (1 - np.eye(12))
    a = 3 * z / z.sum(axis=1, keepdims=True)
    a *= a >= np.sort(a, axis=1)[:, [-3]]
    a = (a + a.T) / 2
    a *= 3 / (a.sum(axis=1, keepdims=True) + 1e-8)
    w = a * d2
    s = (w + w.T) / 2
    deg = s.sum(axis=1)
    scale = 1 / np.sqrt(deg + 1e-8)
    lap = (np.diag(deg) - s) * scale[:, None] * scale[None]
    k = term = np.eye(12)
    for i in range(1, 5):
        term = -term @ lap / i
        k = k + term
    d = ((k[:, None] - k[None]) ** 2).sum(axis=2)
    info = np.mean([d[i, 3 + i] / 0.5 + np.log(np.exp(-d[i, [3 + i, 6 + 2 * i, 7 + 2 * i]] / 0.5).sum()) for i in range(3)])
    kappa = np.where(s != 0, s * (1 / (deg + 1e-9)[:, None] + 1 / (deg + 1e-9)[None]) - (s[:, :, None] * s[:, None, :] / np.sqrt(s[:, :, None] ** 2 * s[:, None, :] + 1e-9)).sum(axis=2), 0)
    ricci = (np.maximum(0.1 - kappa, 0) ** 2).mean()
    assert got["info_nce"] == pytest.approx(info, abs=1e-8) and got["ricci"] == pytest.approx(ricci, abs=1e-7) and got["total"] == pytest.approx(info + 0.2 * ricci, abs=1e-7)


def test_losses(spark):
    d = spark.createDataFrame([(0.1, [0.2, 0.3]), (0.5, [0.4, 0.9])], "d_pos double, d_neg array<double>")
    assert soft.info_nce(d, 0.1).first()["loss"] == pytest.approx(0.862890697)
    k = spark.createDataFrame([(-1.0,), (0.5,), (-2.0,)], "k double")
    assert k.agg(soft.hinge(F.col("k"))).first()[0] == pytest.approx(5 / 3) and k.agg(soft.hinge(F.col("k"), 0.5)).first()[0] == pytest.approx(2.833333, abs=1e-6)


def test_metrics(spark):
    run = spark.createDataFrame([("1", "x", 3.0), ("1", "a", 2.0), ("1", "c", 1.0)], "qid string, doc_id string, score double")
    qrels = spark.createDataFrame([("1", "a", 2), ("1", "b", 1), ("1", "c", 1)], "qid string, doc_id string, rel int")
    row = metrics.retrieval_metrics(run, qrels, 3).first()
    assert row["ndcg"] == pytest.approx(0.562727255) and row["recall"] == pytest.approx(2 / 3)
    rows = spark.createDataFrame([(0, 0.1, 0.9), (1, 0.2, 0.5), (2, 0.3, 0.7)], "pos long, recall double, quality double")
    assert metrics.non_monotonicity(rows).first()["score"] == pytest.approx(2 / 3)
    assert metrics.non_monotonicity(rows.withColumn("pos", -F.col("pos"))).first()["score"] == 0
    assert metrics.non_monotonicity(rows.where("pos > 9")).first()["score"] == 0
    r = np.random.default_rng(4)
    many = [(int(p), float(a), float(b)) for p, a, b in zip(r.integers(0, 90, 120), r.integers(0, 5, 120), r.integers(0, 5, 120))]
    pairs = [(x, y) for x in many for y in many if x[0] < y[0]]
    bad = sum(x[1] < y[1] and x[2] > y[2] for x, y in pairs)
    table = spark.createDataFrame(many, "pos long, recall double, quality double")
    for block in (7, 50, 1000):
        assert metrics.non_monotonicity(table, block).first()["score"] == pytest.approx(bad / len(pairs))
    text = spark.createDataFrame([("do not go",), ("No way, never",), ("not, this",), (None,)], "t string")
    assert [r[0] for r in text.select(metrics.negations(F.col("t"))).collect()] == [1, 2, 0, 0]
    assert spark.range(1).select(metrics.keyword_judge(F.lit("A FACTual reason"))).first()[0] == 0.5
    scores = spark.createDataFrame([(0.2,), (0.6,), (0.9,)], "s double")
    assert [round(scores.agg(metrics.policy(F.col("s"), p)).first()[0], 6) for p in ("mean", "majority", "max", "min")] == [0.566667, 0.666667, 0.9, 0.2]
    assert spark.range(1).select(metrics.overlap(F.lit("a b c"), F.lit("b c c d"))).first()[0] == 0.5
    with pytest.raises(ValueError):
        metrics.policy(F.col("s"), "other")


def test_sources(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\tc\n a\tb\n\n\tb\tc\n")
    (tmp_path / "c.txt").write_text(" x \n\n y\n")
    assert [tuple(r) for r in tables.triplets(spark, f"file://{tmp_path}/t.tsv").collect()] == [("a", "b", "c")]
    assert sorted(tuple(r) for r in tables.text_lines(spark, f"file://{tmp_path}/c.txt").collect()) == [(0, "x"), (1, "y")]
    with pytest.warns(UserWarning):
        assert tables.text_lines(spark, f"file://{tmp_path}/none.txt").count() == 0
    with pytest.raises(FileNotFoundError):
        tables.text_lines(spark, f"file://{tmp_path}/none.txt", strict=True)
    (tmp_path / "e.jsonl").write_text('{"docs": ["a"]}\n')
    assert tables.eval_records(spark, f"file://{tmp_path}/e.jsonl").first()["query"] == ""
    assert tables.synthetic(spark, num_samples=5, embedding_dim=3).count() == 5
    assert [tuple(r) for r in tables.in_memory(spark, ["a", "b"]).collect()] == [(0, "a"), (1, "b")]


def test_lines_are_numbered_by_file_and_place(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a1\n\na2\na3\n")
    (tmp_path / "b.txt").write_text("".join(f"b{i}\n" for i in range(1, 40)))
    rows = sorted(map(tuple, tables.text_lines(spark, f"file://{tmp_path}/*.txt").collect()))
    assert [t for _, t in rows] == ["a1", "a2", "a3"] + [f"b{i}" for i in range(1, 40)] and [i for i, _ in rows] == list(range(42))
    assert sorted(r["text"] for r in tables.text_lines(spark, f"file://{tmp_path}/*.txt", max_docs=3).collect()) == ["a1", "a2", "a3"]


def test_index_round_trip(spark, vectors, tmp_path):
    corpus = spark.createDataFrame([(0, "a")], "doc_id long, text string")
    index = GeoIndex(vectors, 2)
    index.save(f"file://{tmp_path}/index", corpus)
    again = GeoIndex.load(spark, f"file://{tmp_path}/index")
    assert sorted(map(tuple, again.edges.collect())) == sorted(map(tuple, index.edges.collect()))
    path = index.save_report("r", f"file://{tmp_path}")
    row = json.loads(spark.read.text(path).first()[0])
    digest = hashlib.sha256(np.array([v for _, v in UNIT], ">f8").tobytes()).hexdigest()
    assert row["sha12"] == digest[:12] and row["embeddings_shape"] == [5, 2] and re.fullmatch(r"\d{8}T\d{6}Z", row["timestamp"]) and row["corpus_size"] == 0
    assert again.corpus.count() == 1


def test_config_and_registry(tmp_path):
    assert TrainerConfig().mode == "classic" and TrainerConfig(lambda_ricci=0.1).mode == "geometric"
    for bad in ({"k_graph": 2}, {"lr": 0}, {"lambda_ricci": -1}, {"ricci_backend": "x"}):
        with pytest.raises(ValueError):
            TrainerConfig(**bad)
    for large in ({"k_graph": 101}, {"lr": 0.2}, {"lambda_forman": 11}):
        with pytest.warns(UserWarning):
            TrainerConfig(**large)
    for bad in ({"epochs": 3}, {"trainer": {"epoch": 1}}, {"encoder": {"mode": "other"}}):
        with pytest.raises(ValueError):
            ExperimentConfig.from_dict(bad)
    (tmp_path / "c.yaml").write_text("dataset: d\ntrainer:\n  epochs: 2\n")
    config = ExperimentConfig.from_yaml(str(tmp_path / "c.yaml"))
    assert config.trainer.epochs == 2 and config.to_dict()["encoder"]["mode"] == "dual"
    r = Registry()
    r.register("encoder")("default")(len)
    assert r["encoder"]["default"] is len and r["other"] == {} and len(make_judges("mock,keyword")) == 2 and make_judges("") == []
    with pytest.raises(ValueError):
        make_judges("none")
