"""Neighbours, soft graphs, paths and kernels over several blocks, against plain versions, and what they shuffle."""

import hashlib
import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import encoders, vectors
from lodestar.operators import graph, knn, soft


def table(spark, x, parts=3):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(parts)


def shuffled(spark):
    """Bytes of shuffle written so far."""
    sc = spark.sparkContext._jsc.sc()
    time.sleep(0.3)
    spark.range(1).count()  # sums are brought up to date by what comes after
    sc.listenerBus().waitUntilEmpty(10_000)
    return sum(e.totalShuffleWrite() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc.statusStore().executorList(False)))


def plain_topk(x, q, k, metric, same=False):
    score = {"cosine": lambda: -(q[:, None] * x[None]).sum(axis=2), "sqeuclidean": lambda: ((q[:, None] - x[None]) ** 2).sum(axis=2)}[metric]()
    if same:
        np.fill_diagonal(score, np.inf)
    return {(i, r + 1): (j, row[j]) for i, row in enumerate(score) for r, j in enumerate(sorted(range(len(x)), key=lambda j: (row[j], j))[:k]) if row[j] < np.inf}


@pytest.mark.parametrize("metric", ["cosine", "sqeuclidean"])
def test_neighbours_with_copies_and_far_from_the_origin(spark, metric):
    r = np.random.default_rng(5)
    for x in (r.normal(size=(90, 5)), r.normal(size=(90, 5)) * 1e-3 + 100, np.repeat(r.normal(size=(6, 5)), 15, axis=0)):
        blocks = knn.packed(table(spark, x), block=16)
        got = {(row["qid"], row["rank"]): (row["vec_id"], row["score"]) for row in knn.topk_blocks(blocks, blocks, 4, metric, True).collect()}
        want = plain_topk(x, x, 4, metric, True)
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and math.isclose(abs(got[k][1]), abs(want[k][1]), rel_tol=1e-12, abs_tol=1e-12) for k in want)


def test_a_bias_of_minus_infinity_comes_last(spark):
    r = np.random.default_rng(6)
    x, q, plus = r.normal(size=(40, 3)), r.normal(size=(5, 3)), r.normal(size=40) * 50
    plus[::2] = -np.inf
    corpus = spark.createDataFrame([(i, v.tolist(), float(b)) for i, (v, b) in enumerate(zip(x, plus))], "vec_id long, embedding array<double>, b double")
    asked = table(spark, q).toDF("qid", "qvec")
    got = {(row["qid"], row["rank"]): row["vec_id"] for row in knn.topk(corpus, asked, 25, block=7, scale=0.5, bias="b").collect()}
    score = 0.5 * q @ x.T + plus
    assert got == {(i, k + 1): j for i in range(5) for k, j in enumerate(sorted(range(40), key=lambda j: (-score[i, j], j))[:25])}


def test_no_vector_is_shuffled(spark):
    x = table(spark, np.random.default_rng(7).normal(size=(1500, 64)), 1)
    before = shuffled(spark)
    edges = knn.knn_edges(x, 5, block=64)
    assert "CoGroup" not in edges._jdf.queryExecution().toString() and edges.count() > 1500
    assert shuffled(spark) - before < 1_500_000  # 24 blocks of 64 vectors meet; the vectors have 770 KB


def test_soft_graph_shuffles_neighbours_only(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(2100, 64))
    rows = table(spark, x, 1)
    before = shuffled(spark)
    gamma = soft.gamma_of(rows, 8)
    assert soft.soft_neighbours(rows, 8, gamma).count() == 8 * 2100
    assert shuffled(spark) - before < 6_000_000
    d2 = ((x[:300, None] - x[None]) ** 2).sum(axis=2)
    some = table(spark, x[:300], 2)
    assert soft.gamma_of(some, 8) == pytest.approx(np.quantile(d2[:, :300][d2[:, :300] > 0], 0.2) / np.log(8), rel=1e-12)


def test_copies_tie_in_the_soft_graph(spark):
    x = np.repeat(np.random.default_rng(9).normal(size=(4, 3)), 6, axis=0)
    got = {(r["i"], r["j"]): r["d2"] for r in soft.soft_neighbours(table(spark, x), 3, 0.7).collect()}
    assert got == {(i, j): 0.0 for i in range(24) for j in range(24) if i != j and i // 6 == j // 6}


def jobs(spark, work):
    """What work() gives, and how many jobs it ran."""
    spark.sparkContext.setJobGroup("counted", "")
    try:
        found = work()
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_long_paths_take_no_rounds_of_jobs(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1, 0.5 + i) for i in range(n)], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(i,) for i in [*range(n + 1), 999]], "id long")
    rows, count = jobs(spark, lambda: graph.paths_between(edges, nodes).collect())
    at = np.concatenate([[0], np.cumsum(0.5 + np.arange(n))])
    want = {(i, j): abs(at[i] - at[j]) for i in range(n + 1) for j in range(n + 1)} | {(999, 999): 0.0} | {x: math.inf for i in range(n + 1) for x in ((i, 999), (999, i))}
    assert {(r["src"], r["dst"]): r["dist"] for r in rows} == pytest.approx(want) and len(rows) == len(want)
    assert count < 30
    rows, count = jobs(spark, lambda: graph.ollivier_curvature(edges).collect())
    assert len(rows) == n and count < 30
    found = graph.shortest_paths(edges, nodes.where("id in (3, 999)")).collect()
    assert {(r["src"], r["node"]): r["dist"] for r in found} == pytest.approx({k: v for k, v in want.items() if k[0] in (3, 999) and v < math.inf})
    assert sum(math.isinf(r["dist"]) for r in graph.paths_between(edges.limit(0), nodes).collect()) == 62 * 61


def test_sparse_products_with_a_hub():
    r = np.random.default_rng(10)
    row, column = np.concatenate([r.integers(0, 50, 200), np.full(90, 7)]), r.integers(0, 50, 290)
    value, x = r.random(290), r.random((50, 4))
    full, least = np.zeros((50, 50)), np.full((50, 50), np.inf)
    np.add.at(full, (row, column), value)
    np.minimum.at(least, (row, column), value)
    slots = graph.Slots(row, column, value, 50)
    assert np.allclose(slots.product(x), full @ x) and (slots.nearest(x) == np.minimum(x, (least[:, :, None] + x[None]).min(axis=1))).all()


def test_transport_between_a_hub_and_a_leaf():
    r = np.random.default_rng(11)
    points, give = r.random((60, 2)), np.full(60, 1 / 60)
    cost = np.linalg.norm(points[:, None] - points[None, :3], axis=2)
    take = np.array([0.5, 0.25, 0.25])
    assert graph.transport(cost, give, take) == pytest.approx(graph.transport(cost.T, take, give), abs=1e-9)


def test_heat_kernel_shuffles_no_dense_table(spark):
    r = np.random.default_rng(12)
    n, a = 300, {}
    for _ in range(1500):
        i, j = r.integers(0, n, 2)
        if i != j:
            a[int(i), int(j)] = a[int(j), int(i)] = float(r.random())
    entries = spark.createDataFrame([(i, j, v) for (i, j), v in a.items()], "i long, j long, v double")
    before = shuffled(spark)
    got = {(x["i"], x["j"]): x["d"] for x in soft.heat_kernel_distances(entries, spark.range(n), 1.0, 5).collect()}
    assert shuffled(spark) - before < 600_000  # the kernel has 90,000 entries and is made in five steps
    s = np.zeros((n, n))
    for (i, j), v in a.items():
        s[i, j] = v
    scale = 1 / np.sqrt(s.sum(axis=1) + 1e-8)
    lap = (np.diag(s.sum(axis=1)) - s) * scale[:, None] * scale[None]
    k = term = np.eye(n)
    for i in range(1, 6):
        term = -term @ lap / i
        k = k + term
    d = ((k[:, None] - k[None]) ** 2).sum(axis=2)
    assert len(got) == n * (n - 1) and max(abs(v - d[x]) for x, v in got.items()) < 1e-9


def test_a_long_vector_s_length_is_found_once(spark):
    x = np.random.default_rng(13).normal(size=20_000)
    rows = spark.createDataFrame([(0, x.tolist()), (1, None), (2, []), (3, [0.0, 0.0])], "vec_id long, v array<double>")
    began = time.time()
    got = {r["vec_id"]: r["u"] for r in rows.select("vec_id", vectors.l2_normalize(F.col("v")).alias("u")).collect()}
    assert time.time() - began < 8  # the square of 20,000 takes longer
    assert np.allclose(got[0], x / np.linalg.norm(x)) and got[1] is None and got[2] == [] and got[3] == [0.0, 0.0]


def test_hashed_words(spark):
    texts = ["The cat, the CAT; a2-b3", "", None, "Übung macht den Meister x", "Kelvin İstanbul naïve", "word " * 3000, "--- !!"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lower = {r["doc_id"]: r["t"] for r in rows.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    got = {r["vec_id"]: np.array(r["embedding"]) for r in encoders.encode_corpus(encoders.HashingEncoder(dim=32), rows).collect()}
    raw = {r["doc_id"]: r for r in encoders.HashingEncoder(dim=32, normalize=False).encode(rows).collect()}
    for i, text in enumerate(texts):
        want = np.zeros(32)
        for word in re.split("[^a-z0-9]+", lower[i]):
            if word:
                digest = hashlib.md5(word.encode()).hexdigest()
                want[int(digest[:8], 16) % 32] += 1 - 2 * (int(digest[8], 16) % 2)
        assert raw[i]["embedding"] == want.tolist() and raw[i]["text"] == text
        assert np.allclose(got[i], want / max(np.linalg.norm(want), 1e-12), rtol=1e-15)
