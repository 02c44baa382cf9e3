"""Queries over the test tables, and SQL that gives the same rows. Queries are the means of the ten labels' vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import encoders, judges, vectors
from lodestar.operators import graph, knn, metrics, soft
from lodestar.plans.retriever import GeoIndex
from lodestar.sources.tables import cut, index_report

FLAGSHIP = "geodesic_topk"
DIM = 64


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


def _queries(e: DataFrame) -> DataFrame:
    mean = e.groupBy(F.col("label").cast("long").alias("qid")).agg(vectors.mean_vector(F.col("embedding"), DIM).alias("m"))
    return cut(mean.select("qid", vectors.l2_normalize(F.col("m")).alias("qvec")), "queries")[0]


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def l2_normalize(spark, d):
    e = _embeddings(spark, d).select("vec_id", vectors.l2_normalize(F.transform("embedding", lambda x: 3 * x)).alias("v"))
    return _r(e.select("vec_id", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"), F.col("v")[0].alias("first")), "total", "first")


def cosine_topk(spark, d):
    e = _embeddings(spark, d)
    return _r(knn.topk(e, _queries(e), 10), "score")


def _edges(spark, d, metric="cosine", k=10):
    return cut(knn.knn_edges(_embeddings(spark, d), k, metric), "edges")[0]


def knn_edges_cosine(spark, d):
    return _r(_edges(spark, d), "weight")


def knn_edges_l2(spark, d):
    return _r(_edges(spark, d, "euclidean"), "weight")


def knn_edges_l2sq(spark, d):
    return _r(_edges(spark, d, "sqeuclidean"), "weight")


def forman_edges(spark, d):
    return _r(graph.curvature(_edges(spark, d), "forman"), "kappa")


def node_curvature(spark, d):
    return _r(graph.node_curvature(graph.curvature(_edges(spark, d), "forman"), _embeddings(spark, d).select(F.col("vec_id").alias("id"))), "kappa_avg")


def geo_audit(spark, d):
    return _r(graph.audit(graph.curvature(_edges(spark, d), "forman")), "min_kappa", "avg_kappa", "max_kappa")


def _search(spark, d, **options):
    e = _embeddings(spark, d)
    return GeoIndex(e, edges=_edges(spark, d)).search(_queries(e), **options)


def alpha_mix_topk(spark, d):
    return _r(_search(spark, d, metric="mix", alpha=0.3), "score")


def kappa_mix_topk(spark, d):
    return _r(_search(spark, d, metric="mix", mix_kappa=0.05), "score")


def pure_curvature_topk(spark, d):
    return _r(_search(spark, d, metric="curvature", alpha=1.0), "score")


def geodesic_topk(spark, d):
    return _r(_search(spark, d, k=20, metric="geodesic", search_k=100, connect_k=3), "dist")


def all_shortest_paths(spark, d):
    return _r(graph.paths_between(_edges(spark, d), _embeddings(spark, d).select(F.col("vec_id").alias("id"))), "dist")


def _candidates(spark, d):
    e = _embeddings(spark, d)
    return cut(knn.topk(e, _queries(e), 100), "candidates")[0]


def ppr_scores(spark, d):
    adj = graph.adjacency(_edges(spark, d)).select(F.col("node").alias("src"), F.col("nbr").alias("dst"), (1 - F.col("weight")).alias("w"))
    return _r(graph.pagerank_rerank(_candidates(spark, d), adj, 20), "score")


def _qrels(spark, d):
    return _embeddings(spark, d).select(F.col("label").cast("long").alias("qid"), F.col("vec_id").alias("doc_id"), F.lit(1).alias("rel"))


def eval_cosine(spark, d):
    run = _candidates(spark, d).where("rank <= 50").select("qid", F.col("vec_id").alias("doc_id"), "score")
    return _r(metrics.retrieval_metrics(run, _qrels(spark, d)), "ndcg", "recall")


def eval_ppr(spark, d):
    e = _embeddings(spark, d)
    adj = cut(soft.soft_knn(e).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("a").alias("w")), "adjacency")[0]
    run = graph.pagerank_rerank(_candidates(spark, d), adj, 50).select("qid", F.col("vec_id").alias("doc_id"), "score")
    return _r(metrics.retrieval_metrics(run, _qrels(spark, d)), "ndcg", "recall")


def soft_knn(spark, d):
    return _r(soft.soft_knn(_embeddings(spark, d)).select("i", "j", "a", "w"), "a", "w")


def soft_knn_diagnostics(spark, d):
    e = _embeddings(spark, d)
    gamma = soft.gamma_of(e, 8)
    return _r(soft.diagnostics(cut(soft.soft_knn(e, 8, gamma), "soft")[0], 8, gamma), "gamma", "entropy", "effective_degree", "actual_degree", "degree_error")


def graph_distribution(spark, d):
    return _r(soft.distribution_metrics(soft.soft_knn(_embeddings(spark, d))), "entropy", "effective_degree")


def _soft_matrix(spark, d):
    return cut(soft.soft_knn(_embeddings(spark, d)).select("i", "j", F.col("a").alias("v")), "soft")[0]


def heat_kernel(spark, d):
    return _r(soft.heat_kernel_distances(_soft_matrix(spark, d), _embeddings(spark, d).select(F.col("vec_id").alias("id")), 1.0, 5), "d")


def forman_soft_implemented(spark, d):
    return _r(soft.matrix_forman(_soft_matrix(spark, d)), "kappa")


def forman_soft_documented(spark, d):
    return _r(soft.matrix_forman(_soft_matrix(spark, d), "documented"), "kappa")


def _next_label(each: DataFrame, *values: str) -> DataFrame:
    """label and the values of the label after it, of one row for each label."""
    from pyspark.sql import Window

    labels = Window.orderBy("label")  # of the labels, not of their rows
    whole = labels.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return each.select("label", *[F.coalesce(F.lead(v).over(labels), F.first(v).over(whole)).alias(v) for v in values])


def _triplets(spark, d):
    """q: a vector; p: the next id's with its label; n: the first of the next label, the least label following the largest."""
    from pyspark.sql import Window

    e = _embeddings(spark, d)
    later = Window.orderBy(F.desc("vec_id")).partitionBy("label").rowsBetween(Window.unboundedPreceding, -1)
    p = e.withColumn("pid", F.last("vec_id").over(later))
    n = _next_label(e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("nv")), "nv")
    v = e.select(F.col("vec_id").alias("x"), F.col("embedding").alias("xv"))
    rows = p.join(n, "label").join(v.withColumnsRenamed({"x": "pid", "xv": "pv"}), "pid")
    far = lambda a, b: F.sqrt(vectors.squared_l2(F.col(a), F.col(b)))
    return rows.select("vec_id", far("embedding", "pv").alias("d_pos"), far("embedding", "nv").alias("d_neg"))


def info_nce(spark, d):
    return _r(soft.info_nce(_triplets(spark, d).withColumn("d_neg", F.array("d_neg")), 0.07), "loss")


def triplet_margin(spark, d):
    return _r(_triplets(spark, d).agg(soft.triplet_margin(F.col("d_pos"), F.col("d_neg")).alias("loss")), "loss")


def ricci_hinge(spark, d):
    return _r(graph.curvature(_edges(spark, d), "forman").agg(soft.hinge(F.col("kappa"), 0.0).alias("loss")), "loss")


def geo_loss_forward(spark, d):
    """A batch of a row for each label: q its vectors' mean, p their largest coordinates, n both of the next label."""
    from pyspark.sql import Window

    largest = F.array(*[F.max(F.col("embedding")[i]) for i in range(DIM)])
    each = _embeddings(spark, d).groupBy("label").agg(vectors.mean_vector(F.col("embedding"), DIM).alias("q"), largest.alias("p"))
    each = each.select("label", vectors.l2_normalize(F.col("q")).alias("q"), vectors.l2_normalize(F.col("p")).alias("p"))
    batch = each.join(_next_label(each, "q", "p").select("label", F.array("q", "p").alias("n")), "label")
    batch = cut(batch.select((F.row_number().over(Window.orderBy("label")) - 1).cast("long").alias("id"), "q", "p", "n"), "batch")[0]
    return _r(soft.geometric_loss(batch, 4), "info_nce", "ricci", "total")


def nms(spark, d):
    rows = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("pos"), F.col("toxic").cast("double").alias("recall"), F.col("quality").cast("double").alias("quality"))
    return _r(metrics.non_monotonicity(rows), "score")


def _documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def core_negation(spark, d):
    total = _documents(spark, d).groupBy("source").agg(F.sum(metrics.negations(F.col("text"))).cast("long").alias("n_negations"))
    return _r(total.withColumn("score", metrics.contradiction_resilience(F.col("n_negations"))), "score")


_JUDGED = ("the", "and", "der", "que")


def keyword_judge(spark, d):
    return _documents(spark, d).select("doc_id", metrics.keyword_judge(F.col("text"), _JUDGED).alias("score"))


def judge_policies(spark, d):
    scored = _documents(spark, d).select("source", metrics.keyword_judge(F.col("text"), _JUDGED).alias("score"))
    return _r(scored.groupBy("source").agg(*[metrics.policy(F.col("score"), p).alias(p) for p in ("mean", "majority", "max", "min")]), "mean", "majority")


def meta_eval(spark, d):
    return _r(_documents(spark, d).agg(metrics.meta_evaluation(metrics.keyword_judge(F.col("text"), _JUDGED)).alias("score"), F.count(F.lit(1)).alias("n")), "score")


def sud_delta(spark, d):
    """Every document against the next id's."""
    docs = _documents(spark, d).select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("new"))
    rows = docs.join(after, "doc_id", "left").select(F.col("doc_id").alias("id"), F.array("text").alias("gt_docs"), F.array("new").alias("new_docs"))
    return metrics.sud(rows, lambda a: metrics.keyword_judge(a, _JUDGED)).select(F.col("id").alias("doc_id"), "delta")


def _referenced(spark, d):
    """Every document, with a benchmark text as its reference: that of the id's remainder."""
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    items = b.count()
    docs = _documents(spark, d).select(F.col("doc_id").alias("id"), F.lit("").alias("query"), F.array("text").alias("docs"), F.pmod("doc_id", F.lit(items)).alias("item_id"))
    return docs.join(b.withColumnRenamed("text", "reference"), "item_id", "left").drop("item_id")


def rare_overlap(spark, d):
    rows = _referenced(spark, d)
    return _r(rows.select(F.col("id").alias("doc_id"), metrics.overlap(metrics.answer_of(F.col("docs")), F.col("reference")).alias("score")), "score")


def rare_rouge_l(spark, d):
    return _r(judges.rare(_referenced(spark, d)).select(F.col("id").alias("doc_id"), "score"), "score")


def rare_judged(spark, d):
    """No references, so the judges' share of votes over one half."""
    rows = _referenced(spark, d).withColumn("reference", F.lit(None).cast("string"))
    return judges.rare(rows, [judges.KeywordJudge(_JUDGED), judges.KeywordJudge(("und", "les"))], "majority").select(F.col("id").alias("doc_id"), "score")


def judge_ensemble(spark, d):
    rows = _documents(spark, d).select(F.col("doc_id").alias("id"), F.lit("").alias("query"), F.array("text").alias("docs"))
    scored = judges.judge_ensemble(rows, [judges.KeywordJudge(_JUDGED), judges.KeywordJudge(("und", "les"))])
    return _r(scored.select(F.col("id").alias("doc_id"), "score", F.size("details").alias("n_details")), "score")


def _encoded(spark, d):
    return cut(encoders.encode_corpus(encoders.HashingEncoder(), _documents(spark, d)), "encoded")[0]


def encode_hashing(spark, d):
    places = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    filled = F.size(F.filter("embedding", lambda x: x != 0))
    return _r(_encoded(spark, d).select(F.col("vec_id").alias("doc_id"), filled.alias("n_filled"), places.alias("total")), "total")


def text_search(spark, d):
    """Benchmark texts against all documents; copies have one score, so ids are left out."""
    asked = encoders.HashingEncoder().encode(spark.read.parquet(f"{d}/benchmark.parquet")).select(F.col("item_id").cast("long").alias("qid"), F.col("embedding").alias("qvec"))
    return _r(knn.topk(_encoded(spark, d), cut(asked, "asked")[0], 10).select("qid", "rank", "score"), "score")


def eval_vectors(spark, d):
    e = _embeddings(spark, d)
    return _r(metrics.evaluate_vectors(_queries(e), e.select("vec_id", F.transform("embedding", lambda x: 3 * x).alias("embedding")), _qrels(spark, d)), "ndcg", "recall")


def eval_map(spark, d):
    run = _candidates(spark, d).where("rank <= 50").select("qid", F.col("vec_id").alias("doc_id"), "score")
    return _r(metrics.mean_average_precision(run, _qrels(spark, d)), "map")


def meta_details(spark, d):
    """A judgment of each document, named by its source."""
    rows = _documents(spark, d).select(F.col("doc_id").alias("pos"), F.col("source").alias("name"), metrics.keyword_judge(F.col("text"), _JUDGED).alias("score"))
    return metrics.meta_judgments(rows).select(F.explode("details").alias("source", "last"), F.round("score", 6).alias("score"))


def ollivier_edges(spark, d):
    return _r(graph.curvature(_edges(spark, d, k=3), "ollivier"), "kappa")


def report(spark, d):
    return index_report(_embeddings(spark, d), _documents(spark, d))


_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_Q = f"{_E}, m AS (SELECT label::BIGINT AS qid, [" + ", ".join(f"avg(v[{i}])" for i in range(1, DIM + 1)) + "] AS m FROM e GROUP BY label), q AS (SELECT qid, list_transform(m, lambda x: x / greatest(sqrt(list_dot_product(m, m)), 1e-12)) AS qv FROM m)"
_TOP = f"{_Q}, s AS (SELECT qid, vec_id, list_dot_product(v, qv) AS score FROM e, q), c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::INT AS rank FROM s)"


def _edge_sql(dist: str) -> str:
    return f"p AS (SELECT a.vec_id AS i, b.vec_id AS j, {dist} AS d FROM e a, e b WHERE a.vec_id <> b.vec_id), n AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM p), edges AS (SELECT least(i, j) AS src, greatest(i, j) AS dst, min(greatest(0, d)) AS weight FROM n WHERE r <= 10 GROUP BY 1, 2)"


_COS = _edge_sql("1 - list_dot_product(a.v, b.v)")
_L2SQ = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_KAPPA = "adj AS (SELECT src AS node, dst AS nbr, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges), st AS (SELECT node, sum(weight) AS s, sum(1 / sqrt(weight)) AS r FROM adj GROUP BY node), k AS (SELECT e.src, e.dst, weight * (1 / u.s + 1 / w.s) - sqrt(weight) * (u.r + w.r) + 2 AS kappa FROM edges e JOIN st u ON e.src = u.node JOIN st w ON e.dst = w.node)"
_NODE = f"{_KAPPA}, nk AS (SELECT e.vec_id AS id, coalesce(avg(kappa), 0) AS kappa_avg FROM e LEFT JOIN (SELECT src AS id, kappa FROM k UNION ALL SELECT dst, kappa FROM k) x ON e.vec_id = x.id GROUP BY e.vec_id)"


def _mix_sql(score: str) -> str:
    return f"WITH {_TOP}, {_COS}, {_NODE}, x AS (SELECT qid, vec_id, {score} AS score FROM s JOIN nk ON s.vec_id = nk.id), y AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM x) SELECT qid, rank, vec_id, round(score, 6) AS score FROM y WHERE rank <= 10"


def _metric_sql(run: str) -> str:
    return f"{run}, rel AS (SELECT label::BIGINT AS qid, vec_id FROM e), hit AS (SELECT r.qid, sum(1 / log2(r.rank + 1)) AS dcg, count(*) AS found FROM run r JOIN rel USING (qid, vec_id) WHERE r.rank <= 10 GROUP BY 1), ideal AS (SELECT qid, count(*) AS relevant, list_sum(list_transform(range(1, least(10, count(*)) + 1), lambda x: 1 / log2(x + 1))) AS idcg FROM rel GROUP BY 1) SELECT round(avg(coalesce(dcg, 0) / idcg), 6) AS ndcg, round(avg(coalesce(found, 0) / relevant), 6) AS recall FROM ideal LEFT JOIN hit USING (qid)"


def _soft_sql(where: str, k: int, gamma: str | None) -> str:
    g = gamma or f"(SELECT quantile_cont(d2, 0.2) / ln({k}) FROM pr WHERE d2 > 0)"
    return f"pr AS (SELECT a.vec_id AS i, b.vec_id AS j, {_L2SQ} AS d2 FROM e a, e b WHERE a.vec_id <> b.vec_id {where}), z AS (SELECT *, -d2 / {g} AS z FROM pr), ex AS (SELECT *, exp(z - max(z) OVER (PARTITION BY i)) AS ex FROM z), sp AS (SELECT i, j, d2, ex / sum(ex) OVER (PARTITION BY i) AS p FROM ex), tp AS (SELECT *, rank() OVER (PARTITION BY i ORDER BY p DESC) AS r FROM sp), hf AS (SELECT i, j, d2, p * {k} / 2 AS a FROM tp WHERE r <= {k} UNION ALL SELECT j, i, d2, p * {k} / 2 FROM tp WHERE r <= {k}), mn AS (SELECT i, j, first(d2) AS d2, sum(a) AS a FROM hf GROUP BY i, j), soft AS (SELECT i, j, d2, a * {k} / (sum(a) OVER (PARTITION BY i) + 1e-8) AS a FROM mn)"


_SOFT = _soft_sql("", 8, None)


def _sym_sql(value: str) -> str:
    return f", sy AS (SELECT i, j, sum(v) / 2 AS v FROM (SELECT i, j, {value} AS v FROM soft UNION ALL SELECT j, i, {value} FROM soft) GROUP BY i, j), dg AS (SELECT i, sum(v) AS d FROM sy GROUP BY i)"


def _heat_sql(sym: str, steps: int = 5) -> str:
    terms = "".join(f", t{n} AS MATERIALIZED (SELECT t.i, l.j, -sum(t.v * l.v) / {n} AS v FROM t{n - 1} t JOIN lap l ON t.j = l.i GROUP BY t.i, l.j)" for n in range(1, steps + 1))
    return f"{sym}, lap AS MATERIALIZED (SELECT l.i, l.j, sum(l.v) / sqrt(any_value(a.d) + 1e-8) / sqrt(any_value(b.d) + 1e-8) AS v FROM (SELECT i, j, -v AS v FROM sy UNION ALL SELECT i, i, d FROM dg) l JOIN dg a ON l.i = a.i JOIN dg b ON l.j = b.i GROUP BY l.i, l.j), t0 AS (SELECT i, i AS j, 1.0::DOUBLE AS v FROM dg){terms}, kr AS (SELECT i, j, sum(v) AS v FROM (" + " UNION ALL ".join(f"SELECT * FROM t{n}" for n in range(steps + 1)) + ") GROUP BY i, j), full_k AS (SELECT a.i, b.i AS j, coalesce(kr.v, 0) AS v FROM dg a CROSS JOIN dg b LEFT JOIN kr ON kr.i = a.i AND kr.j = b.i)"


def _walk_sql(adjacency: str, rounds: int = 20) -> str:
    """p{rounds}: PageRank among the 100 candidates of each query, from CTEs c and ``adjacency`` (src, dst, w)."""
    steps = "".join(f", p{n} AS MATERIALIZED (SELECT b.qid, b.node, 0.8 * b.p + 0.2 * coalesce(f.flow, 0) AS p FROM p0 b LEFT JOIN (SELECT p.qid, w.dst AS node, sum(p.p * w.w) AS flow FROM p{n - 1} p JOIN walk w ON w.qid = p.qid AND w.src = p.node GROUP BY 1, 2) f ON f.qid = b.qid AND f.node = b.node)" for n in range(1, rounds + 1))
    return f"cand AS MATERIALIZED (SELECT qid, vec_id, score FROM c WHERE rank <= 100), ins AS (SELECT a.qid, x.src, x.dst, x.w FROM {adjacency} x JOIN cand a ON x.src = a.vec_id JOIN cand b ON x.dst = b.vec_id AND a.qid = b.qid), walk AS MATERIALIZED (SELECT qid, src, dst, w / (sum(w) OVER (PARTITION BY qid, src) + 1e-12) AS w FROM ins), p0 AS MATERIALIZED (SELECT qid, vec_id AS node, greatest(score, 1e-6) / sum(greatest(score, 1e-6)) OVER (PARTITION BY qid) AS p FROM cand){steps}"


_SYM = _SOFT + _sym_sql("a")
_HEAT = _heat_sql(_SYM)
_UNIT = "list_transform({0}, lambda x: x / greatest(sqrt(list_dot_product({0}, {0})), 1e-12))"
_BATCH = f"e0 AS (SELECT label, embedding::DOUBLE[] AS v FROM embeddings), mm AS (SELECT label, [" + ", ".join(f"avg(v[{i}])" for i in range(1, DIM + 1)) + "] AS q, [" + ", ".join(f"max(v[{i}])" for i in range(1, DIM + 1)) + f"] AS p FROM e0 GROUP BY label), nm AS (SELECT row_number() OVER (ORDER BY label) - 1 AS id, {_UNIT.format('q')} AS q, {_UNIT.format('p')} AS p FROM mm), nx AS (SELECT id, q, p, coalesce(lead(q) OVER (ORDER BY id), first(q) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nq, coalesce(lead(p) OVER (ORDER BY id), first(p) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS np FROM nm), sz AS (SELECT count(*) AS b FROM nm), e AS MATERIALIZED (SELECT id AS vec_id, q AS v FROM nx UNION ALL SELECT id + b, p FROM nx, sz UNION ALL SELECT 2 * b + 2 * id, nq FROM nx, sz UNION ALL SELECT 2 * b + 2 * id + 1, np FROM nx, sz)"
_GEO = f"WITH {_BATCH}, {_soft_sql('', 4, None)}{_heat_sql(_sym_sql('a * d2'))}, dd AS MATERIALIZED (SELECT a.i, b.i AS j, sum((a.v - b.v) * (a.v - b.v)) AS d FROM full_k a JOIN full_k b ON a.j = b.j AND a.i <> b.i GROUP BY 1, 2), terms AS (SELECT i, (j = i + b) AS pos, -d / 0.07 AS z FROM dd, sz WHERE i < b AND (j = i + b OR (j >= 2 * b + 2 * i AND j < 2 * b + 2 * i + 2))), nce AS (SELECT avg(l) AS info_nce FROM (SELECT i, max(z) + ln(sum(exp(z - m))) - max(CASE WHEN pos THEN z END) AS l FROM (SELECT *, max(z) OVER (PARTITION BY i) AS m FROM terms) GROUP BY i)), nz AS (SELECT * FROM sy WHERE v <> 0), kp AS (SELECT s.i, s.j, any_value(s.v * (1 / (a.d + 1e-9) + 1 / (b.d + 1e-9))) - sum(s.v * x.v / sqrt(s.v * s.v * x.v + 1e-9)) AS kappa FROM nz s JOIN dg a ON s.i = a.i JOIN dg b ON s.j = b.i JOIN nz x ON x.i = s.i GROUP BY 1, 2), rc AS (SELECT sum(pow(greatest(0 - kappa, 0), 2)) / (SELECT 16 * b * b FROM sz) AS ricci FROM kp) SELECT round(info_nce, 6) AS info_nce, round(ricci, 6) AS ricci, round(info_nce + 0.1 * ricci, 6) AS total FROM nce, rc"
_TRIP = f"WITH {_E}, fl AS (SELECT label, min_by(v, vec_id) AS v FROM e GROUP BY label), nl AS (SELECT label, coalesce(lead(v) OVER (ORDER BY label), first(v) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS v FROM fl), tp AS (SELECT vec_id, label, v, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS pv FROM e), t AS (SELECT list_distance(tp.v, pv) AS dp, list_distance(tp.v, nl.v) AS dn FROM tp JOIN nl USING (label) WHERE pv IS NOT NULL)"
_WORD = "list_filter(regexp_split_to_array(coalesce({}, ''), '\\s+'), lambda w: w <> '')"
_JUDGE = "(" + " + ".join(f"contains(lower({{0}}), '{w}')::INT" for w in _JUDGED) + ") / 4.0::DOUBLE"
_J = _JUDGE.format("coalesce(text, '')")
_ANSWER = "substr(coalesce(text, ''), 1, 1000)"
_OTHER = f"((contains(lower({_ANSWER}), 'und')::INT + contains(lower({_ANSWER}), 'les')::INT) / 2.0::DOUBLE)"
_HASHED = "w0 AS (SELECT {1} AS id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')) AS w FROM {0}), h AS (SELECT id, CASE WHEN w = '' THEN 0 ELSE ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 END AS b, sum(CASE WHEN w = '' THEN 0 ELSE 1 - 2 * (('0x' || substr(md5(w), 9, 1))::INT % 2) END)::DOUBLE AS v FROM w0 GROUP BY 1, 2)"

SQL = {
    "l2_normalize": f"WITH {_E}, x AS (SELECT vec_id, list_transform(v, lambda y: 3 * y) AS v FROM e), n AS (SELECT vec_id, list_transform(v, lambda y: y / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM x) SELECT vec_id, round(list_sum(v), 6) AS total, round(v[1], 6) AS first FROM n",
    "cosine_topk": f"WITH {_TOP} SELECT qid, rank, vec_id, round(score, 6) AS score FROM c WHERE rank <= 10",
    "knn_edges_cosine": f"WITH {_E}, {_COS} SELECT src, dst, round(weight, 6) AS weight FROM edges",
    "knn_edges_l2": f"WITH {_E}, {_edge_sql('list_distance(a.v, b.v)')} SELECT src, dst, round(weight, 6) AS weight FROM edges",
    "knn_edges_l2sq": f"WITH {_E}, {_edge_sql(_L2SQ)} SELECT src, dst, round(weight, 6) AS weight FROM edges",
    "forman_edges": f"WITH {_E}, {_COS}, {_KAPPA} SELECT src, dst, round(kappa, 6) AS kappa FROM k",
    "node_curvature": f"WITH {_E}, {_COS}, {_NODE} SELECT id, round(kappa_avg, 6) AS kappa_avg FROM nk",
    "geo_audit": f"WITH {_E}, {_COS}, {_KAPPA} SELECT count(*) AS n_edges, round(min(kappa), 6) AS min_kappa, round(avg(kappa), 6) AS avg_kappa, round(max(kappa), 6) AS max_kappa FROM k",
    "alpha_mix_topk": _mix_sql("0.7 * score + 0.3 * kappa_avg"),
    "kappa_mix_topk": _mix_sql("score + 0.05 * kappa_avg"),
    "pure_curvature_topk": _mix_sql("0.0 * score + 1.0 * kappa_avg"),
    "ricci_hinge": f"WITH {_E}, {_COS}, {_KAPPA} SELECT round(avg(pow(greatest(0 - kappa, 0), 2)), 6) AS loss FROM k",
    "eval_cosine": "WITH " + _metric_sql(f"{_TOP}, run AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id DESC) AS rank FROM c WHERE rank <= 50)"),
    "soft_knn": f"WITH {_E}, {_SOFT} SELECT i, j, round(a, 6) AS a, round(a * d2, 6) AS w FROM soft",
    "soft_knn_diagnostics": f"WITH {_E}, {_SOFT}, p2 AS (SELECT i, a / (sum(a) OVER (PARTITION BY i) + 1e-12) AS p FROM soft), rw AS (SELECT i, sum(-p * ln(p + 1e-12)) AS h, sum(p * p) AS s FROM p2 GROUP BY i), x AS (SELECT (SELECT quantile_cont(d2, 0.2) / ln(8) FROM pr WHERE d2 > 0) AS gamma, avg(h) AS entropy, 1 / avg(s) AS effective_degree, (SELECT avg(d) FROM (SELECT sum(a) AS d FROM soft GROUP BY i)) AS actual_degree FROM rw) SELECT round(gamma, 6) AS gamma, round(entropy, 6) AS entropy, round(effective_degree, 6) AS effective_degree, round(actual_degree, 6) AS actual_degree, round(abs(actual_degree - 8), 6) AS degree_error, CASE WHEN entropy > 1 AND abs(effective_degree - 8) < 2.4 THEN 'optimal' ELSE 'suboptimal' END AS status FROM x",
    "graph_distribution": f"WITH {_E}, {_SOFT}, p2 AS (SELECT i, a / (sum(a) OVER (PARTITION BY i) + 1e-12) AS p FROM soft), rw AS (SELECT i, sum(-p * ln(p + 1e-12)) AS h, sum(p * p) AS s FROM p2 GROUP BY i) SELECT round(avg(h), 6) AS entropy, round(1 / avg(s), 6) AS effective_degree FROM rw",
    "heat_kernel": f"WITH {_E}, {_HEAT} SELECT a.i, b.i AS j, round(sum((a.v - b.v) * (a.v - b.v)), 6) AS d FROM full_k a JOIN full_k b ON a.j = b.j AND a.i <> b.i GROUP BY 1, 2",
    "forman_soft_implemented": f"WITH {_E}, {_SYM} SELECT s.i, s.j, round(any_value(s.v * (1 / (a.d + 1e-9) + 1 / (b.d + 1e-9))) - sum(s.v * x.v / sqrt(s.v * s.v * x.v + 1e-9)), 6) AS kappa FROM sy s JOIN dg a ON s.i = a.i JOIN dg b ON s.j = b.i JOIN sy x ON x.i = s.i GROUP BY 1, 2",
    "forman_soft_documented": f"WITH {_E}, {_SYM}, tr AS (SELECT s.i, s.j, sum(x.v * y.v / sqrt(s.v * x.v * y.v + 1e-9)) AS t FROM sy s JOIN sy x ON x.i = s.i JOIN sy y ON y.i = s.j AND y.j = x.j GROUP BY 1, 2) SELECT s.i, s.j, round(s.v * (1 / (a.d + 1e-9) + 1 / (b.d + 1e-9)) - coalesce(t, 0), 6) AS kappa FROM sy s JOIN dg a ON s.i = a.i JOIN dg b ON s.j = b.i LEFT JOIN tr ON tr.i = s.i AND tr.j = s.j",
    "info_nce": f"{_TRIP} SELECT round(avg(dp / 0.07 + ln(exp(-dp / 0.07) + exp(-dn / 0.07))), 6) AS loss FROM t",
    "triplet_margin": f"{_TRIP} SELECT round(avg(greatest(0, dp - dn + 1)), 6) AS loss FROM t",
    "geodesic_topk": f"WITH RECURSIVE {_TOP}, {_COS}, adj AS (SELECT src AS node, dst AS nbr, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges), cand AS (SELECT qid, vec_id, rank, score FROM c WHERE rank <= 100), inner_adj AS (SELECT a.qid, adj.node, adj.nbr, adj.weight FROM adj JOIN cand a ON adj.node = a.vec_id JOIN cand b ON adj.nbr = b.vec_id AND a.qid = b.qid), walk(qid, node, dist) USING KEY (qid, node) AS (SELECT qid, vec_id, greatest(0, 1 - score)::DOUBLE FROM cand WHERE rank <= 3 UNION SELECT x.qid, x.node, x.dist FROM (SELECT w.qid, a.nbr AS node, min(w.dist + a.weight) AS dist FROM walk w JOIN inner_adj a ON w.qid = a.qid AND w.node = a.node GROUP BY 1, 2) x LEFT JOIN recurring.walk r ON r.qid = x.qid AND r.node = x.node WHERE r.dist IS NULL OR x.dist < r.dist), o AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, node)::INT AS rank, node AS vec_id, dist FROM walk) SELECT qid, rank, vec_id, round(dist, 6) AS dist FROM o WHERE rank <= 20",
    "all_shortest_paths": f"WITH RECURSIVE {_E}, {_COS}, adj AS (SELECT src AS node, dst AS nbr, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges), walk(src, node, dist) USING KEY (src, node) AS (SELECT vec_id, vec_id, 0::DOUBLE FROM e UNION SELECT x.src, x.node, x.dist FROM (SELECT w.src, a.nbr AS node, min(w.dist + a.weight) AS dist FROM walk w JOIN adj a ON w.node = a.node GROUP BY 1, 2) x LEFT JOIN recurring.walk r ON r.src = x.src AND r.node = x.node WHERE r.dist IS NULL OR x.dist < r.dist) SELECT a.vec_id AS src, b.vec_id AS dst, round(coalesce(dist, 'Infinity'::DOUBLE), 6) AS dist FROM e a CROSS JOIN e b LEFT JOIN walk w ON w.src = a.vec_id AND w.node = b.vec_id",
    "nms": "SELECT round(coalesce(avg((a.toxic < b.toxic AND a.quality > b.quality)::INT::DOUBLE), 0), 6) AS score FROM labels a JOIN labels b ON a.doc_id < b.doc_id",
    "core_negation": f"WITH x AS (SELECT source, sum(len(list_filter({_WORD.format('text')}, lambda w: lower(w) IN ('not', 'no', 'never', 'nor', 'none', 'nobody', 'nothing'))))::BIGINT AS n_negations FROM documents GROUP BY source) SELECT source, n_negations, round(1.0::DOUBLE / (1 + n_negations), 6) AS score FROM x",
    "keyword_judge": f"SELECT doc_id, {_J} AS score FROM documents",
    "judge_policies": f"SELECT source, round(avg({_J}), 6) AS mean, round(avg(({_J} > 0.5)::INT), 6) AS majority, max({_J}) AS max, min({_J}) AS min FROM documents GROUP BY source",
    "meta_eval": f"SELECT round(avg({_J}), 6) AS score, count(*) AS n FROM documents",
    "sud_delta": f"WITH g AS (SELECT d.doc_id, substr(coalesce(d.text, ''), 1, 1000) AS gt, substr(coalesce(n.text, ''), 1, 1000) AS nw FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1) SELECT doc_id, {_JUDGE.format('nw')} - {_JUDGE.format('gt')} AS delta FROM g",
    "ppr_scores": f"WITH {_TOP}, {_COS}, adj AS (SELECT src, dst, 1 - weight AS w FROM edges UNION ALL SELECT dst, src, 1 - weight FROM edges), {_walk_sql('adj')} SELECT qid, rank, vec_id, round(p, 6) AS score FROM (SELECT qid, node AS vec_id, p, row_number() OVER (PARTITION BY qid ORDER BY p DESC, node)::INT AS rank FROM p20) WHERE rank <= 20",
    "eval_ppr": "WITH " + _metric_sql(f"{_TOP}, {_SOFT}, adj AS MATERIALIZED (SELECT i AS src, j AS dst, a AS w FROM soft), {_walk_sql('adj')}, run AS (SELECT qid, node AS vec_id, row_number() OVER (PARTITION BY qid ORDER BY p DESC, node DESC) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY p DESC, node) AS r FROM p20) WHERE r <= 50)"),
    "geo_loss_forward": _GEO,
    "eval_vectors": "WITH " + _metric_sql(f"{_TOP}, run AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id DESC) AS rank FROM c WHERE rank <= 50)"),
    "eval_map": f"WITH {_TOP}, run AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id DESC) AS rank FROM c WHERE rank <= 50), rel AS (SELECT label::BIGINT AS qid, vec_id FROM e), hit AS (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS k FROM run JOIN rel USING (qid, vec_id)), ap AS (SELECT qid, sum(k / rank) AS total FROM hit GROUP BY qid), n AS (SELECT qid, count(*) AS relevant FROM rel GROUP BY qid) SELECT round(avg(coalesce(total, 0) / relevant), 6) AS map FROM n LEFT JOIN ap USING (qid)",
    "judge_ensemble": f"SELECT doc_id, round(({_JUDGE.format(_ANSWER)} + {_OTHER}) / 2, 6) AS score, 1::INT AS n_details FROM documents",
    "rare_judged": f"SELECT doc_id, (({_JUDGE.format(_ANSWER)} > 0.5)::INT + ({_OTHER} > 0.5)::INT) / 2.0::DOUBLE AS score FROM documents",
    "meta_details": f"WITH j AS (SELECT doc_id, source, {_J} AS score FROM documents) SELECT source, arg_max(score, doc_id) AS last, (SELECT round(avg(score), 6) FROM j) AS score FROM j GROUP BY source",
    "encode_hashing": f"WITH {_HASHED.format('documents', 'doc_id')} SELECT id AS doc_id, count(*) FILTER (v <> 0)::INT AS n_filled, round(coalesce(sum(v * (b + 1)) / greatest(sqrt(sum(v * v)), 1e-12), 0), 6) AS total FROM h GROUP BY id",
    "text_search": f"WITH {_HASHED.format('documents', 'doc_id')}, {_HASHED.format('benchmark', 'item_id').replace('w0', 'w1').replace('h AS', 'hq AS')}, n AS (SELECT id, sqrt(sum(v * v)) AS n FROM h GROUP BY id), nq AS (SELECT id, sqrt(sum(v * v)) AS n FROM hq GROUP BY id), dots AS (SELECT hq.id AS qid, h.id, sum(h.v * hq.v) AS s FROM h JOIN hq ON h.b = hq.b GROUP BY 1, 2), sc AS (SELECT nq.id AS qid, n.id, coalesce(s, 0) / greatest(n.n, 1e-12) / greatest(nq.n, 1e-12) AS score FROM n CROSS JOIN nq LEFT JOIN dots ON dots.qid = nq.id AND dots.id = n.id) SELECT qid::BIGINT AS qid, rank, round(score, 6) AS score FROM (SELECT qid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC)::INT AS rank FROM sc) WHERE rank <= 10",
    "rare_overlap": f"SELECT doc_id, round(len(list_intersect({_WORD.format('substr(d.text, 1, 1000)')}, {_WORD.format('b.text')})) / greatest(1, len({_WORD.format('b.text')}))::DOUBLE, 6) AS score FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)",
    "report": "SELECT (SELECT count(*) FROM embeddings) AS n_vectors, (SELECT max(len(embedding))::INT FROM embeddings) AS dim, (SELECT count(*) FROM documents) AS n_documents",
}

QUERIES = {f.__name__: f for f in (l2_normalize, cosine_topk, knn_edges_cosine, knn_edges_l2, knn_edges_l2sq, forman_edges, node_curvature, geo_audit, alpha_mix_topk, kappa_mix_topk, pure_curvature_topk, geodesic_topk, all_shortest_paths, ppr_scores, eval_cosine, eval_ppr, soft_knn, soft_knn_diagnostics, graph_distribution, heat_kernel, forman_soft_implemented, forman_soft_documented, info_nce, triplet_margin, ricci_hinge, geo_loss_forward, nms, core_negation, keyword_judge, judge_policies, judge_ensemble, meta_eval, meta_details, sud_delta, rare_overlap, rare_rouge_l, rare_judged, encode_hashing, text_search, eval_vectors, eval_map, ollivier_edges, report)}
