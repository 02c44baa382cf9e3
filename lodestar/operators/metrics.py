"""Retrieval and answer metrics as aggregations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.tables import cut

# The words that count as negations, the judge's keywords, and the length of an answer.
NEGATIONS = ("not", "no", "never", "nor", "none", "nobody", "nothing")
KEYWORDS = ("fact", "reason", "evidence", "citation")
ANSWER_LENGTH = 1000


def retrieval_metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """run (qid, doc_id, score), qrels (qid, doc_id, rel) -> one row: ndcg and recall at k, means over the queries that
    have a relevant document and a run. Gain is rel, the discount log2(rank + 1); ties go to the larger doc_id."""
    top = run.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("doc_id")))).where(F.col("rank") <= k)
    hits = top.join(qrels.where("rel > 0"), ["qid", "doc_id"]).groupBy("qid").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.count(F.lit(1)).alias("found"))
    ideal = qrels.where("rel > 0").withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")))
    best = ideal.groupBy("qid").agg(F.sum(F.when(F.col("r") <= k, F.col("rel") / F.log2(F.col("r") + 1))).alias("idcg"), F.count(F.lit(1)).alias("relevant"))
    each = best.join(run.select("qid").distinct(), "qid", "left_semi").join(hits, "qid", "left")
    return each.agg(F.avg(F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("idcg")).alias("ndcg"), F.avg(F.coalesce(F.col("found"), F.lit(0)) / F.col("relevant")).alias("recall"))


def _falls(q: np.ndarray, first: np.ndarray) -> int:
    """Pairs (x, y), x before y in the sequence, with first[x], not first[y], and q[x] > q[y]: counted in merges of
    halves, all of one size at once."""
    n, total, size = len(q), 0, 1
    place = np.arange(n)
    while size < n:
        part = place // (2 * size)
        order = np.lexsort((first, q, part))  # of equal q those that come second stand first, and so meet none
        left = (place[order] // size) % 2 == 0
        own = left & first[order]
        before = np.cumsum(own)
        edges = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]]))
        base = np.concatenate([[0], before])[edges]
        count = np.diff(np.concatenate([base, [before[-1]]]))
        which = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, n)))
        second = ~left & ~first[order]
        equal = own.astype(np.int64)
        total += int((count[which] - (before - base[which]))[second].sum())
        # Those of equal q behind a second one in the order were counted as greater; take them out.
        run = np.flatnonzero(np.concatenate([[True], (q[order][1:] != q[order][:-1]) | (part[order][1:] != part[order][:-1])]))
        group = np.repeat(np.arange(len(run)), np.diff(np.append(run, n)))
        ties = np.bincount(group, equal, len(run)) * np.bincount(group, second, len(run))
        total -= int(ties.sum())
        size *= 2
    return total


def _violations(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Pairs of one of a and one of b, both (recall, quality), whose recall rises and whose quality falls."""
    r, q = (np.concatenate(x) for x in zip(a, b))
    first = np.arange(len(r)) < len(a[0])
    order = np.lexsort((first, r))  # of equal recall those of b stand first
    return _falls(q[order], first[order])


def _within(r: np.ndarray, q: np.ndarray) -> int:
    """The same among rows in their order, by halves."""
    total, size, n = 0, 1, len(r)
    while size < n:
        for lo in range(0, n - size, 2 * size):
            mid, hi = lo + size, min(lo + 2 * size, n)
            total += _violations((r[lo:mid], q[lo:mid]), (r[mid:hi], q[mid:hi])) if size >= 32 else int(((r[lo:mid, None] < r[None, mid:hi]) & (q[lo:mid, None] > q[None, mid:hi])).sum())
        size *= 2
    return total


def non_monotonicity(rows: DataFrame, block: int = 16_384) -> DataFrame:
    """rows (pos, recall, quality) -> one row: the share of pairs in order where recall rises and quality falls. Rows are
    dealt into blocks by their order; blocks meet in pairs, each counted by merges, so no pair of rows is made. Of rows
    with one pos none is before the other; rows with a null are left out."""
    rows = rows.select(F.col("pos").cast("double").alias("pos"), F.col("recall").cast("double").alias("recall"), F.col("quality").cast("double").alias("quality")).dropna()
    n = rows.count()
    blocks = max(1, -(-n // block))
    dealt = rows.repartitionByRange(blocks, "pos") if blocks > 1 else rows.coalesce(1)
    dealt, _ = cut(dealt.select(F.spark_partition_id().alias("b"), "*"), "blocks")
    left = dealt.withColumn("c", F.explode(F.sequence(F.col("b"), F.lit(blocks - 1))))
    right = dealt.select(F.col("b").alias("c"), F.col("pos"), F.col("recall"), F.col("quality")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("c"))))

    def count(key, a, b):
        columns = []
        for t in (a, b):
            pos, r, q = (t.column(c).to_numpy() for c in ("pos", "recall", "quality"))
            order = np.argsort(pos, kind="stable")
            columns.append((pos[order], r[order], q[order]))
        if key[0].as_py() != key[1].as_py():
            found = _violations(columns[0][1:], columns[1][1:])
        else:
            pos, r, q = columns[0]
            found = _within(r, q)
            for run in np.split(np.arange(len(pos)), np.flatnonzero(np.diff(pos)) + 1):
                found -= _within(r[run], q[run]) if len(run) > 1 else 0
        return pa.table({"found": pa.array([found], pa.int64())})

    pairs = n * (n - 1) / 2
    same = rows.groupBy("pos").agg(F.count(F.lit(1)).alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2)).first()[0] or 0.0
    found = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(count, "found long")
    return found.agg((F.coalesce(F.sum("found"), F.lit(0)) / F.lit(max(1.0, pairs - float(same)))).alias("score"))


def meta_evaluation(scores: Column) -> Column:
    """Aggregate: the mean, 0 without rows."""
    return F.coalesce(F.avg(scores), F.lit(0.0))


def negations(text: Column) -> Column:
    """White-space separated words that are negations, whatever their case; punctuation keeps a word from being one."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: F.lower(w).isin(*NEGATIONS)))


def contradiction_resilience(total_negations: Column) -> Column:
    return 1.0 / (1.0 + total_negations)


def keyword_judge(answer: Column, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    """Share of keywords that are substrings of the answer in lower case."""
    low, hits = F.lower(F.coalesce(answer, F.lit(""))), F.lit(0)
    for w in keywords:
        hits = hits + F.contains(low, F.lit(w)).cast("int")
    return hits / F.lit(float(len(keywords)))


POLICIES = ("mean", "majority", "max", "min")


def _checked(name: str) -> str:
    if name.lower() not in POLICIES:
        raise ValueError(f"unknown policy {name!r}")
    return name.lower()


def policy(scores: Column, name: str = "mean") -> Column:
    """Aggregate: mean, majority (share above 0.5), max, min; 0 without rows."""
    found = {"mean": F.avg(scores), "majority": F.avg((scores > 0.5).cast("double")), "max": F.max(scores), "min": F.min(scores)}
    return F.coalesce(found[_checked(name)], F.lit(0.0))


def policy_of(scores: Column, name: str = "mean") -> Column:
    """The same over an array of scores."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(scores)
    votes = F.transform(scores, lambda v: F.when(v > 0.5, 1.0).otherwise(0.0))
    found = {"mean": total(scores), "majority": total(votes), "max": F.array_max(scores), "min": F.array_min(scores)}
    return F.when(F.size(scores) > 0, found[_checked(name)]).otherwise(F.lit(0.0))


def answer_of(docs: Column) -> Column:
    """The first 1,000 code points of the documents joined by a space."""
    return F.substring(F.array_join(docs, " "), 1, ANSWER_LENGTH)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def overlap(answer: Column, reference: Column) -> Column:
    """Distinct words that both have, over the reference's words."""
    return F.size(F.array_intersect(words(answer), words(reference))) / F.greatest(F.lit(1), F.size(words(reference)))


def common_length(x: list[str], y: list[str]) -> int:
    """Length of the longest common subsequence: a row of the usual table as bits of one number, for each word of x."""
    at: dict[str, int] = {}
    for j, v in enumerate(y):
        at[v] = at.get(v, 0) | 1 << j
    whole = (1 << len(y)) - 1
    row = whole
    for u in x:
        own = row & at.get(u, 0)
        row = (row + own | row - own) & whole
    return len(y) - row.bit_count()


def rouge_l(rows: DataFrame, stemming: bool = True) -> DataFrame:
    """rows (id, answer, reference) -> id, score: F measure of the longest common subsequence of lower-case words of
    a-z and 0-9, those of four letters or more reduced to their stems if asked."""
    import re

    from lodestar.functions.stemmer import stem

    def words(text: str | None) -> list[str]:
        found = re.findall("[a-z0-9]+", (text or "").lower())
        return [stem(w) if len(w) > 3 else w for w in found] if stemming else found

    def run(batches):
        for batch in batches:
            out = []
            for a, b in zip(batch.column("answer").to_pylist(), batch.column("reference").to_pylist()):
                x, y = words(a), words(b)
                n = common_length(x, y)
                out.append(2.0 * n / (len(x) + len(y)) if n else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.float64())], names=["id", "score"])

    return rows.select(F.col("id").cast("long").alias("id"), "answer", "reference").mapInArrow(run, "id long, score double")


def mean_average_precision(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """run (qid, doc_id, score), qrels (qid, doc_id, rel) -> one row: the mean over queries, as in retrieval_metrics, of
    the sum of precisions at each relevant document found, over all relevant ones."""
    ranked = run.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("doc_id"))))
    good = qrels.where("rel > 0")
    hits = ranked.join(good.select("qid", "doc_id"), ["qid", "doc_id"])
    precision = F.row_number().over(Window.partitionBy("qid").orderBy("rank")) / F.col("rank")
    each = hits.withColumn("precision", precision).groupBy("qid").agg(F.sum("precision").alias("total"))
    all_ = good.groupBy("qid").agg(F.count(F.lit(1)).alias("relevant")).join(run.select("qid").distinct(), "qid", "left_semi")
    return all_.join(each, "qid", "left").agg(F.avg(F.coalesce("total", F.lit(0.0)) / F.col("relevant")).alias("map"))


def evaluate_vectors(queries: DataFrame, documents: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """queries (qid, qvec), documents (vec_id, embedding), both of any length (they are normalised here), qrels (qid,
    doc_id, rel) -> one row: ndcg and recall at k, of the 5 k nearest by cosine."""
    from lodestar.functions.vectors import l2_normalize
    from lodestar.operators.knn import topk

    own = documents.select("vec_id", l2_normalize(F.col("embedding")).alias("embedding"))
    asked = queries.select("qid", l2_normalize(F.col("qvec")).alias("qvec"))
    run = topk(own, asked, 5 * k).select("qid", F.col("vec_id").alias("doc_id"), "score")
    return retrieval_metrics(cut(run, "run")[0], qrels, k)


def meta_judgments(judgments: DataFrame) -> DataFrame:
    """judgments (pos, name, score) -> one row: score, the mean over all, 0 without any, and details, the score by name,
    of one name the last."""
    last = judgments.groupBy("name").agg(F.max_by("score", "pos").alias("score")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "score")))).alias("details"))
    return judgments.agg(meta_evaluation(F.col("score")).alias("score")).join(last)


def sud(rows: DataFrame, judge=keyword_judge, name: str = "mean") -> DataFrame:
    """rows (id, gt_docs, new_docs) -> id, delta: the judge's score of the new documents less that of the old."""
    score = lambda docs: judge(answer_of(docs))
    return rows.select("id", (score(F.col("new_docs")) - score(F.col("gt_docs"))).alias("delta"))
