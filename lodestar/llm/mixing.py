"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash of its doc_id and text, and a second one of all its columns. A source whose target is q times
its size and some rest takes all documents q times, and those below a hash threshold once more. The threshold is found
on histograms: tokens are summed by source and hash bucket, the bucket in which the running sum passes the rest is the
boundary, and only its documents are summed again by the next bits, until a boundary bucket holds one document or rows
that are equal throughout; of those, so many are taken as bring the sum nearest. No document is sorted, and a hot source
is combined before the shuffle like any other. Thresholds are nested: a larger budget keeps what a smaller one took.
What the driver holds is one row for each source.

Defined results: a null text has size 0; a null source is a source of its own and comes last; null doc_ids hash like
the empty string; rows that share their doc_id, or have none, are told apart by their other columns, and equal rows by
count alone; an empty table gives an empty one; other columns are kept by ``mixed`` and left out of the digest (columns
that hold maps take no part in the hash).
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodestar.llm.common import stage, text_bytes, tidy

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
HASH_BITS, LEVEL_BITS = 60, 12
LEVELS = HASH_BITS // LEVEL_BITS
#: Equal rows that one row is made into at once.
AT_ONCE = 10_000


@dataclass
class Share:
    """One source: ``times`` whole passes, and one more for the documents with a hash below ``cut``; of those at ``tie``,
    for the ones with a second hash below ``cut2``; of those at ``tie2``, which are all equal, for ``count``."""

    source: str | None
    size: int
    target: float
    times: int
    cut: int = 0
    tie: int = -1
    cut2: int = 0
    tie2: int = -1
    count: int = 0


def hash_of(documents: DataFrame) -> Column:
    """A number below 2**60 from the MD5 of doc_id and text."""
    key = F.concat(F.coalesce(documents["doc_id"].cast("string"), F.lit("")), F.lit(":"), F.coalesce(documents["text"].cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def second_hash(documents: DataFrame) -> Column:
    """A number below 2**60 from all columns."""
    return F.shiftrightunsigned(F.xxhash64(*[documents[f.name] for f in documents.schema.fields if "map<" not in f.dataType.simpleString()]), 4)


def sizes(documents: DataFrame) -> DataFrame:
    """doc_id, source, size (words), h, g (the hashes), staged."""

    def count(batches):
        for batch in batches:
            n = pa.array([len(t.as_py().split()) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "h", "g")), n], names=["doc_id", "source", "h", "g", "size"])

    docs = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["source"].cast("string").alias("source"), hash_of(documents).alias("h"), second_hash(documents).alias("g"), text_bytes(documents).alias("text"))
    return stage(docs.mapInArrow(tidy(count), "doc_id long, source string, h long, g long, size long"), "op7-sizes")[0]


def targets(totals: list[tuple[str | None, int]], weights: tuple = WEIGHTS, most_times: int = MOST_TIMES) -> list[float]:
    """Targets of sources in order; what a source can't hold is shared again among the others by weight."""
    weight = [weights[i % len(weights)] for i in range(len(totals))]
    total, out, open_ = float(sum(n for _, n in totals)), [0.0] * len(totals), list(range(len(totals)))
    left = total
    while open_:
        unit = left / sum(weight[i] for i in open_)
        over = [i for i in open_ if unit * weight[i] > most_times * totals[i][1]]
        if not over:
            for i in open_:
                out[i] = unit * weight[i]
            break
        for i in over:
            out[i] = float(most_times * totals[i][1])
            left -= out[i]
            open_.remove(i)
    return out


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_key", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))))


def shares(sized: DataFrame, weights: tuple = WEIGHTS, most_times: int = MOST_TIMES) -> list[Share]:
    """The share of each source; sized has source, size and h."""
    spark = sized.sparkSession
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()  # one row for each source
    totals = sorted(((r["source"], r["n"]) for r in rows), key=lambda x: (x[0] is None, (x[0] or "").encode()))
    out, open_ = [], {}
    for (source, n), target in zip(totals, targets(totals, weights, most_times)):
        times = min(most_times, int(target // n)) if n else 0
        out.append(Share(source, n, target, times))
        if n and times < most_times and target - times * n > 0:
            open_["n" if source is None else f"s{source}"] = (out[-1], 0, target - times * n)  # share, bits so far, budget left
    keyed, level = _keyed(sized.select("source", "size", "h", "g")), 0
    while open_:
        first, shift = level < LEVELS, HASH_BITS - LEVEL_BITS * (level % LEVELS + 1)
        hashed = "h" if first else "g"
        state = spark.createDataFrame([(k, b, float(left), share.tie) for k, (share, b, left) in open_.items()], "_key string, bits long, budget double, tie long")
        within = keyed.join(F.broadcast(state), "_key").where(F.shiftright(hashed, shift + LEVEL_BITS) == F.col("bits"))
        if not first:
            within = within.where("h = tie")
        summed = within.groupBy("_key", "budget", F.shiftright(hashed, shift).alias("bucket")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs"))
        running = summed.withColumn("upto", F.sum("n").over(Window.partitionBy("_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        boundary = {r["_key"]: r for r in running.where("upto > budget").groupBy("_key").agg(F.min(F.struct("bucket", "n", "docs", "upto")).alias("b")).select("_key", "b.*").collect()}
        level += 1
        for key, (share, bits, left) in list(open_.items()):
            r = boundary.get(key)
            if r is None:  # the budget takes all that was there
                _cut_at(share, first, (bits + 1) << (shift + LEVEL_BITS))
                del open_[key]
                continue
            left -= r["upto"] - r["n"]
            if r["docs"] == 1:  # the boundary document goes where it brings the sum nearer
                _cut_at(share, first, (r["bucket"] + (2 * left > r["n"])) << shift)
                del open_[key]
            elif shift:
                open_[key] = (share, r["bucket"], left)
            elif first:  # of one doc_id and text: the second hash goes on
                share.cut = share.tie = r["bucket"]
                open_[key] = (share, 0, left)
            else:  # equal rows
                share.cut2 = share.tie2 = r["bucket"]
                one = r["n"] / r["docs"]
                share.count = int(left // one) + (2 * (left - left // one * one) > one)
                del open_[key]
    return out


def _cut_at(share: Share, first: bool, cut: int) -> None:
    if first:
        share.cut = cut
    else:
        share.cut2 = cut


def _share_table(spark: SparkSession, found: list[Share]) -> DataFrame:
    rows = [("n" if s.source is None else f"s{s.source}", s.size, s.target, s.times, s.cut, s.tie, s.cut2, s.tie2, s.count) for s in found]
    return spark.createDataFrame(rows, "_key string, source_size long, target double, times int, cut long, tie long, cut2 long, tie2 long, more long")


def _passes(rows: DataFrame, found: list[Share], *kept: str) -> DataFrame:
    """rows (source, h, g, others) with source_size, target, and passes: how often each is taken. Of equal rows at a
    boundary, which only a count can part, one row is made from each again, with the columns ``kept``."""
    joined = _keyed(rows).join(F.broadcast(_share_table(rows.sparkSession, found)), "_key")
    below = (F.col("h") < F.col("cut")) | ((F.col("h") == F.col("tie")) & (F.col("g") < F.col("cut2")))
    out = [*kept, "source_size", "target"]
    if all(s.tie2 < 0 for s in found):
        return joined.select(*out, (F.col("times") + below.cast("int")).alias("passes"))
    tied = (F.col("h") == F.col("tie")) & (F.col("g") == F.col("tie2"))
    single = joined.where(~tied).select(*out, (F.col("times") + below.cast("int")).alias("passes"))
    groups = joined.where(tied).groupBy("_key", "source_size", "target", "times", "more", "h", "g").agg(*[F.first(c).alias(c) for c in kept], F.count(F.lit(1)).alias("n"))
    parts = groups.withColumn("part", F.explode(F.array(F.struct(F.col("more").alias("rows"), (F.col("times") + 1).alias("passes")), F.struct((F.col("n") - F.col("more")).alias("rows"), F.col("times").alias("passes")))))
    blocks = parts.where("part.rows > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("part.rows") - 1) / AT_ONCE))))
    dealt = blocks.repartition(F.col("_key"), F.col("part.passes"), F.col("block"))  # a group may be of any size
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(AT_ONCE).cast("long"), F.col("part.rows") - F.col("block") * AT_ONCE)))
    return single.union(dealt.select(*out, F.col("part.passes").alias("passes"), again.alias("_again")).drop("_again"))


def taken(sized: DataFrame, found: list[Share]) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    rows = _passes(sized, found, "doc_id", "size")
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("passes")).alias("taken"))


def mixed(documents: DataFrame, weights: tuple = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of documents."""
    found = shares(sizes(documents), weights, most_times)
    # Own names might clash with the caller's, so the counts are worked out on a struct of its row.
    rows = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("row"), documents["source"].alias("source"), hash_of(documents).alias("h"), second_hash(documents).alias("g"))
    counted = _passes(rows, found, "row")
    return counted.where("passes > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("passes")))).select("row.*")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return taken(sized, shares(sized))


OP7_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))), 1, 15)) AS BIGINT) AS h
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM sized GROUP BY source),
weighted AS (SELECT source, n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM totals),
levels AS (
  SELECT *, row_number() OVER o AS k,
         (sum(n) OVER () - coalesce(sum(3 * n) OVER (ORDER BY 3.0 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 3.0 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS unit
  FROM weighted WINDOW o AS (ORDER BY 3.0 * n / w, source NULLS LAST)),
water AS (SELECT min_by(unit, k) AS unit, min(k) AS k FROM levels WHERE unit * w <= 3 * n),
aims AS (SELECT l.source, l.n, CASE WHEN l.k < water.k THEN 3.0 * l.n ELSE water.unit * l.w END::DOUBLE AS target FROM levels l, water),
parts AS (SELECT source, n, target, CASE WHEN n = 0 THEN 0 ELSE least(3, floor(target / n)) END::BIGINT AS times FROM aims),
running AS (
  SELECT s.*, p.n, p.target, p.times, p.target - p.times * p.n AS rest,
         sum(size) OVER (PARTITION BY s.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, n AS source_size, round(target, 6) AS target,
       CAST(size * (times + CASE WHEN times < 3 AND rest > 0 AND (upto <= rest OR (upto - size <= rest AND 2 * (rest - (upto - size)) > size)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running
"""
