"""Best-fit packing by large-item matching.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. Which bin a piece goes to depends on its
length alone, so the plan is made on the histogram of lengths (``capacity`` rows at most) and covers whole classes
of equal bins at once: pieces over a third of the capacity ("large") fit at most twice into a bin and are matched
greedily, the largest with the largest partner that still fits; smaller lengths, in descending order, then go to the
tightest remaining gap that takes them; what no gap takes opens new bins. Pieces find their bin by their rank among
the pieces of their length; ranks come from counts by partition, so no length, however common, is sorted in one task.

Defined results: a null text counts as empty, i.e. the end id alone; null and repeated doc_ids are kept, every row is
a document of its own; sequence numbers are arbitrary but fixed for a staged table; an empty table gives an empty
one; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import tokens
from lodestar.llm.common import slices, stage, tidy

CAPACITY = 2048
END_ID = 0

#: Ids of a part, whose pieces are placed together: about so many bytes.
PART_BYTES = 8 << 20

_PIECE = "part long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(vocabulary: str, end_id: int, capacity: int, with_ids: bool):
    schema = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)

    def run(batches):
        task, filled, encoder = TaskContext.get().partitionId() << 32, 0, tokens.encoder(vocabulary)
        for batch in batches:
            for rows in slices(batch):
                ids, sizes = encoder.encode(rows.column("text").to_pylist())
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id).astype("<u4")
                data, at, out = memoryview(ids.tobytes()), 0, []
                for doc_id, size in zip(rows.column("doc_id").to_pylist(), (sizes + 1).tolist()):
                    part, filled = task + filled // PART_BYTES, filled + 4 * size
                    for k, start in enumerate(range(0, size, capacity)):
                        n = min(capacity, size - start)
                        own = data[4 * (at + start) : 4 * (at + start + n)]
                        out.append((part, doc_id, k, start, n, zlib.crc32(own)) + ((bytes(own),) if with_ids else ()))
                    at += size
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        encoder.release()

    return run


class Plan:
    """Bins by class: ``segments[length]`` lists (first rank, count, per bin, first bin, offset), in order of rank."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.segments, self.n_bins = capacity, {}, 0
        left, used = dict(histogram), dict.fromkeys(histogram, 0)
        self._left, self._used = left, used
        self._gaps: list[int] = []  # ascending, distinct
        self._open: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first bin, count)]
        large = sorted((n for n in left if 3 * n > capacity), reverse=True)
        ascending = large[::-1]
        for a in large:
            while left[a]:
                # the largest partner that still fits; ``ascending`` keeps the lengths that remain
                i = bisect_left(ascending, capacity - a + 1) - 1
                while i >= 0 and (not left[ascending[i]] or (ascending[i] == a and left[a] < 2)):
                    if not left[ascending[i]]:
                        ascending.pop(i)
                    i -= 1
                b = ascending[i] if i >= 0 else None
                if b is None:
                    bins = left[a]
                    first = self._new(bins)
                    self._put(a, bins, 1, first, 0)
                    self._gap(capacity - a, first, bins)
                    break
                bins = left[a] // 2 if a == b else min(left[a], left[b])
                first = self._new(bins)
                self._put(a, bins, 1, first, 0)
                self._put(b, bins, 1, first, a)
                self._gap(capacity - a - b, first, bins)
        for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
            while left[s]:
                i = bisect_left(self._gaps, s)
                if i == len(self._gaps):
                    per = capacity // s
                    full, rest = divmod(left[s], per)
                    for bins, q in ((full, per), (bool(rest), rest)):
                        if bins:
                            first = self._new(int(bins))
                            self._put(s, int(bins), q, first, 0)
                            self._gap(capacity - q * s, first, int(bins))
                    continue
                gap = self._gaps[i]
                first, bins = self._open[gap].pop()
                if not self._open[gap]:
                    del self._open[gap], self._gaps[i]
                per = gap // s
                full, rest = divmod(left[s], per)
                take = min(bins, full)
                if take:
                    self._put(s, take, per, first, capacity - gap)
                    self._gap(gap - per * s, first, take)
                first, bins = first + take, bins - take
                if bins and rest and take == full:
                    self._put(s, 1, rest, first, capacity - gap)
                    self._gap(gap - rest * s, first, 1)
                    first, bins = first + 1, bins - 1
                self._gap(gap, first, bins)

    def _new(self, bins: int) -> int:
        self.n_bins += bins
        return self.n_bins - bins

    def _put(self, length: int, bins: int, per: int, first: int, offset: int) -> None:
        self.segments.setdefault(length, []).append((self._used[length], bins * per, per, first, offset))
        self._used[length] += bins * per
        self._left[length] -= bins * per

    def _gap(self, gap: int, first: int, bins: int) -> None:
        if gap and bins:
            if gap not in self._open:
                insort(self._gaps, gap)
                self._open[gap] = []
            self._open[gap].append((first, bins))


def cut_documents(documents: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, staged: part, doc_id, piece, start, length, ids_crc32 (and ids, if asked for)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return stage(docs.mapInArrow(tidy(_cut(vocabulary or tokens.default_path(), end_id, capacity, with_ids)), _PIECE + ", ids binary" * with_ids), "op5-pieces")[0]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (from cut_documents) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))  # capacity rows for each part at most
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = Plan(histogram, capacity)
    shared = spark.sparkContext.broadcast({n: [np.array(c, np.int64) for c in zip(*s)] for n, s in plan.segments.items()})
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    names = [f.name for f in pieces.schema.fields if f.name != "part"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name != "part")

    def place(own, starts):
        """Sequence and offset of one part's pieces; their ranks go on from those of the parts before."""
        length = own.column("length").to_numpy()
        order = np.lexsort((own.column("start").to_numpy(), own.column("doc_id").fill_null(-(1 << 62)).to_numpy(), length))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        ranks = dict(zip(starts.column("length").to_pylist(), starts.column("before").to_pylist()))
        for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            n = int(length[rows[0]])
            first, _, per, bins, offsets = shared.value[n]
            rank = ranks[n] + np.arange(len(rows))
            s = np.searchsorted(first, rank, side="right") - 1
            within = rank - first[s]
            sequence[rows] = bins[s] + within // per[s]
            offset[rows] = offsets[s] + n * (within % per[s])
        return own.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return pieces.groupBy("part").cogroup(before.groupBy("part")).applyInArrow(place, f"{kinds}, sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
