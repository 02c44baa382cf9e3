"""Exact top-k search and k-nearest-neighbour graphs.

Vectors are packed into blocks, a row of bytes for each, and written. A task reads some blocks of queries and some of the
corpus, scores by matrix product, and keeps k of a query over all that it reads: no vector is shuffled, and what leaves a
task is k rows of each of its queries, never a pair. Ties go to the smaller id. Vectors that are null, empty, or hold a
null or NaN take no part; vectors meet only those of their own length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.tables import cut, settings

BLOCK = 4096
#: Rows of a block that are scored at once.
TILE = 256
#: Bytes of vectors that a task holds of the side that it goes through again for each block of the other.
HELD_BYTES = 64 << 20
#: Tasks there are at least, where there are so many pairs for each and blocks enough.
LEAST_TASKS, TASK_PAIRS = 24, 10_000_000
METRICS = ("cosine", "euclidean", "sqeuclidean", "inner")
#: Blocks are large: few to a file, few to a part of the left side, and one pair of them at a time to Python.
_WRITTEN = {"spark.sql.files.maxRecordsPerFile": 4}
_MET = {"spark.sql.files.maxPartitionBytes": "8m", "spark.sql.files.openCostInBytes": "256k", "spark.sql.execution.arrow.maxRecordsPerBatch": 1}


def _rows(df: DataFrame, id_column: str, vector: str, bias: Column | None = None) -> DataFrame:
    more = [] if bias is None else [bias.alias("bias")]
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), *more)
    return rows.where("id is not null and size(v) > 0").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))).withColumn("dim", F.size("v"))


def _blocks(df: DataFrame, id_column: str, vector: str, block: int) -> tuple[DataFrame, int]:
    rows = _rows(df, id_column, vector)
    n = max(1, -(-rows.count() // block))
    return rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of vectors of one length, as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


@dataclass
class Block:
    """Vectors of one length, by ascending id. ``key`` is its own among the blocks of its table."""

    key: int
    ids: np.ndarray
    x: np.ndarray
    bias: np.ndarray

    def __post_init__(self):
        self.square = np.einsum("ij,ij->i", self.x, self.x)
        self.finite = bool(np.isfinite(self.square).all())


def packed(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", block: int = BLOCK, bias: Column | None = None) -> DataFrame:
    """key, dim, n, ids, v, bias: a row for each block of up to ``block`` vectors, which are those of one partition."""
    rows = _rows(df, id_column, vector, F.lit(0.0) if bias is None else bias)
    schema = pa.schema([("key", pa.int64()), ("dim", pa.int32()), ("n", pa.int64()), ("ids", pa.binary()), ("v", pa.binary()), ("bias", pa.binary())])

    def run(batches):
        waiting: dict[int, list] = {}
        made = TaskContext.get().partitionId() << 32

        def one(dim, ids, x, plus):
            nonlocal made
            order = np.argsort(ids, kind="stable")
            made += 1
            columns = [[made], [dim], [len(ids)], [ids[order].tobytes()], [x[order].tobytes()], [plus[order].tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                own = waiting.setdefault(dim, [])
                own.append((part.column("id").to_numpy(), matrix(part.column("v")), part.column("bias").to_numpy(zero_copy_only=False).astype(float)))
                if sum(len(ids) for ids, _, _ in own) >= block:
                    ids, x, plus = (np.concatenate(c) for c in zip(*own))
                    whole = len(ids) // block * block
                    for lo in range(0, whole, block):
                        yield one(dim, ids[lo : lo + block], x[lo : lo + block], plus[lo : lo + block])
                    waiting[dim] = [(ids[whole:], x[whole:], plus[whole:])]
        for dim, own in waiting.items():
            ids, x, plus = (np.concatenate(c) for c in zip(*own))
            if len(ids):
                yield one(dim, ids, x, plus)

    made = rows.mapInArrow(run, "key long, dim int, n long, ids binary, v binary, bias binary")
    with settings(df.sparkSession, _WRITTEN):
        return cut(made, "blocks")[0]


def meet(left: DataFrame, right: DataFrame, run: Callable[[Iterator[tuple[Block, Block]]], Iterator[pa.RecordBatch]], schema: str, half: bool = False) -> DataFrame:
    """run over pairs of blocks of one length, one of left and one of right, all of a block of left in succession; with
    ``half``, of two blocks of one table only one order, and each with itself. Every task reads its own blocks of either
    side (a Cartesian product of parts), so nothing is shuffled; what run gives is written."""
    spark = left.sparkSession
    rows, held = right.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("dim") * 8), F.lit(0))).first()
    asked = rows if left is right else left.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = min(LEAST_TASKS, 1 + rows * asked // TASK_PAIRS)
    parts = max(1, -(-held // HELD_BYTES), -(-tasks // max(1, len(left.inputFiles()))))

    def decoded(batches):
        last = None
        for batch in batches:
            for row in batch.to_pylist():
                a, b = ((row[f"{s}_key"], np.frombuffer(row[f"{s}_ids"], np.int64), np.frombuffer(row[f"{s}_v"]).reshape(row[f"{s}_n"], row[f"{s}_dim"]), np.frombuffer(row[f"{s}_bias"])) for s in "ab")
                last = last if last is not None and last.key == a[0] else Block(*a)
                yield last, Block(*b)

    own, other = (t.select(*[F.col(c).alias(f"{s}_{c}") for c in t.columns]) for t, s in ((left, "a"), (right, "b")))
    met = F.col("a_dim") == F.col("b_dim")
    pairs = own.hint("shuffle_replicate_nl").join(other.coalesce(parts), met & (F.col("a_key") <= F.col("b_key")) if half else met)
    with settings(spark, _MET):
        return cut(pairs.mapInArrow(lambda batches: run(decoded(batches)), schema), "met")[0]


class Nearest:
    """The k least keys of each row of a block, of all that is added; of equal keys those of the smaller ids, or all that
    equal the k-th with ``ties``."""

    def __init__(self, rows: int, k: int, ties: bool = False):
        self.k, self.ties, self.limit, self.waiting, self.n = k, ties, np.full(rows, np.inf), [], 0
        self.held = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))

    def add(self, rows: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((rows, keys, ids))
        self.n += len(rows)

    def settle(self, least: int = 0) -> None:
        """Bring ``held`` and the limits up to date, if so many rows wait."""
        if self.n <= least:
            return
        rows, keys, ids = (np.concatenate(c) for c in zip(self.held, *self.waiting))
        order = np.lexsort((ids, keys, rows))
        rows, keys, ids = rows[order], keys[order], ids[order]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        size = np.diff(np.append(starts, len(rows)))
        full = starts[size >= self.k] + self.k - 1
        self.limit[rows[full]] = np.where(np.isnan(keys[full]), np.inf, keys[full])
        keep = np.arange(len(rows)) - np.repeat(starts, size) < self.k
        if self.ties:
            keep |= keys <= self.limit[rows] * (1 + 1e-15)
        self.held, self.waiting, self.n = (rows[keep], keys[keep], ids[keep]), [], 0


def same_ids(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b, which ascends) of equal ids."""
    lo, hi = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
    at = np.flatnonzero(hi > lo)
    size = (hi - lo)[at]
    first = np.repeat(lo[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(at) else np.empty(0, np.int64)
    return np.repeat(at, size), first + np.arange(int(size.sum()))


def topk(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = False, block: int = BLOCK, scale: float = 1.0, bias: str | None = None) -> DataFrame:
    """corpus (vec_id, embedding), queries (qid, qvec) -> qid, rank, vec_id, score. cosine and inner score by inner
    product, larger first (vectors are taken as normalised); the others by distance, smaller first. With ``bias``, a
    column of corpus, the product is scaled and the column added before anything is ranked."""
    own = packed(corpus, block=block, bias=F.col(bias).cast("double") if bias else None)
    return topk_blocks(own, packed(queries, "qid", "qvec", block), k, metric, exclude_self, scale, bool(bias))


def topk_blocks(own: DataFrame, asked: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = False, scale: float = 1.0, biased: bool = False) -> DataFrame:
    """topk over tables of packed(). Products in single precision, with a bound of their error, find what may be among the
    k; those are scored in double precision, each by itself, so equal vectors have equal scores."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k < 0:
        raise ValueError("k must not be negative")
    inner = metric in ("cosine", "inner")
    if biased and not inner:
        raise ValueError("a bias goes with cosine or inner")
    schema = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("key", pa.float64())])

    def exact(q: Block, x: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if not inner:
            key = ((x.x[j] - q.x[i]) ** 2).sum(axis=1)
            return np.sqrt(key) if metric == "euclidean" else key
        dot = (q.x[i] * x.x[j]).sum(axis=1)
        return -(scale * dot + x.bias[j]) if biased else -dot

    def scorer(q: Block, x: Block, kind: type):
        """Functions of a tile: its scores, larger ones being nearer, what a limit among keys is among those, and the error."""
        if inner:
            left, right = (scale if biased else 1.0) * q.x, x.x
            if biased:
                left, right = np.hstack([left, np.ones((len(left), 1))]), np.hstack([right, x.bias[:, None]])
            plain = np.sqrt(x.square.max()) * np.sqrt(q.square) * (abs(scale) if biased else 1.0)
            most = plain + (np.abs(x.bias[np.isfinite(x.bias)]).max(initial=0.0) if biased else 0.0)
            limit = lambda lo, hi, keys: -keys
        else:
            left, right = np.hstack([2 * q.x, -np.ones((len(q.x), 1))]), np.hstack([x.x, x.square[:, None]])
            far = np.sqrt(x.square.max())
            most = (far + np.sqrt(q.square)) ** 2
            limit = lambda lo, hi, keys: q.square[lo:hi] - (keys * keys if metric == "euclidean" else keys)
        left, right = left.astype(kind), np.ascontiguousarray(right.astype(kind).T)
        error = (left.shape[1] + 8) * np.finfo(kind).eps * most + 1e-30
        return (lambda lo, hi: left[lo:hi] @ right), limit, error

    def search(q: Block, x: Block, near: Nearest) -> None:
        usable = q.finite and x.finite and max(q.square.max(), x.square.max()) < 1e30
        same = same_ids(q.ids, x.ids) if exclude_self else None
        scorers = {}
        for lo in range(0, len(q.ids), TILE):
            hi = min(lo + TILE, len(q.ids))
            for kind in (np.float32, np.float64) if usable else ():
                if kind not in scorers:
                    scorers[kind] = scorer(q, x, kind)
                scores, limit, error = scorers[kind]
                s = scores(lo, hi)
                if exclude_self:
                    mine = slice(*np.searchsorted(same[0], (lo, hi)))
                    s[same[0][mine] - lo, same[1][mine]] = -np.inf
                least = limit(lo, hi, near.limit[lo:hi]) - error[lo:hi]
                if s.shape[1] > k and not np.isfinite(near.limit[lo:hi]).all():
                    least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 2 * error[lo:hi])
                at = np.flatnonzero(s >= np.nextafter(least.astype(kind), kind(-np.inf))[:, None])
                if len(at) <= max(4 * k * (hi - lo), s.size // 20):
                    break
            if not usable:
                at = np.arange((hi - lo) * len(x.ids))
            for part in np.array_split(at, -(-len(at) // 100_000)) if len(at) else ():
                i, j = np.divmod(part, len(x.ids))
                i += lo
                if exclude_self:
                    other = q.ids[i] != x.ids[j]
                    i, j = i[other], j[other]
                key = exact(q, x, i, j)
                may = ~(key > near.limit[i])
                near.add(i[may], key[may], x.ids[j[may]])
                near.settle(1_000_000)
        near.settle(2 * len(near.held[0]))

    def run(pairs):
        last, near = None, None

        def found():
            near.settle()
            rows, keys, ids = near.held
            for lo in range(0, len(rows), 50_000):
                part = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(last.ids[rows[part]]), pa.array(ids[part]), pa.array(keys[part])], schema=schema)

        for q, x in pairs:
            if last is not q:
                if last is not None:
                    yield from found()
                last, near = q, Nearest(len(q.ids), k)
            search(q, x, near)
        if last is not None:
            yield from found()

    pairs = meet(asked, own, run if k else lambda pairs: iter(()), "qid long, vec_id long, key double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("key", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "vec_id", (F.col("key") * (-1.0 if inner else 1.0)).alias("score"))


def knn_edges(embeddings: DataFrame, k: int = 10, metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """src < dst, weight: an edge where either end is among the other's k nearest, its weight the distance (cosine:
    one minus the inner product, not below zero). A node without neighbours has no row."""
    blocks = packed(embeddings, block=block)
    near = topk_blocks(blocks, blocks, k, metric, True)
    weight = F.greatest(F.lit(0.0), 1.0 - F.col("score")) if metric in ("cosine", "inner") else F.col("score")
    return near.groupBy(F.least("qid", "vec_id").alias("src"), F.greatest("qid", "vec_id").alias("dst")).agg(F.min(weight).alias("weight"))


def pairs(embeddings: DataFrame, block: int = 1024) -> DataFrame:
    """i, j, d2: squared distances of all ordered pairs i <> j, by blocks; for the dense operators of a bounded set."""
    left, n = _blocks(embeddings, "vec_id", "embedding", block)
    right = left.select(F.col("id").alias("other"), F.col("v").alias("u"), F.col("b").alias("c"), "dim").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left = left.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def apart(a, b):
        if not a.num_rows or not b.num_rows:
            return pa.schema([("i", pa.int64()), ("j", pa.int64()), ("d2", pa.float64())]).empty_table()
        i, j = a.column("id").to_numpy(), b.column("other").to_numpy()
        x, y = matrix(a.column("v")), matrix(b.column("u"))
        d2 = np.stack([((y - p) ** 2).sum(axis=1) for p in x])
        keep = i[:, None] != j[None, :]
        return pa.table({"i": np.repeat(i, len(j))[keep.ravel()], "j": np.tile(j, len(i))[keep.ravel()], "d2": d2.ravel()[keep.ravel()]})

    return left.groupBy("b", "c", "dim").cogroup(right.groupBy("b", "c", "dim")).applyInArrow(apart, "i long, j long, d2 double")


def squared_distances(a: Block, b: Block, half: bool = False) -> Iterator[tuple[int, int, np.ndarray]]:
    """(lo, hi, squared distances of a[lo:hi] from b) of two blocks; infinite between equal ids, and with ``half`` in one
    block's order of the two. By matrix product, but where it would cancel by differences, so equal vectors have zero."""
    left = np.hstack([-2 * a.x, a.square[:, None], np.ones((len(a.ids), 1))])
    right = np.ascontiguousarray(np.hstack([b.x, np.ones((len(b.ids), 1)), b.square[:, None]]).T)
    close = 1e-6 * (np.sqrt(a.square) + np.sqrt(b.square.max())) ** 2
    same = same_ids(a.ids, b.ids)
    with np.errstate(invalid="ignore"):
        for lo in range(0, len(a.ids), TILE):
            hi = min(lo + TILE, len(a.ids))
            if a.finite and b.finite:
                d2 = left[lo:hi] @ right
                at = np.flatnonzero(d2 < close[lo:hi, None])
                for part in np.array_split(at, -(-len(at) // 100_000)) if len(at) else ():
                    i, j = np.divmod(part, len(b.ids))
                    d2.ravel()[part] = ((b.x[j] - a.x[lo + i]) ** 2).sum(axis=1)
            else:
                d2 = np.stack([((b.x - p) ** 2).sum(axis=1) for p in a.x[lo:hi]])
            mine = slice(*np.searchsorted(same[0], (lo, hi)))
            d2[same[0][mine] - lo, same[1][mine]] = np.inf
            if half and a.key == b.key:
                d2[np.arange(len(b.ids))[None, :] <= np.arange(lo, hi)[:, None]] = np.inf
            yield lo, hi, d2


def block_distances(embeddings: DataFrame, what: Callable[[Iterator[tuple[Block, Block]]], Iterator[pa.RecordBatch]], schema: str, block: int = BLOCK) -> DataFrame:
    """what over all pairs of blocks (see meet and squared_distances). Nothing but what it returns, a table of ``schema``,
    leaves the task."""
    blocks = packed(embeddings, block=block)
    return meet(blocks, blocks, what, schema)
