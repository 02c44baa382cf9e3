"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, results merged.

Equal vectors are one point of a graph that carries their smallest ids (a search for k never needs more than k + 1 of
them, ties going to smaller ids), so a vector that a third of all rows share neither disconnects a graph nor grows a
group. Points are dealt to shards by a hash of the vector: as many as a task's memory holds (``SHARD``), or fewer where
that leaves under ``PARALLEL`` shards. A shard's graph is built in one task and stored as one row of flat arrays:
vectors, ids, and per level the neighbour numbers. A search sends each graph once; the queries of its dimension follow
it through the same task as a stream, in blocks, and the best k of all shards remain. Graphs are built and walked in
single precision, on vectors scaled by the shard's largest component; distances that are returned are worked out anew
in double precision, and of points at one distance all that were found compete, so ties go to smaller ids.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
with a null id; vectors meet only those of their own length; of rows that repeat an id, each distinct vector is a
candidate, and the least vector asks if that id is a query; with fewer than k candidates all are returned; an empty
table gives an empty one; columns other than vec_id and embedding are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.llm.common import stage

K = 10
#: Points of a shard at most, about; shards that a table is cut into at least, while each keeps LEAST_SHARD points.
SHARD, PARALLEL, LEAST_SHARD = 100_000, 32, 1024
LINKS = 16
EF_BUILD, EF_SEARCH = 80, 160
#: Queries that are searched at once.
BLOCK = 256
EVERY = 100


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of queries a (n, d) to their own rows b (n, m, d)."""
    gap = b - a[:, None, :]
    return np.einsum("nmd,nmd->nm", gap, gap)


def beam(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one level for many queries in step: (numbers, squared distances), ascending, -1 and inf
    beyond what was found. entry: (queries, e) numbers to set out from, -1 for none."""
    n = len(queries)
    seen = np.zeros((n, len(points) + 1), bool)
    seen[:, -1] = True
    row = np.arange(n)[:, None]
    number = np.full((n, ef), -1)
    gap = np.full((n, ef), np.inf, np.float32)
    open_ = np.zeros((n, ef), bool)
    fresh = entry
    while True:
        fresh = np.sort(fresh, axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
        fresh = np.where(seen[row, fresh], -1, fresh)
        seen[row, fresh] = True
        d = np.where(fresh < 0, np.inf, distances(queries, points[fresh])).astype(np.float32)
        number, gap, open_ = np.concatenate([number, fresh], axis=1), np.concatenate([gap, d], axis=1), np.concatenate([open_, fresh >= 0], axis=1)
        order = np.argsort(gap, axis=1, kind="stable")[:, :ef]
        number, gap, open_ = number[row, order], gap[row, order], open_[row, order]
        rank = np.cumsum(open_, axis=1)
        chosen = open_ & (rank <= expand)
        if not chosen.any():
            return number, gap
        open_ &= ~chosen
        at = np.where(chosen, rank - 1, expand)
        nodes = np.full((n, expand + 1), -1)
        nodes[row, at] = np.where(chosen, number, -1)
        nodes = nodes[:, :expand]
        fresh = np.where(nodes[:, :, None] < 0, -1, links[nodes]).reshape(n, -1)


def diverse(points: np.ndarray, number: np.ndarray, gap: np.ndarray, most: int) -> np.ndarray:
    """Of candidates in ascending order, those nearer to the point than to any chosen before; then the nearest of the
    others until ``most`` are chosen. (n, most) numbers, -1 beyond."""
    n, m = number.shape
    own = points[number]
    square = np.einsum("nmd,nmd->nm", own, own)
    among = square[:, :, None] + square[:, None, :] - 2 * np.matmul(own, own.transpose(0, 2, 1))
    chosen, count = np.zeros((n, m), bool), np.zeros(n, int)
    nearest = np.full((n, m), np.inf, np.float32)  # to any chosen one
    valid = number >= 0
    for j in range(m):
        take = valid[:, j] & (gap[:, j] < nearest[:, j]) & (count < most)
        chosen[:, j] = take
        count += take
        nearest = np.where(take[:, None], np.minimum(nearest, among[:, j, :]), nearest)
    place = np.where(chosen, 0, np.where(valid, 1, 2)) * m + np.arange(m)
    order = np.argsort(place, axis=1)[:, :most]
    row = np.arange(n)[:, None]
    return np.where(valid[row, order], number[row, order], -1)


class Graph:
    """points (n, d) float32; per level an array (n, links) of neighbour numbers, -1 for none; the entry point."""

    def __init__(self, points: np.ndarray, levels: list[np.ndarray], entry: int):
        self.points, self.levels, self.entry = points, levels, entry

    @classmethod
    def build(cls, points: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = 11) -> Graph:
        n = len(points)
        top = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int), 6)
        first = int(np.argmax(top))
        graph = cls(points, [np.full((n + 1, 2 * links if k == 0 else links), -1) for k in range(top[first] + 1)], first)
        order = np.concatenate([[first], np.delete(np.arange(n), first)])
        done = 1
        while done < n:
            batch = order[done : done + max(1, min(256, done))]
            start = np.full((len(batch), 1), graph.entry)
            for k in range(len(graph.levels) - 1, -1, -1):
                goes = top[batch] >= k
                found, gap = beam(points, graph.levels[k], points[batch], start, ef if goes.any() else 1)
                if goes.any():
                    graph._insert(k, batch[goes], found[goes], gap[goes])
                start = found[:, : max(1, min(8, found.shape[1]))]
            done += len(batch)
        return graph

    def _insert(self, k: int, batch: np.ndarray, found: np.ndarray, gap: np.ndarray) -> None:
        links, points = self.levels[k], self.points
        # Points of one batch don't find each other in the graph, so they are candidates as well.
        mates = np.broadcast_to(batch, (len(batch), len(batch)))
        apart = distances(points[batch], points[mates])
        np.fill_diagonal(apart, np.inf)
        near = np.argsort(apart, axis=1)[:, : found.shape[1] // 2]
        row = np.arange(len(batch))[:, None]
        number = np.concatenate([found, np.where(np.isinf(apart[row, near]), -1, mates[row, near])], axis=1)
        gap = np.concatenate([gap, apart[row, near]], axis=1)
        order = np.argsort(gap, axis=1, kind="stable")[:, : found.shape[1]]
        own = diverse(points, number[row, order], gap[row, order], LINKS)
        links[batch, : own.shape[1]] = own
        source, target = np.repeat(batch, own.shape[1]), own.ravel()
        keep = target >= 0
        self._link_back(links, source[keep], target[keep])

    def _link_back(self, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        if not len(target):
            return
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        more = np.full((len(nodes), count.max()), -1)
        more[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        merged = np.sort(np.concatenate([links[nodes], more], axis=1), axis=1)
        merged[:, 1:][merged[:, 1:] == merged[:, :-1]] = -1
        width = links.shape[1]
        for lo in range(0, len(nodes), 512):
            part, now = nodes[lo : lo + 512], merged[lo : lo + 512]
            gap = np.where(now < 0, np.inf, distances(self.points[part], self.points[now]))
            near = np.argsort(gap, axis=1, kind="stable")
            at = np.arange(len(part))[:, None]
            now, gap = now[at, near], gap[at, near]
            full = (now >= 0).sum(axis=1) > width
            links[part[~full]] = now[~full, :width]
            if full.any():
                links[part[full]] = diverse(self.points, now[full], gap[full], width)

    def search(self, queries: np.ndarray, ef: int = EF_SEARCH) -> np.ndarray:
        """Numbers of the nearest points found, nearest first, -1 beyond."""
        out = []
        for lo in range(0, len(queries), 256):
            part = queries[lo : lo + 256]
            start = np.full((len(part), 1), self.entry)
            for k in range(len(self.levels) - 1, 0, -1):
                start = beam(self.points, self.levels[k], part, start, 4)[0]
            out.append(beam(self.points, self.levels[0], part, start, ef)[0])
        return np.concatenate(out)


_VECTOR = "dim int, vec binary, ids array<long>"


def _valid(batch) -> list[tuple[int, bytes]]:
    """(vec_id, float64 bytes) of the rows that take part."""
    out = []
    for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
        if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
        if np.isfinite(x).all() and x.any():
            out.append((i, x.tobytes()))
    return out


def distinct_vectors(embeddings: DataFrame, k: int = K) -> DataFrame:
    """Staged: dim, vec, and the k + 1 smallest ids of each distinct vector."""

    def run(batches):
        for batch in batches:
            groups: dict[bytes, set] = {}
            for i, v in _valid(batch):
                groups.setdefault(v, set()).add(i)
            if groups:
                yield pa.RecordBatch.from_arrays([pa.array([len(v) // 8 for v in groups], pa.int32()), pa.array(list(groups), pa.binary()), pa.array([sorted(x)[: k + 1] for x in groups.values()], pa.list_(pa.int64()))], names=["dim", "vec", "ids"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, _VECTOR)
    own = rows.select("dim", "vec", F.explode("ids").alias("id")).distinct()
    # Spark applies the limit before the shuffle as well, so a vector's group is k + 1 rows of each partition.
    rank = F.row_number().over(Window.partitionBy("dim", "vec").orderBy("id"))
    merged = own.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("dim", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return stage(merged, "op8-vectors")[0]


_INDEX = "dim int, shard int, vectors binary, scale double, ids array<long>, id_ends array<long>, neighbours array<binary>, entry int"


def _scaled(points: np.ndarray, scale: float) -> np.ndarray:
    """In single precision, where squares of far queries still have to be finite."""
    return np.clip(points / scale, -1e15, 1e15).astype(np.float32)


def build_index(vectors: DataFrame, shard_size: int = SHARD, parallel: int = PARALLEL, least: int = LEAST_SHARD) -> DataFrame:
    """Staged: dim, shard, and a graph's flat arrays."""
    n = F.col("n")
    number = F.greatest(F.ceil(n / shard_size), F.least(F.lit(parallel), F.ceil(n / least))).cast("int")
    shards, _ = stage(vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select("dim", number.alias("shards")), "op8-shards")
    total = shards.agg(F.sum("shards")).first()[0] or 1

    def build(key, table):
        points = np.stack([np.frombuffer(v.as_py(), "<f8") for v in table.column("vec")])
        order = np.lexsort(points.T[::-1])  # the graph doesn't depend on the order of rows
        ids = table.column("ids").to_pylist()
        points, ids = points[order], [ids[i] for i in order]
        scale = float(np.abs(points).max())
        graph = Graph.build(_scaled(points, scale))
        row = {"dim": key[0].as_py(), "shard": key[1].as_py(), "vectors": points.tobytes(), "scale": scale, "ids": [i for x in ids for i in x], "id_ends": np.cumsum([len(x) for x in ids]).tolist(), "neighbours": [x[:-1].astype("<i4").tobytes() for x in graph.levels], "entry": graph.entry}
        return pa.Table.from_pylist([row], schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("vectors", pa.binary()), ("scale", pa.float64()), ("ids", pa.list_(pa.int64())), ("id_ends", pa.list_(pa.int64())), ("neighbours", pa.list_(pa.binary())), ("entry", pa.int32())]))

    # One row for each length of vectors; the number of partitions is stated, else small shards would be put together.
    dealt = vectors.join(F.broadcast(shards), "dim").withColumn("shard", F.pmod(F.xxhash64("vec"), F.col("shards")).cast("int")).drop("shards")
    return stage(dealt.repartition(min(4096, 2 * total), "dim", "shard").groupBy("dim", "shard").applyInArrow(build, _INDEX), "op8-index")[0]


def queries_of(embeddings: DataFrame) -> DataFrame:
    """query_id, dim, vec of the valid rows; the least vector of a repeated id."""

    def run(batches):
        for batch in batches:
            rows = _valid(batch)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([len(v) // 8 for _, v in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())], names=["query_id", "dim", "vec"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "query_id long, dim int, vec binary").groupBy("query_id").agg(F.min(F.struct("dim", "vec")).alias("v")).select("query_id", "v.dim", "v.vec")


class _Shard:
    """A stored graph, ready to be searched."""

    def __init__(self, row: dict):
        self.points = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
        n = len(self.points)
        levels = [np.concatenate([np.frombuffer(x, "<i4").reshape(n, -1), np.full((1, len(x) // 4 // n), -1, np.int32)]) for x in row["neighbours"]]
        self.scale, self.graph = row["scale"], Graph(_scaled(self.points, row["scale"]), levels, row["entry"])
        self.ids, self.ends = np.array(row["ids"], np.int64), [0, *row["id_ends"]]

    def nearest(self, query_id: int, vector: np.ndarray, near: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(query_id, vec_id, score) of the k nearest of the points found."""
        near = near[near >= 0]
        gap = self.points[near] - vector
        with np.errstate(over="ignore"):
            score = np.sqrt((gap * gap).sum(axis=1))
        if np.isinf(score).any():  # squares beyond double precision
            most = np.abs(gap).max(axis=1)
            score = most * np.sqrt(((gap / np.where(most > 0, most, 1)[:, None]) ** 2).sum(axis=1))
        if len(score) > k:
            # One point may be the query's own, so one more counts; points as near as the last of them all compete.
            keep = score <= np.partition(score, k)[k]
            near, score = near[keep], score[keep]
        pairs = sorted((float(s), i) for s, j in zip(score, near) for i in self.ids[self.ends[j] : self.ends[j + 1]].tolist() if i != query_id)
        return [(query_id, i, s) for s, i in pairs[:k]]


def search(index: DataFrame, queries: DataFrame, k: int = K, ef: int = EF_SEARCH, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, its own id left out."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    names = [f.split()[0] for f in _INDEX.split(", ")]
    shards, _ = stage(index.select("dim", "shard"), "op8-shards")
    total = max(1, shards.count())

    def find(batches):
        """Rows come by shard, its graph first."""
        shard, last = None, None
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                head = {n: batch.column(n)[lo].as_py() for n in ("dim", "shard")}
                if batch.column("vectors")[lo].is_valid:
                    shard, last = _Shard({n: batch.column(n)[lo].as_py() for n in names}), head
                    lo += 1
                    continue
                own = batch.slice(lo, block)
                same = [i for i, (d, s, v) in enumerate(zip(own.column("dim").to_pylist(), own.column("shard").to_pylist(), own.column("vectors").is_valid().to_pylist())) if v or {"dim": d, "shard": s} != head]
                own = own.slice(0, same[0] if same else own.num_rows)
                lo += own.num_rows
                if head != last:
                    raise RuntimeError(f"no graph for {head}")
                query = np.stack([np.frombuffer(v.as_py(), "<f8") for v in own.column("vec")])
                found = shard.graph.search(_scaled(query, shard.scale), max(ef, k + 1))
                out = [x for q, vector, near in zip(own.column("query_id").to_pylist(), query, found) for x in shard.nearest(q, vector, near, k)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in index.schema.fields if f.name not in ("dim", "shard")]
    graphs = index.select(*names, F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("binary").alias("vec"))
    last = F.broadcast(shards.groupBy("dim").agg(F.max("shard").alias("last")))  # one row for each length of vectors
    asked = queries.join(last, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), "last"))).select("dim", "shard", *empty, "query_id", "vec")
    rows = graphs.unionByName(asked.select(*graphs.columns)).repartition(min(4096, 2 * total), "dim", "shard")
    found = rows.sortWithinPartitions("dim", "shard", F.col("vectors").isNull(), "query_id").mapInArrow(find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = build_index(distinct_vectors(embeddings))
    return search(index, queries_of(embeddings.where(F.col("vec_id") % EVERY == 0)))
