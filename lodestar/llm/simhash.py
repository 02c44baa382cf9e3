"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``2 * half`` bits have a common variant within ``half`` bits of either, so every distinct
fingerprint emits all variants in that ball (2,081 of 64 bits at half = 2), variants meet in a shuffle, and
fingerprints with a common variant are linked after their distance is checked. Variants are dealt by ``ROUTE_BITS``
of their own bits. All variants of one fingerprint that agree in these bits then go to one task, so the shuffle
carries the fingerprint once for them (37 times in all, not 2,081) and the task emits them. A task with many
fingerprints splits further by the next bits in the same way, so its arrays stay small. Fingerprints that share a
variant become a star about their least one, not all pairs; every link lies in one star, as any two of its members
are within the radius. Components of the stars are found in Spark.

Defined results: a null text has no words; without words the fingerprint is zero and links like any other; with
fewer words than a shingle has, the whole sequence is the one shingle; null doc_ids are kept and never name a
component unless all its documents have none; rows with one doc_id are documents of their own; an empty table gives
an empty one; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.joins import join_keys
from lodestar.llm.common import slices, stage, text_bytes, tidy
from lodestar.llm.components import components

SHINGLE = 4
RADIUS = 4
ROUTE_BITS = 8
#: Fingerprints that a bucket gets about; more bits route when there are more fingerprints.
BUCKET_PRINTS = 100_000
#: Fingerprints that a task expands at once; more are split by further bits.
AT_ONCE = 1500
SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the shingles' XXH64 values."""
    words = text.lower().split()  # ASCII only, both
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], "<u8")
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        votes += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                prints = np.fromiter((fingerprint(t, shingle) for t in part.column("text").to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(documents).alias("text")).mapInArrow(tidy(run), "doc_id long, fp long")


def _flips(bits: list[int], most: int) -> list[int]:
    return [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(bits, k)]


def _stars(prints: np.ndarray, left: np.ndarray, fixed: int, half: int, at_once: int = AT_ONCE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among fingerprints of one bucket. prints: already with the routed bits flipped; left: flips that each
    may still make; fixed: bits 0..fixed-1 are settled. Returns arrays of positions (member, centre)."""
    if len(prints) < 2:
        return []
    if len(prints) > at_once and fixed < 56:
        out, step = [], 8
        keys, rows, rest = [], [], []
        for flip in _flips(list(range(step)), half):
            cost = bin(flip).count("1")
            ok = np.flatnonzero(left >= cost)
            keys.append((((prints[ok] >> np.uint64(fixed)) & np.uint64(255)) ^ np.uint64(flip)).astype(np.int64))
            rows.append(ok)
            rest.append((prints[ok] ^ np.uint64(flip << fixed), left[ok] - cost))
        key, row = np.concatenate(keys), np.concatenate(rows)
        value, budget = np.concatenate([r[0] for r in rest]), np.concatenate([r[1] for r in rest])
        order = np.argsort(key, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            out += [(row[part][m], row[part][c]) for m, c in _stars(value[part], budget[part], fixed + step, half, at_once)]
        return out
    free = list(range(fixed, 64))
    values, owners = [], []
    for k in range(half + 1):
        ok = np.flatnonzero(left >= k)
        if not len(ok):
            break
        masks = np.array([sum(1 << b for b in c) for c in combinations(free, k)], np.uint64)
        if len(masks):
            values.append((prints[ok][:, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(ok, len(masks)))
    value, owner = np.concatenate(values), np.concatenate(owners)
    ranked = np.sort(value)
    common = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(common):
        return []
    at = np.searchsorted(common, value)
    at[at == len(common)] = 0
    hit = np.flatnonzero(common[at] == value)
    group, member = at[hit], owner[hit]
    order = np.lexsort((member, group))
    group, member = group[order], member[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
    centre = np.repeat(member[first], np.diff(np.concatenate([first, [len(group)]])))
    pair = np.unique(np.stack([member, centre], axis=1)[member != centre], axis=0)
    return [(pair[:, 0], pair[:, 1])] if len(pair) else []


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b), enough of them to connect all that lie within the radius. Even radii
    only: with an odd one, pairs at just that distance have no common variant within half of it."""
    if radius % 2:
        raise ValueError(f"radius must be even, not {radius}")
    half, buckets_bits, n = radius // 2, ROUTE_BITS, prints.count()
    while n * len(_flips(list(range(buckets_bits)), half)) > BUCKET_PRINTS << buckets_bits and buckets_bits < 20:
        buckets_bits += 2

    def route(batches):
        flips = _flips(list(range(buckets_bits)), half)
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            low = fp.view(np.uint64) & np.uint64((1 << buckets_bits) - 1)
            bucket = np.concatenate([(low ^ np.uint64(f)).astype(np.int32) for f in flips])
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.tile(fp, len(flips)))], names=["bucket", "fp"])

    def meet(key, table):
        fp = np.sort(table.column("fp").to_numpy()).view(np.uint64)
        low = np.uint64((1 << buckets_bits) - 1)
        flip = (fp & low) ^ np.uint64(key[0].as_py())
        cost = np.bitwise_count(flip).astype(np.int64)
        found = _stars(fp ^ flip, half - cost, buckets_bits, half)
        if found:
            pair = np.unique(np.concatenate([np.stack(x, axis=1) for x in found]), axis=0)
            a, b = fp[pair[:, 0]], fp[pair[:, 1]]
            near = np.bitwise_count(a ^ b) <= radius  # holds for all; the check that the method asks for
            a, b = _forest(a[near].view(np.int64), b[near].view(np.int64))
        else:
            a = b = np.zeros(0, np.int64)
        return pa.table({"a": a, "b": b})

    return prints.select("fp").mapInArrow(route, "bucket int, fp long").repartition(1 << buckets_bits, "bucket").groupBy("bucket").applyInArrow(meet, "a long, b long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same nodes, one less than nodes in each component: each node to its least one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable), fp, root (the component's
    least fp); one row for each document."""
    docs, _ = stage(fingerprints(documents, shingle), "op4-prints")
    # Exact copies and any other documents of one fingerprint meet here, combined before the shuffle.
    distinct, _ = stage(docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("docs")), "op4-distinct")
    size, total = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    root = components(links(distinct, radius))
    named, _ = stage(distinct.join(root, distinct.fp == root.node, "left").select("fp", "first", "docs", F.coalesce("root", "fp").alias("root")), "op4-named")
    # A component may hold a third of all fingerprints, and a fingerprint a third of all documents: see join_keys.
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    labels, _ = stage(join_keys(named, least, "root", size).select("fp", "component_id", "root", F.col("docs").alias("n")), "op4-labels")
    return join_keys(docs, labels, "fp", total).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp", "root")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("fp", "root")
