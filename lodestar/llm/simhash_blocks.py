"""SimHash near-duplicates of a stated shingle similarity: ball hashing over many short fingerprints.

Texts of Jaccard similarity J differ in a share ``angle(J)`` of their SimHash bits (0.15 at J = 0.8), far more than a ball
about one 64-bit fingerprint can hold. So every text has a long print of ``PRINT_BITS`` bits, and fingerprints of it,
each a fixed choice of ``bits`` of them. Every fingerprint emits all variants within half the radius (RADIUS = 2), the
shuffle is by fingerprint, and texts that share a variant are candidates; their long prints and then their exact sets
of shingles are compared. ``plan`` takes so many fingerprints that a pair of similarity ``least`` shares a variant with
a probability of RECALL, and so many bits that unlike texts seldom do, whatever the number of texts.

A fingerprint of more texts than a task should hold is dealt by a few bits of each of three parts of it: of two texts
that differ in two bits one part agrees, so three copies of a row do, however many tasks there are. Fingerprints are dealt some at a time
(``in_rounds``), so that the disk a round's shuffle takes grows with the texts and not with texts times fingerprints.

In each fingerprint a text is first paired with the busiest of those that it shares a variant with (the one that meets
most others overall, such as the template of a family of copies), so that a large group costs no square. Pairs whose long prints
are at all alike (LOOSE) make families. Where texts of a family are not yet in one component after that, ``families``
finds all their links exactly, without a table of their pairs; where texts meet across families, all those pairs are
compared. So no link is lost to the stars.

In a family each set of shingles is told by its difference D from the pivot's set T. Of two sets X and Y the symmetric
difference is that of their D; they are similar if it has at most l = (1 - least) / (1 + least) * (|X| + |Y|) shingles, so
if their D share at least t = (|D(X)| + |D(Y)| - l) / 2. With t <= 0 both are similar to T, which each is compared
with. Else the first shared shingle, in any one order, has |D(X)| - t others at most before it in D(X), and likewise in
D(Y). The order is by how many of the D in a sample of the family have a shingle, rare ones first, so unlike
copies of one template, whose changes differ, seldom meet. The sample only sets the order: no result depends on it.

Defined results: words are lower-cased (ASCII) runs of anything but white space; with fewer words than a shingle has,
the whole sequence is the one shingle; null texts and texts without words are copies of each other; null doc_ids are
kept and rows with one doc_id are documents of their own; an empty table gives an empty one. Word sequences are told
apart by a 64-bit hash.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.joins import join_keys
from lodestar.llm.common import drop, release, slices, stage, text_bytes, tidy
from lodestar.llm.components import components

SHINGLE, LEAST, RECALL = 5, 0.8, 0.995
PRINT_BITS, RADIUS, LEAST_BITS = 512, 2, 36
#: Standard deviations beyond the mean by which the long prints of a pair may differ where it should still meet with a
#: probability of RECALL, and where it is still compared.
MARGIN, TOLERANCE = 2.0, 4.0
#: Similarity at which long prints differ, on the average, as much as those of texts of one family may: far from the half in
#: which unlike texts differ.
LOOSE = 0.25
#: Texts of a family that set the order of its shingles, about; bytes of shingles that a task compares, about; texts that
#: share a shingle and are compared each with each without a look at what they might reach.
SAMPLE, FAMILY_BYTES, SMALL = 64, 16 << 20, 32
#: Pairs of each text that make families, over all fingerprints.
STARS = 8
#: Texts that a task of one fingerprint gets about, and those whose variants it lays out at once.
BUCKET_TEXTS, AT_ONCE = 400_000, 8000
#: Copies of each text that a round of fingerprints shuffles, ROW_BYTES each, or more while a round is below ROUND_BYTES.
ROUND_COPIES, ROUND_BYTES, ROW_BYTES = 24, 256 << 20, 24
SEED = 42
_OFFSETS = np.random.default_rng(SEED).integers(1, 1 << 63, PRINT_BITS // 64, np.uint64)


def angle(similarity: float) -> float:
    """Share of SimHash bits in which two sets of one size and that Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def differing(similarity: float, deviations: float) -> float:
    """Share of its bits in which the long prints of such a pair differ if it is as many deviations beyond the mean."""
    p = angle(similarity)
    return p + deviations * math.sqrt(p * (1 - p) / PRINT_BITS)


def plan(texts: int, least: float = LEAST, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a fingerprint, number of fingerprints)."""
    bits, p = max(LEAST_BITS, 16 + math.ceil(math.log2(max(texts, 1)))), differing(least, MARGIN)
    meets = sum(math.comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(RADIUS + 1))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meets))


def dealing(texts: int) -> tuple[int, int]:
    """(bits that a fingerprint is dealt by, copies of a row that this takes)."""
    route = 0
    while texts > BUCKET_TEXTS << route:
        route += 1
    return route, RADIUS + 1 if route else 1


def rounds(texts: int, number: int) -> list[range]:
    """Fingerprints of each round."""
    own = max(1, max(ROUND_COPIES, ROUND_BYTES // (ROW_BYTES * max(texts, 1))) // dealing(texts)[1])
    return [range(lo, min(lo + own, number)) for lo in range(0, number, own)]


def choices(bits: int, prints: int) -> np.ndarray:
    """(prints, bits) positions in the long print."""
    r = np.random.default_rng(SEED + 1)
    return np.stack([np.sort(r.permutation(PRINT_BITS)[:bits]) for _ in range(prints)])


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 of each run of that many words, ascending."""
    words = text.lower().split()  # ASCII only, both
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def long_print(hashes: np.ndarray) -> np.ndarray:
    """PRINT_BITS bits as 64-bit words: a bit is set if it is set in over half of the shingles' hashes."""
    votes = np.zeros(PRINT_BITS, np.int64)
    for i in range(0, len(hashes), 255):  # votes of so many fit a byte
        words = _mixed(hashes[i : i + 255, None] + _OFFSETS)
        votes += np.unpackbits(words.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets, as sorted distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def text_key(text: bytes) -> int:
    """64-bit hash of a text's lower-case words, signed; 0 without words."""
    words = text.lower().split()
    h = xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return h - (1 << 64) if h >> 63 else h


def prints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """id, fp (text_key) and print (array of longs), one row for each document, staged."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                found = np.stack([long_print(shingles(t, shingle)) for t in texts]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([text_key(t) for t in texts], pa.int64()), lists], names=["id", "fp", "print"])

    rows = documents.select(documents["doc_id"].cast("long").alias("id"), text_bytes(documents).alias("text"))
    return stage(rows.mapInArrow(tidy(run), "id long, fp long, print array<long>"), "long-prints")[0]


def variant_groups(value: np.ndarray, left: np.ndarray, fixed: int, bits: int, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of texts that share a variant: (number of the run, position), runs of two or more in a row. left: bits that
    a text may still flip (0 or 1); bits below fixed are settled."""
    if len(value) < 2:
        return
    some = np.flatnonzero(left)
    # As many bits as bring the parts below at_once, all at one go: splitting a part that is little above again makes tiny ones.
    step = 0
    while step < min(12, bits - fixed) and len(value) + step * len(some) > at_once << step:
        step += 1
    flips = range(fixed, fixed + step) if step else range(fixed, bits)
    key = np.concatenate([value, *[value[some] ^ np.uint64(1 << i) for i in flips]])
    row = np.concatenate([np.arange(len(value)), np.tile(some, len(flips))])
    if step:
        budget = np.concatenate([left, np.zeros(len(key) - len(left), left.dtype)])
        part = ((key >> np.uint64(fixed)) & np.uint64((1 << step) - 1)).astype(np.uint16)  # sorted by radix
        order = np.argsort(part, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            for run, member in variant_groups(key[own], budget[own], fixed + step, bits, at_once):
                yield run, row[own][member]
        return
    # Settled bits are equal here; what is left of a key has room for the position, and plain sorting is much the fastest.
    width = np.uint64(len(value).bit_length())
    packed = ((key >> np.uint64(fixed)) << width) | row.astype(np.uint64)
    packed.sort()
    same = packed[1:] >> width == packed[:-1] >> width
    if same.any():
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        first = shared & ~np.concatenate([[False], same])
        yield np.cumsum(first)[shared], (packed[shared] & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)


def stars(run: np.ndarray, member: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Pairs of positions: each member with the one of the highest rank in any of its runs."""
    order = np.lexsort((rank[member], run))
    run, member = run[order], member[order]
    last = np.flatnonzero(np.concatenate([run[1:] != run[:-1], [True]]))
    centre = np.repeat(member[last], np.diff(np.concatenate([[-1], last])))
    other = member != centre
    member, centre = member[other], centre[other]
    order = np.lexsort((rank[centre], member))
    member, centre = member[order], centre[order]
    best = np.concatenate([member[1:] != member[:-1], [True]]) if len(member) else np.zeros(0, bool)
    return np.stack([member[best], centre[best]], axis=1)


def across(run: np.ndarray, member: np.ndarray, part: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of positions within runs whose parts differ."""
    order = np.lexsort((part[member], run))
    run, member = run[order], member[order]
    edges = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1], [True]]))
    mixed = part[member[edges[:-1]]] != part[member[edges[1:] - 1]]
    for a, b in zip(edges[:-1][mixed], edges[1:][mixed]):
        own = member[a:b]
        for i in range(len(own) - 1):
            others = own[i + 1 :][part[own[i + 1 :]] != part[own[i]]]
            if len(others):
                yield np.stack([np.full(len(others), own[i]), others], axis=1)


def turned(value: np.ndarray, by: int, bits: int) -> np.ndarray:
    """Fingerprints whose bit ``by`` is the lowest one, those below it being the highest."""
    return ((value >> np.uint64(by)) | (value << np.uint64(bits - by))) & np.uint64((1 << bits) - 1)


def dealt(value: np.ndarray, bits: int, route: int, copies: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, positions, fingerprints turned for it): two that differ in fewer bits than there are copies share a
    bucket, in which the lowest ``route`` bits are equal."""
    for part in range(copies):
        own = turned(value, part * bits // copies, bits)
        bucket = (own & np.uint64((1 << route) - 1)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            yield (part << route) + int(bucket[at[0]]), at, own[at]


def meetings(texts: DataFrame, size: int, least: float, numbers: range, what: Callable, schema: str, more: str | None = None) -> DataFrame:
    """texts (fp, print, and a long column ``more``) dealt by the fingerprints of those numbers; what(runs, fp, more)
    yields arrays of columns of ``schema`` for the texts of a task."""
    bits, number = plan(size, least)
    route, copies = dealing(size)
    chosen, names = choices(bits, number)[numbers.start : numbers.stop], [x.split()[0] for x in schema.split(", ")]
    kinds = pa.schema([(n, pa.int64()) for n in names])

    def emit(batches):
        held, n = [], 0

        def rows():
            words, fp, extra = (np.concatenate(c) for c in zip(*held))
            by_bit = np.unpackbits(words.astype("<i8").view(np.uint8), axis=1, bitorder="little").T.copy()
            out = []
            for k, own in enumerate(chosen):
                octets = np.packbits(by_bit[own], axis=0, bitorder="little").astype(np.uint64)
                value = np.bitwise_or.reduce(octets << (np.arange(len(octets), dtype=np.uint64) * np.uint64(8))[:, None], axis=0)
                out += [(((k * copies) << route) + bucket, v.tobytes(), fp[at].tobytes(), extra[at].tobytes()) for bucket, at, v in dealt(value, bits, route, copies)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "value", "fp", "more"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                held.append((part.column("print").flatten().to_numpy().reshape(part.num_rows, -1), part.column("fp").to_numpy(), part.column("more").to_numpy()))
                n += part.num_rows
                if n >= 4096:
                    yield rows()
                    held, n = [], 0
        if n:
            yield rows()

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = [b.select(["value", "fp", "more"]).to_pydict() for b in batches]
        value, fp, extra = (np.frombuffer(b"".join(x for p in packed for x in p[n]), d) for n, d in (("value", "<u8"), ("fp", "<i8"), ("more", "<i8")))
        del packed
        order = np.argsort(fp)
        value, fp, extra = value[order], fp[order], extra[order]
        for columns in what(variant_groups(value, np.ones(len(value), np.int64), route, bits), fp, extra):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=kinds)
        release()

    rows = texts.select("fp", "print", (F.col(more) if more else F.lit(0)).cast("long").alias("more"))
    packed = rows.mapInArrow(tidy(emit), "bucket int, value binary, fp binary, more binary")
    return packed.repartition(min((len(numbers) * copies) << route, 4096), "bucket").groupBy("bucket").applyInArrow(meet, schema)


def in_rounds(texts: DataFrame, size: int, least: float, name: str, combined: Callable[[DataFrame], DataFrame], what: Callable, schema: str, more: str | None = None) -> DataFrame:
    """combined, a function of tables, of all meetings, staged. It is applied to each round, whose shuffle is gone
    before the next one's, and then to all that the rounds left."""
    parts = [stage(combined(meetings(texts, size, least, own, what, schema, more)), f"{name}-round", alone=True) for own in rounds(size, plan(size, least)[1])]
    if len(parts) == 1:
        return parts[0][0]
    found = stage(combined(functools.reduce(DataFrame.union, [p for p, _ in parts])), name, alone=True)[0]
    drop(texts.sparkSession, *[path for _, path in parts])
    return found


def _count(groups, fp, _):
    total = np.zeros(len(fp), np.int64)
    for run, member in groups:
        np.add.at(total, member, np.bincount(run)[run] - 1)
    met = np.flatnonzero(total)
    if len(met):
        yield fp[met], total[met]


def _named(fp: np.ndarray, pairs: np.ndarray):
    a, b = fp[pairs[:, 0]], fp[pairs[:, 1]]
    return np.minimum(a, b), np.maximum(a, b)


def _star_pairs(groups, fp, met):
    """One pair at most for each text of a task, however many of its variants meet others."""
    rank = np.lexsort((fp, met)).argsort()
    best = np.full(len(fp), -1)
    for run, member in groups:
        a, b = stars(run, member, rank).T
        better = (best[a] < 0) | (rank[b] > rank[best[a]])
        best[a[better]] = b[better]
    own = np.flatnonzero(best >= 0)
    if len(own):
        yield fp[own], fp[best[own]], met[best[own]]


def busiest(pairs: DataFrame) -> DataFrame:
    """Of each text's pairs (fp, other, met) the STARS with the busiest others. This only makes families: where the other
    pairs are links, ``families`` or the pass across families finds them."""
    best = F.slice(F.sort_array(F.collect_set(F.struct("met", "other")), asc=False), 1, STARS)
    return pairs.groupBy("fp").agg(best.alias("best")).select("fp", F.explode("best").alias("x")).select("fp", "x.other", "x.met")


def _cross_pairs(groups, fp, root):
    for run, member in groups:
        held, n = [], 0
        for pairs in across(run, member, root):
            held.append(pairs)
            n += len(pairs)
            if n >= 100_000:
                yield _named(fp, np.unique(np.concatenate(held), axis=0))
                held, n = [], 0
        if held:
            yield _named(fp, np.unique(np.concatenate(held), axis=0))


def close_prints(pairs: DataFrame, texts: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) whose long prints differ in at most that share of their bits, and in how many (differ)."""
    x, y = (texts.select(F.col("fp").alias(n), F.col("print").alias(m)) for n, m in (("a", "x"), ("b", "y")))
    differ = F.aggregate(F.zip_with("x", "y", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, n: s + n)
    return pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", differ.alias("differ")).where(F.col("differ") <= int(PRINT_BITS * share))


def paired_texts(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs, staged ones, with all their columns and the texts x of a and y of b, in runs of one a."""

    def named(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([text_key(t.as_py()) for t in batch.column("text")], pa.int64()), batch.column("text")], names=["fp", "text"])

    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = documents.select(text_bytes(documents).alias("text")).mapInArrow(tidy(named), "fp long, text binary")
    # Exact copies, however many, are one text here, combined before the shuffle.
    distinct = texts.groupBy("fp").agg(F.first("text").alias("text"))
    needed, _ = stage(distinct.join(nodes.hint("merge"), F.col("fp") == F.col("node"), "left_semi"), "pair-texts")
    x = needed.select(F.col("fp").alias("a"), F.col("text").alias("x"))
    y = needed.select(F.col("fp").alias("b"), F.col("text").alias("y"))
    return pairs.join(y.hint("merge"), "b").join(x.hint("merge"), "a")


def similar(documents: DataFrame, pairs: DataFrame, least: float = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b), staged ones, whose texts have at least that similarity, staged."""

    def compared(batches):
        last, mine = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                keep = []
                for a, x, y in zip(part.column("a").to_pylist(), part.column("x").to_pylist(), part.column("y").to_pylist()):
                    if a != last:
                        last, mine = a, shingles(x, shingle)
                    keep.append(jaccard(mine, shingles(y, shingle)) >= least)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stage(paired_texts(documents, pairs).select("a", "b", "x", "y").mapInArrow(tidy(compared), "a long, b long"), "similar")[0]


def changes(documents: DataFrame, members: DataFrame, least: float, shingle: int) -> DataFrame:
    """members (a, the pivot of a family; b, another text of it; root), staged, with the size of b's set, its difference
    from a's (packed 64-bit shingles) and whether the two are similar; staged."""

    def run(batches):
        last, mine = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part, out = batch.slice(lo, 64), []
                for a, x, y in zip(part.column("a").to_pylist(), part.column("x").to_pylist(), part.column("y").to_pylist()):
                    if a != last:
                        last, mine = a, shingles(x, shingle)
                    own = shingles(y, shingle)
                    out.append((len(own), np.setxor1d(mine, own, assume_unique=True).tobytes(), jaccard(mine, own) >= least))
                more = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("a", "b", "root")), *more], names=["a", "b", "root", "size", "change", "linked"])

    rows = paired_texts(documents, members).select("a", "b", "root", "x", "y")
    return stage(rows.mapInArrow(tidy(run), "a long, b long, root long, size long, change binary, linked boolean"), "changes")[0]


def usual(sample: DataFrame) -> DataFrame:
    """(a, packed shingles, packed counts) of those that two or more of a family's sampled differences have."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = np.unique(np.frombuffer(b"".join(c for b in batches for c in b.column("change").to_pylist()), np.uint64), return_counts=True)
        have, n = have[n > 1], n[n > 1].astype("<i4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([have.tobytes()]), pa.array([n.tobytes()])], names=["a", "have", "n"])

    return sample.select("a", "change").groupBy("a").applyInArrow(run, "a long, have binary, n binary")


def rare_first(change: np.ndarray, have: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The shingles by their counts n (have, ascending, are those with one), then by value."""
    count = np.zeros(len(change), np.int64)
    if len(have):
        at = np.minimum(np.searchsorted(have, change), len(have) - 1)
        count = np.where(have[at] == change, n[at], 0)
    return change[np.lexsort((change, count))]


def reach(size: int, least: float) -> int:
    """Shingles by which a set of that size and a similar one differ at most."""
    return int((1 - least) / least * size + 1e-9)


#: Of a shingle of a text's difference: which (and of which family), the text, its component, the size of its set and of the difference, the place.
ENTRY = np.dtype([("key", "<u8"), ("fp", "<i8"), ("root", "<i8"), ("size", "<i4"), ("change", "<i4"), ("place", "<i4")])


def sharing(entries: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """Pairs of positions, of different components, that may be similar by a shingle that both have; entries are in order
    of their keys."""
    key, root = entries["key"], entries["root"]
    size, change, place = (entries[n].astype(np.int64) for n in ("size", "change", "place"))
    part = (1 - least) / (1 + least)

    def pairs(i, j):
        most = np.floor(part * (size[i] + size[j]) + 1e-9).astype(np.int64)
        shared = (change[i] + change[j] - most + 1) // 2
        good = (root[i] != root[j]) & (shared > 0) & (place[i] <= change[i] - shared) & (place[j] <= change[j] - shared)
        return np.stack([i[good], j[good]], axis=1)

    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    length = np.diff(edges)
    small = np.repeat(length <= SMALL, length)
    for step in range(1, SMALL):
        first = np.flatnonzero(small[: len(key) - step] & (key[step:] == key[: len(key) - step]))
        if not len(first):
            break
        yield pairs(first, first + step)
    for lo in np.flatnonzero(length > SMALL).tolist():
        own = np.arange(edges[lo], edges[lo + 1])
        # A text's place lets it reach others with differences of at most ``limit``, and only those whose limit reaches it.
        limit = np.floor((1 - least) / least * size[own] + 1e-9).astype(np.int64) + change[own] - 2 * place[own]
        while len(own):
            keep = (change[own] <= limit.max()) & (limit >= change[own].min())
            if keep.all():
                break
            own, limit = own[keep], limit[keep]
        names, which, n = np.unique(root[own], return_inverse=True, return_counts=True)
        if len(names) < 2:
            continue
        # Each text but those of the largest component, with the others in order of their differences up to its limit.
        order = np.argsort(change[own], kind="stable")
        own, limit, which = own[order], limit[order], which[order]
        upto = np.searchsorted(change[own], limit, side="right")
        for i in np.flatnonzero(which != n.argmax()).tolist():
            others = own[: upto[i]][limit[: upto[i]] >= change[own[i]]]
            yield pairs(np.full(len(others), own[i]), others)


def in_families(parts: DataFrame, alike: DataFrame) -> DataFrame:
    """(root, family, n: texts) of each component: of those that pairs (a, b) of ``alike`` join it with, the one with the
    busiest text, then that one's, four times over. Families are any sets of whole components; these only save work."""
    groups, _ = stage(parts.groupBy("root").agg(F.max(F.struct("met", "fp")).alias("top"), F.count(F.lit(1)).alias("n")), "groups")
    x, y = (parts.select(F.col("fp").alias(f"of_{n}"), F.col("root").alias(f"root_{n}")) for n in "ab")
    met = alike.join(x.hint("merge"), F.col("a") == F.col("of_a")).join(y.hint("merge"), F.col("b") == F.col("of_b")).where("root_a <> root_b").select("root_a", "root_b").distinct()
    both = met.union(met.select("root_b", "root_a")).toDF("root", "other")
    best = both.join(groups.select(F.col("root").alias("other"), F.col("top").alias("best")).hint("merge"), "other").groupBy("root").agg(F.max_by("other", "best").alias("other"), F.max("best").alias("best"))
    found = groups.join(best.hint("merge"), "root", "left").select("root", F.when(F.col("best") > F.col("top"), F.col("other")).otherwise(F.col("root")).alias("family"), "n")
    for _ in range(2):
        found, _ = stage(found, "family-hops")
        on = found.where("root <> family").select(F.col("root").alias("at"), F.col("family").alias("next"))
        found = found.join(on.hint("merge"), F.col("family") == F.col("at"), "left").select("root", F.coalesce("next", "family").alias("family"), "n")
    return found


def families(documents: DataFrame, members: DataFrame, least: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Of members (a, the pivot of a family; b, another text of it; root; texts, how many the family has), staged: links (a, b) to
    pivots, and pairs (a, b) of different components to compare, among them all similar ones that no links to the pivot join."""
    found = changes(documents, members.select("a", "b", "root"), least, shingle)
    sample = found.join(members.where(F.pmod(F.xxhash64("b"), F.ceil(F.col("texts") / SAMPLE)) == 0).select("b").hint("merge"), "b", "left_semi")
    order = stage(usual(sample), "usual")[0]
    total = found.agg(F.sum(F.octet_length("change"))).first()[0] or 0
    buckets = max(1, -(-total // 8 * ENTRY.itemsize // FAMILY_BYTES))

    def emit(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                held = []
                for r in batch.slice(lo, 256).to_pylist():
                    change = np.frombuffer(r["change"], np.uint64)
                    own = rare_first(change, np.frombuffer(r["have"] or b"", np.uint64), np.frombuffer(r["n"] or b"", "<i4"))[: reach(r["size"], least) + 1]
                    entry = np.zeros(len(own), ENTRY)
                    entry["key"] = _mixed(own ^ _mixed(np.array([r["a"]], np.int64).view(np.uint64)))
                    entry["fp"], entry["root"], entry["size"], entry["change"], entry["place"] = r["b"], r["root"], r["size"], len(change), np.arange(len(own))
                    held.append(entry)
                entry = np.concatenate(held)
                bucket = entry["key"] % np.uint64(buckets)
                by = np.argsort(bucket, kind="stable")
                parts = [p for p in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(p)]
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[p[0]]) for p in parts], pa.int32()), pa.array([entry[p].tobytes() for p in parts], pa.binary())], names=["bucket", "entries"])

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = np.frombuffer(b"".join(e for b in batches for e in b.column("entries").to_pylist()), ENTRY)
        entries = entries[np.argsort(entries["key"], kind="stable")]
        held, n = [], 0
        for pairs in itertools.chain(sharing(entries, least), [None]):
            if pairs is not None:
                held.append(pairs)
                n += len(pairs)
            if n >= 100_000 or pairs is None and n:
                a, b = np.unique(np.stack(_named(entries["fp"], np.concatenate(held)), axis=1), axis=0).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                held, n = [], 0
        release()

    rows = found.join(order.hint("merge"), "a", "left").select("a", "b", "root", "size", "change", "have", "n")
    dealt = rows.mapInArrow(tidy(emit), "bucket int, entries binary").repartition(min(buckets, 4096), "bucket")
    pairs = stage(dealt.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct(), "family-pairs")[0]
    return found.where("linked").select("a", "b"), pairs


def near_duplicates(documents: DataFrame, least: float = LEAST, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of each document, and (fp, root), the component's least fp, of each distinct word sequence that has a
    partner; both staged."""
    rows = prints(documents, shingle)
    texts, _ = stage(rows.where("fp <> 0").groupBy("fp").agg(F.first("print").alias("print")), "distinct-prints")
    size, rows = texts.count(), rows.select("id", "fp")
    met = in_rounds(texts, size, least, "met", lambda t: t.groupBy("fp").agg(F.sum("met").alias("met")), _count, "fp long, met long")
    texts, _ = stage(texts.join(met.hint("merge"), "fp"), "long-prints-met")
    first = in_rounds(texts, size, least, "stars", busiest, _star_pairs, "fp long, other long, met long", "met")
    first, _ = stage(first.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct(), "stars")
    alike, _ = stage(close_prints(first, texts, angle(LOOSE)), "star-pairs")
    close = differing(least, TOLERANCE)
    links = similar(documents, alike.where(F.col("differ") <= int(PRINT_BITS * close)).select("a", "b"), least, shingle)
    root = components(links).select(F.col("node").alias("fp"), "root")
    parts, _ = stage(texts.join(root.hint("merge"), "fp", "left").select("fp", "print", "met", F.coalesce("root", "fp").alias("root")), "parts")
    groups, _ = stage(in_families(parts, alike), "families")
    parts, _ = stage(join_keys(parts, groups, "root", size), "parts")
    several = parts.groupBy("family").agg(F.max_by("fp", F.struct("met", "fp")).alias("a"), F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    several, _ = stage(several.select("family", "a", "n"), "pivots")
    members, _ = stage(join_keys(parts, several.withColumn("texts", F.col("n")), "family", size).where("fp <> a").select("a", F.col("fp").alias("b"), "root", "texts"), "members")
    rest = in_rounds(parts, size, least, "cross", DataFrame.distinct, _cross_pairs, "a long, b long", "family")
    rest, _ = stage(close_prints(rest.join(first.hint("merge"), ["a", "b"], "left_anti"), texts, close).select("a", "b"), "cross-pairs")
    links = rest.limit(0)
    if members.take(1):
        links, pairs = families(documents, members, least, shingle)
        rest = rest.union(pairs)
    if rest.take(1):
        links = links.union(similar(documents, rest, least, shingle))
    # Links within a component tell nothing new, and mostly there are no others.
    own = parts.where("fp <> root").select("fp", "root")
    x, y = (own.select(F.col("fp").alias(n), F.col("root").alias(m)) for n, m in (("a", "x"), ("b", "y")))
    new = links.join(x.hint("merge"), "a", "left").join(y.hint("merge"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    new, _ = stage(new.where("a <> b").distinct(), "new-links")
    if new.take(1):
        merged = components(new).select(F.col("node").alias("old"), F.col("root").alias("least"))
        root = stage(parts.select("fp", "root").join(merged.hint("merge"), F.col("root") == F.col("old"), "left").select("fp", F.coalesce("least", "root").alias("root")).where("fp <> root"), "roots")[0]
    return rows, root


def representatives(documents: DataFrame, least: float = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """documents without near copies: of each component the row with the least doc_id (a null one comes last), and of
    rows with one doc_id and one word sequence a single one. All columns stay as they are, whatever their names."""
    found, root = near_duplicates(documents, least, shingle)
    rows = found.groupBy("id", "fp").agg(F.count(F.lit(1)).alias("n")).join(root.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "n")).alias("x")).select(F.col("x.id").alias("kid"), F.col("x.fp").alias("kfp"), F.col("x.n").alias("n"))
    kept, _ = stage(kept, "representatives")
    packed = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("row"), documents["doc_id"].cast("long").alias("id"), text_bytes(documents).alias("text"))
    schema = T.StructType([packed.schema["row"], packed.schema["id"], T.StructField("fp", T.LongType())])

    def named(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array([text_key(t.as_py()) for t in batch.column("text")], pa.int64())], names=["row", "id", "fp"])

    keyed = packed.mapInArrow(tidy(named), schema)
    same = F.col("id").eqNullSafe(F.col("kid")) & (F.col("fp") == F.col("kfp"))
    # As many rows are kept as there are components, so they are never broadcast, whatever the size.
    single = keyed.join(kept.where("n = 1").hint("merge"), same, "left_semi").select("row.*")
    if not kept.where("n > 1").take(1):
        return single
    copies = keyed.join(kept.where("n > 1").hint("merge"), same, "left_semi").groupBy("id", "fp").agg(F.first("row").alias("row"))
    return single.union(copies.select("row.*"))
