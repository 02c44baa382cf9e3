"""Exact substring removal by Rabin-Karp hashes of every window of ``WINDOW`` words.

Documents are dealt into chunks. Each chunk's task hashes all its windows (a polynomial of 64-bit word hashes, rolled by
prefix sums) and sends every distinct hash once to the bucket that its high bits name, as packed arrays, so a passage
that a third of all documents share costs one entry per chunk. Buckets count in how many chunks each hash starts and
answer with one bit per entry; with what repeats inside the chunk itself these are the candidates. Only a part of the
hash travels, of as many bits as keep chance candidates below one in a thousand. Candidates then go the same way again
with 128 bits: the whole polynomial hash, and an independent one of the window's words (XXH3 of their bytes); windows
count as equal if both agree. Windows that overlap or touch merge into maximal intervals, which are removed.

Numbers of chunks and buckets grow with the text, so neither outgrows a task. A chunk sends one message to each bucket
for which it has a hash: fewer messages than windows at any size, and each bucket answers them one by one. Beyond about
a terabyte raise ``chunk_bytes`` with the executors' memory, so that messages stay long.

Defined results: a null text has no words; texts shorter than a window lose nothing; kept words of a text without any
are the empty string; null and repeated doc_ids are kept, every row is a document of its own (so two rows with one
text of 35 words or more lose each other's windows); an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import stage, text_bytes, total_bytes

WINDOW = 35
CHUNK_BYTES = 6 << 20
#: Windows a bucket gets about; a word takes about six bytes.
BUCKET_WINDOWS = 3 << 20
BASE = 0x9E3779B97F4A7C15  # 5 modulo 8: of the highest order modulo 2**64
MAX_WORDS = 150_000
#: A window's polynomial hash, and an independent one of its words.
KEY = np.dtype([("a", "<u8"), ("b", "<u8")])


class _WordHash(dict):
    def __missing__(self, word):
        h = xxhash.xxh64_intdigest(word, 7)
        if len(self) < MAX_WORDS:
            self[word] = h
        return h


_HASHES = _WordHash()


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(texts: list[bytes], window: int) -> tuple[list[np.ndarray], list[int]]:
    """Hashes of all windows of each text, by position, and the texts' numbers of words."""
    look, out, sizes = _HASHES.__getitem__, [], []
    for text in texts:
        words = text.split()
        n = len(words)
        sizes.append(n)
        if n < window:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.fromiter(map(look, words), np.uint64, n)
        power = _powers_upto(n)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[0][:n])])
        out.append(_mix((prefix[window:] - prefix[:-window]) * power[1][: n - window + 1]))
    return out, sizes


_POWERS: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_upto(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 2 * n
        _POWERS[0], _POWERS[1] = _powers(size, BASE), _powers(size, pow(BASE, -1, 1 << 64))
    return _POWERS


def intervals(repeated: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal [start, end) of words that the windows starting at the given ascending positions cover."""
    if not len(repeated):
        return []
    cut = np.flatnonzero(np.diff(repeated) > window)
    starts = repeated[np.concatenate([[0], cut + 1])]
    ends = repeated[np.concatenate([cut, [len(repeated) - 1]])] + window
    return list(zip(starts.tolist(), ends.tolist()))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending in the hash, so ascending distinct hashes fall into runs of buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _runs(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, first, stop) of ascending buckets."""
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, int)
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])]


class _Chunk:
    """The windows of a chunk's texts: hash, text and place of each, and the hashes that travel first."""

    def __init__(self, texts: list[bytes], window: int, drop: int):
        self.texts, self.window = texts, window
        by_text, self.sizes = window_hashes(texts, window)
        self.hash = np.concatenate(by_text) if by_text else np.zeros(0, np.uint64)
        self.ends = np.cumsum([len(h) for h in by_text])
        self.short, counts = np.unique(self.hash >> np.uint64(drop) << np.uint64(drop), return_counts=True)
        self.drop, self.often = drop, counts > 1

    def candidates(self, answers: list[tuple[int, bytes]], buckets: int) -> np.ndarray:
        """Positions of the windows whose short hash starts elsewhere too."""
        repeated = self.often | _answered(_bucket(self.short, buckets), answers)
        return np.flatnonzero(_member(self.hash >> np.uint64(self.drop) << np.uint64(self.drop), self.short[repeated]))

    def keys(self, at: np.ndarray) -> np.ndarray:
        """(hash, independent hash) of the windows at these positions."""
        out = np.zeros(len(at), KEY)
        out["a"] = self.hash[at]
        which = np.searchsorted(self.ends, at, side="right")
        starts = np.concatenate([[0], self.ends[:-1]])
        digest, last = xxhash.xxh3_64_intdigest, -1
        for k, (i, w) in enumerate(zip(which.tolist(), (at - starts[which]).tolist() if len(at) else [])):
            if i != last:
                words = self.texts[i].split()
                line, last = b" ".join(words), i
                stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()
            out["b"][k] = digest(line[stops[w - 1] if w else 0 : stops[w + self.window - 1] - 1])
        return out


def _answered(bucket: np.ndarray, answers: list[tuple[int, bytes]]) -> np.ndarray:
    out, own = np.zeros(len(bucket), bool), {b: (lo, hi) for b, lo, hi in _runs(bucket)}
    for b, bits in answers:
        lo, hi = own[b]
        out[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
    return out


def remove_repeats(documents: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_removed, removed (array of maximal [start, end) intervals of words), kept_text (binary)."""
    size = total_bytes(documents)
    chunks = max(1, -(-size // chunk_bytes))
    buckets = max(1, -(-size // 6 // bucket_windows))
    width = min(8, max(4, -(-(max(1, size // 6).bit_length() + 10) // 8)))  # bytes of a hash that travel first
    drop = 64 - 8 * width
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(documents).alias("text"))
    # By the row's number, so that equal rows part as well.
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int")).repartition(chunks, "chunk")

    def packed(short: np.ndarray) -> bytes:
        return np.ascontiguousarray(short.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()

    def unpacked(data: bytes) -> np.ndarray:
        out = np.zeros((len(data) // width, 8), np.uint8)
        out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
        return out.view(">u8").ravel().astype(np.uint64)

    def messages(key, bucket: np.ndarray, data: list[bytes], runs) -> pa.Table:
        return pa.table({"bucket": pa.array([b for b, _, _ in runs], pa.int32()), "chunk": pa.array([key[0].as_py()] * len(runs), pa.int32()), "hashes": pa.array(data, pa.binary())})

    def send(key, table):
        own = _Chunk(table.column("text").to_pylist(), window, drop)
        runs = _runs(bucket := _bucket(own.short, buckets))
        return messages(key, bucket, [packed(own.short[a:b]) for _, a, b in runs], runs)

    def counted(table, read):
        sent = [read(h) for h in table.column("hashes").to_pylist()]
        distinct, counts = _distinct(np.concatenate(sent))
        repeated = distinct[counts > 1]
        bits = [np.packbits(_member(h, repeated)).tobytes() for h in sent]
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "bits": pa.array(bits, pa.binary())})

    def count(key, table):
        return counted(table, unpacked)

    def count_whole(key, table):
        return counted(table, lambda h: np.frombuffer(h, KEY))

    def pairs(answers) -> list[tuple[int, bytes]]:
        return list(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()))

    def send_whole(key, table, answers):
        if not table.num_rows:
            return messages(key, None, [], [])
        own = _Chunk(table.column("text").to_pylist(), window, drop)
        distinct, _ = _distinct(own.keys(own.candidates(pairs(answers), buckets)))
        runs = _runs(bucket := _bucket(distinct["a"], buckets))
        return messages(key, bucket, [distinct[a:b].tobytes() for _, a, b in runs], runs)

    def cut_out(key, table, answers):
        own = _Chunk(table.column("text").to_pylist(), window, drop)
        # Both answers come in one table, those of short hashes first.
        kind = np.array(answers.column("whole").to_pylist(), bool)
        both = pairs(answers)
        at = own.candidates([x for x, k in zip(both, kind) if not k], buckets)
        keys = own.keys(at)
        distinct, counts = _distinct(keys)
        repeated = (counts > 1) | _answered(_bucket(distinct["a"], buckets), [x for x, k in zip(both, kind) if k])
        wanted = at[_member(keys, distinct[repeated])]
        removed, spans, kept, lo = [], [], [], 0
        for text, end in zip(own.texts, own.ends.tolist()):
            own_at = wanted[np.searchsorted(wanted, lo) : np.searchsorted(wanted, end)] - lo
            gone, lo = intervals(own_at, window), end
            words, left, i = text.split(), [], 0
            for a, b in gone:
                left += words[i:a]
                i = b
            left += words[i:]
            removed.append(len(words) - len(left))
            spans.append([list(x) for x in gone])
            kept.append(b" ".join(left))
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(own.sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "removed": pa.array(spans, pa.list_(pa.list_(pa.int32()))), "kept_text": pa.array(kept, pa.binary())})

    message, answer = "bucket int, chunk int, hashes binary", "bucket int, chunk int, bits binary"
    # One plan, so that the texts are shuffled once and all three uses read that shuffle.
    first = docs.groupBy("chunk").applyInArrow(send, message).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(count, answer)
    sent = docs.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(send_whole, message)
    second = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(count_whole, answer)
    both = first.withColumn("whole", F.lit(False)).union(second.withColumn("whole", F.lit(True)))
    return docs.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(cut_out, "doc_id long, n_words long, n_removed long, removed array<array<int>>, kept_text binary")


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs; of numbers, or of pairs of KEY."""
    if keys.dtype != KEY:
        return np.unique(keys, return_counts=True)
    found = keys[np.argsort(keys["a"], kind="stable")]
    same = found["a"][1:] == found["a"][:-1]
    if (same & (found["b"][1:] != found["b"][:-1])).any():
        found = keys[np.lexsort((keys["b"], keys["a"]))]
    first = np.flatnonzero(np.concatenate([[True], ~same | (found["b"][1:] != found["b"][:-1])])) if len(found) else np.zeros(0, int)
    return found[first], np.diff(np.append(first, len(found)))


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the ascending array; of numbers, or of pairs of KEY."""
    if not len(among):
        return np.zeros(len(values), bool)
    paired = values.dtype == KEY
    first, own = (among["a"], values["a"]) if paired else (among, values)
    at = np.searchsorted(first, own)
    at[at == len(among)] = 0
    found = first[at] == own
    if paired:
        open_ = np.flatnonzero(found)
        found &= among["b"][at] == values["b"]
        open_ = open_[~found[open_]]
        while len(open_):  # another pair with this first hash
            at[open_] += 1
            open_ = open_[at[open_] < len(among)]
            open_ = open_[first[at[open_]] == own[open_]]
            found[open_] = among["b"][at[open_]] == values["b"][open_]
            open_ = open_[~found[open_]]
    return found


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def brute_force(rows: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract word for word, for tests: rows (doc_id, text) -> (doc_id, n_words, n_removed, kept_sha256)."""
    split = [(d, (t or "").encode().split()) for d, t in rows]
    seen: dict[tuple, int] = {}
    for _, w in split:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out
