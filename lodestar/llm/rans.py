"""Token-id files compressed by a static range asymmetric numeral system.

``write_token_files`` encodes every text, appends the end id, and writes one continuous stream of ids, in ascending
doc_id order, as blocks of at most ``block_tokens`` ids. One table of symbol frequencies, counted over all documents,
serves all blocks. A block is coded on its own: its ids go round ``lanes`` interleaved coder states that share one
sequence of 32-bit words, and after every ``step_tokens`` steps a checkpoint holds the states and the place in the
words, so a reader decodes the segments between checkpoints side by side. Payload and ids have a CRC-32 each.

Files (Parquet containers, written by Spark's committer into ``path``):
  symbols  symbol, frequency (they sum to 2**PRECISION)
  shards   shard, start, n_tokens, n_documents
  blocks   shard, block, n_tokens, lanes, step_tokens, payload_crc32, ids_crc32, checkpoints, payload, and the
           directory of the document pieces within the block: doc_ids, doc_seqs, doc_starts, piece_ends
Checksums are of ids as little-endian unsigned 32-bit numbers, whatever the width of the ids on the way.

Defined results: a null text counts as empty and still gets the end id; null doc_ids come first; rows of one doc_id
come in the order of a hash of their text, then of the text, and each row is a document of its own; an empty table
gives empty files; columns other than doc_id and text are not looked at. A document may be longer than a block.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import tokens
from lodestar.llm.common import drop, new_path, slices, stage, tidy, total_bytes

PRECISION = 22
LOW = np.uint64(1 << 31)
LANES = 32
STEP_TOKENS = 256
BLOCK_TOKENS = 32 * 1024
#: Bytes of text a shard holds about. A task gets a shard as one Arrow batch, so this bounds its memory.
SHARD_BYTES = 8 << 20
#: Shards whose starts are summed in one task; their sums are summed in another.
SHARD_GROUP = 4096
#: Blocks that are coded side by side.
AT_ONCE = 16

#: ids: 16-bit numbers if they take 2 * n_tokens bytes, else 32-bit ones.
_BLOCK = "shard int, block int, n_tokens int, ids binary, doc_ids array<long>, doc_seqs array<long>, doc_starts array<long>, piece_ends array<int>"
_CODED = "shard int, block int, n_tokens int, lanes int, step_tokens int, payload_crc32 long, ids_crc32 long, checkpoints binary, payload binary, doc_ids array<long>, doc_seqs array<long>, doc_starts array<long>, piece_ends array<int>"


def scaled_frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**PRECISION, at least 1 for each symbol that occurs; deterministic."""
    total, room = int(counts.sum()), 1 << PRECISION
    if not total:
        return np.zeros(len(counts), np.uint64)
    used = counts > 0
    if used.sum() > room:
        raise ValueError("more symbols than the precision has slots")
    free = room - int(used.sum())
    share = counts.astype(object) * free
    out = used.astype(np.int64) + np.array([int(x) // total for x in share], np.int64)
    out[int(np.argmax(counts))] += room - int(out.sum())
    return out.astype(np.uint64)


def encode_block(ids: np.ndarray, frequency: np.ndarray, lower: np.ndarray, lanes: int = LANES, step_tokens: int = STEP_TOKENS) -> tuple[bytes, bytes]:
    """(checkpoints, payload) of one block."""
    coded = encode_blocks([ids], frequency, lower, lanes, step_tokens)
    return coded[0]


def encode_blocks(blocks: list[np.ndarray], frequency: np.ndarray, lower: np.ndarray, lanes: int, step_tokens: int) -> list[tuple[bytes, bytes]]:
    """Blocks side by side: every step codes one symbol of each lane of each block. Short blocks are filled up with
    their first symbol at the end; the reader cuts that off."""
    steps = max(-(-len(b) // lanes) for b in blocks)
    n = len(blocks)
    grid = np.empty((n, steps * lanes), np.int32)
    for i, b in enumerate(blocks):
        grid[i, : len(b)] = b
        grid[i, len(b) :] = b[0]
    grid = grid.reshape(n, steps, lanes)
    own_steps = np.array([-(-len(b) // lanes) for b in blocks])
    state = np.full((n, lanes), LOW, np.uint64)
    emitted = np.zeros((steps, n, lanes), bool)
    words = np.zeros((steps, n, lanes), np.uint32)
    marks = {}
    shift, precision = np.uint64(32), np.uint64(PRECISION)
    top = np.uint64(31 - PRECISION + 32)
    for t in range(steps - 1, -1, -1):
        live = own_steps > t
        symbols = grid[:, t, :]
        f, c = frequency[symbols], lower[symbols]
        over = (state >= (f << top)) & live[:, None]
        emitted[t] = over
        words[t] = state.astype(np.uint32)
        x = np.where(over, state >> shift, state)
        q = x // f
        state = np.where(live[:, None], (q << precision) + (x - q * f) + c, state)
        if t % step_tokens == 0:
            marks[t] = state.copy()
    out = []
    at = np.concatenate([np.zeros((1, n), np.int64), np.cumsum(emitted.sum(axis=2), axis=0)])
    for i, b in enumerate(blocks):
        s = int(own_steps[i])
        checks = b"".join(marks[t][i].astype("<u8").tobytes() + int(at[t, i]).to_bytes(8, "little") for t in range(0, s, step_tokens))
        out.append((checks, words[:s, i][emitted[:s, i]].astype("<u4").tobytes()))
    return out


def decode_block(checkpoints: bytes, payload: bytes, n_tokens: int, symbol: np.ndarray, frequency: np.ndarray, lower: np.ndarray, lanes: int = LANES, step_tokens: int = STEP_TOKENS) -> np.ndarray:
    return decode_blocks([(checkpoints, payload, n_tokens)], symbol, frequency, lower, lanes, step_tokens)[0]


def decode_blocks(blocks: list[tuple[bytes, bytes, int]], symbol: np.ndarray, frequency: np.ndarray, lower: np.ndarray, lanes: int, step_tokens: int) -> list[np.ndarray]:
    """All segments between checkpoints, of all blocks, side by side. symbol: of each of the 2**PRECISION slots."""
    states, places, lefts, first, base = [], [], [], [0], 0
    width = 8 * lanes + 8
    words = np.concatenate([np.frombuffer(p, "<u4") for _, p, _ in blocks] + [np.zeros(lanes, np.uint32)])
    for checks, payload, n in blocks:
        steps = -(-n // lanes)
        for k in range(len(checks) // width):
            part = checks[k * width : (k + 1) * width]
            states.append(np.frombuffer(part[:-8], "<u8"))
            places.append(base + int.from_bytes(part[-8:], "little"))
            lefts.append(min(step_tokens, steps - k * step_tokens))
        base += len(payload) // 4
        first.append(len(states))
    state, place, left = np.array(states, np.uint64), np.array(places, np.int64), np.array(lefts)
    out = np.zeros((len(states), step_tokens, lanes), np.uint32)
    mask, precision, shift = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION), np.uint64(32)
    for t in range(int(left.max())):
        live = (left > t)[:, None]
        slot = state & mask
        s = symbol[slot.astype(np.int64)]
        out[:, t] = s
        x = frequency[s] * (state >> precision) + slot - lower[s]
        need = (x < LOW) & live
        order = np.cumsum(need, axis=1)
        read = words[np.where(need, place[:, None] + order - 1, len(words) - 1)]
        state = np.where(live, np.where(need, (x << shift) | read, x), state)
        place += order[:, -1]
    return [out[a:b].reshape(-1)[: blocks[i][2]] for i, (a, b) in enumerate(zip(first, first[1:]))]


def _slots(symbols: np.ndarray, frequencies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """symbol of each slot, and frequency and lower bound by symbol."""
    size = int(symbols.max()) + 1 if len(symbols) else 1
    frequency = np.zeros(size, np.uint64)
    frequency[symbols] = frequencies
    lower = np.cumsum(frequency) - frequency
    return np.repeat(np.arange(size, dtype=np.uint32), frequency.astype(np.int64)), frequency, lower


def _tokenize(vocabulary: str, end_id: int, block_tokens: int):
    """Rows in order -> blocks of ids with their directories."""

    def run(batches):
        shard, seq, start, block = TaskContext.get().partitionId(), 0, 0, 0
        encoder = tokens.encoder(vocabulary)
        held, filled, pieces = [], 0, []  # the open block: arrays, ids so far, (doc_id, seq, start, end within the block)

        def flush():
            nonlocal held, filled, pieces, block
            row = {"shard": shard, "block": block, "n_tokens": filled, "ids": _packed(np.concatenate(held))}
            row |= {k: [p[i] for p in pieces] for i, k in enumerate(("doc_ids", "doc_seqs", "doc_starts", "piece_ends"))}
            held, filled, pieces, block = [], 0, [], block + 1
            return row

        for batch in batches:
            for part in slices(batch):
                ids, sizes = encoder.encode(part.column("text").to_pylist())
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id)
                ids = ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else ids
                rows, at = [], 0
                for doc_id, size in zip(part.column("doc_id").to_pylist(), (sizes + 1).tolist()):
                    done = 0
                    while done < size:
                        take = min(size - done, block_tokens - filled)
                        held.append(ids[at + done : at + done + take].copy())  # else all of ids stays
                        filled, done = filled + take, done + take
                        pieces.append((doc_id, seq, start, filled))
                        if filled == block_tokens:
                            rows.append(flush())
                    at, seq, start = at + size, seq + 1, start + size
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_arrow(_BLOCK))
        if filled:
            yield pa.RecordBatch.from_pylist([flush()], schema=_arrow(_BLOCK))
        # The encoder's bounded tables stay for the worker's next shard, which would fill them anew.

    return run


def _packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes()


def _unpacked(ids: bytes, n_tokens: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n_tokens else "<u4")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(f.rsplit(" ", 1)[0].strip(), kinds[f.rsplit(" ", 1)[1]]) for f in ddl.split(", ")])


def _count(batches):
    total = np.zeros(1, np.int64)
    for batch in batches:
        for ids, n in zip(batch.column("ids"), batch.column("n_tokens").to_pylist()):
            here = np.bincount(_unpacked(ids.as_py(), n))
            if len(here) > len(total):
                here, total = total, here.astype(np.int64)
            total[: len(here)] += here
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["symbol", "n"])


def _encode(symbols: list[int], frequencies: list[int], lanes: int, step_tokens: int):
    def run(batches):
        _, frequency, lower = _slots(np.array(symbols, np.int64), np.array(frequencies, np.uint64))
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                rows = batch.slice(lo, AT_ONCE).to_pylist()
                blocks = [_unpacked(r.pop("ids"), r["n_tokens"]) for r in rows]
                for r, own, (checks, payload) in zip(rows, blocks, encode_blocks(blocks, frequency, lower, lanes, step_tokens)):
                    r |= {"lanes": lanes, "step_tokens": step_tokens, "ids_crc32": zlib.crc32(own.astype("<u4").tobytes()), "payload_crc32": zlib.crc32(checks + payload), "checkpoints": checks, "payload": payload}
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow(_CODED))

    return run


def write_token_files(documents: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1, block_tokens: int = BLOCK_TOKENS, lanes: int = LANES, step_tokens: int = STEP_TOKENS, shard_bytes: int = SHARD_BYTES) -> str:
    """Encode all documents (doc_id, text) into files below path; see the module for the format."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n_shards = max(1, -(-total_bytes(docs) // shard_bytes))
    # The last key parts rows that are equal in all else, however many there are.
    order = ["doc_id", "_hash", "_part"]
    dealt = docs.withColumns({"_hash": F.xxhash64("text"), "_part": F.rand(5)}).repartitionByRange(n_shards, *order).sortWithinPartitions("doc_id", "_hash", "text")
    raw, staged = stage(dealt.select("doc_id", "text").mapInArrow(tidy(_tokenize(vocabulary or tokens.default_path(), end_id, block_tokens)), _BLOCK), "op1-ids")
    # One row per symbol, so as many as the vocabulary has at most.
    counted = raw.select("ids", "n_tokens").mapInArrow(_count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).orderBy("symbol").collect()
    symbols = [r["symbol"] for r in counted]
    scaled = scaled_frequencies(np.array([r["n"] for r in counted], np.int64)).tolist() if counted else []
    spark.createDataFrame(list(zip(symbols, map(int, scaled))), "symbol long, frequency long").coalesce(1).write.parquet(f"{path}/symbols")
    raw.mapInArrow(tidy(_encode(symbols, scaled, lanes, step_tokens)), _CODED).write.option("compression", "none").parquet(f"{path}/blocks")
    _shard_starts(spark.read.schema(_CODED).parquet(f"{path}/blocks")).write.parquet(f"{path}/shards")
    drop(spark, staged)
    return path


def _shard_starts(blocks: DataFrame, group: int = SHARD_GROUP) -> DataFrame:
    """shard, start, n_tokens, n_documents: running sums within groups of shards, and of the groups before."""
    sizes = blocks.groupBy("shard").agg(F.sum(F.col("n_tokens").cast("long")).alias("n_tokens"), F.max(F.array_max("doc_seqs") + 1).alias("n_documents")).withColumn("g", F.floor(F.col("shard") / group))
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sizes.groupBy("g").agg(F.sum("n_tokens").alias("n_tokens")).select("g", before(Window.orderBy("g")).alias("base"))
    within = sizes.withColumn("own", before(Window.partitionBy("g").orderBy("shard")))
    return within.join(groups, "g").select("shard", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "n_documents")


def _decoded(spark: SparkSession, path: str, check: bool):
    """A function from batches of coded blocks to lists of (row, ids), some blocks at a time."""
    table = spark.read.parquet(f"{path}/symbols").orderBy("symbol").collect()  # the vocabulary's size at most
    symbols, frequencies = [r["symbol"] for r in table], [r["frequency"] for r in table]

    def run(batches):
        symbol, frequency, lower = _slots(np.array(symbols, np.int64), np.array(frequencies, np.uint64))
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                rows, out = batch.slice(lo, AT_ONCE).to_pylist(), []
                if check and (bad := [(r["shard"], r["block"]) for r in rows if zlib.crc32(r["checkpoints"] + r["payload"]) != r["payload_crc32"]]):
                    raise ValueError(f"damaged payload in (shard, block) {bad}")
                groups: dict[tuple, list] = {}
                for r in rows:
                    groups.setdefault((r["lanes"], r["step_tokens"]), []).append(r)
                for (lanes, step), group in groups.items():
                    for r, ids in zip(group, decode_blocks([(r["checkpoints"], r["payload"], r["n_tokens"]) for r in group], symbol, frequency, lower, lanes, step)):
                        ids = ids.astype("<u4").tobytes()
                        if check and zlib.crc32(ids) != r["ids_crc32"]:
                            raise ValueError(f"damaged ids in (shard, block) {(r['shard'], r['block'])}")
                        out.append((r, ids))
                yield out

    return run


def read_blocks(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """The files' ids: shard, block, ids (little-endian unsigned 32-bit) and the directory of each block. A wrong
    checksum raises an error that names the block."""
    decoded = _decoded(spark, path, check)

    def run(batches):
        for found in decoded(batches):
            yield pa.RecordBatch.from_pylist([{k: ids if k == "ids" else r[k] for k in _arrow(_BLOCK).names} for r, ids in found], schema=_arrow(_BLOCK))

    return spark.read.schema(_CODED).parquet(f"{path}/blocks").mapInArrow(run, _BLOCK)


_PIECE = "doc_id long, shard int, doc_seq long, doc_start long, block int, length long, crc long"


def read_pieces(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Each document's piece in each block: length, and CRC-32 of its decoded ids. Decoding and digest run in one worker."""
    decoded = _decoded(spark, path, check)

    def run(batches):
        schema = _arrow(_PIECE)
        for found in decoded(batches):
            rows = []
            for r, ids in found:
                lo = 0
                for doc_id, seq, start, hi in zip(r["doc_ids"], r["doc_seqs"], r["doc_starts"], r["piece_ends"]):
                    rows.append((doc_id, r["shard"], seq, start, r["block"], hi - lo, zlib.crc32(ids[4 * lo : 4 * hi])))
                    lo = hi
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spark.read.schema(_CODED).parquet(f"{path}/blocks").mapInArrow(tidy(run), _PIECE)


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def _zero_runs() -> list[list[int]]:
    """Matrices that move a CRC-32 over 1, 2, 4, ... zero bytes: the one of a zero bit, squared again and again."""
    matrix, out = [0xEDB88320] + [1 << i for i in range(31)], []
    for k in range(3 + 48):
        if k >= 3:
            out.append(matrix)
        matrix = [_times(matrix, r) for r in matrix]
    return out


_ZERO_RUNS = _zero_runs()


def crc32_join(a: int, b: int, length: int) -> int:
    """CRC-32 of two byte strings in a row, from their CRCs and the second one's length (below 2**48)."""
    for matrix in _ZERO_RUNS:
        if not length:
            break
        if length & 1:
            a = _times(matrix, a)
        length >>= 1
    return a ^ b


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    pieces = read_pieces(spark, path)
    whole = pieces.groupBy("shard", "doc_seq").agg(F.first("doc_id").alias("doc_id"), F.first("doc_start").alias("doc_start"), F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("block", "length", "crc"))).alias("parts"))

    def join(batches):
        for batch in batches:
            parts = batch.column("parts")
            _, length, crc = (c.to_numpy() for c in parts.flatten().flatten())
            ends = np.cumsum(parts.value_lengths().to_numpy())
            first = np.concatenate([[0], ends[:-1]])[: len(ends)]
            crcs = crc[first]
            for i in np.flatnonzero(ends - first > 1).tolist():  # the few documents that go over a block's end
                for j in range(first[i] + 1, ends[i]):
                    crcs[i] = crc32_join(int(crcs[i]), int(crc[j]), 4 * int(length[j]))
            keep = [batch.column(c) for c in ("doc_id", "shard", "doc_start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(crcs, pa.int64())], names=["doc_id", "shard", "doc_start", "n_tokens", "ids_crc32"])

    joined = whole.mapInArrow(join, "doc_id long, shard int, doc_start long, n_tokens long, ids_crc32 long")
    shards = spark.read.schema("shard int, start long").parquet(f"{path}/shards")  # one row per shard
    return joined.join(shards, "shard").select("doc_id", (F.col("start") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32")


def op1_rans_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "op1-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return document_digests(spark, path)
