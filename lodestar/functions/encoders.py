"""Encoders: text columns to vectors of one length.

An encoder has ``dim`` and ``encode(rows, text, is_query)``, which adds a column ``embedding`` (array of doubles) to a
DataFrame. Models are not part of this package; register a loader in the group ``encoder`` to bring one. The default is a
hashing encoder, which needs none; ``ColumnEncoder`` takes vectors that are there already.
"""

from __future__ import annotations

import abc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.registry import registry
from lodestar.functions.vectors import l2_normalize

try:
    from _md5 import md5 as _md5  # the same digests in half the time for short words
except ImportError:
    _md5 = hashlib.md5

#: Words that a worker remembers.
MOST_WORDS = 300_000


class Encoder(abc.ABC):
    """mode: ``dual`` for a query tower and a document tower, ``mono`` for one; the encoders here have one tower."""

    dim: int

    def __init__(self, mode: str = "dual", normalize: bool = True):
        if mode not in ("dual", "mono"):
            raise ValueError(f"mode must be 'dual' or 'mono', not {mode!r}")
        self.mode, self.normalize = mode, normalize

    @abc.abstractmethod
    def encode(self, rows: DataFrame, text: str = "text", is_query: bool = False) -> DataFrame:
        """rows with a column ``embedding``, in place of one of that name; an empty table gives an empty one."""

    def _finished(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("embedding", l2_normalize(F.col("embedding"))) if self.normalize else rows


#: Bytes that are no part of a word become spaces; so does each byte of a character beyond ASCII.
_SEPARATED = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


class _Places(dict):
    """Of a word's MD5, twice the place, plus one for a negative sign; as many as MOST_WORDS are remembered."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __reduce__(self):
        return _places, (self.dim,)

    def __missing__(self, word: bytes) -> int:
        digest = _md5(word).digest()
        found = 2 * (int.from_bytes(digest[:4]) % self.dim) + (digest[4] >> 4) % 2
        if len(self) < MOST_WORDS:
            self[word] = found
        return found


_KNOWN: dict[int, _Places] = {}


def _places(dim: int) -> _Places:
    """A worker keeps them from task to task, for the last few dims."""
    if dim not in _KNOWN and len(_KNOWN) >= 2:
        _KNOWN.clear()
    return _KNOWN.setdefault(dim, _Places(dim))


class HashingEncoder(Encoder):
    """Signed counts of lower-case words, each in the place that its MD5 names. A text without words has a zero vector."""

    def __init__(self, name: str = "hashing", mode: str = "dual", normalize: bool = True, dim: int = 256):
        super().__init__(mode, normalize)
        if dim < 1:
            raise ValueError("dim must be positive")
        self.name, self.dim = name, dim

    def encode(self, rows: DataFrame, text: str = "text", is_query: bool = False) -> DataFrame:
        dim = self.dim
        kept = [f for f in rows.schema.fields if f.name.lower() != "embedding"]

        known = _places(dim)
        normalize = self.normalize

        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    words = [(text or b"").translate(_SEPARATED).split() for text in part.column("_text").to_pylist()]
                    at = np.array([known[w] for own in words for w in own], np.int64)
                    row = np.repeat(np.arange(len(words)), [len(own) for own in words])
                    out = np.bincount(row * dim + (at >> 1), 1.0 - 2.0 * (at & 1), len(words) * dim).astype(float).reshape(-1, dim)
                    if normalize:
                        out /= np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * dim), pa.array(out.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column("_row"), lists], names=["_row", "embedding"])

        row = F.struct(*[rows[f.name] for f in kept]).alias("_row")
        packed = rows.select(row, F.lower(rows[text].cast("string")).cast("binary").alias("_text"))
        made = packed.mapInArrow(run, T.StructType([packed.schema["_row"], T.StructField("embedding", T.ArrayType(T.DoubleType()))]))
        return made.select("_row.*", "embedding")


class ColumnEncoder(Encoder):
    """Vectors of a column that the rows have."""

    def __init__(self, name: str = "embedding", mode: str = "dual", normalize: bool = True):
        super().__init__(mode, normalize)
        self.name = name

    def encode(self, rows: DataFrame, text: str = "text", is_query: bool = False) -> DataFrame:
        return self._finished(rows.withColumn("embedding", F.col(self.name).cast("array<double>")))


registry.register("encoder")("default")(HashingEncoder)
registry.register("encoder")("hashing")(HashingEncoder)
registry.register("encoder")("column")(ColumnEncoder)


def load_encoder(name: str = "hashing", mode: str = "dual", **options) -> Encoder:
    """The encoder registered under name, or else the default loader's encoder of that name."""
    loaders = registry["encoder"]
    loader = loaders.get(name) or loaders.get("default")
    if loader is None:
        raise RuntimeError("no default encoder is registered")
    return loader(mode=mode, **options) if name in loaders else loader(name=name, mode=mode, **options)


def encode_corpus(encoder: Encoder, corpus: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text -> vec_id, embedding."""
    return encoder.encode(corpus, text).select(F.col("doc_id").cast("long").alias("vec_id"), "embedding")
