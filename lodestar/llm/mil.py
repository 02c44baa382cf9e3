"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage of the whole text is encoded (a learned hashing
embedding of its words beside word-shape statistics, through one layer), gated attention weighs the passages, and
the weighted sum gives the score; only documents have labels, attention learns which passages matter. The model is
trained with Adam on whole texts, those of at most ``per_class`` labelled documents of either class and of
``TRAIN_PASSAGES`` passages together (documented bounds): rows that aren't held out, by the smallest hash, left out from
the one on that exceeds the passages. Training looks at passages as sparse counts. Scoring covers every word of every
document, in batches.

Defined results: a null text counts as empty; an empty text is one passage without words and gets that passage's
score; null doc_ids are scored and count as held out, as do all rows that training may not see; repeated rows get one
score each; labels without a document, with a null quality, or more than one row are ignored beyond the first; with
no labels of either class every score is that of a model without evidence (the share of label 1, or 0.5 without any
label); an empty table gives an empty one; a column named ``score`` is replaced. Only text reaches the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import slices, text_bytes, tidy

PASSAGE = 128
BUCKETS, WIDTH, HIDDEN, ATTENTION = 512, 8, 24, 12
PER_CLASS = 1500
#: Passages of all training documents together; they take about 30 MB on the driver.
TRAIN_PASSAGES = 100_000
THRESHOLD = 0.3
SHAPES = 8
#: Texts are laid side by side up to so many bytes, and passages looked at so many at once.
GROUP_BYTES, BLOCK = 2 << 20, 512


def _flags(values: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint64)
    out[list(values)] = 1
    return out


_SPACE = _flags(b" \t\n\v\f\r").astype(bool)
_UPPER, _SYMBOL, _DIGIT = _flags(bytes(range(65, 91))), _flags(b"#*$%&|<>!@^~_={}[]\\"), _flags(bytes(range(48, 58)))
_LETTER = _UPPER + _flags(bytes([*range(97, 123), *range(128, 256)]))
#: Two counts by byte in one number; neither outgrows its 32 bits.
_UPPER_LETTER, _SYMBOL_DIGIT = _UPPER << np.uint64(32) | _LETTER, _SYMBOL << np.uint64(32) | _DIGIT
_LOW32 = np.uint64(0xFFFFFFFF)
#: A word's hash is the sum of its bytes' numbers times powers of an odd number, modulo 2**64, then mixed.
_NUMBERS = np.random.default_rng(3).integers(1, 1 << 63, 256, np.uint64) * ~_SPACE
_POWERS = np.multiply.accumulate(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64))


def _word_rows(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shape, hash) of every word; buffer holds nothing but white space between them."""
    part, at, n = buffer[starts[0] : ends[-1]], starts - starts[0], ends - starts
    place = np.arange(len(part)) - np.repeat(at, np.diff(np.append(at, len(part))))
    key = np.add.reduceat(_NUMBERS[part] * _POWERS[place & 0xFFFF], at)
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    ul, sd = np.add.reduceat(_UPPER_LETTER[part], at), np.add.reduceat(_SYMBOL_DIGIT[part], at)
    upper, letters, symbols, digits = ul >> np.uint64(32), ul & _LOW32, sd >> np.uint64(32), sd & _LOW32
    columns = (np.minimum(n, 30) / 10, upper / n, symbols / n, digits / n, letters == 0, (upper > 1) & (upper == letters), n > 20)
    return np.stack([c.astype(np.float32) for c in columns], axis=1), key


def _group(texts: list[bytes]):
    """passages() of texts that fit in memory side by side."""
    buffer = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[buffer]
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    upto = np.searchsorted(starts, edges, side="right")
    upto[0], words = 0, np.diff(upto)
    per_text = np.maximum(1, -(-words // PASSAGE))
    within = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    first = np.repeat(upto[:-1], per_text) + PASSAGE * within
    size = np.clip(np.repeat(upto[1:], per_text) - first, 0, PASSAGE)
    shape, bucket = np.zeros((len(first), SHAPES + 1), np.float32), np.zeros(len(starts), np.uint16)
    shape[:, SHAPES - 1] = 1.0
    full = np.flatnonzero(size)
    for lo in range(0, len(full), BLOCK):
        own = full[lo : lo + BLOCK]
        a, n = first[own[0]], size[own]
        b = first[own[-1]] + n[-1]
        rows, key = _word_rows(buffer, starts[a:b], ends[a:b])
        bucket[a:b] = key >> np.uint64(64 - BUCKETS.bit_length() + 1)
        held = np.arange(PASSAGE) < n[:, None]
        keys = np.full(held.shape, ~np.uint64(0))
        keys[held] = key
        keys.sort(axis=1)
        distinct = 1 + ((keys[:, 1:] != keys[:, :-1]) & held[:, 1:]).sum(axis=1)
        shape[own, : SHAPES - 1] = np.add.reduceat(rows, first[own] - a, axis=0) / n[:, None]
        shape[own, SHAPES - 1] = distinct / n
    shape[:, SHAPES] = size / PASSAGE
    return shape, bucket, size, per_text


def passages(texts: list[bytes]):
    """(shapes by passage, embedding buckets by word, words of each passage, passages of each text)"""
    found, held, total = [], [], 0
    for i, text in enumerate(texts):
        held.append(text)
        total += len(text)
        if total >= GROUP_BYTES or i == len(texts) - 1:
            found.append(_group(held))
            held, total = [], 0
    if not found:
        return np.zeros((0, SHAPES + 1), np.float32), np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(part) for part in zip(*found))


def bags(buckets: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Word counts by bucket of each passage, scaled so that a passage's squares sum to about one."""
    n = len(size)
    flat = np.repeat(np.arange(n) * BUCKETS, size) + buckets
    counts = np.bincount(flat, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    return np.sqrt(counts / np.maximum(size, 1).astype(np.float32)[:, None])


class SparseBags:
    """bags() without its zeros: rows, in order, with their buckets and values. ``bag @ E`` and ``bag.T @ x`` as dense."""

    def __init__(self, ends: np.ndarray, column: np.ndarray, value: np.ndarray, turned: bool = False):
        self.ends, self.column, self.value, self.turned = ends, column, value, turned

    @classmethod
    def of(cls, buckets: np.ndarray, size: np.ndarray) -> SparseBags:
        columns, values, counts, word = [], [], [], np.concatenate([[0], np.cumsum(size)])
        for lo in range(0, len(size), 4096):
            own = size[lo : lo + 4096]
            row = np.repeat(np.arange(len(own)), own)
            flat, n = np.unique(row * BUCKETS + buckets[word[lo] : word[lo + len(own)]], return_counts=True)
            columns.append((flat % BUCKETS).astype(np.uint16))
            values.append(np.sqrt(n / own[flat // BUCKETS]).astype(np.float32))
            counts.append(np.bincount(flat // BUCKETS, minlength=len(own)))
        if not columns:
            return cls(np.zeros(1, np.int64), np.zeros(0, np.uint16), np.zeros(0, np.float32))
        return cls(np.concatenate([[0], np.cumsum(np.concatenate(counts))]), np.concatenate(columns), np.concatenate(values))

    def __getitem__(self, rows: np.ndarray) -> SparseBags:
        n = self.ends[rows + 1] - self.ends[rows]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.ends[rows] - ends[:-1], n) + np.arange(ends[-1])
        return SparseBags(ends, self.column[at], self.value[at])

    @property
    def T(self) -> SparseBags:
        return SparseBags(self.ends, self.column, self.value, True)

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        n = np.diff(self.ends)
        if self.turned:
            terms = self.value[:, None] * np.repeat(x, n, axis=0)
            return np.stack([np.bincount(self.column, t, BUCKETS) for t in terms.T], axis=1).astype(x.dtype)
        out, full = np.zeros((len(n), x.shape[1]), x.dtype), np.flatnonzero(n)
        if len(full):
            out[full] = np.add.reduceat(self.value[:, None] * x[self.column], self.ends[:-1][full], axis=0)
        return out


class Model:
    """Weights: E (buckets x width), W and b of the passage layer, V and U of gated attention, a, c and bias."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @classmethod
    def fresh(cls, seed: int = 7) -> Model:
        r = np.random.default_rng(seed)
        dims = {"E": (BUCKETS, WIDTH), "W": (WIDTH + SHAPES + 1, HIDDEN), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "a": (ATTENTION,), "c": (HIDDEN,)}
        w = {k: (r.normal(size=d) / np.sqrt(d[0])).astype(np.float32) for k, d in dims.items()}
        return cls(w | {"b": np.zeros(HIDDEN, np.float32), "bias": np.zeros(1, np.float32), "mean": np.zeros(SHAPES + 1, np.float32), "scale": np.ones(SHAPES + 1, np.float32)})

    def passage(self, bag: np.ndarray, shape: np.ndarray):
        """Input, code, both halves of the gate, and attention (before it is scaled) of each passage."""
        w = self.weights
        x = np.concatenate([bag @ w["E"], (shape - w["mean"]) / w["scale"]], axis=1)
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        return x, h, t, g, (t * g) @ w["a"]

    def pool(self, h: np.ndarray, e: np.ndarray, cut: np.ndarray):
        """Document of each passage, its weight there, and code and score of each document. cut: first passage of each
        document; documents have one passage at least."""
        doc = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(e))))
        weight = np.exp(e - np.maximum.reduceat(e, cut)[doc])
        weight /= np.add.reduceat(weight, cut)[doc]
        z = np.add.reduceat(h * weight[:, None], cut, axis=0)
        return doc, weight, z, 1 / (1 + np.exp(-np.clip(z @ self.weights["c"] + self.weights["bias"][0], -30, 30)))

    def score(self, bag: np.ndarray, shape: np.ndarray, cut: np.ndarray) -> np.ndarray:
        *_, h, _, _, e = self.passage(bag, shape)
        return self.pool(h, e, cut)[-1]

    def gradients(self, bag, shape, cut, label) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        w = self.weights
        x, h, t, g, e = self.passage(bag, shape)
        doc, weight, z, p = self.pool(h, e, cut)
        d = (p - label) / len(label)
        dz = d[:, None] * w["c"]
        dh = weight[:, None] * dz[doc]
        dw = (h * dz[doc]).sum(axis=1)
        de = weight * (dw - np.add.reduceat(weight * dw, cut)[doc])
        dt, dg = de[:, None] * w["a"] * g * (1 - t * t), de[:, None] * w["a"] * t * g * (1 - g)
        dh += dt @ w["V"].T + dg @ w["U"].T
        dy = dh * (1 - h * h)
        dx = dy @ w["W"].T
        return {"E": bag.T @ dx[:, :WIDTH], "W": x.T @ dy, "b": dy.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ d, "bias": np.array([d.sum()], np.float32)}


def train(features: tuple, labels: list[int], epochs: int = 40, batch: int = 256, rate: float = 0.01, decay: float = 1e-3) -> Model:
    """Adam over the documents, features being their passages(); the same texts give the same model."""
    model = Model.fresh()
    label = np.array(labels, np.float32)
    share = float(label.mean()) if len(label) else 0.5
    model.weights["bias"][:] = np.log((share + 0.01) / (1.01 - share))
    if len(set(labels)) < 2:
        model.weights["c"][:] = 0
        return model
    shape, bucket, size, per_text = features
    bag = SparseBags.of(bucket, size)
    model.weights["mean"], model.weights["scale"] = shape.mean(axis=0), shape.std(axis=0) + np.float32(0.02)
    ends = np.cumsum(per_text)
    first, second, step, r = {}, {}, 0, np.random.default_rng(1)
    for _ in range(epochs):
        order = r.permutation(len(label))
        for lo in range(0, len(order), batch):
            docs = order[lo : lo + batch]
            rows = np.concatenate([np.arange(ends[i] - per_text[i], ends[i]) for i in docs])
            cut = np.concatenate([[0], np.cumsum(per_text[docs])[:-1]])
            step += 1
            for k, grad in model.gradients(bag[rows], shape[rows], cut, label[docs]).items():
                grad = grad + decay * model.weights[k] * (k != "bias")
                first[k] = 0.9 * first.get(k, 0) + 0.1 * grad
                second[k] = 0.999 * second.get(k, 0) + 0.001 * grad * grad
                model.weights[k] = (model.weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def training_rows(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most: int = TRAIN_PASSAGES) -> tuple[tuple, list[int]]:
    """passages() and labels of at most per_class rows of either class, and most passages, those of the smallest hashes,
    never held out ones."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    picked = None
    for q in (0, 1):
        own = rows.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = own if picked is None else picked.union(own)
    picked = picked.groupBy("doc_id").agg(F.min("quality").alias("quality"))  # 2 * per_class rows at most
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(documents).alias("text"))
    kinds = "doc_id long, quality int, n long, shape binary, bucket binary, size binary"

    def run(batches):
        """Features in place of texts, a quarter of their size."""
        for batch in batches:
            out = []
            for doc_id, text, quality in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "quality"))):
                shape, bucket, size, per_text = passages([text])
                out.append((doc_id, quality, int(per_text[0]), shape.astype("<f4").tobytes(), bucket.astype("<u2").tobytes(), size.astype("<i8").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=[k.split()[0] for k in kinds.split(", ")])

    made = texts.join(F.broadcast(picked), "doc_id").mapInArrow(run, kinds).dropDuplicates(["doc_id"])
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # of 2 * per_class rows
    found = sorted(made.withColumn("upto", upto).where(F.col("upto") <= most).collect(), key=lambda r: r["doc_id"])
    parts = [np.frombuffer(b"".join(bytes(r[c]) for r in found), d) for c, d in (("shape", "<f4"), ("bucket", "<u2"), ("size", "<i8"))]
    return (parts[0].reshape(-1, SHAPES + 1), parts[1], parts[2], np.array([r["n"] for r in found], np.int64)), [r["quality"] for r in found]


def _scores(model: Model, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    shape, bucket, size, per_text = passages(texts)
    word, h, e = np.concatenate([[0], np.cumsum(size)]), [], []
    for lo in range(0, len(size), BLOCK):
        hi = min(lo + BLOCK, len(size))
        _, own, _, _, attention = model.passage(bags(bucket[word[lo] : word[hi]], size[lo:hi]), shape[lo:hi])
        h.append(own)
        e.append(attention)
    return model.pool(np.concatenate(h), np.concatenate(e), np.cumsum(per_text) - per_text)[-1].astype(float)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """documents' columns with score as the last one, in place of one of that name."""
    weights = model.weights
    columns = [f for f in documents.schema.fields if f.name.lower() != "score"]
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", score double"

    def run(batches):
        own = Model(weights)
        for batch in batches:
            for part in slices(batch, 128):
                scores = _scores(own, [t if isinstance(t, bytes) else (t or "").encode() for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, "score"])

    return documents.select(*[documents[f.name] for f in columns]).mapInArrow(tidy(run), spec)


def classifier(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return train(*training_rows(documents, labels, per_class))


def op6_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = classifier(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(documents).alias("text")), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents that score threshold or more, with their own columns only."""
    weights = model.weights

    def run(batches):
        own = Model(weights)
        for batch in batches:
            for part in slices(batch, 128):
                scores = _scores(own, [(t or "").encode() for t in part.column("text").to_pylist()])
                yield part.filter(pa.array(scores >= threshold))

    return documents.mapInArrow(tidy(run), documents.schema)
