"""Exact token counts at every prefix of a text, by dynamic programming over its prefixes.

Within a word the recurrence is that of byte-pair encodings: the encoding of x[:k] is the encoding of x[:j] and one more
token x[j:k], for the one j at which that token and the last token of x[:j] stay apart when the two are merged by
themselves. So ``count[k] = count[j] + 1``, and no prefix is encoded. Where a word ends its last symbol has an end mark,
so every prefix has a second value, for the text that is cut there; it comes from the first values in the same way.
Between words the counts add up, as no token spans white space or two kinds of characters. Words repeat, so a bounded
table keeps the steps of each (the differences between the counts of consecutive prefixes).

``prefix_table`` stores the steps of every character of every text, one byte each. Totals, budget and truncation
questions (``answers``, ``prefix_counts``) are sums over the stored steps; no text is looked at again.

Defined results: a null text counts as empty, with 0 bytes, 0 tokens and no steps; null or repeated doc_ids are kept as
they are, one row out for each row in; an empty table gives an empty one; other columns are ignored. A special string
in a text is one token from its last character on. Characters that the normaliser would join with their neighbours are
counted by the library, prefix by prefix, within their white-space separated chunk.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import tokens
from lodestar.llm.common import slices, stage, tidy

LIMIT = 2048
#: Entries of each table of a worker.
MAX_WORDS, MAX_PAIRS = 300_000, 500_000
#: Letters of a word's beginning that is remembered by itself.
SHARED = 7
#: A step of this size stands for one that takes more than a byte; those are kept beside the steps, in order.
ESCAPE = -128
_SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_CHUNKS = re.compile(f"[{_SPACES}]+|[^{_SPACES}]+")
_BITS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACES}\p{{L}}\p{{N}}]+")
_FAST = re.compile(f" ?(?:{tokens._UNITS.pattern})|\\s+")


class Merges:
    """The vocabulary's pair merges, and how tokens follow each other."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        vocabulary = model["vocab"]
        ending = {t.removesuffix(self.end) for t in vocabulary if t.endswith(self.end)} - {""}
        inner = {t for t in vocabulary if not self.end or not t.endswith(self.end)}
        #: token -> what it may follow, as far as known: True or False by the token before, within a word and at its end
        self.tokens = {t: ({} if t in inner else None, {} if t in ending else None) for t in inner | ending}
        self.longest, self.known = max(map(len, self.tokens)), 0
        #: what counts() has found for prefixes of up to SHARED letters, which many words share
        self.states: dict[str, tuple[str, int, int]] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Merges of the lowest rank first, leftmost first among equals."""
        rank = self.rank
        while len(symbols) > 1:
            best, at = 1 << 60, 0
            for i in range(len(symbols) - 1):
                r = rank.get((symbols[i], symbols[i + 1]), best)
                if r < best:
                    best, at = r, i
            if best == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _follows(self, before: str, token: str, end: str, follow: dict[str, bool]) -> bool:
        """Whether token may come behind ``before`` (nothing, if empty): merged together they stay these two."""
        symbols = [*before, *token]
        symbols[-1] += end
        found = self.merged(symbols) == ([before] if before else []) + [token + end]
        if self.known < MAX_PAIRS:
            follow[before] = found
            self.known += 1
        return found

    def counts(self, letters: str) -> tuple[list[int], list[int]]:
        """Tokens of letters[:k], k = 0 to the length: with more to come, and as a whole word."""
        n, longest, look = len(letters), self.longest, self.tokens.get
        last, count, whole = [""] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        states = self.states
        for k in range(1, n + 1):
            if k <= SHARED:
                known = states.get(letters[:k])
                if known is not None:
                    last[k], count[k], whole[k] = known
                    continue
            left = right = True
            for j in range(k - 1, max(-1, k - longest - 1), -1):
                token = letters[j:k]
                found = look(token)
                if found is None:
                    continue
                before, (inner, ending) = last[j], found
                if right and ending is not None:
                    ok = ending.get(before)
                    if ok or ok is None and self._follows(before, token, self.end, ending):
                        whole[k], right = count[j] + 1, False
                        if not left:
                            break
                if left and inner is not None:
                    ok = inner.get(before)
                    if ok or ok is None and self._follows(before, token, "", inner):
                        last[k], count[k], left = token, count[j] + 1, False
                        if not right:
                            break
            if left or right:
                raise ValueError(f"the vocabulary has no token for {letters[:k]!r}")
            if k <= SHARED and len(states) < MAX_WORDS:
                states[letters[:k]] = last[k], count[k], whole[k]
        return count, whole


class Prefixes:
    """Steps of texts, for one vocabulary."""

    def __init__(self, path: str):
        self.encoder = tokens.encoder(path)
        self.merges = Merges(path)
        self.special = [t.content for t in self.encoder.tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.table: dict[str, bytes] = {}

    def release(self) -> None:
        """Forget the words; what is known of the vocabulary stays."""
        self.table, self.merges.states = {}, {}
        self.encoder.release()

    def unit(self, unit: str) -> list[int]:
        """Counts of unit[:k], for k = 1 to its length; unit is a match of the vocabulary's pattern."""
        if unit[0] == "'" and len(unit) > 1 and unit[1].isalpha():  # its prefixes are an apostrophe and letters
            out = []
            for k in range(1, len(unit)):
                out.append(sum(self.merges.counts(_letters(part))[1][-1] for part in (unit[:1], unit[1:k]) if part))
            return [*out, self.merges.counts(_letters(unit))[1][-1]]
        if unit.isascii() and unit.isprintable():
            return self.merges.counts(unit)[1][1:]
        whole = self.merges.counts(_letters(unit))[1]
        ends = np.cumsum([len(c.encode()) for c in unit])
        return [whole[e] for e in ends]

    def _piece(self, piece: str) -> bytes:
        """Steps of a match of _FAST: a unit, maybe behind a space, or white space."""
        unit = piece[1:] if piece[0] == " " else piece
        if not unit or unit[0].isspace():
            return bytes(len(piece))
        counts = self.unit(unit)
        steps = [b - a for a, b in zip([0, *counts], counts)]
        if max(steps) > 127 or min(steps) <= ESCAPE:
            raise ValueError("a step within a word that takes more than a byte")
        return bytes(len(piece) - len(unit)) + bytes([x & 255 for x in steps])

    def plain(self, text: str) -> bytes:
        """Steps of a text of characters for which lower-casing is all that the normaliser does."""
        table, out = self.table, []
        for piece in _FAST.findall(text.lower()):
            steps = table.get(piece)
            if steps is None:
                steps = self._piece(piece)
                if len(table) < MAX_WORDS:
                    table[piece] = steps
            out.append(steps)
        return b"".join(out)

    def _ordinary(self, chunk: str) -> list[int]:
        """Counts of chunk[:k] for k = 1 to its length, whatever its characters, special strings taken as ordinary text."""
        low = [c.lower() for c in chunk]
        if unicodedata.is_normalized("NFC", chunk) and all(len(c) == 1 for c in low):
            out, before = [], 0
            for unit in _BITS.findall("".join(low)):
                out += [before + n for n in self.unit(unit)]
                before = out[-1]
            if before == len(self.encoder.tokenizer.encode(chunk, add_special_tokens=False).ids) or self._special.search(chunk):
                return out
        return [len(self.encoder.tokenizer.encode(chunk[:k], add_special_tokens=False).ids) for k in range(1, len(chunk) + 1)]

    def chunk(self, chunk: str) -> list[int]:
        """Counts of chunk[:k] for k = 1 to its length; chunk has no white space."""
        out, at, before = [], 0, 0
        for found in [*self._special.finditer(chunk), None]:
            own = self._ordinary(chunk[at : found.end() if found else None])
            out += [before + n for n in own]
            if found:
                before = (out[found.start() - 1] if found.start() else 0) + 1
                out[-1] = before
                at = found.end()
        return out

    def steps(self, text: str) -> tuple[bytes, list[int]]:
        """The steps of a text's characters, and those of them that take more than a byte."""
        if self.encoder.plain and not tokens._BEYOND.search(text):
            return self.plain(text), []
        parts, long = [], []
        for chunk in _CHUNKS.findall(text):
            if self.encoder.plain and not tokens._BEYOND.search(chunk):
                parts.append(self.plain(chunk))
            else:
                step = np.diff([0, *self.chunk(chunk)])
                wide = (step <= ESCAPE) | (step > 127)
                long += step[wide].tolist()
                parts.append(np.where(wide, ESCAPE, step).astype(np.int8).tobytes())
        return b"".join(parts), long


def _letters(text: str) -> str:
    return text.encode().decode("latin-1").translate(tokens._BYTES)


_PREFIXES: dict[str, Prefixes] = {}


def prefixes(path: str) -> Prefixes:
    """This process's recurrence for a vocabulary file."""
    if path not in _PREFIXES:
        _PREFIXES[path] = Prefixes(path)
    return _PREFIXES[path]


def prefix_table(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_bytes, steps (binary: for each character, as a signed byte, the tokens that it adds to the prefix
    before it), long_steps (the steps that a byte can't hold, whose byte is -128)."""
    path = vocabulary or tokens.default_path()

    def run(batches):
        own = prefixes(path)
        for batch in batches:
            for part in slices(batch):
                found = [own.steps(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array([s for s, _ in found], pa.binary()), pa.array([x for _, x in found], pa.list_(pa.int64()))], names=["doc_id", "n_bytes", "steps", "long_steps"])
        own.release()

    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return docs.mapInArrow(tidy(run), "doc_id long, n_bytes long, steps binary, long_steps array<long>")


def prefix_counts(steps: bytes, long_steps: list[int]) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2, ... characters of one text."""
    step = np.frombuffer(steps, np.int8).astype(np.int64)
    if long_steps:
        step[step == ESCAPE] = long_steps
    return np.concatenate([[0], np.cumsum(step)])


def answers(table: DataFrame, budget: int = LIMIT) -> DataFrame:
    """From the stored steps: doc_id, n_bytes, n_tokens, over_limit, and where the text may be cut: fit_chars, the
    characters of the longest prefix within the budget, and fit_tokens, that prefix's tokens."""

    def run(batches):
        for batch in batches:
            out = []
            for steps, long_steps in zip(batch.column("steps"), batch.column("long_steps").to_pylist()):
                counts = prefix_counts(steps.as_py(), long_steps)
                total = int(counts[-1])
                fit = len(counts) - 1 if total <= budget else int(np.flatnonzero(counts <= budget)[-1])
                out.append((total, total > budget, fit, int(counts[fit])))
            columns = [list(c) for c in zip(*out)] if out else [[]] * 4
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars", "fit_tokens"])

    return table.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long, fit_tokens long")


def op10_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, _ = stage(prefix_table(spark.read.parquet(f"{sf_dir}/documents.parquet")), "op10-steps")
    return answers(table)
