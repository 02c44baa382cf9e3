"""Token ids of whole texts, by the tokenizers library, with each distinct piece of a text encoded once.

The vocabulary's normaliser and pre-tokeniser never join what white space separates, so the ids of a text are the
ids of its white-space separated pieces in a row. Pieces repeat heavily, so a bounded table of them replaces most
calls of the library; pieces beyond the bound are encoded anew each time. Special strings hold no white space, so
they stay within a piece and are treated as the library's default treats them.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np

#: Entries of each table; one takes about 200 bytes.
MAX_PIECES = 150_000
#: Entries of the table of units for each of those; one takes about 55 bytes.
UNIT_SHARE = 3
#: str.split() also splits at these, which are no white space to the library.
_CONTROL = re.compile("[\x1c-\x1f]")
_SAFE = re.compile("[ \t\n\r]+")
#: Beyond these characters, or with a special string's start, a chunk goes to the library whole.
_BEYOND = re.compile("[^\x00-\u017f]|[\x1c-\x1f\u0130]|<\\|")
_LETTERS, _DIGITS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_UNITS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_letters()


def _is_plain(tokenizer) -> bool:
    """Whether _UNITS and the model give what the library gives, tried on a text with all characters below U+0180."""
    pieces = [f"{c}a'{c}S 1{c}" for c in map(chr, range(384)) if not _BEYOND.search(c) and not c.isspace()] + ["we'Ll", "don't!", "12e5"]
    want = [e.ids for e in tokenizer.encode_batch(pieces, add_special_tokens=False)]
    model = lambda u: [t.id for t in tokenizer.model.tokenize(u.encode().decode("latin-1").translate(_BYTES))]
    return want == [[i for u in _UNITS.findall(p.lower()) for i in model(u)] for p in pieces]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Table(dict):
    """piece -> number, new pieces noted in ``new``."""

    def __init__(self):
        self.new = []

    def __missing__(self, piece):
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class _Store:
    """Ids of numbered pieces, one after the other: piece i has ids[starts[i]:starts[i + 1]]."""

    def __init__(self, most: int):
        self.most, self.table = most, _Table()
        self.ids, self.starts, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64), 0

    def learn(self, encode) -> None:
        """Encode the new pieces and append their ids."""
        new, self.table.new = self.table.new, []
        flat, lengths = [], []
        for piece in new:
            ids = encode(piece)
            lengths.append(len(ids))
            flat += ids
        n = len(flat)
        if self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(self.used, n), np.uint32)])
        self.ids[self.used : self.used + n] = flat
        self.used += n
        if new:
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.array(lengths, np.int64))])

    def forget(self) -> None:
        """Back to the bound: the earliest pieces, which are the commonest, stay."""
        if len(self.table) > self.most:
            for piece in list(islice(reversed(self.table), len(self.table) - self.most)):
                del self.table[piece]
            self.starts = self.starts[: self.most + 1].copy()
            self.used = int(self.starts[-1])


#: Texts are split side by side up to so many characters.
GROUP_CHARS = 1 << 18
_LOWER = np.array([ord(chr(c).lower()[0]) for c in range(0x181)], np.uint16)
_IS_BEYOND = np.array([bool(_BEYOND.match(chr(c))) for c in range(0x181)])
_SPACE, _LETTER, _DIGIT, _SYMBOL = range(4)
_KIND = np.array([_SPACE if chr(c).isspace() else _LETTER if re.match(f"[{_LETTERS}]", chr(c)) else _DIGIT if re.match(f"[{_DIGITS}]", chr(c)) else _SYMBOL for c in range(0x181)], np.int8)
_NUMBERS = np.random.default_rng(5).integers(1, 1 << 63, 0x181, np.uint64) * (_KIND != _SPACE)
_POWERS = np.multiply.accumulate(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64))


def _unit_starts(code: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where _UNITS would find its matches; code begins with white space and ends with three of them."""
    start = (kind != _SPACE) & (kind == _DIGIT)
    start[1:] |= (kind[1:] != _SPACE) & (kind[1:] != kind[:-1])
    mark = np.flatnonzero((code == ord("'")) & start)  # an apostrophe within symbols is one of them
    one, two = code[mark + 1], code[mark + 2]
    e, l, r, v = map(ord, "elrv")  # noqa: E741
    long = ((one == r) | (one == v)) & (two == e) | (one == l) & (two == l)
    short = np.isin(one, [ord(c) for c in "stmd"])
    for own, size in ((mark[short], 2), (mark[long], 3)):
        start[own + 1] = False
        start[own + size] |= kind[own + size] == _LETTER
    return np.flatnonzero(start)


def _ranges(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for lengths[0] numbers, then first[1], ..."""
    ends = np.cumsum(lengths)
    return np.repeat(first - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Units:
    """Ids of units by a 64-bit hash, in an open-addressed table; each use compares the unit's characters as well."""

    def __init__(self, most: int):
        self.most, self.bits = most, max(4, (2 * most).bit_length())
        self.slots, self.keys = np.full(1 << self.bits, -1, np.int32), np.zeros(0, np.uint64)
        self.chars, self.char_starts = np.zeros(0, np.uint16), np.zeros(1, np.int64)
        self.ids, self.id_starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        number, rest, slot = np.full(len(key), -1, np.int64), np.arange(len(key)), (key >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(rest):
            here = self.slots[slot]
            taken = here >= 0
            same = taken.copy()
            same[taken] = self.keys[here[taken]] == key[rest[taken]]
            number[rest[same]] = here[same]
            on = taken & ~same
            rest, slot = rest[on], (slot[on] + 1) & (len(self.slots) - 1)
        return number

    def _insert(self, first: int) -> None:
        rest = np.arange(first, len(self.keys))
        slot = (self.keys[first:] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(rest):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rest[free]
            lost = self.slots[slot] != rest
            rest, slot = rest[lost], (slot[lost] + 1) & (len(self.slots) - 1)

    def ids_of(self, code: np.ndarray, kind: np.ndarray, starts: np.ndarray, encode):
        """(ids of all units in a row, number of ids of each); ids is None if two different units have one hash."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lo, at = starts[0], starts - starts[0]
        part, solid = code[lo:], kind[lo:] != _SPACE
        place = np.arange(len(part)) - np.repeat(at, np.diff(np.append(at, len(part))))
        key = np.add.reduceat(_NUMBERS[part] * _POWERS[place & 0xFFFF], at)
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        size = np.add.reduceat(solid, at, dtype=np.int64)
        number = self._find(key)
        known, missing = len(self.keys), np.flatnonzero(number < 0)
        if len(missing):
            new, example, which = np.unique(key[missing], return_index=True, return_inverse=True)
            number[missing] = known + which
            example = missing[example]
            text = part.astype("<u4").tobytes().decode("utf-32-le")
            ids = [encode(text[a : a + n]) for a, n in zip(at[example].tolist(), size[example].tolist())]
            self.keys = np.concatenate([self.keys, new])
            self.chars = np.concatenate([self.chars, part[_ranges(at[example], size[example])]])
            self.char_starts = np.concatenate([self.char_starts, self.char_starts[-1] + np.cumsum(size[example])])
            self.ids = np.concatenate([self.ids, np.fromiter((i for one in ids for i in one), np.uint32)])
            self.id_starts = np.concatenate([self.id_starts, self.id_starts[-1] + np.cumsum([len(one) for one in ids])])
        first = self.char_starts[number]
        right = np.array_equal(self.char_starts[number + 1] - first, size) and np.array_equal(self.chars[_ranges(first, size)], part[solid])
        first = self.id_starts[number]
        lengths = self.id_starts[number + 1] - first
        out = self.ids[_ranges(first, lengths)] if right else None
        if len(self.keys) > self.most:  # the earliest stay; the others are encoded anew each time
            self.keys = self.keys[: self.most].copy()
            self.char_starts, self.id_starts = self.char_starts[: self.most + 1].copy(), self.id_starts[: self.most + 1].copy()
            self.chars, self.ids = self.chars[: self.char_starts[-1]].copy(), self.ids[: self.id_starts[-1]].copy()
        self._insert(known)
        return out, lengths


class PieceEncoder:
    """Bounded tables: white-space separated chunks, and the letter runs, digits and symbol runs within them."""

    def __init__(self, path: str, max_pieces: int = MAX_PIECES):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.plain = _is_plain(self.tokenizer)
        self.max_pieces = max_pieces
        self.release()

    def release(self) -> None:
        """Empty tables: an idle worker, which outlives its tasks, should hold none."""
        self.units: dict[str, list[int]] = {}
        self.others, self.whole = _Store(self.max_pieces), _Units(UNIT_SHARE * self.max_pieces)

    def split(self, text: str) -> list[str]:
        return text.split() if not _CONTROL.search(text) else [p for p in _SAFE.split(text) if p]

    def model_ids(self, unit: str) -> list[int]:
        if not (unit.isascii() and unit.isprintable()):  # those stand for themselves
            unit = unit.encode().decode("latin-1").translate(_BYTES)
        return [t.id for t in self.tokenizer.model.tokenize(unit)]

    def unit_ids(self, unit: str) -> list[int]:
        ids = self.units.get(unit)
        if ids is None:
            ids = self.model_ids(unit)
            if len(self.units) < self.max_pieces:
                self.units[unit] = ids
        return ids

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of one chunk: its units by the library's model, or the whole chunk by the library where its
        normaliser could do more than lower-casing."""
        if not self.plain or _BEYOND.search(chunk):
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        ids: list[int] = []
        for unit in _UNITS.findall(chunk.lower()):
            ids += self.unit_ids(unit)
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32), and the number of ids of each text."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            lo = 0
            while len(text) - lo > GROUP_CHARS and (gap := _SAFE.search(text, lo + GROUP_CHARS)):
                parts.append(text[lo : gap.start()])
                owner.append(i)
                lo = gap.start()
            parts.append(text[lo:])
            owner.append(i)
        ids, sizes, held, total = [], [], [], 0
        for i, part in enumerate(parts):
            held.append(part)
            total += len(part)
            if total >= GROUP_CHARS or i == len(parts) - 1:
                found = self._group(held)
                ids.append(found[0])
                sizes.append(found[1])
                held, total = [], 0
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(ids), np.bincount(owner, np.concatenate(sizes), len(texts)).astype(np.int64)

    def _group(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.plain:
            return self._by_chunk(parts)
        codes = np.frombuffer(("\n" + "\n".join(parts) + "\n\n\n").encode("utf-32-le"), "<u4")
        edges = np.cumsum([1] + [len(p) + 1 for p in parts])
        code = np.minimum(codes, len(_LOWER) - 1).astype(np.uint16)
        beyond = _IS_BEYOND[code]
        beyond[:-1] |= (code[:-1] == 60) & (code[1:] == 124)
        others = np.unique(np.searchsorted(edges, np.flatnonzero(beyond), side="right") - 1)
        code = _LOWER[code]
        for i in others:
            code[edges[i] : edges[i + 1] - 1] = 10
        kind = _KIND[code]
        starts = _unit_starts(code, kind)
        ids, lengths = self.whole.ids_of(code, kind, starts, self.model_ids)
        if ids is None:  # two units of one hash
            return self._by_chunk(parts)
        sizes = np.bincount(np.searchsorted(edges, starts, side="right") - 1, lengths, len(parts)).astype(np.int64)
        if len(others):
            more, counts = self._by_chunk([parts[i] for i in others])
            at = np.cumsum(sizes)[others]  # they have no ids yet, so this is where theirs go
            ids = np.insert(ids, np.repeat(at, counts), more)
            sizes[others] = counts
        return ids, sizes

    def _by_chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        store, flat, sizes = self.others, [], []
        look = store.table.__getitem__
        for text in texts:
            chunks = self.split(text)
            sizes.append(len(chunks))
            flat.extend(map(look, chunks))
        store.learn(self.chunk_ids)
        number = np.array(flat, np.int64)
        first = store.starts[number]
        lengths = store.starts[number + 1] - first
        ids = store.ids[_ranges(first, lengths)]
        upto = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])]
        store.forget()
        return ids, np.diff(upto)


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
