"""Porter's stemmer (M. F. Porter, "An algorithm for suffix stripping", Program 14(3), 1980), with two of its author's
later departures: "bli" for "abli" and "logi" for "log" in the second step."""

from __future__ import annotations

from functools import lru_cache

# The algorithm's suffixes and what replaces them, in the order of the paper.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _kinds(word: str) -> str:
    """c or v for each letter; y is a vowel behind a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or x == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    kinds = _kinds(word)
    return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:]))


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _longest(word: str, pairs: tuple, least: int) -> str:
    for end, new in sorted(pairs, key=lambda p: -len(p[0])):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + new if _measure(stem) > least else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Of a lower-case word; words of two letters or fewer stay."""
    if len(word) <= 2:
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                left = word[: -len(end)]
                if "v" in _kinds(left):
                    word = left
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif _double(word) and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short_end(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _longest(_longest(word, STEP_2, 0), STEP_3, 0)
    for end in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(end):
            left = word[: -len(end)]
            if _measure(left) > 1 and (end != "ion" or left.endswith(("s", "t"))):
                word = left
            break
    if word.endswith("e"):
        left = word[:-1]
        if _measure(left) > 1 or _measure(left) == 1 and not _short_end(left):
            word = left
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word
