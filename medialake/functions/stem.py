"""Stems of English words, by Porter's published rules (1980)."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: The published endings of steps 2, 3 and 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c for consonants, v for vowels; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", re.sub("c+", "c", _shape(stem))))


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, endings, least: int, into=None) -> str:
    """The longest of the endings replaced, if what is before it measures more than least."""
    for end in sorted(endings, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            if _measure(stem) > least and (end != "ion" or stem[-1:] in ("s", "t")):
                return stem + (endings[end] if into is None else into)
            return word
    return word


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; short ones and those with other letters stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):  # plurals
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            base = word[: len(word) - len(end)]
            if word.endswith(end) and "v" in _shape(base):
                if base.endswith(("at", "bl", "iz")):
                    base += "e"
                elif _shape(base)[-2:] == "cc" and base[-1] == base[-2] and base[-1] not in "lsz":
                    base = base[:-1]
                elif _measure(base) == 1 and _short(base):
                    base += "e"
                word = base
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _longest(_longest(word, STEP2, 0), STEP3, 0)
    word = _longest(word, STEP4, 1, "")
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(lists: pd.Series) -> pd.Series:
    return pd.Series([[stem(w) for w in words] for words in lists], dtype=object)


def stems(words: Column) -> Column:
    """Stems of an array of lower-case words, in order."""
    return _stems(words)
