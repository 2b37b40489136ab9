"""English word stems by Porter's published rules (1980), for terms that should match in all their forms."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: suffixes of steps 2, 3 and 4 of the published rules, and what takes their place
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_RUN = re.compile("v+c+")
_ASCII = re.compile("[a-z]+")


def _shape(word: str) -> str:
    """c or v for each letter; a y after a consonant is a vowel."""
    out = ""
    for k, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and k > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(part: str) -> int:
    return len(_RUN.findall(_shape(part)))


def _short_end(part: str) -> bool:
    """Consonant, vowel, consonant at the end, the last none of w, x, y."""
    return _shape(part).endswith("cvc") and part[-1] not in "wxy"


def _replaced(word: str, rules: list[tuple[str, str]], least: int) -> str:
    """The longest suffix of the rules gives way if the measure of what stands before it is more than ``least``."""
    for suffix, other in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            part = word[: -len(suffix)]
            if suffix == "ion" and not part.endswith(("s", "t")):
                return word
            return part + other if _measure(part) > least else word
    return word


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of up to two letters and words with other letters than a to z stay."""
    if len(word) < 3 or not _ASCII.fullmatch(word):
        return word
    for suffix, other in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + other
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            part = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(part):
                word = part
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(word, STEP2, 0)
    word = _replaced(word, STEP3, 0)
    word = _replaced(word, [(s, "") for s in STEP4], 1)
    if word.endswith("e"):
        part = word[:-1]
        if _measure(part) > 1 or (_measure(part) == 1 and not _short_end(part)):
            word = part
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stemmed(word: Column) -> Column:
    """The stem of each word; for columns of distinct words or of counted terms, not of whole texts."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(stem, na_action="ignore")

    return run(word)
