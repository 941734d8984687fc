"""The suffix stripping of Porter (1980), for words of ASCII letters, as a pandas UDF over distinct words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The endings of steps 2, 3 and 4 of the published algorithm, and what takes their place.
SECOND = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(stem: str) -> str:
    """The stem as a run of c and v, a y after a consonant being a vowel."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def measure(stem: str) -> int:
    """How many times vowels are followed by consonants."""
    return len(re.findall("v+c+", shape(stem)))


def short(stem: str) -> bool:
    """Whether it ends in consonant, vowel, consonant, the last not w, x or y."""
    return shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and shape(stem).endswith("c")


def _by_table(word: str, table: dict[str, str]) -> str:
    for ending in sorted(table, key=len, reverse=True):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            return stem + table[ending] if measure(stem) > 0 else word
    return word


def porter(word: str) -> str:
    """The stem of a word in lower case; words of one or two letters, and words with other characters, stay."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    for ending, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(ending):
            word = word[: -len(ending)] + new
            break
    cut = None
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and "v" in shape(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in shape(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            word = cut + "e"
        elif double(cut) and cut[-1] not in "lsz":
            word = cut[:-1]
        else:
            word = cut + "e" if measure(cut) == 1 and short(cut) else cut
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = _by_table(_by_table(word, SECOND), THIRD)
    for ending in sorted(FOURTH, key=len, reverse=True):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            if measure(stem) > 1 and (ending != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if measure(word) > 1 and double(word) and word.endswith("l") else word


@F.pandas_udf(StringType())
def stemmed(words: pd.Series) -> pd.Series:
    """Stems of words; give it distinct ones."""
    return words.map(lambda w: porter(w) if w is not None else None)
