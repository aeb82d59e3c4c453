"""English words for search: lower case without accents, stop words left out, Porter's stems."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Common English function words.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further "
    "had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own "
    "same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves".split()
)

# The suffixes of Porter's steps 2 to 4 and what takes their place.
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """A letter for each of the word's: v for a vowel, c for a consonant; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often consonants follow vowels."""
    return _shape(stem).count("vc")


def _short_end(word: str) -> bool:
    """Whether it ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _replaced(word: str, endings: dict[str, str], least: int) -> str:
    """With its longest ending of ``endings`` replaced, if the stem before has a measure of at least ``least``."""
    for size in range(min(7, len(word)), 1, -1):
        if word[-size:] in endings:
            stem = word[:-size]
            return stem + endings[word[-size:]] if _measure(stem) >= least else word
    return word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Porter's stem of a lower-case word (M. F. Porter, An algorithm for suffix stripping, 1980); words of one or two letters stay."""
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e)), None)
        if cut is not None and "v" in _shape(cut):
            word = cut
            if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and _short_end(word)):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP_2, 1), _STEP_3, 1)
    ending = max((e for e in _STEP_4 if word.endswith(e)), key=len, default="")
    if ending and _measure(word[: -len(ending)]) > 1 and (ending != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(ending)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def words(text: str | None, stop_words: frozenset[str] = frozenset(STOP_WORDS), stemmed: bool = True) -> list[str]:
    """The stems of a text's words of the letters a to z."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text or "") if not unicodedata.combining(c)).lower()
    return [stem(w) if stemmed else w for w in re.findall("[a-z]+", plain) if w not in stop_words]


def english_words(text: Column, stop_words: tuple[str, ...] = STOP_WORDS, stemmed: bool = True) -> Column:
    """The ``words`` of a text."""
    stop = frozenset(stop_words)

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: words(t, stop, stemmed))

    return F.pandas_udf(run, "array<string>")(text)
