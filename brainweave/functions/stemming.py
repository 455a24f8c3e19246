"""Lexemes of English full-text search: words without stop words, reduced by the Snowball English stemmer ("Porter2").

The stemmer is a function of one word; columns get it by Arrow UDFs that stem each distinct word of a batch once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brainweave.functions.text import STOP_WORDS

#: Words with stems of their own, words that stay once a plural's s is off, and beginnings after which region 1 starts.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
FINISHED = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
BEGINNINGS = "gener|commun|arsen"
#: Endings of the second to fourth step, and what replaces them.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion",
)

#: Words that are stemmed at once.
WORDS = 1 << 18

_REGION = re.compile(f"^(?:{BEGINNINGS})|[aeiouy][^aeiouy]")
_NEXT = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_VOWEL = re.compile("[aeiouy]")
_LETTERS = re.compile(r"[^\W\d_]+")


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _step_1(word: str, r1: int) -> str:
    """Plurals, then past forms and ``ing``, then a closing y. Words in FINISHED stay once the plural is off."""
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in FINISHED:
        return word
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: len(word) - len(end)] + "ee"
    elif end and _VOWEL.search(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            word = word[:-1]
        elif len(word) <= r1 and _SHORT.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    return word


def _steps_2_to_5(word: str, r1: int, r2: int) -> str:
    end = _longest(word, STEP_2)
    if end and (at := len(word) - len(end)) >= r1:
        before = word[at - 1]
        if not (end == "ogi" and before != "l" or end == "li" and before not in "cdeghkmnrt"):
            word = word[:at] + STEP_2[end]
    end = _longest(word, STEP_3)
    if end and (at := len(word) - len(end)) >= (r2 if end == "ative" else r1):
        word = word[:at] + STEP_3[end]
    end = _longest(word, STEP_4)
    if end and (at := len(word) - len(end)) >= r2 and (end != "ion" or word[at - 1] in "st"):
        word = word[:at]
    at = len(word) - 1
    if word.endswith("e") and (at >= r2 or at >= r1 and not _SHORT.search(word[:-1])):
        return word[:-1]
    if word.endswith("ll") and at >= r2:
        return word[:-1]
    return word


@lru_cache(1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case word. Words of one or two letters and words with other characters than letters stay."""
    if len(word) <= 2 or not _LETTERS.fullmatch(word):
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))  # such a y is no vowel
    first = _REGION.search(word)
    r1 = first.end() if first else len(word)
    second = _NEXT.search(word, r1)
    r2 = second.end() if second else len(word)
    once = _step_1(word, r1)
    return (once if once in FINISHED else _steps_2_to_5(once, r1, r2)).replace("Y", "y")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _stemmed(flat: pa.Array) -> pa.Array:
    """Stems of words; null for stop words. Each distinct word is stemmed once."""
    coded = flat.dictionary_encode()
    stops = set(STOP_WORDS)
    stems = pa.array([None if w in stops else stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    return stems.take(coded.indices)


def _stemmed_lists(lists: pa.ListArray) -> pa.ListArray:
    stems = _stemmed(lists.flatten())
    keep = stems.is_valid()
    kept = np.append(0, keep.to_numpy(zero_copy_only=False).cumsum())
    ends = np.append(0, lists.value_lengths().fill_null(0).to_numpy().cumsum())
    return pa.ListArray.from_arrays(pa.array(kept[ends], pa.int32()), stems.filter(keep), mask=lists.is_null())


def portions(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """A batch of lists in pieces of about ``WORDS`` words, a list at least."""
    ends, start = lists.value_lengths().fill_null(0).to_numpy().cumsum(), 0
    while start < len(lists):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + WORDS, "right")))
        yield lists.slice(start, end - start)
        start = end


@F.arrow_udf(T.ArrayType(T.StringType()))
def _lexemes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for lists in batches:
        yield from map(_stemmed_lists, portions(lists))


def lexemes(text: Column) -> Column:
    """The stems of a text's words in order, stop words left out; null for null."""
    return _lexemes(words(text))


def search_terms(query: str) -> list[str]:
    """Distinct stems of a query's words: characters other than ASCII letters and digits are taken out of words, stop words are left out."""
    found = ("".join(c for c in w if c.isascii() and c.isalnum()).lower() for w in query.split())
    return list(dict.fromkeys(stem(w) for w in found if w and w not in STOP_WORDS))
