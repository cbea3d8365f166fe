"""Trigram sets and their similarity."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolegrid.functions.text import bind

# Fixed value: two titles of one company are the same above this similarity.
SIMILARITY_TENTHS = 7


def trigrams(text: Column) -> Column:
    """Distinct trigrams of every alphanumeric word, padded "  word "."""
    words = F.filter(F.split(F.lower(text), "[^0-9a-z]+"), lambda w: w != "")
    per_word = F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) + 1),
        lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(per_word))


_WORD = re.compile("[0-9a-z]+")


def text_trigrams(lowered: str) -> set[str]:
    """``trigrams`` of one text in lower case."""
    grams = set()
    for word in _WORD.findall(lowered):
        padded = f"  {word} "
        grams.update([padded[i:i + 3] for i in range(len(word) + 1)])
    return grams


# Trigrams of lower-case words are drawn from the blank, 0-9 and a-z.
BASE = 37
N_CODES = BASE ** 3


def trigram_codes(text: Column) -> Column:
    """``trigrams`` as whole numbers below ``N_CODES``, for compact rows."""
    words = F.filter(F.split(F.lower(text), "[^0-9a-z]+"), lambda w: w != "")

    def digit(padded: Column, i: Column) -> Column:
        code = F.ascii(F.substring(padded, i, F.lit(1)))
        return F.when(code >= 97, code - 86).when(code >= 48, code - 47).otherwise(0)

    def of_padded(p: Column) -> Column:
        digits = F.transform(F.sequence(F.lit(1), F.length(p)), lambda i: digit(p, i))
        return bind(digits, lambda d: F.transform(
            F.sequence(F.lit(0), F.size(d) - 3),
            lambda i: (F.get(d, i) * BASE + F.get(d, i + 1)) * BASE + F.get(d, i + 2)))

    per_word = F.transform(words, lambda w: bind(F.concat(F.lit("  "), w, F.lit(" ")), of_padded))
    return F.array_distinct(F.flatten(per_word))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both texts; 0 for empty texts."""
    ta, tb = trigrams(a), trigrams(b)
    shared = F.size(F.array_intersect(ta, tb))
    union = F.size(ta) + F.size(tb) - shared
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)

