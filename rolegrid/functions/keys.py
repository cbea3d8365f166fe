"""Duplicate keys of a posting: company key, title key, fingerprint, row key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolegrid.functions import patterns as P
from rolegrid.functions.patterns import jvm
from rolegrid.functions.text import bind, trim_white


def company_key(name: Column) -> Column:
    """Company name without legal form, listing suffix, punctuation and case."""
    # the patterns of rare words run only where the word occurs at all
    s = bind(F.lower(name), lambda x: F.when(F.contains(x, F.lit("persero")), F.regexp_replace(x, jvm(P.PERSERO), " ")).otherwise(x))
    s = bind(s, lambda x: F.when(F.contains(x, F.lit("tbk")), F.regexp_replace(x, jvm(P.TBK), " ")).otherwise(x))
    s = F.translate(s, ".,", "")
    s = F.regexp_replace(s, jvm(P.LEGAL_FORM), "")
    s = F.regexp_replace(s, jvm(P.BLANKS), " ")
    return trim_white(s)


def title_key(title: Column) -> Column:
    """Title reduced to ``[a-z0-9]`` without work-mode tag and leading seniority.

    The seniority word is only dropped at the very start: a title with leading
    blanks keeps it.
    """
    s = F.lower(title)
    s = F.regexp_replace(s, jvm(P.MODE_TAG), " ")
    s = F.regexp_replace(s, jvm(P.TITLE_SENIORITY), "")
    return F.regexp_replace(s, jvm(P.NON_KEY), "")


def fingerprint(company: Column, title: Column) -> Column:
    """sha256 of both keys, joined without a separator."""
    return F.sha2(F.concat(company, title), 256)


def row_key(*parts: Column) -> Column:
    """Deterministic id of a row: a random one would change on recompute."""
    return F.sha2(F.concat_ws("\u0001", *[p.cast("string") for p in parts]), 256)
