"""Free-text salary to whole rupiah bounds and a confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.functions import patterns as P
from rolegrid.functions.patterns import jvm
from rolegrid.functions.reuse import spelled_once
from rolegrid.functions.text import bind, trim_white


def _factor(unit: Column) -> Column:
    (words, factor), *rest = P.UNIT_FACTORS
    value = F.when(F.lower(unit).isin(*words), F.lit(float(factor)))
    for words, factor in rest:
        value = value.when(F.lower(unit).isin(*words), F.lit(float(factor)))
    return value.otherwise(F.lit(1.0))


def _amount(number: Column, unit: Column) -> Column:
    """Rupiah of a figure and its unit; NULL for a malformed figure.

    ``.`` and ``,`` group thousands, except that one or two digits after the
    only separator are a fraction when a unit follows (``6,5 jt``).
    """
    def read(s: Column) -> Column:
        digits = F.replace(s, F.lit("."), F.lit(""))
        fraction = ((_factor(unit) > 1) & (F.length(s) - F.length(digits) == 1)
                    & (F.length(s) - F.instr(s, ".") <= 2))
        value = (F.when((s == "") | F.contains(s, F.lit("..")), F.lit(None))
                 .when(fraction, s).otherwise(digits))
        return F.round(value.try_cast("double") * _factor(unit)).try_cast("long")

    one_sign = F.rtrim(F.replace(number, F.lit(","), F.lit(".")), F.lit("."))
    return bind(one_sign, read)


def with_salary(df: DataFrame, raw: str = "salary_raw", prefix: str = "salary") -> DataFrame:
    """Add ``<prefix>_min``, ``<prefix>_max`` and ``<prefix>_conf``.

    A side the text does not state is NULL. A range wins over a single figure;
    a range with a malformed figure falls back to the single figure.
    """
    *steps, helpers = _salary_columns(raw, prefix)
    for columns in steps:
        df = df.withColumns(columns)
    return df.drop(*helpers)


@spelled_once
def _salary_columns(raw: str, prefix: str) -> tuple:
    """The columns of ``with_salary`` step by step, and the names of the helping ones."""
    t, m = f"__{prefix}_text", f"__{prefix}_match"
    text = trim_white(F.coalesce(F.col(raw), F.lit("")))
    # a pattern runs only where one of its words occurs at all
    vague = reduce(lambda a, b: a | b, [
        reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in needles]) & F.rlike(text, F.lit(jvm(pattern)))
        for needles, pattern in ((P.VAGUE_NEEDLES, P.SALARY_VAGUE), (P.FOREIGN_NEEDLES, P.SALARY_FOREIGN))])
    bare = F.regexp_replace(F.regexp_replace(text, jvm(P.SALARY_CURRENCY), ""),
                            jvm(P.SALARY_PERIOD), "")
    figures = {t: F.when(~vague & F.rlike(text, F.lit("[0-9]")), bare).otherwise("")}

    whole = F.regexp_extract(F.col(t), jvm(P.SALARY_RANGE), 0)

    def part(pattern: str, group: int) -> Column:
        found = F.regexp_extract(F.col(t), jvm(pattern), group)
        return F.when(whole != "", found).otherwise("") if pattern == P.SALARY_RANGE else found

    before = F.regexp_extract(F.col(t), "(?s)^([^0-9]*)", 1)
    match = {m: F.struct(
        part(P.SALARY_RANGE, 1).alias("n1"), part(P.SALARY_RANGE, 2).alias("u1"),
        part(P.SALARY_RANGE, 3).alias("n2"), part(P.SALARY_RANGE, 4).alias("u2"),
        part(P.SALARY_SINGLE, 1).alias("n"), part(P.SALARY_SINGLE, 2).alias("u"),
        F.when(F.rlike(before, F.lit(jvm(P.SALARY_MAX_WORD))), "max")
         .when(F.rlike(before, F.lit(jvm(P.SALARY_MIN_WORD))), "min")
         .otherwise("both").alias("side"))}

    u1, u2 = F.col(f"{m}.u1"), F.col(f"{m}.u2")
    shared1 = F.when(u1 == "", u2).otherwise(u1)
    shared2 = F.when(u2 == "", u1).otherwise(u2)
    a, b, n = f"__{prefix}_a", f"__{prefix}_b", f"__{prefix}_n"
    amounts = {
        a: _amount(F.col(f"{m}.n1"), shared1),
        b: _amount(F.col(f"{m}.n2"), shared2),
        n: _amount(F.col(f"{m}.n"), F.col(f"{m}.u")),
    }
    ranged = F.col(a).isNotNull() & F.col(b).isNotNull()
    side, single = F.col(f"{m}.side"), F.col(n)
    bounds = {
        f"{prefix}_min": F.when(ranged, F.least(a, b)).when(side != "max", single),
        f"{prefix}_max": F.when(ranged, F.greatest(a, b)).when(side != "min", single),
        f"{prefix}_conf": (F.when(ranged, "range").when(single.isNull(), "unknown")
                           .when(side == "both", "exact").otherwise("estimated")),
    }
    return figures, match, amounts, bounds, (t, m, a, b, n)


def stored_bounds(low: Column, high: Column, conf: Column) -> tuple[Column, Column]:
    """Bounds as they are stored: 0 never stands for "not stated".

    unknown keeps no side, estimated keeps a side only if it is positive,
    exact and range keep both.
    """
    both = conf.isin("exact", "range")
    one = conf == "estimated"
    return (F.when(both | (one & (low > 0)), low), F.when(both | (one & (high > 0)), high))
