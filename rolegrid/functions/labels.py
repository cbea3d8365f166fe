"""Work mode, seniority level and city of a posting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolegrid.functions import patterns as P
from rolegrid.functions.patterns import jvm
from rolegrid.functions.text import bind, trim_white


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def _mentions(lowered: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in words])


def work_mode(title: Column, location: Column, description: Column) -> Column:
    """hybrid, remote or onsite by wording; a stated location alone is onsite.

    A plain substring test goes first, so that a pattern runs only on rows
    holding one of its words.
    """
    text = F.concat(_text(title), F.lit(" "), _text(location), F.lit(" "), _text(description))

    def label(lowered: Column) -> Column:
        arms = [(name, _mentions(lowered, P.MODE_NEEDLES[name])
                 & F.rlike(lowered, F.lit(jvm(pattern)))) for name, pattern in P.MODE_PATTERNS]
        out = F.when(arms[0][1], arms[0][0])
        for name, test in arms[1:]:
            out = out.when(test, name)
        return out.when(trim_white(_text(location)) != "", "onsite").otherwise("unknown")

    return bind(F.lower(text), label)


def years_of_experience(description: Column) -> Column:
    """Years a text asks for, NULL if it states none.

    Each pattern looks at its first match only; a rejected or oversized number
    passes on to the next pattern, not to a later match.
    """
    def read(lowered: Column) -> Column:
        found = []
        for i, pattern in enumerate(P.YEARS_PATTERNS):
            number = F.nullif(F.regexp_extract(lowered, jvm(pattern), 1), F.lit(""))
            number = number.try_cast("long")
            if i == P.YEARS_REJECTING:
                number = F.when(F.regexp_extract(lowered, jvm(pattern), 2) == "", number)
            found.append(F.when(F.contains(lowered, F.lit(P.YEARS_NEEDLES[i])), number))
        return F.coalesce(*found)

    return bind(F.lower(description), read)


def level_of_years(years: Column) -> Column:
    return (F.when(years < 2, "junior").when(years < 5, "mid")
            .when(years.isNotNull(), "senior").otherwise("unknown"))


def experience_level(title: Column, description: Column) -> Column:
    """Seniority word of the title, else the band of the stated years."""
    lowered = F.lower(_text(title))
    arms = [(name, _mentions(lowered, P.LEVEL_NEEDLES[name]) & F.rlike(_text(title), F.lit(jvm(pattern))))
            for name, pattern in P.LEVEL_PATTERNS]
    by_title = reduce(lambda acc, arm: acc.when(arm[1], arm[0]), arms[1:], F.when(arms[0][1], arms[0][0]))
    # looking at the years is left to the rows whose title says nothing
    by_years = bind(years_of_experience(_text(description)), level_of_years)
    return F.coalesce(by_title, by_years)


def city(location: Column) -> Column:
    """Part before the first comma, without a work-mode tag."""
    head = F.substring_index(_text(location), ",", 1)
    return trim_white(F.regexp_replace(head, jvm(P.MODE_TAG), ""))
