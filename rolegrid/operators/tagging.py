"""Tagging with a dictionary that is a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.functions.text import bind

# Dictionary rows up to this many are sent to every task.
BROADCAST_ALIASES = 200_000
# Keys up to this many are named in the plan, so that only words and seams among them leave a text.
NAMED_KEYS = 1000

_WORD = "[^0-9a-z_]+"
_WORD_ANY_CASE = "[^0-9A-Za-z_]+"
# Every two neighbours of which one is neither letter nor digit, and every such character alone.
_SEAMS = "(?s)(?=(.[^0-9a-z]|[^0-9a-z].))"
_SIGNS = "([^0-9a-z])"


def _quoted(text: Column) -> Column:
    """A regular expression for the text itself."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def prepared_dictionary(dictionary: DataFrame) -> DataFrame:
    """``key, tag, alias, test, pattern``: how each alias is found and what then is tested.

    ``key`` is something that each text with the alias holds: the word itself
    (``w``; ``c`` where case counts), or two neighbouring characters of the alias
    of which one is neither letter nor digit (``s``). ``test``: ``none`` (the key is the
    alias), ``part`` (substring of the lower-cased text), ``case`` or ``lower``
    (pattern on the text, or on the lower-cased text).
    """
    given = lambda c: F.col(c).cast("string") if c in dictionary.columns else F.lit(None).cast("string")
    rows = (dictionary.select("tag", F.col("alias").cast("string").alias("spelled"), F.coalesce(given("kind"), F.lit("word")).alias("kind"),
                              F.nullif(given("not_after"), F.lit("")).alias("not_after"),
                              F.nullif(given("not_before"), F.lit("")).alias("not_before"))
            .where(F.col("spelled").isNotNull() & (F.col("spelled") != "") & F.col("tag").isNotNull()))
    alias, cap = F.lower("spelled"), F.col("kind") == "cap"
    guarded = cap | F.col("not_after").isNotNull() | F.col("not_before").isNotNull()
    plain = F.rlike(alias, F.lit("\\A[0-9a-z]+\\z"))
    seam = F.coalesce(F.nullif(F.regexp_extract(alias, _SEAMS, 1), F.lit("")), alias)
    key = F.when(plain, F.concat(F.when(cap, F.lit("c:")).otherwise("w:"), alias)).otherwise(F.concat(F.lit("s:"), seam))
    title = F.concat(F.upper(F.substring("spelled", 1, 1)), F.lower(F.expr("substring(spelled, 2)")))
    written = F.when(cap, F.concat(_quoted(title), F.lit("|"), _quoted(F.upper("spelled")))).otherwise(_quoted(alias))
    pattern = F.concat(
        F.lit("(?<![0-9A-Za-z_])"), F.coalesce(F.concat(F.lit("(?<!"), _quoted(F.col("not_after")), F.lit(")")), F.lit("")),
        F.lit("(?:"), written, F.lit(")(?![0-9A-Za-z_])"),
        F.coalesce(F.concat(F.lit("(?!(?i:[\\t\\n\\f\\r -]*"), _quoted(F.col("not_before")), F.lit("(?![0-9A-Za-z_])))")), F.lit("")))
    test = (F.when(guarded & cap, "case").when(guarded, "lower").when(plain, "none").otherwise("part"))
    return rows.select(key.alias("key"), "tag", alias.alias("alias"), test.alias("test"),
                       F.when(guarded, pattern).alias("pattern")).distinct()


def dictionary_tags(texts: DataFrame, ident: str, text: str, dictionary: DataFrame,
                    limit: int = BROADCAST_ALIASES, named_keys: int = NAMED_KEYS) -> DataFrame:
    """``ident, tags``: sorted tags of the dictionary rows that match in each text.

    ``dictionary``: tag, alias, and if wanted kind, not_after, not_before, with the
    meaning of ``functions.tags.Alias``: an alias of letters and digits is a whole
    word in any case, one with signs or blanks a substring in any case; kind
    ``cap`` is a word written Xxx or XXX; ``not_after`` must not stand before the
    word, ``not_before`` must not follow it. Rows without tag or alias are ignored.

    What a text holds (its distinct words and seams between words and signs) meets
    the dictionary's keys in a join, by broadcast if the dictionary has at most
    ``limit`` rows, else by shuffle; up to ``named_keys`` keys are
    known to the texts beforehand, which then give out nothing else. A whole word in any case is settled by that;
    for the others the few rows that met go back to the text, which is read once
    more to test them there. Texts without a match, null texts among them, have
    an empty array. ``ident`` must be unique.
    """
    rows = prepared_dictionary(dictionary)
    few = rows.limit(limit + 1).count() <= limit
    kinds = {r[0] for r in rows.select(F.substring("key", 1, 1)).distinct().collect()}  # at most three
    known = [r.key for r in rows.select("key").distinct().limit(named_keys + 1).collect()]
    named = lambda kind, items: F.transform(items, lambda x: F.concat(F.lit(f"{kind}:"), x))
    whole, lowered = F.coalesce(F.col(text), F.lit("")), F.lower(F.coalesce(F.col(text), F.lit("")))
    if len(known) <= named_keys:
        wanted = lambda kind: F.array(*[F.lit(k[2:]) for k in known if k.startswith(f"{kind}:")]).cast("array<string>")
        words = lambda items, kind: F.array_intersect(items, wanted(kind))
        seams = bind(lowered, lambda low: F.filter(wanted("s"), lambda k: F.contains(low, k)))
    else:
        words = lambda items, kind: F.array_distinct(items)
        seams = F.array_distinct(F.concat(F.regexp_extract_all(lowered, F.lit(_SEAMS), F.lit(1)),
                                          F.regexp_extract_all(lowered, F.lit(_SIGNS), F.lit(1))))
    holds = {"w": named("w", words(F.split(lowered, _WORD), "w")),
             "c": named("c", words(F.transform(F.split(whole, _WORD_ANY_CASE), F.lower), "c")),
             "s": named("s", seams)}
    keys = F.concat(F.array().cast("array<string>"), *[holds[k] for k in sorted(kinds)])
    met = (texts.select(ident, F.explode(keys).alias("key"))
           .join(F.broadcast(rows) if few else rows.hint("merge"), "key")
           .groupBy(ident).agg(F.collect_set(F.struct("tag", "alias", "test", "pattern")).alias("met")))

    def fires(c: Column, low: Column) -> Column:
        return (F.when(c["test"] == "none", True).when(c["test"] == "part", F.contains(low, c["alias"]))
                .when(c["test"] == "case", F.rlike(whole, c["pattern"])).otherwise(F.rlike(low, c["pattern"])))

    fired = bind(lowered, lambda low: F.filter("met", lambda c: fires(c, low)))
    tags = F.array_sort(F.array_distinct(F.transform(fired, lambda c: c["tag"])))
    none = F.array().cast("array<string>")
    return (texts.select(ident, text).join(met, ident, "left")
            .select(ident, F.when(F.col("met").isNull(), none).otherwise(F.coalesce(tags, none)).alias("tags")))
