"""Quality rules: fixed bounds and robust multivariate outliers, all in SQL functions.

Each text gets five statistics; their transformed values form a vector. Per
language and source a minimum-covariance-determinant estimate is found by
C-steps: start from medians and interquartile ranges, then keep taking mean
and covariance of the share ``H`` of rows with the smallest Mahalanobis
distance. A text is rejected if its distance to its group's estimate passes
the chi-square quantile ``TAIL``, or if it fails the fixed bounds.

Vectors are integers (thousandths), so sums are exact and the outcome does not
depend on the order of rows. Quantiles are taken from counts per integer
value or distance class, which are reduced before they are shuffled; no group
is ever collected.

Defined results: a null text has no words and fails the bounds; null language
or source count as empty strings; the groups of a language with fewer than
``MIN_GROUP`` rows inside the bounds are judged as one, and by the bounds alone
if they are too few together; repeated rows all stay and
all count; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.common import BROADCAST_IDS, write_once

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
H = 0.75
STEPS = 3
TAIL = 1 - 1e-5
MIN_GROUP = 50
DIM = 5
# Smallest standard deviation of each statistic, in thousandths of its
# transformed unit: below these, differences say nothing about quality. The
# largest value of each share still passes the quantile alone.
FLOOR = (700, 150, 700, 1200, 1200)
POOLED = "\x00"  # stands for all small sources of a language

_BLANK = " \t\n\x0b\f\r"
_POS_BITS = 24  # words of a text that the packed sort can number
_GROUP = ["g_lang", "g_source"]


def chi2_cdf(x: float, k: int) -> float:
    """Distribution function of chi-square with ``k`` degrees, by its series."""
    if x <= 0:
        return 0.0
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, k) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def _repeat_words(df: DataFrame) -> DataFrame:
    """``n_repeat_words`` from ``words``: words in three-word windows found twice.

    Windows become 64-bit hashes. Where any repeats, hash and position are
    packed into one integer and sorted, so equal windows are neighbours; the
    full hashes are compared before two neighbours count as equal.
    """
    low = (1 << _POS_BITS) - 1
    words = F.col("words")
    df = df.withColumn("grams", F.when(F.size(words) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))).otherwise(F.array().cast("array<long>")))
    grams = F.col("grams")
    df = df.withColumn("packed", F.when(
        F.size(F.array_distinct(grams)) < F.size(grams),
        F.sort_array(F.transform(grams, lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))))
    packed = F.col("packed")
    place = lambda k: packed[k].bitwiseAND(F.lit(low)).cast("int")
    df = df.withColumn("twins", F.filter(
        F.sequence(F.lit(1), F.size(packed) - 1),
        lambda k: (packed[k].bitwiseAND(F.lit(~low)) == packed[k - 1].bitwiseAND(F.lit(~low)))
        & (grams[place(k)] == grams[place(k - 1)])))
    df = df.withColumn("places", F.sort_array(F.array_distinct(F.flatten(F.transform(
        "twins", lambda k: F.array(place(k - 1), place(k)))))))
    places = F.col("places")
    covered = F.aggregate(F.sequence(F.lit(1), F.size(places) - 1), F.lit(3).cast("long"),
                          lambda n, k: n + F.least(F.lit(3), places[k] - places[k - 1]))
    return df.withColumn("n_repeat_words", F.when(F.size(places) > 0, covered).otherwise(F.lit(0).cast("long"))
                         ).drop("grams", "packed", "twins", "places")


def statistics(docs: DataFrame) -> DataFrame:
    """Statistics per row: ``doc_id, g_lang, g_source, row_key``, counts, ``base_failed``."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row_key"),
        F.coalesce("lang", F.lit("")).alias("g_lang"), F.coalesce("source", F.lit("")).alias("g_source"),
        text.alias("body"), F.btrim(text, F.lit(_BLANK)).alias("trimmed"))
    df = df.withColumn("words", F.when(F.col("trimmed") == "", F.array().cast("array<string>"))
                       .otherwise(F.split("trimmed", r"[\x20\x09-\x0D]+")))
    df = df.withColumn("lines", F.filter(F.split("body", "\n"),
                                         lambda s: F.btrim(s, F.lit(_BLANK)) != ""))
    df = _repeat_words(df)
    counted = df.select(
        "doc_id", "row_key", *_GROUP, F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words")
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text", "lang", "source")


def _vector() -> list[Column]:
    """Transformed statistics in thousandths.

    The two shares are log odds of percents, repeated words as a share of what
    the bounds allow: they stretch near the top, so each can reject alone.
    """
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    odds = lambda percent: F.log1p(percent) + math.log(101) - F.log1p(F.greatest(100 - percent, F.lit(0)))
    parts = [F.log1p(n), F.log1p(F.col("word_chars") / n), F.log1p(F.col("n_symbols") * 1000 / n),
             odds(F.col("n_dup_lines") * 100 / lines), odds(F.col("n_repeat_words") * (10_000 / MAX_REPEAT_PERCENT) / n)]
    return [F.round(p * 1000).cast("long") for p in parts]


def _quantile_by_count(counts: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key the smallest value at which the running count reaches each share."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    run = (counts.withColumn("run", F.sum("n").over(
        w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w)))
    return run.groupBy(*keys).agg(*[
        F.min(F.when(F.col("run") >= F.col("all") * s, F.col(value))).alias(name) for name, s in shares.items()])


def _start(vectors: DataFrame) -> DataFrame:
    """Medians, and squared interquartile scales as a diagonal covariance."""
    parts = vectors.select(*_GROUP, F.posexplode("x").alias("j", "v"))
    counts = parts.groupBy(*_GROUP, "j", "v").agg(F.count("*").alias("n"))
    q = _quantile_by_count(counts, [*_GROUP, "j"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    wide = q.groupBy(*_GROUP).agg(
        *[F.max(F.when(F.col("j") == j, F.col("q2"))).cast("double").alias(f"m{j}") for j in range(DIM)],
        *[F.max(F.when(F.col("j") == j, (F.col("q3") - F.col("q1")) / 1.349)).alias(f"s{j}") for j in range(DIM)])
    return wide.select(*_GROUP, *[f"m{j}" for j in range(DIM)], *[
        (F.pow(F.col(f"s{i}"), 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}")
        for i in range(DIM) for j in range(i + 1)])


def _estimate(kept: DataFrame) -> DataFrame:
    """Mean and consistent covariance of the kept rows of each group."""
    x = [F.col("x")[j] for j in range(DIM)]
    sums = kept.groupBy(*_GROUP).agg(
        F.count("*").cast("double").alias("n"), *[F.sum(x[j]).cast("double").alias(f"t{j}") for j in range(DIM)],
        *[F.sum(x[i] * x[j]).cast("double").alias(f"p{i}{j}") for i in range(DIM) for j in range(i + 1)])
    factor = H / chi2_cdf(chi2_quantile(H, DIM), DIM + 2)
    return sums.select(*_GROUP, *[(F.col(f"t{j}") / F.col("n")).alias(f"m{j}") for j in range(DIM)], *[
        ((F.col(f"p{i}{j}") - F.col(f"t{i}") * F.col(f"t{j}") / F.col("n"))
         / F.greatest(F.col("n") - 1, F.lit(1.0)) * factor).alias(f"c{i}{j}")
        for i in range(DIM) for j in range(i + 1)])


def _factor(model: DataFrame) -> DataFrame:
    """Cholesky factor of covariance plus floors, column by column."""
    for i in range(DIM):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (F.lit(float(FLOOR[i] ** 2)) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # the floors keep pivots positive; greatest() only guards rounding
            model = model.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j
                                     else rest / F.col(f"l{j}{j}"))
    return model.select(*_GROUP, F.array(*[f"m{j}" for j in range(DIM)]).alias("m"),
                        F.array(*[f"l{i}{j}" for i in range(DIM) for j in range(i + 1)]).alias("l"))


def _with_distance(vectors: DataFrame, model: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance of each row to its group's estimate."""
    df = vectors.join(model, _GROUP, "left")
    for i in range(DIM):
        part = F.col("x")[i] - F.col("m")[i]
        for k in range(i):
            part = part - F.col("l")[i * (i + 1) // 2 + k] * F.col(f"z{k}")
        df = df.withColumn(f"z{i}", part / F.col("l")[i * (i + 1) // 2 + i])
    z = [F.col(f"z{i}") for i in range(DIM)]
    total = z[0] * z[0]
    for c in z[1:]:
        total = total + c * c
    return df.withColumn("distance", total).drop("m", "l", *[f"z{i}" for i in range(DIM)])


def pooled(stats: DataFrame) -> DataFrame:
    """``stats`` with the small groups of each language under one source name."""
    large = (stats.where(~F.col("base_failed")).groupBy(*_GROUP).agg(F.count("*").alias("n"))
             .where(F.col("n") >= MIN_GROUP).select(*_GROUP, F.lit(True).alias("large")))
    return stats.join(large, _GROUP, "left").withColumn(
        "g_source", F.when(F.col("large"), F.col("g_source")).otherwise(F.lit(POOLED))).drop("large")


def fit(stats: DataFrame) -> DataFrame:
    """``g_lang, g_source, m, l``: centre and Cholesky factor of each group."""
    vectors = stats.where(~F.col("base_failed")).select(*_GROUP, F.array(*_vector()).alias("x"))
    sizes = vectors.groupBy(*_GROUP).agg(F.count("*").alias("n")).where(F.col("n") >= MIN_GROUP).select(*_GROUP)
    model = write_once(_factor(_start(vectors).join(sizes, _GROUP, "left_semi")), "mcd")
    for _ in range(STEPS):
        near = _with_distance(vectors.join(model.select(*_GROUP), _GROUP, "left_semi"), model).withColumn(
            "ring", F.floor(F.log1p("distance") * 100))
        counts = near.groupBy(*_GROUP, "ring").agg(F.count("*").alias("n"))
        edge = _quantile_by_count(counts, _GROUP, "ring", {"edge": H})
        model = write_once(_factor(_estimate(near.join(edge, _GROUP).where("ring <= edge"))), "mcd")
    return model


def judge(docs: DataFrame) -> DataFrame:
    """Statistics of every row with ``distance`` (null: no estimate) and ``kept``."""
    stats = pooled(write_once(statistics(docs), "quality"))
    model = fit(stats)
    cutoff = chi2_quantile(TAIL, DIM)
    scored = _with_distance(stats.withColumn("x", F.array(*_vector())), model)
    return scored.drop("x").withColumn("kept", ~F.col("base_failed") & (
        F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff))


def keep_good(docs: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` without the rows that :func:`judge` rejects."""
    bad = write_once(judge(docs).where(~F.col("kept")).select(
        F.col("doc_id").alias("bad_id"), F.col("row_key").alias("bad_key")).distinct(), "rejected")
    few = bad.limit(limit + 1).count() <= limit
    same = (_row_key() == F.col("bad_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("bad_id"))
    return docs.join(F.broadcast(bad) if few else bad, same, "left_anti")
