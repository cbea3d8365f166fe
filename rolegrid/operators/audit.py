"""Constraint audit: what a database would refuse, as one violations table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _result(df: DataFrame, check: str) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.col("key").cast("string").alias("key"),
                     F.col("n").cast("long").alias("n"))


def duplicate_keys(df: DataFrame, check: str, *keys: str) -> DataFrame:
    """Keys that occur more than once (NULL keys never conflict)."""
    counted = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"))
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return _result(counted.where(F.col("n") > 1).select(key.alias("key"), "n"), check)


def orphans(child: DataFrame, check: str, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Foreign keys without a parent.

    Child keys are counted first: the anti join sees one row per distinct key,
    so a key held by a third of the rows is no hot partition.
    """
    keys = (child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("key"))
            .agg(F.count("*").alias("n")))
    parents = parent.select(F.col(pk).alias("__pk"))
    return _result(keys.join(parents, keys["key"] == parents["__pk"], "left_anti"), check)


def outside_set(df: DataFrame, check: str, column: str, allowed) -> DataFrame:
    bad = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
    return _result(bad.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")), check)


def missing(df: DataFrame, check: str, *columns: str) -> DataFrame:
    """Number of NULLs per column that must not have any; one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("key"), F.col(c).alias("n")) for c in columns])).alias("x"))
    return _result(long.select("x.key", "x.n").where(F.col("n") > 0), check)


def deep_pointers(postings: DataFrame, check: str = "pointer target is not canonical") -> DataFrame:
    """Pointers at a posting that itself points elsewhere."""
    targets = (postings.where(F.col("canonical_job_id").isNotNull())
               .groupBy(F.col("canonical_job_id").alias("key")).agg(F.count("*").alias("n")))
    followers = postings.where(F.col("canonical_job_id").isNotNull()).select(F.col("id").alias("__id"))
    return _result(targets.join(followers, targets["key"] == followers["__id"], "left_semi"), check)


def violations(*checks: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def audit_postings(postings: DataFrame, companies: DataFrame, sources: DataFrame) -> DataFrame:
    """Every constraint of the posting tables."""
    from rolegrid import schemas as S

    return violations(
        duplicate_keys(companies, "company name is unique", "name_normalized"),
        duplicate_keys(postings, "source url is unique", "source_id", "source_url"),
        duplicate_keys(sources, "source slug is unique", "slug"),
        orphans(postings, "company exists", "company_id", companies, "id"),
        orphans(postings, "source exists", "source_id", sources, "id"),
        orphans(postings, "canonical exists", "canonical_job_id", postings, "id"),
        outside_set(postings, "salary_conf value", "salary_conf", S.SALARY_CONFIDENCE),
        outside_set(postings, "mode value", "mode", S.WORK_MODES),
        outside_set(postings, "level value", "level", S.EXPERIENCE_LEVELS),
        missing(postings, "required value", *[f.name for f in S.POSTINGS if not f.nullable]),
        deep_pointers(postings),
    )
