"""Statistics over active canonical postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.operators.search import active_canonical


def active_count(postings: DataFrame) -> DataFrame:
    return postings.where(active_canonical()).agg(F.count("*").alias("active_jobs"))


def tag_rows(postings: DataFrame, key: str = "id", tags: str = "stack") -> DataFrame:
    """``key, tag``: one row per tag; rows without tags give none."""
    return (postings.select(key, F.explode_outer(tags).alias("tag"))
            .where(F.col("tag").isNotNull()))


def tag_stats(postings: DataFrame) -> DataFrame:
    """Postings per tag, most common first."""
    return (tag_rows(postings.where(active_canonical()))
            .groupBy("tag").agg(F.count("*").alias("job_count"))
            .orderBy(F.col("job_count").desc(), F.col("tag")))


def source_stats(sources: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings per source with the last run; sources without any stay, at 0.

    Postings are counted before the join, so a source that holds a third of
    them crosses the shuffle as one row per task.
    """
    counts = (postings.where(active_canonical()).groupBy("source_id")
              .agg(F.count("*").alias("n")))
    return (sources.join(counts, sources["id"] == counts["source_id"], "left")
            .select("id", "slug", "name", "last_run_at",
                    F.coalesce("n", F.lit(0)).alias("active_jobs"))
            .orderBy("slug"))


def stats_bundle(sources: DataFrame, postings: DataFrame) -> dict[str, DataFrame]:
    """total, by_source and by_tag over one narrow read of the postings."""
    narrow = postings.where(active_canonical()).select(
        "id", "source_id", "stack", "canonical_job_id", "is_active")
    return {"total": active_count(narrow), "by_source": source_stats(sources, narrow),
            "by_tag": tag_stats(narrow)}


# --- statistics kept by change ---------------------------------------------------

COUNTED = ("source_id", "stack", "canonical_job_id", "is_active")


def contributions(postings: DataFrame) -> DataFrame:
    """``part, name``: a row for everything a posting counts in (total, its source, each tag)."""
    kind = lambda part, name: F.struct(F.lit(part).alias("part"), name.alias("name"))
    tags = F.transform(F.array_distinct(F.coalesce("stack", F.array().cast("array<string>"))), lambda t: kind("tag", t))
    return (postings.where(active_canonical())
            .select(F.explode(F.concat(F.array(kind("total", F.lit("")), kind("source", F.col("source_id").cast("string"))), tags)).alias("c"))
            .select("c.part", "c.name"))


def stat_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``part, name, n``: what changed postings take from the counts and add to them.

    Both hold the changed postings only, as they were and as they are; a posting
    that is new, or gone, is in one of them. A posting that counts alike before
    and after leaves no row.
    """
    signed = (contributions(before).withColumn("n", F.lit(-1).cast("long"))
              .unionByName(contributions(after).withColumn("n", F.lit(1).cast("long"))))
    return signed.groupBy("part", "name").agg(F.sum("n").alias("n")).where(F.col("n") != 0)


def add_changes(counts: DataFrame, *changes: DataFrame) -> DataFrame:
    """Counts after changes; what is down at 0 is left out.

    A table of counts has a row per source and tag, not per posting.
    """
    for more in changes:
        counts = counts.unionByName(more)
    return counts.groupBy("part", "name").agg(F.sum("n").alias("n")).where(F.col("n") != 0)


def kept_bundle(sources: DataFrame, counts: DataFrame) -> dict[str, DataFrame]:
    """``stats_bundle`` from a table of counts; no posting is read."""
    part = lambda name: counts.where(F.col("part") == name)
    n = part("source").select(F.col("name").cast("int").alias("source_id"), "n")
    return {
        "total": part("total").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("active_jobs")),
        "by_source": (sources.join(n, sources["id"] == n["source_id"], "left")
                      .select("id", "slug", "name", "last_run_at", F.coalesce("n", F.lit(0)).alias("active_jobs")).orderBy("slug")),
        "by_tag": (part("tag").select(F.col("name").alias("tag"), F.col("n").alias("job_count"))
                   .orderBy(F.col("job_count").desc(), F.col("tag")))}
