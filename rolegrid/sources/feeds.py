"""Feeds: named producers of raw postings, combined with partial failure."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrid.schemas import RAW_POSTINGS
from rolegrid.session import stage

# rows, or rows and a table of errors (feed, error)
Feed = Callable[[SparkSession, int], "DataFrame | tuple[DataFrame, DataFrame]"]


class UnknownFeed(KeyError):
    """The slug has no registered feed."""


@dataclass
class FeedRegistry:
    """Source slug -> function (spark, max_pages) -> raw postings."""

    feeds: dict[str, Feed] = field(default_factory=dict)

    def register(self, slug: str, feed: Feed) -> None:
        self.feeds[slug] = feed

    def has(self, slug: str) -> bool:
        return slug in self.feeds

    def read(self, spark: SparkSession, slug: str, max_pages: int = 0) -> DataFrame:
        """Reject an unknown slug before any work starts."""
        if slug not in self.feeds:
            raise UnknownFeed(slug)
        return self.feeds[slug](spark, max_pages)

    def collect(self, spark: SparkSession, slug: str, max_pages: int = 0) -> tuple[DataFrame, str | None]:
        """Rows of a feed and its error text. A feed that fails to start or to
        be read gives no rows; its rows are read here once to find out."""
        try:
            found = self.read(spark, slug, max_pages)
            rows, errors = found if isinstance(found, tuple) else (found, None)
            rows = stage(rows, "feed")
            return rows, error_text(errors).first().error if errors is not None else None
        except UnknownFeed:
            raise
        except Exception as exc:  # noqa: BLE001 - any feed error belongs to its run
            return spark.createDataFrame([], RAW_POSTINGS), f"scrape: {str(exc).splitlines()[0]}"


def arrival_order(rows: DataFrame, *order: str) -> DataFrame:
    """Raw postings with an ``ingest_seq`` that grows in the order of ``order``.

    Without columns the rows keep the order they are read in. Numbers have
    gaps; they only order deliveries.
    """
    have = set(rows.columns)
    base = rows.orderBy(*order) if order else rows
    if not order and "ingest_seq" in have:
        return rows
    names = [f for f in RAW_POSTINGS.fieldNames() if f not in ("ingest_seq", "source_id")]
    return base.select(F.monotonically_increasing_id().alias("ingest_seq"), *names,
                       *(["source_id"] if "source_id" in have else []))


def union_feeds(spark: SparkSession, feeds: dict[str, Callable[[], DataFrame]],
                ) -> tuple[DataFrame, DataFrame]:
    """Rows of all feeds and the errors of those that failed.

    A failing feed never drops the rows of the others: each feed is read into
    the shared folder on its own, so one with a file that cannot be read fails
    alone. The number of feeds is a property of the configuration, not of the
    data.
    """
    good, errors = [], []
    for name, read in feeds.items():
        try:
            good.append(stage(read(), "feed").withColumn("feed", F.lit(name)))
        except Exception as exc:  # noqa: BLE001 - any feed error is a row
            errors.append((name, f'feed "{name}": {str(exc).splitlines()[0] if str(exc) else type(exc).__name__}'))
    if good:
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), good)
    else:
        rows = spark.createDataFrame([], RAW_POSTINGS).withColumn("feed", F.lit(""))
    return rows, spark.createDataFrame(errors, "feed string, error string")


def error_text(errors: DataFrame) -> DataFrame:
    """``error``: the feed errors as one text, in feed order; NULL if there are none.

    One line per configured feed at most, so the text is bounded.
    """
    ordered = F.array_sort(F.collect_list(F.struct("feed", "error")))
    return errors.agg(F.nullif(F.array_join(F.transform(ordered, lambda e: e["error"]), "\n"),
                               F.lit("")).alias("error"))
