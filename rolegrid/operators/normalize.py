"""Raw postings to normalized postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.functions.keys import company_key, fingerprint, row_key, title_key
from rolegrid.functions.labels import city, experience_level, work_mode
from rolegrid.functions.reuse import spelled_once
from rolegrid.functions.salary import stored_bounds, with_salary
from rolegrid.functions.tags import DEFAULT_DICTIONARY, Alias, text_tags
from rolegrid.functions.text import blank_to_null, html_to_text, search_text, trim_white


def normalize_postings(raw: DataFrame, dictionary: tuple[Alias, ...] = DEFAULT_DICTIONARY,
                       more: tuple[str, ...] = ()) -> DataFrame:
    """Structure every text column of a raw posting table.

    A pure projection: no shuffle, no Python rows. Filters over its columns
    would be pushed below it and repeat the text work, so callers that filter
    write the result first (``session.stage``). ``more``: other columns of
    ``raw`` that stay.
    """
    cleaned, structured, stored = _columns(dictionary)
    return with_salary(raw.withColumns(cleaned)).withColumns(structured).select(*stored, *more)


@spelled_once
def _columns(dictionary: tuple[Alias, ...]) -> tuple:
    """The steps of ``normalize_postings``: columns before and after the salary, and the result's."""
    low, high = stored_bounds(F.col("salary_min"), F.col("salary_max"), F.col("salary_conf"))
    structured = {
        "title_normalized": title_key(F.col("title")),
        "company_normalized": company_key(F.col("company")),
        "stack": text_tags(F.col("title"), F.col("description"), dictionary),
        "mode": work_mode(F.col("title"), F.col("location"), F.col("description")),
        "level": experience_level(F.col("title"), F.col("description")),
        "location_city": city(F.col("location")),
        "salary_min": low, "salary_max": high,
    }
    return {"description": html_to_text(F.col("description"))}, structured, (
        "ingest_seq", "source_id", "source_url",
        row_key(F.col("source_id"), F.col("source_url")).alias("id"),
        trim_white(F.col("title")).alias("title"), "title_normalized",
        trim_white(F.col("company")).alias("company_name"), "company_normalized",
        row_key(F.col("company_normalized")).alias("company_id"),
        blank_to_null(F.col("description")).alias("description"),
        "salary_min", "salary_max", "salary_conf",
        blank_to_null(F.col("salary_raw")).alias("salary_raw"),
        "stack",
        blank_to_null(F.col("location")).alias("location"),
        blank_to_null(F.col("location_city")).alias("location_city"),
        "mode", "level",
        blank_to_null(F.col("source_job_id")).alias("source_job_id"),
        fingerprint(F.col("company_normalized"), F.col("title_normalized")).alias("fingerprint"),
        "posted_at",
        search_text(F.col("title"), F.col("stack"), F.col("description")).alias("search_text"),
    )


def remade() -> dict[str, tuple[tuple[str, ...], Column]]:
    """Columns that others of a normalized posting give: what they are made of, and how.

    Written tables leave them out and readers make them again: hashes take more
    room than what they are made of, and the search text repeats the texts.
    """
    c = F.col
    return {"id": (("source_id", "source_url"), row_key(c("source_id"), c("source_url"))),
            "company_id": (("company_normalized",), row_key(c("company_normalized"))),
            "fingerprint": (("company_normalized", "title_normalized"), fingerprint(c("company_normalized"), c("title_normalized"))),
            "search_text": (("title", "stack", "description"), search_text(c("title"), c("stack"), c("description")))}


def with_remade(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` with the columns ``names`` of ``remade``."""
    made = remade()
    return rows.withColumns({name: made[name][1] for name in names})


def left_out(rows: DataFrame, *names: str) -> DataFrame:
    """The columns ``names`` of ``remade``, NULL where they are what they would be made of.

    Rows stored before may hold other ids: those stay. ``put_back`` is the way back.
    """
    made = remade()
    return rows.withColumns({name: F.nullif(F.col(name), made[name][1]) for name in names})


def put_back(rows: DataFrame, *names: str) -> DataFrame:
    made = remade()
    return rows.withColumns({name: F.coalesce(F.col(name), made[name][1]) for name in names})
