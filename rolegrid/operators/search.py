"""Listing: filters, text search, keyset pages, public JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegrid.functions.text import bind, search_form
from rolegrid.schemas import DEFAULT_PAGE_SIZE, EXPERIENCE_LEVELS, MAX_PAGE_SIZE, WORK_MODES
from rolegrid.session import cut


class NotFound(LookupError):
    """No row with that key."""


def active_canonical() -> Column:
    return F.col("canonical_job_id").isNull() & F.col("is_active")


def clamp_limit(limit: int | None) -> int:
    if limit is None or limit <= 0:
        return DEFAULT_PAGE_SIZE
    return min(limit, MAX_PAGE_SIZE)


# --- text search ------------------------------------------------------------

def _term(form: Column, words: str) -> Column:
    """Test for one term or phrase; one without any token matches nothing."""
    needle = search_form(F.lit(words))
    return (F.trim(needle) != "") & F.contains(form, needle)


def text_matches(form: Column, all_of=(), any_of=(), none_of=()) -> Column:
    """Every term of ``all_of``, one of ``any_of`` (if given), none of ``none_of``.

    A term of several words is a phrase. Without any term nothing matches.
    """
    def test(f: Column) -> Column:
        tests = [_term(f, t) for t in all_of]
        if any_of:
            tests.append(reduce(lambda a, b: a | b, [_term(f, t) for t in any_of]))
        tests += [~_term(f, t) for t in none_of]
        return reduce(lambda a, b: a & b, tests)

    return bind(form, test) if all_of or any_of or none_of else F.lit(False)


def search_tokens(df: DataFrame, doc_id: str, form: Column) -> DataFrame:
    """Token table ``doc_id, pos, token`` for repeated searches.

    ``save_token_table`` stores it for searches that read only the asked tokens.
    """
    tokens = F.filter(F.split(form, " "), lambda t: t != "")
    return (df.select(F.col(doc_id).alias("doc_id"), F.posexplode_outer(tokens).alias("pos", "token"))
            .where(F.col("token").isNotNull())
            .withColumn("pos", F.col("pos") + 1))


def save_token_table(tokens: DataFrame, path: str) -> None:
    """Write a token table sorted by token, then document.

    Range partitioning on both splits a token that a third of all rows hold;
    the min/max of the files prune the rest.
    """
    (tokens.repartitionByRange("token", "doc_id").sortWithinPartitions("token", "doc_id", "pos")
     .write.mode("errorifexists").parquet(path))


def _tokens_of(term: str) -> list[str]:
    """Tokens of a search term, cut as ``search_form`` cuts texts."""
    return "".join(c if c.isalnum() else " " for c in term.lower()).split()


def search_by_tokens(tokens: DataFrame, all_of=(), any_of=(), none_of=(),
                     documents: DataFrame | None = None) -> DataFrame:
    """Documents of a token table by the rules of ``text_matches``.

    A term is a run of tokens. Only rows of asked tokens are read; a row votes
    for the place where its term would start, and a place with a vote of every
    token of the term is a hit. The rows are dealt by document once, and both
    counts happen there: votes per term and place, hits per document.

    Documents that hold none of the asked tokens are no rows of the token table,
    so a search of exclusions alone needs ``documents``, one ``doc_id`` per
    document with a search form: the excluded ones are taken out of it.
    """
    if none_of and not all_of and not any_of:
        if documents is None:
            raise ValueError("a search of exclusions alone needs the table of documents")
        ids, out = documents.select("doc_id"), [t for t in none_of if _tokens_of(t)]
        return ids.join(search_by_tokens(tokens, any_of=out), "doc_id", "left_anti") if out else ids
    terms = [_tokens_of(t) for t in (*all_of, *any_of, *none_of)]
    need, either = len(all_of), len(all_of) + len(any_of)
    if not terms or not all(terms[:need]) or (any_of and not any(terms[need:either])):
        return tokens.select("doc_id").limit(0)
    votes = [(i, k, word) for i, term in enumerate(terms) for k, word in enumerate(term)]
    wanted = sorted({word for _, _, word in votes})
    cast = F.filter(F.array(*[F.when(F.col("token") == word, F.struct(
        F.lit(i).alias("term"), F.lit(k).alias("at"))) for i, k, word in votes]), lambda v: v.isNotNull())
    rows = (tokens.where(F.col("token").isin(wanted)).repartition("doc_id")
            .select("doc_id", "pos", F.explode(cast).alias("v"))
            .select("doc_id", F.col("v.term").alias("term"), (F.col("pos") - F.col("v.at")).alias("start"), "v.at"))
    sizes = F.element_at(F.array(*[F.lit(len(t)) for t in terms]), F.col("term") + 1)
    # sets of numbers below the size of a term and the number of terms
    places = (rows.groupBy("doc_id", "term", "start").agg(F.size(F.collect_set("at")).alias("n"))
              .where(F.col("n") == sizes))
    hits = places.groupBy("doc_id").agg(F.collect_set("term").alias("hit"))
    held = lambda numbers: F.array(*[F.lit(i) for i in numbers])
    test = F.size(F.array_intersect("hit", held(range(need)))) == len(set(range(need))) if need else F.lit(True)
    if any_of:
        test = test & F.arrays_overlap("hit", held(range(need, either)))
    if none_of:
        test = test & ~F.arrays_overlap("hit", held(range(either, len(terms))))
    return hits.where(test).select("doc_id")


# --- filters ----------------------------------------------------------------

def listing_filters(stack: list[str] | None = None, salary_min: int | None = None,
                    mode: str | None = None, level: str | None = None,
                    city: str | None = None, text: dict | None = None) -> list[Column]:
    """Predicates of the given arguments only; absent ones never reach the plan."""
    tests: list[Column] = []
    if stack is not None:
        wanted = F.array(*[F.lit(s) for s in stack]).cast("array<string>")
        tests.append(F.arrays_overlap(F.col("stack"), wanted))
    if salary_min is not None:
        if salary_min < 0:
            raise ValueError("salary_min must not be negative")
        tests.append(F.col("salary_max") >= salary_min)
    if mode is not None:
        if mode not in WORK_MODES:
            raise ValueError(f"unknown mode {mode!r}")
        tests.append(F.col("mode") == mode)
    if level is not None:
        if level not in EXPERIENCE_LEVELS:
            raise ValueError(f"unknown level {level!r}")
        tests.append(F.col("level") == level)
    if city is not None:
        # a pattern match: % and _ are wildcards
        tests.append(F.col("location_city").ilike(city))
    if text is not None:
        # the stored column: no text is tokenized at search time
        tests.append(text_matches(F.col("search_text"), **text))
    return tests


def after_cursor(cursor: tuple, when: str = "posted_at", key: str = "id") -> Column:
    """Rows behind ``(when, key)`` in descending order, unknown dates last.

    Spelled as plain comparisons so that the scan can use them.
    """
    posted, last = cursor
    w, k = F.col(when), F.col(key)
    if posted is None:
        return w.isNull() & (k < F.lit(last))
    return (w < F.lit(posted)) | ((w == F.lit(posted)) & (k < F.lit(last))) | w.isNull()


def list_postings(postings: DataFrame, limit: int | None = None, cursor: tuple | None = None,
                  **filters) -> DataFrame:
    """One page of active canonical postings, newest first."""
    tests = [active_canonical(), *listing_filters(**filters)]
    if cursor is not None:
        tests.append(after_cursor(cursor))
    return keyset_page(postings.where(reduce(lambda a, b: a & b, tests)), limit)


def keyset_page(df: DataFrame, limit: int | None = None, cursor: tuple | None = None,
                when: str = "posted_at", key: str = "id") -> DataFrame:
    if cursor is not None:
        df = df.where(after_cursor(cursor, when, key))
    return df.orderBy(F.col(when).desc_nulls_last(), F.col(key).desc()).limit(clamp_limit(limit))


def next_cursor(page: DataFrame, limit: int | None = None, when: str = "posted_at",
                key: str = "id") -> tuple | None:
    """Cursor behind a page of ``list_postings``; None if the page is not full."""
    rows = page.select(when, key).collect()  # at most MAX_PAGE_SIZE rows
    if not rows or len(rows) < clamp_limit(limit):
        return None
    return (rows[-1][0], rows[-1][1])


def page_boundaries(df: DataFrame, limit: int | None = None, when: str = "posted_at",
                    key: str = "id") -> DataFrame:
    """Last row of every full page: ``page, when, key``, ready as cursors.

    A ranking over the whole table would run in one task. Here the keys are
    range-sorted, numbered within their partition, and shifted by the sizes of
    the partitions before it; that offset table has one row per partition,
    whatever the data. ``limit`` is taken as it is: the clamp belongs to the
    listing. The sorted keys are checkpointed so that numbering and
    offsets see the same partitions.
    """
    size = DEFAULT_PAGE_SIZE if limit is None or limit <= 0 else limit
    ordered = cut(
        df.select(F.col(when).alias("when"), F.col(key).alias("key"))
        .orderBy(F.col("when").desc_nulls_last(), F.col("key").desc())
        .withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    numbered = ordered.select("when", "key", part.alias("part"),
                              (F.col("__at") - F.shiftleft(part, 33)).alias("row"))
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))
    offsets = sizes.select("part", (F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
        .alias("before"))
    rank = F.col("before") + F.col("row") + 1
    return (numbered.join(F.broadcast(offsets), "part")  # one row per partition
            .where(rank % size == 0)
            .select((rank / size).cast("long").alias("page"),
                    F.col("when").alias(when), F.col("key").alias(key)))


# --- lookups and output ------------------------------------------------------

def by_id(postings: DataFrame, value, key: str = "id") -> DataFrame:
    """Point lookup in any state (duplicates and inactive rows too)."""
    return postings.where(F.col(key) == F.lit(value))


def one(df: DataFrame, what: str = "row"):
    """The only row of a point lookup, or NotFound."""
    rows = df.take(1)
    if not rows:
        raise NotFound(what)
    return rows[0]


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in ``ids``."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def with_company(postings: DataFrame, companies: DataFrame) -> DataFrame:
    """Add the display name; an unknown company gives an empty one."""
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    return (postings.join(names, "company_id", "left")
            .withColumn("company", F.coalesce("company", F.lit(""))))


def public_json(postings: DataFrame) -> DataFrame:
    """``id, json``: the public form; absent fields are left out, tags never are."""
    def shown(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("")).alias(name)

    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    fields = F.struct(
        "id", "title", "company", shown("description"), "salary_min", "salary_max",
        F.col("salary_conf").alias("salary_confidence"), shown("salary_raw"),
        F.coalesce("stack", F.array().cast("array<string>")).alias("stack"),
        shown("location"), shown("location_city"), "mode", "level", "source_url",
        stamp("posted_at"), stamp("first_seen_at"), stamp("last_seen_at"), "is_active")
    return postings.select("id", F.to_json(fields).alias("json"))


def details(postings: DataFrame, companies: DataFrame, asked: DataFrame) -> DataFrame:
    """Every asked posting (column ``id``) and the listings merged into it.

    Long form: ``asked_id``, ``role`` (``job`` or ``duplicate``) and the
    posting's columns. A posting asked for that is a duplicate itself comes
    alone: listings are merged into canonical postings only.
    """
    ids = asked.select(F.col("id").alias("asked_id")).distinct()
    jobs = postings.join(ids, postings["id"] == ids["asked_id"]).withColumn("role", F.lit("job"))
    merged = postings.join(ids, postings["canonical_job_id"] == ids["asked_id"]).withColumn("role", F.lit("duplicate"))
    return with_company(jobs.unionByName(merged), companies)


def detail(postings: DataFrame, companies: DataFrame, value) -> DataFrame:
    """One posting and every listing merged into it, duplicates oldest first."""
    asked = postings.where(F.col("id") == F.lit(value)).select("id")
    return (details(postings, companies, asked).drop("asked_id")
            .orderBy(F.col("role").desc(), "first_seen_at", "first_seq"))
