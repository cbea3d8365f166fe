"""Duplicate groups, canonical election and pointer maintenance.

A posting is a duplicate of another if both have the same fingerprint, or the
same company and titles of trigram similarity above 0.7. Pointers form a flat
forest: a duplicate points straight at its canonical posting.

``resolve`` settles a whole table as sets: postings that are linked by any
chain of matches form one group. The one-by-one rule of a row-at-a-time store
depends on arrival order where two postings match only through a third one;
elsewhere both give the same pointers. Only pairs the rule accepts are linked,
and nothing is capped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegrid.operators.components import connected_components
from rolegrid.operators.similarity import spanning_edges
from rolegrid.session import remove_folder, stage, staged, use_skew_settings

NODE = ("fingerprint", "company_id", "title_normalized")


def preference() -> Column:
    """Orders postings of a group: known date, earliest date, first seen."""
    return F.struct(F.col("posted_at").isNull().alias("unknown"), "posted_at",
                    "first_seen_at", "first_seq", "id")


def elect_canonical(df: DataFrame, *group: str) -> DataFrame:
    """``group..., canonical_id, members``: the preferred posting per group.

    A minimum over a struct is a partial aggregate, so a group holding a third
    of all rows shrinks to one row per task before the shuffle; a ranking
    window would send it to a single task.
    """
    return (df.groupBy(*group)
            .agg(F.min(preference()).alias("best"), F.count("*").alias("members"))
            .select(*group, F.col("best.id").alias("canonical_id"), "members"))


def match_edges(nodes: DataFrame) -> DataFrame:
    """Edges that span the groups of duplicate keys: ``nodes`` has the NODE columns and ``node``.

    The OR of the rule becomes two equi-joins. Keys with the same fingerprint
    are tied to the smallest of them (a star, not all pairs); similar titles
    are tied as far as their components need it. Keys with the same company and
    title need no tie of their own: the fingerprint is made of both. A column
    ``changed`` limits the title pairs to those with a changed key.
    """
    low = nodes.groupBy("fingerprint").agg(F.min("node").alias("v"), F.count("*").alias("n"))
    star = (nodes.join(low.where(F.col("n") > 1), "fingerprint").where(F.col("node") != F.col("v"))
            .select(F.col("node").alias("u"), "v"))
    similar = spanning_edges(nodes, "company_id", "title_normalized", "node",
                             changed="changed" if "changed" in nodes.columns else None)
    return star.unionByName(similar)


def duplicate_groups(postings: DataFrame) -> DataFrame:
    """One row per duplicate key with its group and the group's canonical id.

    A boolean column ``changed`` tells the postings whose match with the others
    is not settled yet; without it all are compared with all. Columns: the NODE columns, ``members`` (postings of the key), ``component``
    (smallest posting id of the group), ``canonical_id``.
    """
    groups, texts = _groups(postings)
    return groups.select("component", *[unpack(F.col(c)).alias(c) if c in texts else F.col(c) for c in NODE], "members", "canonical_id")


def shared_prints(postings: DataFrame, packed: bool = False) -> DataFrame:
    """``fingerprint, canonical_id`` of the groups that hold several postings.

    A posting of any other fingerprint is alone in its group. Groups have
    different canonical postings, so ``canonical_id`` also names the group. Ids
    are compared as bytes on the way: of postings alike in all else, one whose id
    is no sha256 is preferred to one whose id is. ``packed``: both columns, then
    ``print, canonical_id``, stay bytes; they must be strings.
    """
    texts = [c for c, kind in postings.select("id", "fingerprint").dtypes if kind == "string"]
    groups, _ = _groups(postings.withColumn("id", pack(F.col("id"))) if "id" in texts else postings)
    prints = (groups.where((F.col("members") > 1) | F.col("tied"))
              .groupBy("fingerprint").agg(F.min("canonical_id").alias("canonical_id")))
    if packed:
        return prints.withColumnRenamed("fingerprint", "print")
    return prints.withColumns({c: unpack(F.col(c)) for c, of in (("fingerprint", "fingerprint"), ("canonical_id", "id")) if of in texts})


def _groups(postings: DataFrame) -> tuple[DataFrame, list[str]]:
    """The duplicate keys with their group, and the key columns held as bytes; ``tied``: to another key."""
    use_skew_settings(postings.sparkSession)
    marks = [F.max("changed").alias("changed")] if "changed" in postings.columns else []
    texts = [c for c, kind in postings.select("fingerprint", "company_id").dtypes if kind == "string"]
    nodes = stage(postings.withColumns({c: pack(F.col(c)) for c in texts}).groupBy(*NODE)
                  .agg(F.min("id").alias("node"), F.min(preference()).alias("best"),
                       F.count("*").alias("members"), *marks), "nodes")
    components = connected_components(match_edges(nodes))
    # a key that is tied to no other is a group of its own and elects nobody
    tied = stage(nodes.select("node", "best").join(components, "node"), "tied")
    winners = tied.groupBy("component").agg(F.min("best")["id"].alias("canonical_id"))
    labels = tied.select("node", "component").join(winners, "component")
    alone = F.col("component").isNull()
    groups = (nodes.where(F.col("node").isNotNull()).join(labels, "node", "left")
              .withColumn("tied", ~alone)
              .withColumn("canonical_id", F.when(alone, F.col("best")["id"]).otherwise(F.col("canonical_id")))
              .withColumn("component", F.coalesce("component", "node")))
    return groups, texts


_HEX = "\\A[0-9a-f]{64}\\z"


def pack(text: Column) -> Column:
    """A string as bytes, a sha256 in hex in half its length; equal only where the strings are."""
    return (F.when(F.rlike(text, F.lit(_HEX)), F.concat(F.lit(b"\x01"), F.unhex(text)))
            .otherwise(F.concat(F.lit(b"\x00"), text.cast("binary"))))


def unpack(packed: Column) -> Column:
    rest = F.substring(packed, 2, 2**31 - 1)
    return F.when(F.substring(packed, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


_packed, _unpacked = pack, unpack


def groups_by_print(groups: DataFrame) -> DataFrame:
    """``fingerprint, component, canonical_id`` of ``duplicate_groups``.

    Keys with the same fingerprint are in one group, so the fingerprint alone
    leads a posting to its group.
    """
    return groups.groupBy("fingerprint").agg(F.min("component").alias("component"),
                                             F.min("canonical_id").alias("canonical_id"))


def resolve(postings: DataFrame) -> DataFrame:
    """``id, canonical_id`` of every posting without a pointer, NULL if canonical."""
    open_rows = postings.where(F.col("canonical_job_id").isNull())
    groups = groups_by_print(duplicate_groups(open_rows)).drop("component")
    return (open_rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in NODE]))
            .select("id", "fingerprint").join(groups, "fingerprint")
            .select("id", F.when(F.col("id") != F.col("canonical_id"), F.col("canonical_id"))
                    .alias("canonical_id")))


MOVE_IN_CYCLE = "the moves lead back to where they came from"


def settle_moves(moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Final targets of chained moves ``old_id -> new_id``, and the moves without one.

    Pointer jumping: every round doubles how far each move reaches, so a chain of
    n moves takes log2(n) rounds, each written in the shared folder in place of
    the one before. Moves still
    open after as many rounds as there can be run into a cycle; they are returned
    with an ``error``. A posting moved to several is moved to the smallest id.
    """
    moves = (moved.where(F.col("old_id").isNotNull() & F.col("new_id").isNotNull())
             .groupBy("old_id").agg(F.min("new_id").alias("first_id")).withColumn("new_id", F.col("first_id")))
    spark = moved.sparkSession
    now, folder = staged(moves.withColumn("jumped", F.lit(True)), "moves")
    rounds = max(1, now.count()).bit_length() + 1
    for _ in range(rounds):
        # both sides grow with the moves: none of them goes through the driver
        ahead = now.select(F.col("old_id").alias("__at"), F.col("new_id").alias("__to")).hint("merge")
        ahead_of = now.join(ahead, now["new_id"] == F.col("__at"), "left")
        before = folder
        now, folder = staged(ahead_of.select("old_id", "first_id", F.coalesce("__to", "new_id").alias("new_id"),
                                             F.col("__at").isNotNull().alias("jumped")), "moves")
        remove_folder(spark, before)
        if not now.where("jumped").take(1):
            break
    open_ends = now.select(F.col("old_id").alias("__at")).distinct().hint("merge")
    done = now.join(open_ends, now["new_id"] == F.col("__at"), "left")
    return (done.where(F.col("__at").isNull()).select("old_id", "new_id"),
            done.where(F.col("__at").isNotNull()).select("old_id", F.col("first_id").alias("new_id"),
                                                         F.lit(MOVE_IN_CYCLE).alias("error")))


def reparent(postings: DataFrame, moved: DataFrame) -> DataFrame:
    """Repoint followers of displaced postings; ``moved``: old_id, new_id.

    ``moved`` maps to final winners; moves that follow each other go through
    ``settle_moves`` first. A posting moved to several is moved to the smallest id.
    """
    m = moved.groupBy(F.col("old_id").alias("__old")).agg(F.min("new_id").alias("__new")).hint("merge")
    return (postings.join(m, postings["canonical_job_id"] == F.col("__old"), "left")
            .withColumn("canonical_job_id", F.coalesce("__new", "canonical_job_id"))
            .drop("__old", "__new"))


def apply_pointers(postings: DataFrame, pointers: DataFrame, ids: Column | None = None) -> DataFrame:
    """Store resolved pointers and repoint the followers of the losers.

    ``pointers``: id, canonical_id (strings). Both steps are one lookup: a posting
    moves by its own id if it is canonical so far, else by the id it points at.
    ``ids`` gives the postings' ids where the column ``id`` leaves them out.
    Adds ``was_moved``.
    """
    p = (pointers.where(F.col("canonical_id").isNotNull())
         .groupBy(pack(F.col("id")).alias("__id")).agg(F.min("canonical_id").alias("__to")))
    anchor = F.coalesce(F.col("canonical_job_id"), F.col("id") if ids is None else ids)
    return (postings.withColumn("__anchor", pack(anchor)).join(p, F.col("__anchor") == F.col("__id"), "left")
            .withColumns({"canonical_job_id": F.coalesce("__to", "canonical_job_id"),
                          "was_moved": F.col("__to").isNotNull()})
            .drop("__anchor", "__id", "__to"))


SELF_MERGE = "a posting cannot be a duplicate of itself"
UNKNOWN_TARGET = "the target of the merge does not exist"
UNKNOWN_POSTING = "the posting to merge does not exist"


def manual_merge(postings: DataFrame, merges: DataFrame, seq: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Moderator merges ``job_id -> canonical_id``.

    Merges of a posting into itself, into an unknown posting or of an unknown
    posting are rejected. Of several merges of one posting the last by the
    column ``seq`` counts (without it, or in a tie, the largest target), so a
    posting never multiplies. Sets the pointer only, as a merge by hand does:
    followers stay. Returns the postings and the rejected merges.
    """
    targets = postings.select(F.col("id").alias("canonical_id"), F.lit(True).alias("__target"))
    jobs = postings.select(F.col("id").alias("job_id"), F.lit(True).alias("__known"))
    checked = (merges.join(targets, "canonical_id", "left").join(jobs, "job_id", "left")
               .withColumn("error", F.when(F.col("job_id") == F.col("canonical_id"), SELF_MERGE)
                           .when(F.col("__target").isNull(), UNKNOWN_TARGET)
                           .when(F.col("__known").isNull(), UNKNOWN_POSTING)).drop("__target", "__known"))
    order = F.col(seq) if seq else F.lit(0)
    good = (checked.where(F.col("error").isNull()).groupBy(F.col("job_id").alias("__job"))
            .agg(F.max(F.struct(order.alias("seq"), "canonical_id")).alias("last"))
            .select("__job", F.col("last.canonical_id").alias("__to")))
    merged = (postings.join(good, postings["id"] == F.col("__job"), "left")
              .withColumn("canonical_job_id", F.coalesce("__to", "canonical_job_id"))
              .drop("__job", "__to"))
    return merged, checked.where(F.col("error").isNotNull()).select(*merges.columns, "error")


def duplicates_of(postings: DataFrame, canonicals: DataFrame | None = None) -> DataFrame:
    """Canonical postings next to their duplicates, one row per duplicate.

    Long form on purpose: a canonical posting may have any number of
    duplicates, so they are never gathered into one array.
    """
    heads = postings if canonicals is None else canonicals
    h = heads.select(F.col("id").alias("canonical_id"), F.col("title").alias("canonical_title"))
    d = (postings.where(F.col("canonical_job_id").isNotNull())
         .withColumnRenamed("canonical_job_id", "canonical_id"))
    return d.join(h, "canonical_id")


def related(open_rows: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows that a batch can match: same company or same fingerprint.

    Canonical postings that no batch row can match keep their state, so an
    incremental run resolves only the companies it touches.
    """
    companies = batch.select("company_id").distinct().withColumn("__c", F.lit(True))
    prints = batch.select("fingerprint").distinct().withColumn("__f", F.lit(True))
    return (open_rows.join(companies, "company_id", "left").join(prints, "fingerprint", "left")
            .where(F.col("__c") | F.col("__f")).select(open_rows.columns))


def duplicate_on_arrival(members: DataFrame, span: int = 100_000) -> DataFrame:
    """Add ``arrived_duplicate``: a preferred posting of the group came before.

    ``members``: component, arrival (0 for postings stored before the batch,
    else first_seq + 1) and the columns of ``preference``. This is a running
    minimum in arrival order. A group may hold a third of all rows, so it runs
    in two steps: within spans of ``span`` arrivals, and over one minimum per
    span.
    """
    m = members.withColumn("__pref", preference()).withColumn(
        "__span", F.floor(F.col("arrival") / span))
    per_span = m.groupBy("component", "__span").agg(F.min("__pref").alias("low"))
    before = Window.partitionBy("component").orderBy("__span").rowsBetween(
        Window.unboundedPreceding, -1)
    earlier = per_span.select("component", "__span", F.min("low").over(before).alias("__earlier"))
    inside = Window.partitionBy("component", "__span").orderBy("arrival", "__pref").rowsBetween(
        Window.unboundedPreceding, -1)
    seen = m.withColumn("__inside", F.min("__pref").over(inside)).join(earlier, ["component", "__span"])
    beaten = (F.coalesce(F.col("__earlier") < F.col("__pref"), F.lit(False))
              | F.coalesce(F.col("__inside") < F.col("__pref"), F.lit(False)))
    return seen.withColumn("arrived_duplicate", beaten).drop(
        "__pref", "__span", "__earlier", "__inside")
