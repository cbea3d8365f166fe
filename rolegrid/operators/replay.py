"""Duplicate resolution in exact arrival order.

``dedup.resolve`` settles a table as sets. This operator gives the pointers a
store reaches by taking one event after the other: each event of a posting
that has no pointer is matched with the postings that are canonical *at that
moment*; the preferred one stays, the others point at it, and their followers
move along. A posting with a pointer is refreshed but never matched again.

Order matters only within a connected component of matches, so components are
found once for all events and replayed in parallel, each streamed through a task that holds nothing but the
component's canonical postings. What one task may have to stream is bounded by
cutting the events of components with more than ``slice_rows`` of them into slices in arrival order: a slice sees
the canonical postings left by the slices before it, so the result does not
depend on the cut. The price is one round per slice of the large components; ``dedup.resolve`` is the
way for whole tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.functions.keys import row_key
from rolegrid.functions.trigram import SIMILARITY_TENTHS
from rolegrid.operators.components import connected_components
from rolegrid.operators.dedup import NODE, match_edges, related
from rolegrid.session import cut

EVENT = ("id", *NODE, "posted_at", "first_seen_at", "first_seq")
_RESULT = "id string, seq long, winner string, was_inserted boolean, is_duplicate boolean"
_ORDERED = ("component", "seq", "id", *NODE, "unknown", "posted", "seen", "first_seq")


def _grams(title: str) -> frozenset:
    padded = f"  {title} "
    return frozenset(padded[i:i + 3] for i in range(len(title) + 1)) if title else frozenset()


KNOWN_PAIRS = 1_000_000  # compared titles that a component remembers


class _Component:
    """Canonical postings of one component while its events pass by."""

    def __init__(self):
        self.canonical: dict[str, tuple] = {}  # id -> preference, fingerprint, company, title
        self.winner_of: dict[str, str] = {}
        self.grams: dict[str, frozenset] = {}
        self.near: dict[str, dict[str, bool]] = {}  # title -> the titles it was compared with
        self.pairs = 0

    def _same(self, near: dict[str, bool], title, other_title) -> bool:
        """Titles of one company are similar; ``near`` is what is known of ``title``."""
        if self.pairs >= KNOWN_PAIRS:
            self.pairs = 0
            self.near.clear()
            self.grams.clear()
            near.clear()
        for t in (title, other_title):
            if t not in self.grams:
                self.grams[t] = _grams(t)
        a, b = self.grams[title], self.grams[other_title]
        near[other_title] = found = (10 + SIMILARITY_TENTHS) * len(a & b) > SIMILARITY_TENTHS * (len(a) + len(b))
        self.pairs += 1
        return found

    def take(self, seq, key, print_, company, title, preference):
        """Outcome ``(was_inserted, is_duplicate)`` of an event; stored rows have seq -1."""
        if key in self.winner_of:
            return False, True
        old = self.canonical.get(key)
        if old is not None:
            preference = (*preference[:2], *old[0][2:])
        self.canonical[key] = (preference, print_, company, title)
        if seq < 0:
            return None
        near = self.near.setdefault(title, {})
        matches = [key] + [
            k for k, (_, p, c, t) in self.canonical.items()
            if k != key and (p == print_ or (c == company and (near[t] if t in near else self._same(near, title, t))))]
        best = min(matches, key=lambda k: self.canonical[k][0])
        for loser in matches:
            if loser != best:
                self.winner_of[loser] = best
                del self.canonical[loser]
        return old is None, best != key

    def pointers(self):
        for loser, top in self.winner_of.items():
            while top in self.winner_of:
                top = self.winner_of[top]
            yield loser, None, top, None, None


def replay_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Take rows sorted by component and seq in order, holding one component's state.

    Gives one row per event (its outcome) and one per posting that lost its
    canonical state (seq NULL, its final winner).
    """
    def frame(rows):
        out = pd.DataFrame(rows, columns=["id", "seq", "winner", "was_inserted", "is_duplicate"])
        return out.astype({"seq": "Int64", "was_inserted": "boolean", "is_duplicate": "boolean"})

    current, state = None, _Component()
    for batch in batches:
        rows = []
        for component, seq, key, print_, company, title, unknown, posted, seen, first in zip(
                *(batch[c] for c in _ORDERED)):
            if component != current:
                rows.extend(state.pointers())
                current, state = component, _Component()
            outcome = state.take(seq, key, print_, company, title, (unknown, posted, seen, first))
            if outcome is not None:
                rows.append((key, seq, None, *outcome))
        yield frame(rows)
    yield frame(list(state.pointers()))


def _placed(rows: DataFrame) -> DataFrame:
    """``rows(seq, EVENT...)`` with their connected component of matches."""
    rows = cut(rows.withColumn("node", row_key(*[F.col(c) for c in NODE])))
    nodes = rows.select("node", *NODE).distinct()
    # versions of one posting belong together, whatever they match
    low = rows.groupBy("id").agg(F.min("node").alias("v"))
    versions = (rows.select("id", F.col("node").alias("u")).join(low, "id")
                .where(F.col("u") != F.col("v")).select("u", "v"))
    components = connected_components(match_edges(nodes).unionByName(versions))
    return cut(rows.join(components, "node", "left")
               .withColumn("component", F.coalesce("component", "node")).drop("node"))


def _streamed(placed: DataFrame) -> DataFrame:
    """Outcomes and pointers of rows that have their component."""
    micros = lambda c: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(0))
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (placed
               .withColumns({"unknown": F.col("posted_at").isNull(), "posted": micros("posted_at"),
                             "seen": micros("first_seen_at")})
               .select(*_ORDERED)
               .repartition(tasks, "component").sortWithinPartitions("component", "seq"))
    return cut(ordered.mapInPandas(replay_rows, _RESULT))


def _slices(events: DataFrame, slice_rows: int) -> list:
    """Upper bounds of the slices: numbers, one per slice."""
    n = events.count()
    parts = max(1, -(-n // slice_rows))
    if parts == 1:
        return [None]
    shares = [i / parts for i in range(1, parts)]
    bounds = events.agg(F.percentile_approx("seq", shares, 10_000).alias("b")).first().b
    return [*sorted(set(bounds)), None]


def _parted(result: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (result.where(F.col("seq").isNotNull()).select("id", "seq", "was_inserted", "is_duplicate"),
            result.where(F.col("seq").isNull()).select("id", F.col("winner").alias("canonical_id")))


def replay(events: DataFrame, stored: DataFrame | None = None,
           slice_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """``(outcomes, pointers)`` of the events in order of ``seq``.

    ``events``: seq (unique) and the EVENT columns, one row per delivery.
    ``stored``: canonical postings before the first event, same columns.
    ``outcomes``: id, seq, was_inserted, is_duplicate per event;
    ``pointers``: id, canonical_id of every posting that is no longer canonical.
    Events of postings stored with a pointer must be left out by the caller:
    they are duplicates by definition.
    """
    events = events.select("seq", *EVENT)
    if stored is not None:
        events = cut(events)
        canonical, ids = stored.select(*EVENT), events.select("id").distinct()
        near = related(canonical.join(ids, "id", "left_anti"), events)
        events = events.unionByName(canonical.join(ids, "id", "left_semi").unionByName(near)
                                    .withColumn("seq", F.lit(-1).cast("long")))
    placed = _placed(events)
    large = cut(placed.where("seq >= 0").groupBy("component").agg(F.count("*").alias("n"))
                .where(F.col("n") > slice_rows).select("component"))
    if not large.take(1):
        return _parted(_streamed(placed))
    outcomes, pointers = _parted(_streamed(placed.join(large, "component", "left_anti")))
    more = _sliced(cut(placed.join(large, "component", "left_semi")), slice_rows)
    return outcomes.unionByName(more[0]), pointers.unionByName(more[1])


def _sliced(placed: DataFrame, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """Outcomes and pointers of large components, slice after slice."""
    stored, events = placed.where("seq < 0"), placed.where("seq >= 0")
    canonical = stored.drop("seq")
    outcomes = pointers = None
    lower = None
    for upper in _slices(events, slice_rows):
        part = events
        if lower is not None:
            part = part.where(F.col("seq") > lower)
        if upper is not None:
            part = part.where(F.col("seq") <= upper)
        lower = upper
        if pointers is not None:
            # deliveries of postings that already lost are duplicates
            lost = pointers.select("id")
            known = part.join(lost, "id", "left_semi")
            outcomes = outcomes.unionByName(known.select(
                "id", "seq", F.lit(False).alias("was_inserted"), F.lit(True).alias("is_duplicate")))
            part = part.join(lost, "id", "left_anti")
        done, moved = _parted(_streamed(canonical.withColumn("seq", F.lit(-1).cast("long")).unionByName(part)))
        outcomes = done if outcomes is None else outcomes.unionByName(done)
        if pointers is None:
            pointers = moved
        else:
            to = moved.select(F.col("id").alias("canonical_id"), F.col("canonical_id").alias("__to"))
            pointers = cut(pointers.join(to, "canonical_id", "left")
                           .select("id", F.coalesce("__to", "canonical_id").alias("canonical_id"))
                           .unionByName(moved))
        if upper is not None:
            canonical = cut(_canonical_after(canonical, part, moved))
    return outcomes, pointers


def _canonical_after(canonical: DataFrame, part: DataFrame, moved: DataFrame) -> DataFrame:
    """Latest version of every posting still canonical; first sight is kept."""
    content = (*NODE, "posted_at")
    versions = (canonical.withColumn("seq", F.lit(-1).cast("long"))
                .unionByName(part.select(*canonical.columns, "seq")))
    first = F.min(F.struct("seq", "first_seen_at", "first_seq")).alias("f")
    last = F.max(F.struct("seq", *content)).alias("l")
    return (versions.join(moved.select("id"), "id", "left_anti")
            .groupBy("id").agg(first, last, F.min("component").alias("component"))
            .select("id", *[F.col(f"l.{c}").alias(c) for c in content],
                    F.col("f.first_seen_at").alias("first_seen_at"),
                    F.col("f.first_seq").alias("first_seq"), "component")
            .select(*EVENT, "component"))
