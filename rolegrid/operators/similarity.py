"""Similar titles within a block, without forming the block's pairs."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.functions.trigram import N_CODES, SIMILARITY_TENTHS, text_trigrams, trigram_codes, trigrams
from rolegrid.session import stage, use_skew_settings

_SHIFT = 65536  # above every trigram code


def pair_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Add ``shared``, ``total`` and ``similarity`` of two text columns."""
    ta, tb = trigrams(F.col(a)), trigrams(F.col(b))
    df = pairs.withColumns({"__ta": ta, "__tb": tb})
    shared = F.size(F.array_intersect("__ta", "__tb"))
    df = df.withColumn("shared", shared)
    df = df.withColumn("total", F.size("__ta") + F.size("__tb") - F.col("shared"))
    return df.withColumn(
        "similarity",
        F.when(F.col("total") == 0, 0.0).otherwise(F.col("shared") / F.col("total")),
    ).drop("__ta", "__tb")


def _rarity_classes(texts: DataFrame) -> bytes:
    """One byte per trigram code: 0 if unseen, else 1 + ceil(log2(frequency)).

    The frequency table has at most ``N_CODES`` (37^3) rows whatever the data,
    because trigrams are made of 37 characters only.
    """
    counts = (texts.select(F.explode_outer("codes").alias("g")).where(F.col("g").isNotNull())
              .groupBy("g").agg((1 + F.ceil(F.log2(F.count("*")))).cast("int").alias("c")))
    classes = bytearray(N_CODES)
    for g, c in counts.collect():
        classes[g] = c
    return bytes(classes)


def _distinct_texts(items: DataFrame, block: str, text: str, ident: str | None, changed: str | None) -> DataFrame:
    """``block, text, id, changed``: one written row per distinct text of a block."""
    return stage(
        items.where(F.col(text) != "").groupBy(F.col(block).alias("block"), F.col(text).alias("text"))
        .agg(F.min(ident).alias("id") if ident else F.lit(None).cast("string").alias("id"),
             F.max(changed).alias("changed") if changed else F.lit(True).alias("changed")), "texts")


def _with_codes(texts: DataFrame) -> DataFrame:
    return stage(texts.withColumn("codes", trigram_codes(F.col("text"))), "codes")


def _prefix_entries(texts: DataFrame, tenths: int, *more: str) -> DataFrame:
    """A row for each of the rarest trigrams of which similar texts share one.

    Class and code are one number: sorting it sorts by rarity, and equal numbers
    are equal trigrams.
    """
    classes = F.lit(_rarity_classes(texts))

    def ranked(code: Column) -> Column:
        rarity = F.ascii(F.substring(classes, code + 1, F.lit(1)).cast("string"))
        return rarity * _SHIFT + code

    n = F.coalesce(F.size("gs"), F.lit(0))  # never NULL: no filter repeats the sort
    kept = ("block", "text", "id", "changed", *more)
    return (texts.select(*kept, F.array_sort(F.transform("codes", ranked)).alias("gs"))
            .select(*kept, "gs", n.alias("n"),
                    F.posexplode_outer(F.slice("gs", F.lit(1), n - F.floor(n * tenths / 10).cast("int")))
                    .alias("pos", "g"))
            .where(F.col("g").isNotNull()))


def _pair_condition(tenths: int) -> tuple[Column, Column]:
    """Shared trigrams of ``l`` and ``r``, and the test of two entries with one trigram.

    A pair passes at its first shared trigram only, so it passes once.
    """
    ln, rn = F.col("l.n"), F.col("r.n")
    common = F.array_intersect("l.gs", "r.gs")
    # this trigram and everything after it on the shorter remainder
    reachable = F.least(ln - F.col("l.pos"), rn - F.col("r.pos"))
    return common, (
        (F.col("l.text") != F.col("r.text"))
        & ((F.col("l.text") < F.col("r.text")) | ~F.col("r.changed"))
        & (10 * F.least(ln, rn) > tenths * F.greatest(ln, rn))
        & ((10 + tenths) * reachable > tenths * (ln + rn))
        & (F.get(common, F.lit(0)) == F.col("l.g"))
        & ((10 + tenths) * F.size(common) > tenths * (ln + rn)))


def similar_pairs(items: DataFrame, block: str, text: str, ident: str | None = None,
                  changed: str | None = None, tenths: int = SIMILARITY_TENTHS,
                  slice_rows: int = 20_000) -> DataFrame:
    """Distinct texts of one block whose trigram similarity is > tenths/10.

    Returns ``block, text_a, text_b, shared, total`` with ``text_a < text_b``,
    and ``id_a, id_b`` (the smallest ``ident`` of either text) if asked for.
    With ``changed``, a boolean column, only pairs with a changed text are
    formed: one side of the join is the changed texts alone. Meant for keys of
    ``[0-9a-z]``; other characters only separate words.
    Exact: prefix filtering (Bayardo et al., WWW 2007) with the positional
    bound of Xiao et al. (WWW 2008).

    * Copies collapse first, so a group of copies costs one row. The distinct
      texts are written once and read by the three steps that need them.
    * Trigrams are ordered from rare to frequent. Two sets with similarity
      above the threshold share one of the first ``n - floor(t n)`` of them,
      so only those enter the join, keyed by (block, trigram).
    * A pair is accepted at its first shared trigram only, which makes the
      result distinct without another shuffle; size, position and the exact
      test are part of the join condition, so rejected pairs are never rows.
    * A trigram that is frequent *within its block* is cut into slices of at
      most ``slice_rows`` rows: one side picks a slice, the other visits all of
      them, so a hot block spreads over many tasks and no pair is lost. Only
      (block, trigram) keys above that bound are in the table of slices; rows
      of all other keys stay single.
    """
    use_skew_settings(items.sparkSession)
    texts = _with_codes(_distinct_texts(items, block, text, ident, changed))
    entries = _prefix_entries(texts, tenths)
    heavy = (entries.groupBy("block", "g").agg(F.count("*").alias("rows")).where(F.col("rows") > slice_rows)
             .select("block", "g", F.ceil(F.col("rows") / slice_rows).cast("int").alias("slices")))
    entries = entries.join(heavy, ["block", "g"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    left = (entries.where("changed")
            .withColumn("slice", F.pmod(F.xxhash64("text"), F.col("slices")).cast("int")).alias("l"))
    right = entries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).alias("r")
    ln, rn = F.col("l.n"), F.col("r.n")
    common, test = _pair_condition(tenths)
    condition = ((F.col("l.block") == F.col("r.block")) & (F.col("l.g") == F.col("r.g"))
                 & (F.col("l.slice") == F.col("r.slice")) & test)
    # sizes are estimated from the stored texts, which the explode multiplies:
    # a broadcast chosen on that estimate could not be trusted
    first = F.col("l.text") < F.col("r.text")
    ids = [F.when(first, F.col("l.id")).otherwise(F.col("r.id")).alias("id_a"),
           F.when(first, F.col("r.id")).otherwise(F.col("l.id")).alias("id_b")] if ident else []
    return (left.join(right.hint("merge"), condition)
            .select(F.col("l.block").alias("block"), F.least("l.text", "r.text").alias("text_a"),
                    F.greatest("l.text", "r.text").alias("text_b"), *ids, F.size(common).alias("shared"),
                    (ln + rn - F.size(common)).alias("total")))


# Distinct texts of a block up to which its pairs are tested in its one row.
BLOCK_ROWS = 128
# Texts of one (block, trigram) key up to which groups are told apart by a plain test.
PLAIN_ROWS = 64
# Bits of a group's hash by which texts of a frequent key are told apart.
GROUP_BITS = 12
# Smallest hashes of a text's trigrams by which it finds hubs, besides its rarest trigrams.
HUB_HASHES = 4


def _hub_links(texts: DataFrame, tenths: int) -> DataFrame:
    """``u, v``: texts tied to a similar hub, never text to text.

    A text meets the hub of each of its keys: its rarest trigrams and a few
    smallest hashes of its trigrams, on which near-equal texts agree. The hub is
    the smallest changed text of the key, so there are as many tests as keys.
    """
    smallest = [F.array_min(F.transform("codes", lambda c, i=i: F.xxhash64(c, F.lit(i)))) for i in range(HUB_HASHES)]
    rare = _prefix_entries(texts, tenths).select("block", "text", "id", "changed", "gs", F.col("g").cast("long").alias("key"),
                                                 F.lit(-1).alias("kind"))
    hashed = (texts.where(F.size("codes") > 0)
              .select("block", "text", "id", "changed", F.col("codes").alias("gs"), F.posexplode(F.array(*smallest)).alias("kind", "key"))
              .select("block", "text", "id", "changed", "gs", "key", "kind"))
    links = []
    for rows in (rare, hashed):
        hubs = (rows.where("changed").groupBy("block", "key", "kind")
                .agg(F.min(F.struct("text", "id", "gs")).alias("hub")))
        shared = F.size(F.array_intersect("gs", "hub.gs"))
        near = (10 + tenths) * shared > tenths * (F.size("gs") + F.size("hub.gs"))
        links.append(rows.join(hubs.hint("merge"), ["block", "key", "kind"])
                     .where((F.col("text") != F.col("hub.text")) & near)
                     .select(F.col("id").alias("u"), F.col("hub.id").alias("v")))
    return links[0].unionByName(links[1]).distinct()


def _block_ties(words: list[str], changed: list[bool], tenths: int) -> tuple[list[int], list[int]]:
    """Places ``u, v`` of similar texts of one block: a spanning forest of its similar pairs.

    ``words``: the texts in lower case. Shared trigrams of all pairs are one product of the
    0/1 matrix of texts and trigrams with itself; a walk over similar texts keeps a tie to each
    text it has not seen.
    """
    n, columns, rows, at = len(words), {}, [], []
    for i, text in enumerate(words):
        for gram in text_trigrams(text):
            rows.append(i)
            at.append(columns.setdefault(gram, len(columns)))
    has = np.zeros((n, len(columns)), np.float32)
    has[rows, at] = 1
    sizes = has.sum(axis=1)
    new = np.array(changed, bool)
    near = []  # per text the similar ones as bits
    for low in range(0, n, BLOCK_ROWS):
        part = slice(low, low + BLOCK_ROWS)
        similar = (10 + tenths) * (has[part] @ has.T) > tenths * (sizes[part, None] + sizes)
        similar &= new[part, None] | new
        near += [int.from_bytes(bits, "little") for bits in map(bytes, np.packbits(similar, axis=1, bitorder="little"))]
    us, vs, unseen = [], [], (1 << n) - 1
    while unseen:
        first = unseen & -unseen
        unseen ^= first
        walk = [first.bit_length() - 1]
        while walk:
            u = walk.pop()
            found = near[u] & unseen
            unseen ^= found
            while found:
                bit = found & -found
                found ^= bit
                walk.append(bit.bit_length() - 1)
                us.append(u)
                vs.append(walk[-1])
    return us, vs


def _small_block_edges(texts: DataFrame, tenths: int) -> DataFrame:
    """``u, v``: similar texts of small blocks, as many as their components need.

    The texts of a block come one after the other to one task, which holds one
    block at a time; a text is shuffled once. The tasks are as many as the shuffle's
    partitions: few bytes of titles are much work.
    """
    def settle(it):
        held = None  # the last block so far, which the next batch may go on with
        for batch in it:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            blocks = held.column("block").to_pylist()
            last = next((i for i in range(len(blocks) - 1, 0, -1) if blocks[i] != blocks[i - 1]), 0)
            if last:
                yield from ties(held.slice(0, last), blocks[:last])
                held = held.slice(last)
        if held is not None:
            yield from ties(held, held.column("block").to_pylist())

    def ties(table, blocks):
        words, changed = table.column("words").to_pylist(), table.column("changed").to_pylist()
        us, vs, low = [], [], 0
        for high in range(1, len(blocks) + 1):
            if high < len(blocks) and blocks[high] == blocks[low]:
                continue
            if high - low > 1:
                u, v = _block_ties(words[low:high], changed[low:high], tenths)
                us += [low + i for i in u]
                vs += [low + i for i in v]
            low = high
        ids = table.column("id").combine_chunks()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(x, pa.int64())) for x in (us, vs)], ["u", "v"])

    kind = texts.schema["id"].dataType.simpleString()
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (texts.select("block", F.lower("text").alias("words"), "id", "changed")
            .repartition(tasks, "block").sortWithinPartitions("block"))
    return rows.mapInArrow(settle, f"u {kind}, v {kind}")


def spanning_edges(items: DataFrame, block: str, text: str, ident: str, changed: str | None = None,
                   tenths: int = SIMILARITY_TENTHS, slice_rows: int = 20_000, plain_rows: int = PLAIN_ROWS,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges ``u, v`` (identifiers) with the connected components of ``similar_pairs``.

    Blocks of at most ``block_rows`` distinct texts are settled whole, a block
    at a time; that is linear in the texts. In larger blocks ``n`` near-equal texts
    need no ``n * n`` edges to be one component:

    1. Every text is tied to the hubs it is similar to. Texts with a common hub
       are in one group; a hub tied to a smaller hub passes its group on.
    2. Only texts of different groups are compared. Two groups differ in some
       first bit of their hashes: at a frequent trigram, texts whose group has
       the bit set meet those whose group has not, level by level, so that
       texts of one group never meet at all.
    3. Of all similar pairs between two groups one edge is kept.

    ``ident`` must be unique per block and text. ``changed`` as in ``similar_pairs``.
    """
    use_skew_settings(items.sparkSession)
    texts = _distinct_texts(items, block, text, ident, changed)
    large = stage(texts.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select("block"), "large-blocks")
    small = _small_block_edges(texts.join(large, "block", "left_anti"), tenths)
    if not large.take(1):
        return small
    return small.unionByName(_large_block_edges(texts.join(large, "block", "left_semi"), tenths, slice_rows, plain_rows))


def _large_block_edges(texts: DataFrame, tenths: int, slice_rows: int, plain_rows: int) -> DataFrame:
    """The three steps of ``spanning_edges``."""
    texts = _with_codes(texts)
    links = stage(_hub_links(texts, tenths), "hub-links")
    first = links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("up"))
    first = first.select("id", F.least("id", "up").alias("up"))
    above = first.select(F.col("id").alias("up"), F.col("up").alias("top"))
    groups = first.join(above, "up", "left").select("id", F.coalesce("top", "up").alias("team"))
    texts = texts.join(groups, "id", "left").withColumn("team", F.coalesce("team", "id"))
    entries = stage(_prefix_entries(texts, tenths, "team"), "entries")
    mixed = (entries.groupBy("block", "g").agg(F.count("*").alias("rows"), F.min("team").alias("a"), F.max("team").alias("b"))
             .where(F.col("a") != F.col("b")).select("block", "g", "rows"))
    team_hash = F.xxhash64("team")
    level = F.when(F.col("rows") > plain_rows, F.sequence(F.lit(0), F.lit(GROUP_BITS))).otherwise(F.array(F.lit(GROUP_BITS)))
    # frequent keys: agree on the bits below the level, differ in the level's bit; the last level holds what agrees on all
    agreed = F.when(F.col("rows") > plain_rows, F.pmod(team_hash, F.pow(F.lit(2), F.col("level")).cast("long"))).otherwise(F.lit(0))
    bit = F.when(F.col("level") < GROUP_BITS, F.getbit(team_hash, F.col("level")).cast("int")).otherwise(F.lit(-1))
    entries = (entries.join(mixed.hint("merge"), ["block", "g"]).withColumn("level", F.explode(level))
               .withColumn("agreed", agreed).withColumn("bit", bit))
    key = ["block", "g", "level", "agreed", "bit"]
    heavy = (entries.groupBy(*key).agg(F.count("*").alias("m")).where(F.col("m") > slice_rows)
             .select(*key, F.ceil(F.col("m") / slice_rows).cast("int").alias("slices")))
    # a row visits the slices of the side it meets
    met = F.when(F.col("bit") < 0, F.col("bit")).otherwise(1 - F.col("bit"))
    left = (entries.where("changed").withColumn("bit", met)
            .join(heavy, key, "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).alias("l"))
    right = (entries.join(heavy, key, "left")
             .withColumn("slice", F.pmod(F.xxhash64("text"), F.coalesce("slices", F.lit(1))).cast("int")).alias("r"))
    _, test = _pair_condition(tenths)
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*key, "slice")]
    condition = reduce(lambda a, b: a & b, same) & (F.col("l.team") != F.col("r.team")) & test
    between = (left.join(right.hint("merge"), condition)
               .groupBy(F.least("l.team", "r.team").alias("a"), F.greatest("l.team", "r.team").alias("b"))
               .agg(F.min(F.struct(F.col("l.id").alias("u"), F.col("r.id").alias("v"))).alias("e")))
    return links.unionByName(between.select("e.u", "e.v"))
