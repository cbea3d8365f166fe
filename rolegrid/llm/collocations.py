"""Phrases whose words occur together more often than apart, mined with count automata.

Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and
pieces into words at blanks and tabs. Every word starts one window: itself and
up to two words behind it in its piece. A phrase occurs as often as windows
begin with it, so all counts are sums of window weights over a prefix.

* A task collects windows of up to ``SHARD_WORDS`` words, sorts them, and builds
  from the sorted list an acyclic automaton over words that maps each window to
  its count; equal states are kept once. It is cut into blocks between word pairs.
* Blocks meet by prefix range. The borders of the ranges are pairs of words, so
  that a pair's windows stand together, while a frequent first word may spread
  over many ranges. They are drawn from the blocks' first keys (from a sample of
  ``BORDER_SAMPLE`` keys beyond that many; borders only decide who sums what).
* Very many ranges are reached in steps, over wider ranges whose blocks are united.
* A range unites its automata, sums the weights, and sums again over prefixes.
  What is left is one automaton per range from phrases to counts. Phrases below
  ``least`` cannot be a candidate or a part of one and are left out.
* Parts of candidates are asked for by composing the automaton of a range's
  requests with that of its counts. The counts of a word that spreads over
  ranges are added up.

Scores are exact: products are taken in 38 decimal digits, enough for phrases
that occur up to 10^15 times.

A null text is the empty text; a null language is ``und``. Repeated rows count
as often as they occur, ties are ordered by the phrase's bytes, an empty table
gives no row, other columns do not matter. A language is not collected in one
task: each of ``SALTS`` parts is cut to the best ``top`` before they meet.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegrid.llm.common import forget, map_rows, mix, raw_texts, values, write_once
from rolegrid.session import use_skew_settings

SHARD_WORDS = 1_000_000
# Bytes of one text worked on at once.
PART_BYTES = 1 << 21
BLOCK_WINDOWS = 1 << 13
RANGE_WINDOWS = 500_000
# Ranges a block is dealt to at once; more are reached in several steps.
FAN = 256
BORDER_SAMPLE = 20_000
SALTS = 64

_SPLIT = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + _SPLIT, bytes(range(97, 123)) + b"." * len(_SPLIT))


def words_and_ends(text: bytes) -> list[bytes]:
    """The words of a text; ``b"."`` stands between pieces."""
    return text.translate(_TABLE).replace(b".", b" . ").split()


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts, cut at blanks; the parts' words are the text's."""
    start = 0
    while start < len(text):
        stop = text.find(b" ", start + PART_BYTES)
        stop = len(text) if stop < 0 else stop
        yield text[start:stop]
        start = stop


class Automaton:
    """Maps sequences of one to three words to whole numbers.

    ``words`` are sorted; a path is three numbers, 0 for no word, else a word's
    place plus one; paths are sorted and distinct.
    """

    def __init__(self, words: list[bytes], paths: np.ndarray, weights: np.ndarray):
        self.words, self.paths, self.weights = words, paths, weights

    @classmethod
    def of(cls, words: list[bytes], paths: np.ndarray, weights: np.ndarray) -> Automaton:
        """From paths in any order; weights of equal paths are added up."""
        return cls.joined(words, [paths], [weights])

    @classmethod
    def joined(cls, words: list[bytes], parts: list[np.ndarray], weights: list[np.ndarray]) -> Automaton:
        """As ``of`` for paths in several arrays, as one number each while they are sorted."""
        bits = _bits(len(words))
        if 3 * bits <= 63:
            key = np.concatenate([_keys(p, bits) for p in parts]) if parts else np.zeros(0, np.int64)
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            sums = np.concatenate(weights)[order] if parts else key
            sums = np.add.reduceat(sums, first) if len(first) else sums
            key = key[first]
            low = (1 << bits) - 1
            return cls(words, np.stack([key >> (2 * bits), (key >> bits) & low, key & low], 1), sums)
        paths, weights = np.concatenate(parts), np.concatenate(weights)
        order, first = _sorted(paths, len(words))
        paths, weights = paths[order], weights[order]
        if len(first):
            paths, weights = paths[first], np.add.reduceat(weights, first)
        return cls(words, paths, weights)

    def part(self, start: int, stop: int) -> Automaton:
        """The paths from ``start`` to ``stop`` with the words they use."""
        return self.compact(self.paths[start:stop], self.weights[start:stop])

    def compact(self, paths: np.ndarray, weights: np.ndarray) -> Automaton:
        used = np.unique(paths)
        used = used[used > 0]
        place = np.zeros(len(self.words) + 1, np.int64)
        place[used] = np.arange(1, len(used) + 1)
        return Automaton([self.words[i - 1] for i in used.tolist()], place[paths], weights)

    def key(self, at: int) -> tuple[bytes, bytes]:
        """The first two words of a path; no word sorts before every word."""
        return tuple(self.words[i - 1] if i else b"" for i in self.paths[at, :2].tolist())

    def pair_starts(self) -> np.ndarray:
        p = self.paths
        return np.flatnonzero(np.r_[True, (p[1:, 0] != p[:-1, 0]) | (p[1:, 1] != p[:-1, 1])][:len(p)])

    def to_bytes(self) -> bytes:
        """Arcs level by level; third-level states that are equal are written once."""
        p, starts = self.paths, self.pair_starts()
        sizes = np.diff(np.r_[starts, len(p)])
        first = np.flatnonzero(np.r_[True, p[starts[1:], 0] != p[starts[:-1], 0]][:len(starts)])
        state, kept = _equal_states(p[:, 2], self.weights, starts, sizes)
        arcs = np.repeat(starts[kept] - (np.cumsum(sizes[kept]) - sizes[kept]), sizes[kept]) + np.arange(sizes[kept].sum())
        small = lambda a: a.astype("<u4").tobytes()
        parts = [b" ".join(self.words), small(p[starts[first], 0]), small(np.diff(np.r_[first, len(starts)])),
                 small(p[starts, 1]), small(state), small(sizes[kept]), small(p[arcs, 2]), self.weights[arcs].astype("<i8").tobytes()]
        head = np.array([len(x) for x in parts], "<u4").tobytes()
        return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Automaton:
        raw = zstandard.ZstdDecompressor().decompress(raw)
        ends = np.cumsum(np.r_[32, np.frombuffer(raw[:32], "<u4")]).tolist()
        parts = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        one, fan, two, state, sizes, three = (np.frombuffer(x, "<u4").astype(np.int64) for x in parts[1:7])
        weights = np.frombuffer(parts[7], "<i8")
        begin, width = (np.cumsum(sizes) - sizes)[state], sizes[state]
        arcs = np.repeat(begin - (np.cumsum(width) - width), width) + np.arange(width.sum())
        paths = np.stack([np.repeat(np.repeat(one, fan), width), np.repeat(two, width), three[arcs]], 1)
        return cls(parts[0].split(b" ") if parts[0] else [], paths, weights[arcs])

    def prefix_sums(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Each distinct beginning of ``length`` words and the weight of all paths under it."""
        p = self.paths[:, :length]
        starts = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]).any(1)][:len(p)])
        if not len(starts):
            return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        found = np.zeros((len(starts), 3), np.int64)
        found[:, :length] = p[starts]
        sums = np.add.reduceat(self.weights, starts)
        whole = found[:, length - 1] > 0  # shorter windows are no phrase of this length
        return found[whole], sums[whole]

    def phrases(self) -> list[bytes]:
        spell = [b"", *self.words]
        return [b" ".join([spell[i] for i in path if i]) for path in self.paths.tolist()]

    def look_up(self, asked: Automaton) -> tuple[np.ndarray, np.ndarray]:
        """Composition: which paths of ``asked`` are paths here too, and their weights."""
        place = {w: i + 1 for i, w in enumerate(self.words)}
        here = np.array([0, *(place.get(w, -1) for w in asked.words)], np.int64)[asked.paths]
        at = np.flatnonzero((here >= 0).all(1))
        both = np.concatenate([self.paths, here[at]])
        order, first = _sorted(both, len(self.words), stable=True)
        group = np.zeros(len(both), np.int64)
        group[first] = 1
        leader = order[first][np.cumsum(group) - 1]  # equal paths stand together, the one of this automaton first
        mine = np.empty(len(both), np.int64)
        mine[order] = leader
        hit = mine[len(self.paths):]
        found = hit < len(self.paths)
        return at[found], self.weights[hit[found]]


def _bits(words: int) -> int:
    return (words + 1).bit_length()


def _keys(paths: np.ndarray, bits: int) -> np.ndarray:
    return (paths[:, 0] << (2 * bits)) | (paths[:, 1] << bits) | paths[:, 2]


def _sorted(paths: np.ndarray, words: int, stable: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Order of the paths, and where in it a new path begins."""
    bits = _bits(words)
    if 3 * bits <= 63:
        key = _keys(paths, bits)
        order = np.argsort(key, kind="stable" if stable else None)
        return order, np.flatnonzero(np.diff(key[order], prepend=-1))
    order = np.lexsort((paths[:, 2], paths[:, 1], paths[:, 0]))
    p = paths[order]
    return order, np.flatnonzero(np.r_[True, (p[1:] != p[:-1]).any(1)][:len(p)])


def _equal_states(labels: np.ndarray, weights: np.ndarray, starts: np.ndarray,
                  sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State of each list of arcs, and the list that stands for each state."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    arc = mix(labels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + weights.astype(np.uint64))
    digest = np.add.reduceat(arc, starts) + sizes.astype(np.uint64)
    _, lead, state = np.unique(digest, return_index=True, return_inverse=True)
    # lists with one digest are compared arc by arc; a differing one stands for itself
    same = sizes[lead[state]] == sizes
    like = np.where(same, lead[state], np.arange(len(starts)))
    arcs = np.repeat(starts[like] - starts, sizes) + np.arange(len(labels))
    equal = np.logical_and.reduceat((labels[arcs] == labels) & (weights[arcs] == weights), starts)
    own = np.flatnonzero(~(same & equal))
    state[own] = len(lead) + np.arange(len(own))
    return state, np.r_[lead, own]


class Shard:
    """Words of one language met in a task since its last blocks went out."""

    def __init__(self):
        self.place: dict[bytes, int] = {b".": 0}
        self.numbers: list[np.ndarray] = []
        self.last: list[bytes] = []

    def add(self, words: list[bytes]) -> None:
        place = self.place
        for w in set(words).difference(place):
            place[w] = len(place)
        self.numbers.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
        self.last = [*self.last, *words[-2:]][-2:]

    def windows(self, ended: bool = True) -> Automaton:
        """All windows; where the last text goes on, without those of its last two words."""
        words = sorted(w for w in self.place if w != b".")
        rank = np.zeros(len(self.place), np.int64)
        rank[[self.place[w] for w in words]] = np.arange(1, len(words) + 1)
        text = rank.astype(np.int32)[np.concatenate([*self.numbers, np.zeros(2 if ended else 0, np.int32)])]
        begin = np.flatnonzero(text[:-2])
        paths = np.empty((len(begin), 3), np.int64)
        paths[:, 0], paths[:, 1] = text[begin], text[begin + 1]
        paths[:, 2] = np.where(paths[:, 1] > 0, text[begin + 2], 0)
        return Automaton.of(words, paths, np.ones(len(paths), np.int64))


def blocks(docs: DataFrame, shard_words: int = SHARD_WORDS, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``lang, first, last, windows, total, block`` of every shard; first and last are word pairs."""
    def count(it):
        shards: dict[str, Shard] = {}
        held = 0
        for batch in it:
            for lang, text in zip(values(batch, "lang"), raw_texts(batch), strict=True):
                for part in _parts(text or b""):
                    shard = shards.setdefault(lang, Shard())
                    words = words_and_ends(part)
                    shard.add(words)
                    held += len(words)
                    if held >= shard_words:
                        for other in shards:
                            yield from emit(other, shards[other].windows(other != lang))
                        shards, held = {lang: Shard()}, 0
                        shards[lang].add(shard.last)
                if lang in shards:
                    shards[lang].add([b"."])
        for lang, shard in shards.items():
            yield from emit(lang, shard.windows())

    def emit(lang: str, found: Automaton) -> Iterator[pa.RecordBatch]:
        return _block_rows(lang, found, block_windows)

    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string"))
    return map_rows(docs, count, BLOCK)


BLOCK = ("lang string, first1 binary, first2 binary, last1 binary, last2 binary, windows long, total long, block binary")


def _block_rows(lang: str, found: Automaton, block_windows: int) -> Iterator[pa.RecordBatch]:
    """An automaton cut into blocks between word pairs."""
    starts, at = found.pair_starts(), 0
    while at < len(found.paths):
        next_pair = np.searchsorted(starts, at + block_windows)
        stop = int(starts[next_pair]) if next_pair < len(starts) else len(found.paths)
        yield _block_row(lang, found.part(at, stop))
        at = stop


def _block_row(lang: str, a: Automaton) -> pa.RecordBatch:
    first, last = a.key(0), a.key(-1)
    row = [lang, *first, *last, len(a.paths), int(a.weights.sum()), a.to_bytes()]
    kinds = [pa.string(), *[pa.binary()] * 4, pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)],
                                      names=[c.split()[0] for c in BLOCK.split(", ")])


def borders(table: DataFrame, range_windows: int = RANGE_WINDOWS, sample: int = BORDER_SAMPLE) -> list[tuple]:
    """Keys ``(lang, word, word)`` at which a new range begins."""
    size = table.agg(F.count(F.lit(1)), F.sum("windows")).first()
    keys = table.select("lang", "first1", "first2", "windows")
    if size[0] > sample:
        keys = keys.sample(min(1.0, sample / size[0]), seed=7)
    found = sorted(((r.lang.encode(), bytes(r.first1), bytes(r.first2)), r.windows) for r in keys.collect())
    share = sum(n for _, n in found) / max(1, -(-(size[1] or 0) // range_windows))
    out, run = [], 0
    for key, n in found:
        if run >= share and (not out or key > out[-1]):
            out.append(key)
            run = 0
        run += n
    return out


def to_ranges(table: DataFrame, cuts: list[tuple]) -> DataFrame:
    """``range, lang, block``: blocks that reach over a border are cut there."""
    def split(it):
        for batch in it:
            out = []
            for row in batch.to_pylist():
                lang = row["lang"].encode()
                low = bisect_right(cuts, (lang, row["first1"], row["first2"]))
                high = bisect_right(cuts, (lang, row["last1"], row["last2"]))
                if low == high:
                    out.append((low, row["lang"], row["block"]))
                    continue
                a = Automaton.from_bytes(row["block"])
                starts = a.pair_starts()
                keys = [(lang, *a.key(i)) for i in starts.tolist()]
                ends = [0, *(int(starts[i]) for i in (bisect_left(keys, c) for c in cuts[low:high])), len(a.paths)]
                out += [(low + i, row["lang"], a.part(p, q).to_bytes())
                        for i, (p, q) in enumerate(zip(ends, ends[1:], strict=False)) if q > p]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.string()),
                                              pa.array([o[2] for o in out], pa.binary())], names=["range", "lang", "block"])

    return map_rows(table, split, "range int, lang string, block binary")


def deal(table: DataFrame, cuts: list[tuple], range_windows: int = RANGE_WINDOWS, fan: int = FAN) -> DataFrame:
    """``range, lang, block`` for any number of ranges.

    Cutting every shard's blocks at every border would leave pieces of a few
    windows when there are many shards and ranges. Blocks are first dealt to at
    most ``fan`` wide ranges; inside one, bundles of about ``range_windows`` windows
    are united and cut into blocks anew, which then reach over few borders. The
    blocks of ``table`` are removed once bundles are written.
    """
    stride = 1
    while len(cuts) // stride >= fan:
        stride *= fan
    while stride > 1:
        wide = cuts[stride - 1::stride]
        total = table.agg(F.sum("windows")).first()[0] or 0
        bundles = max(1, -(-total // (range_windows * (len(wide) + 1))))

        def gather(key, blocks_of):
            held = unite([Automaton.from_bytes(b.as_py()) for b in blocks_of.column("block")])
            return pa.Table.from_batches(_block_rows(key[1].as_py(), held, BLOCK_WINDOWS))

        dealt = to_ranges(table, wide).withColumn("bundle", F.pmod(F.xxhash64("block"), F.lit(bundles)))
        bundled = write_once(dealt.groupBy("range", "lang", "bundle").applyInArrow(gather, BLOCK), "window-bundles")
        forget(table)
        table = bundled
        stride //= fan
    return to_ranges(table, cuts)


def unite(parts: list[Automaton]) -> Automaton:
    """One automaton with the weights of all added up."""
    words = sorted(set().union(*(a.words for a in parts)))
    place = {w: i + 1 for i, w in enumerate(words)}
    paths = [np.array([0, *map(place.__getitem__, a.words)], np.int64)[a.paths] for a in parts]
    return Automaton.joined(words, paths, [a.weights for a in parts])


def phrase_counts(ranged: DataFrame, cuts: list[tuple], least: int) -> DataFrame:
    """``range, lang, block``: counts of the phrases of each range."""
    def add_up(key, table):
        number, lang = key[0].as_py(), key[1].as_py()
        held, waiting = None, []
        for raw in table.column("block"):  # unite a few at a time
            waiting.append(Automaton.from_bytes(raw.as_py()))
            if sum(len(a.paths) for a in waiting) >= max(RANGE_WINDOWS, len(held.paths) if held else 0):
                held, waiting = unite([held, *waiting] if held else waiting), []
        held = unite([held, *waiting] if held else waiting) if waiting else held
        (one, n1), (two, n2), (three, n3) = (held.prefix_sums(k) for k in (1, 2, 3))
        # a word that begins before or goes on behind this range may have more windows there
        spread = [i for i in {held.paths[0, 0], held.paths[-1, 0]}
                  if len(_word_ranges(cuts, lang.encode(), held.words[i - 1])) > 1]
        keep = (n1 >= least) | np.isin(one[:, 0], spread)
        paths = np.concatenate([one[keep], two[n2 >= least], three[n3 >= least]])
        weights = np.concatenate([n1[keep], n2[n2 >= least], n3[n3 >= least]])
        order, _ = _sorted(paths, len(held.words))
        block = held.compact(paths[order], weights[order]).to_bytes()
        return pa.table({"range": pa.array([number], pa.int32()), "lang": pa.array([lang], pa.string()),
                         "block": pa.array([block], pa.binary())})

    return ranged.groupBy("range", "lang").applyInArrow(add_up, "range int, lang string, block binary")


def _word_ranges(cuts: list[tuple], lang: bytes, word: bytes) -> range:
    """The ranges that may hold windows beginning with ``word``."""
    return range(bisect_right(cuts, (lang, word, b"")), bisect_left(cuts, (lang, word + b"\0", b"")) + 1)


def _words(phrase: Column | str) -> Column:
    return F.split(phrase, " ")


def candidates(counts: DataFrame, least: int, percent: int) -> DataFrame:
    """``lang, phrase, a``: phrases of two and three words that no longer one stands for."""
    def spell(it):
        for batch in it:
            for lang, raw in zip(values(batch, "lang"), values(batch, "block"), strict=True):
                a = Automaton.from_bytes(raw)
                long = a.paths[:, 1] > 0
                a = Automaton(a.words, a.paths[long], a.weights[long])
                for at in range(0, len(a.paths), BLOCK_WINDOWS):
                    part = Automaton(a.words, a.paths[at:at + BLOCK_WINDOWS], a.weights[at:at + BLOCK_WINDOWS])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part.paths), pa.string()), pa.array(part.phrases(), pa.binary()).cast(pa.string()),
                         pa.array(part.weights, pa.int64())], names=["lang", "phrase", "a"])

    found = write_once(map_rows(counts.select("lang", "block"), spell, "lang string, phrase string, a long"), "phrases")
    long = found.where(F.size(_words("phrase")) == 3)
    inner = F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))
    marks = long.select("lang", F.explode(inner).alias("phrase"), F.lit(0).cast("long").alias("a"), F.col("a").alias("inside"))
    both = found.withColumn("inside", F.lit(0).cast("long")).unionByName(marks)
    return (both.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("inside").alias("inside"))
            .where((F.col("inside") == 0) | (100 * F.col("inside") < percent * F.col("a"))).drop("inside"))


def part_counts(counts: DataFrame, asked: DataFrame, cuts: list[tuple]) -> DataFrame:
    """``lang, part, f`` of the distinct ``asked(lang, part)``."""
    def route(it):
        for batch in it:
            out = []
            for lang, part in zip(values(batch, "lang"), raw_texts(batch, "part"), strict=True):
                one, _, two = part.partition(b" ")
                ranges = ([bisect_right(cuts, (lang.encode(), one, two))] if two
                          else _word_ranges(cuts, lang.encode(), one))
                out += [(r, lang, part) for r in ranges]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.string()),
                                              pa.array([o[2] for o in out], pa.binary()).cast(pa.string())],
                                             names=["range", "lang", "part"])

    def compose(key, left, right):
        empty = pa.table({"lang": pa.array([], pa.string()), "part": pa.array([], pa.string()), "f": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        parts = [p.encode().split(b" ") for p in right.column("part").to_pylist()]
        words = sorted({w for p in parts for w in p})
        place = {w: i + 1 for i, w in enumerate(words)}
        paths = np.array([[place[p[0]], place[p[1]] if len(p) > 1 else 0, 0] for p in parts], np.int64)
        asked_for = Automaton.of(words, paths, np.ones(len(paths), np.int64))
        at, f = Automaton.from_bytes(left.column("block")[0].as_py()).look_up(asked_for)
        spelled = asked_for.phrases()
        return pa.table({"lang": pa.array([key[1].as_py()] * len(at), pa.string()),
                         "part": pa.array([spelled[i].decode() for i in at.tolist()], pa.string()), "f": pa.array(f, pa.int64())})

    routed = map_rows(asked, route, "range int, lang string, part string")
    found = (counts.groupBy("range", "lang").cogroup(routed.groupBy("range", "lang"))
             .applyInArrow(compose, "lang string, part string, f long"))
    return found.groupBy("lang", "part").agg(F.sum("f").alias("f"))


def collocations(docs: DataFrame, least: int = 10, percent: int = 50, top: int = 2000,
                 shard_words: int = SHARD_WORDS, block_windows: int = BLOCK_WINDOWS,
                 range_windows: int = RANGE_WINDOWS, fan: int = FAN) -> DataFrame:
    """The best ``top`` phrases of every language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase occurs ``least`` times or more. One whose words stand inside a longer
    such phrase that has ``percent`` in a hundred of its occurrences is left out.
    """
    use_skew_settings(docs.sparkSession)
    table = write_once(blocks(docs, shard_words, block_windows), "window-blocks")
    totals = write_once(table.groupBy("lang").agg(F.sum("total").alias("n")), "words-per-language")
    cuts = borders(table, range_windows)
    counts = write_once(phrase_counts(deal(table, cuts, range_windows, fan), cuts, least), "phrase-counts")
    found = write_once(candidates(counts, least, percent), "candidates")
    w = _words("phrase")
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts_of = (found.withColumn("w", w).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
               .select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"),
                       part(F.col("k") + 1, F.size("w") - F.col("k")).alias("right")))
    asked = cuts_of.select("lang", F.explode(F.array("left", "right")).alias("part")).distinct()
    f = write_once(part_counts(counts, asked, cuts), "part-counts")
    for side, name in (("left", "l"), ("right", "r")):
        cuts_of = cuts_of.join(f.select("lang", F.col("part").alias(side), F.col("f").alias(name)), ["lang", side])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    score = F.expr("(CAST(1000000 AS DECIMAL(38,0)) * wa * wa) div (wl * wr)")
    scored = (cuts_of.select("lang", "phrase", "a", "l", "r", "k", wide("a").alias("wa"), wide("l").alias("wl"), wide("r").alias("wr"))
              .withColumn("score", score).groupBy("lang", "phrase", "a")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
              .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    best = scored.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
