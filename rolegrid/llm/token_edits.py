"""Token counts that follow edits.

A document's text is cut into pre-tokens, whose tokens never reach across a
border; its token count is the sum over pre-tokens. The counts hang on a
segment tree per document: leaves are chunks of up to ``CHUNK`` pre-tokens,
nodes hold the characters and tokens below them. An edit finds its place by
the character sums, re-cuts from the last border that cannot depend on the
edited characters until a new border falls on an old one behind the edit,
counts only the pre-tokens in between, and updates the sums up to the root.

A border depends on the text up to one character behind the pre-token that
ends there (a run of white space keeps its last blank for the next word), so
pre-tokens that end two characters or more before the edit stay.

``build`` makes the stored form of the trees (one row per document),
``recount`` applies edits to it. Edits are ``start, deleted, inserted`` in code
points, applied in the order of the array, each to the text the one before
left; places beyond the text mean its end. Null texts are empty, null edit
arrays hold no edit, null inserted texts insert nothing; repeated rows are
edited alike; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.common import map_rows, values
from rolegrid.llm.packing import Encoder

CHUNK = 64

# Fixed value: white space as the vocabulary's own cutter knows it, then its pattern.
_SPACE = r"\t\n\v\f\r \x85\xa0  -     　"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _SPACE + r"\p{L}\p{N}]+"
           r"|[" + _SPACE + r"]+(?![^" + _SPACE + r"])|[" + _SPACE + r"]+")

EDITS = "array<struct<start:int,deleted:int,inserted:string>>"


def _cutter():
    import regex

    return regex.compile(PATTERN)


class Counts(dict):
    """Tokens of a pre-token, remembered."""

    def __init__(self, tokenizer_path: str):
        super().__init__()
        self.encoder = Encoder(tokenizer_path)

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self.encoder[piece]) // 4
        return n

    def trim(self) -> None:
        self.encoder.trim()
        if not self.encoder:
            self.clear()


class TokenTree:
    """Pre-token lengths and token counts of one text under a segment tree."""

    def __init__(self, sizes: list[int], tokens: list[int]):
        self.chunks = [(sizes[i:i + CHUNK], tokens[i:i + CHUNK]) for i in range(0, len(sizes), CHUNK)]
        self._sum_all()

    def _sum_all(self) -> None:
        self.leaves = 1
        while self.leaves < len(self.chunks):
            self.leaves *= 2
        self.chars = [0] * (2 * self.leaves)
        self.tokens = [0] * (2 * self.leaves)
        for i, (sizes, tokens) in enumerate(self.chunks):
            self.chars[self.leaves + i], self.tokens[self.leaves + i] = sum(sizes), sum(tokens)
        for node in range(self.leaves - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def locate(self, place: int) -> tuple[int, int]:
        """The chunk that holds character ``place`` and the characters before the chunk."""
        node, before = 1, 0
        while node < self.leaves:
            node *= 2
            if place - before >= self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.leaves, before

    def replace(self, first: int, last: int, sizes: list[int], tokens: list[int]) -> None:
        """Put new pre-tokens in the place of chunks ``first`` to ``last``."""
        new = [(sizes[i:i + CHUNK], tokens[i:i + CHUNK]) for i in range(0, len(sizes), CHUNK)]
        if len(new) != last - first + 1:
            self.chunks[first:last + 1] = new
            self._sum_all()
            return
        for i, chunk in enumerate(new, first):
            self.chunks[i] = chunk
            node = self.leaves + i
            self.chars[node], self.tokens[node] = sum(chunk[0]), sum(chunk[1])
            while node > 1:
                node //= 2
                self._sum(node)

    def edit(self, text: str, start: int, deleted: int, inserted: str, cut, counts) -> tuple[str, int]:
        """The new text, and how many pre-tokens were counted for it."""
        start = min(max(start, 0), len(text))
        deleted = min(max(deleted, 0), len(text) - start)
        new = text[:start] + inserted + text[start + deleted:]
        if not self.chunks:
            pieces = cut.findall(new)
            self.__init__(list(map(len, pieces)), [counts[p] for p in pieces])
            return new, len(pieces)
        first, before = self.locate(max(0, start - 2))
        sizes, tokens = [], []
        at = before
        for size, count in zip(*self.chunks[first], strict=True):  # pre-tokens the edit cannot reach
            if at + size > start - 2:
                break
            sizes.append(size)
            tokens.append(count)
            at += size
        # old borders behind the edit, as far as they are asked for
        last, old_at, k = first, at, len(sizes)
        shift, fresh, met = len(inserted) - deleted, 0, False
        behind = start + len(inserted)
        for m in cut.finditer(new, at):
            sizes.append(m.end() - m.start())
            tokens.append(counts[m[0]])
            fresh += 1
            if m.end() < behind:
                continue
            while old_at < m.end() - shift:
                if k == len(self.chunks[last][0]):
                    last, k = last + 1, 0
                old_at += self.chunks[last][0][k]
                k += 1
            if old_at == m.end() - shift:
                met = True
                break
        if not met:
            last, k = len(self.chunks) - 1, len(self.chunks[-1][0])
        self.replace(first, last, sizes + self.chunks[last][0][k:], tokens + self.chunks[last][1][k:])
        return new, fresh


def build(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``docs`` with ``sizes`` and ``tokens``: the leaves of each document's tree."""
    kept = [c for c in docs.columns if c not in ("sizes", "tokens")]
    docs = docs.select(*kept)
    out = docs.withColumns({"sizes": F.lit(None).cast("array<int>"), "tokens": F.lit(None).cast("array<int>")})

    def leaves(it):
        cut, counts = _cutter(), Counts(tokenizer_path)
        for batch in it:
            sizes, tokens = [], []
            for text in values(batch, "text"):
                pieces = cut.findall(text or "")
                sizes.append(list(map(len, pieces)))
                tokens.append(list(map(counts.__getitem__, pieces)))
            counts.trim()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32()))],
                [*batch.schema.names, "sizes", "tokens"])

    return map_rows(docs, leaves, out.schema)


def recount(trees: DataFrame, tokenizer_path: str, keep_trees: bool = False) -> DataFrame:
    """Counts before and after the edits of ``trees(doc_id, text, sizes, tokens, edits)``.

    ``doc_id, n_tokens_before, n_tokens, n_edits, n_recounted, n_pretokens``, and
    the new ``text, sizes, tokens`` with ``keep_trees``.
    """

    def follow(it):
        cut, counts = _cutter(), Counts(tokenizer_path)
        for batch in it:
            out: dict[str, list] = {c: [] for c in (
                "doc_id", "n_tokens_before", "n_tokens", "n_edits", "n_recounted", "n_pretokens", "text", "sizes", "tokens")}
            for doc_id, text, sizes, tokens, edits in zip(
                    *(values(batch, c) for c in ("doc_id", "text", "sizes", "tokens", "edits")), strict=True):
                text, tree, fresh = text or "", TokenTree(sizes or [], tokens or []), 0
                before = tree.total
                for e in edits or []:
                    text, n = tree.edit(text, e["start"] or 0, e["deleted"] or 0, e["inserted"] or "", cut, counts)
                    fresh += n
                row = (doc_id, before, tree.total, len(edits or []), fresh, sum(len(c[0]) for c in tree.chunks))
                for key, value in zip(out, row):  # noqa: B905 the tree's columns follow
                    out[key].append(value)
                if keep_trees:
                    out["text"].append(text)
                    out["sizes"].append([s for c in tree.chunks for s in c[0]])
                    out["tokens"].append([t for c in tree.chunks for t in c[1]])
            counts.trim()
            kinds = {"text": pa.string(), "sizes": pa.list_(pa.int32()), "tokens": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()
                                              if keep_trees or k not in kinds})

    schema = ("doc_id long, n_tokens_before long, n_tokens long, n_edits long, n_recounted long, n_pretokens long"
              + (", text string, sizes array<int>, tokens array<int>" if keep_trees else ""))
    return map_rows(trees.select("doc_id", "text", "sizes", "tokens", "edits"), follow, schema)


def attach_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with the array ``edits`` of a table ``edits(doc_id, seq, start, deleted, inserted)``."""
    each = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(
        F.struct("seq", "start", "deleted", "inserted"))).alias("all"))
    each = each.select("doc_id", F.transform("all", lambda e: F.struct(
        e["start"].cast("int").alias("start"), e["deleted"].cast("int").alias("deleted"),
        e["inserted"].alias("inserted"))).alias("edits"))
    return docs.drop("edits").join(each, "doc_id", "left")
