"""Secret scan: fixed patterns plus a character network over every candidate.

Three patterns give the base findings, which always stand: a value assigned
to a key word, access key ids, long hex runs. Further candidates are all runs
of ``MIN_RUN`` or more key characters that no base finding covers whole; one
that reaches beyond a base finding overlaps it. A convolutional network over
characters scores every candidate with the text around it (base findings too,
as information); a candidate becomes a finding of kind ``cnn`` if its
calibrated probability reaches the threshold.

The network is trained here, with numpy, on labelled findings that
:func:`labelled_findings` writes out by rule from a seed: keys of many shapes
against words, dates, versions, paths, numbers and names that look like keys.
It learns and is measured on the candidates that the scan cuts from those
texts. A part held back from training calibrates the score (logistic scaling)
and sets the threshold: the highest one that still finds ``RECALL`` of the
held-back keys that no base finding covers; a key that is no candidate counts
as missed. Candidates longer than the network's view are read in overlapping views and
get the highest score.

Offsets are code points, end exclusive. Null texts are empty texts; repeated
rows all stay; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import random
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.common import map_rows, values

KINDS = ("assign", "access", "hex", "cnn")
# The patterns of the base findings and their shortest lengths.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run, so the bound may stand inside
ASSIGN_VALUE, ACCESS_LENGTH = 12, 18

_KEY_STEMS = ("passw", "secret", "token", "api")
MIN_RUN = 8  # shorter runs are never judged
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}" % MIN_RUN)

RECALL = 0.98
BEFORE, VIEW, AFTER, STRIDE = 20, 48, 8, 32
VIEWS = 4096
WIDTH, FILTERS = 5, 24
_SPAN = BEFORE + VIEW + AFTER
_CHARS = 97  # padding, 95 printable characters, everything else


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, sorted."""
    out = []
    low = text.lower()
    if any(stem in low for stem in _KEY_STEMS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def extra_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of key characters that no base finding covers whole."""
    out = []
    for m in _RUN.finditer(text):
        start, end = m.start(), m.start() + len(m[0].rstrip(".-_/"))
        if end - start >= MIN_RUN and not any(a <= start and end <= b for a, _, b in base):
            out.append((start, end))
    return out


def encode_spans(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of each view of each span and the span's number; inside and outside differ."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.zeros(len(raw) + BEFORE + 2 * _SPAN, np.int16)
    codes[BEFORE:BEFORE + len(raw)] = np.where((raw >= 32) & (raw < 127), raw - 31, _CHARS - 1)
    start, end = np.array(spans, np.int64).reshape(-1, 2).T
    views = np.maximum(1, -(-(end - start - VIEW + STRIDE) // STRIDE))
    owner = np.repeat(np.arange(len(spans)), views)
    shift = STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(views) - views, views))
    at = (start[owner] + shift)[:, None] + np.arange(_SPAN)
    inside = (at - BEFORE >= start[owner][:, None]) & (at - BEFORE < end[owner][:, None])
    return codes[at] + np.int16(_CHARS) * inside, owner


def encode_views(text: str, start: int, end: int) -> list[np.ndarray]:
    """The views of one span."""
    return list(encode_spans(text, [(start, end)])[0])


class CharNet:
    """One convolution over character codes, maximum over places, one output."""

    def __init__(self, seed: int = 0):
        rng = np.random.RandomState(seed)
        self.kernel = rng.normal(0, 0.1, (WIDTH, 2 * _CHARS, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.out = rng.normal(0, 0.3, FILTERS)
        self.level = np.zeros(1)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        places = _SPAN - WIDTH + 1
        conv = np.repeat(self.bias[None, None], len(x), axis=0).repeat(places, axis=1)
        for k in range(WIDTH):
            conv += self.kernel[k][x[:, k:k + places]]
        best = conv.argmax(axis=1)
        top = np.maximum(np.take_along_axis(conv, best[:, None], axis=1)[:, 0], 0)
        return best, top, top @ self.out + self.level[0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        kernel, places = self.kernel.astype(np.float32), _SPAN - WIDTH + 1
        parts = []
        room = np.empty((64 * places, FILTERS), np.float32)
        for i in range(0, len(x), 64):  # small enough for the cache
            part = x[i:i + 64].astype(np.intp)
            conv = np.take(kernel[0], part[:, :places].ravel(), axis=0)
            for k in range(1, WIDTH):
                conv += np.take(kernel[k], part[:, k:k + places].ravel(), axis=0, out=room[:len(conv)], mode="clip")
            best = conv.reshape(len(part), places, FILTERS).max(axis=1)
            parts.append(np.maximum(best + self.bias, 0) @ self.out + self.level[0])
        return np.concatenate(parts) if parts else np.zeros(0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -40, 40)))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int = 1) -> None:
        """Logistic loss, Adam, batches in seeded order."""
        rng = np.random.RandomState(seed)
        params = [self.kernel, self.bias, self.out, self.level]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step, filters = 0, np.arange(FILTERS)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 64):
                xb, yb = x[order[at:at + 64]], y[order[at:at + 64]]
                best, top, logit = self._forward(xb)
                d = (1 / (1 + np.exp(-logit)) - yb) / len(yb)
                back = (d[:, None] * self.out) * (top > 0)
                kernel = np.zeros_like(self.kernel)
                for k in range(WIDTH):
                    codes = np.take_along_axis(xb, best + k, axis=1)
                    np.add.at(kernel[k], (codes, filters[None]), back)
                grads = [kernel + 1e-5 * self.kernel, back.sum(axis=0), top.T @ d, np.array([d.sum()])]
                step += 1
                for p, g, (m, v) in zip(params, grads, moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 0.01 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)

    def calibrate(self, logits: np.ndarray, y: np.ndarray, judged: np.ndarray, recall: float) -> None:
        """Logistic scaling by Newton steps, then the highest threshold that keeps ``recall`` of the ``judged`` keys.

        A key that no candidate holds has the logit ``-inf``.
        """
        z = np.column_stack([np.maximum(logits, -40), np.ones(len(logits))])
        # smoothed targets keep the slope finite when the classes separate
        n1 = y.sum()
        target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
            hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
            w -= np.linalg.solve(hess, z.T @ (p - target))
        self.scale, self.shift = map(float, w)
        found = np.sort(logits[(y == 1) & judged])
        least = found[int((1 - recall) * len(found))]
        if not np.isfinite(least):
            raise ValueError("the candidates hold too few of the keys for this recall")
        self.threshold = float(1 / (1 + np.exp(-np.clip(self.scale * least + self.shift, -40, 40))))


_WORDS = ("the", "value", "in", "see", "report", "of", "stamp", "page", "with", "und", "pour", "la", "build", "at")


_SYLLABLES = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou le ve co me de hi ri ro ic ne "
    "ea ra ce tion ing ent ation ment ness able ly wh sh ein sch ich ver ung keit lich zu ge be auf tz pf eau aux que "
    "oi ai elle eur cion ado dad os la el ar ll pre con dis com per pro man ber lan for").split()


def _secret(rng: random.Random) -> tuple[str, str]:
    """A key and the text before it."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    mixed, upper = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    shape = rng.randrange(13)
    if shape == 0:
        key = pick(mixed, rng.randrange(20, 60))
    elif shape == 1:
        key = base64.b64encode(rng.randbytes(rng.randrange(15, 60))).decode()
    elif shape == 2:
        key = rng.choice(["sk_live_", "pk_test_", "ghp_", "glpat-", "xoxb-", "SG.", "npm_", "hf_"]) + pick(mixed, rng.randrange(20, 44))
    elif shape == 3:
        key = rng.choice(["AKIA", "ASIA"]) + pick(upper, 16)
    elif shape == 4:
        key = pick("0123456789abcdef", rng.choice([32, 40, 64]))
    elif shape == 5:
        key = "eyJ" + pick(mixed, 30) + "." + pick(mixed, 40) + "." + pick(mixed + "-_", 30)
    elif shape == 6:
        key = "-".join(pick(upper, 5) for _ in range(rng.randrange(4, 6)))
    elif shape == 7:
        key = pick("0123456789ABCDEF", rng.choice([32, 40]))
    elif shape == 8:
        key = pick(string.ascii_letters, rng.randrange(16, 48))
    elif shape == 9:
        key = pick(rng.choice([string.ascii_lowercase, string.ascii_uppercase]), rng.randrange(20, 48))
    elif shape == 10:
        key = pick(string.digits, rng.randrange(24, 48))
    elif shape == 11:
        key = pick(mixed, rng.randrange(10, 20))
    else:
        key = rng.choice(["xkeysib-", "dop_v1_", "key-", "re_"]) + pick("0123456789abcdef", 64) + "-" + pick(mixed, 16)
    lead = rng.choice(["token: ", "key=", "Authorization: Bearer ", "secret is ", "export API_KEY=", "pwd ", "", "",
                       rng.choice(_WORDS) + " ", "credentials: "])
    return key, lead


def _harmless(rng: random.Random) -> tuple[str, str]:
    """A run that looks like a key, and the text before it."""
    num = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    word = lambda: "".join(rng.choice("aeioubdlmnrst") for _ in range(rng.randrange(3, 11)))
    spelt = lambda: "".join(rng.choice(_SYLLABLES) for _ in range(rng.randrange(3, 7)))
    shape = rng.randrange(16)
    if shape == 0:
        run = f"20{num(2)}-{num(2)}-{num(2)}T{num(2)}.{num(2)}.{num(2)}Z"
    elif shape == 1:
        run = f"{word()}-{rng.randrange(9)}.{num(2)}.{num(1)}-{word()}.tar.gz"
    elif shape == 2:
        run = "/".join(["www." + word() + ".com", word(), num(4), word() + ".html"])
    elif shape == 3:
        run = f"IMG_20{num(6)}_{num(6)}.jpg"
    elif shape == 4:
        run = word() + word().capitalize() + word() + num(rng.randrange(1, 5))
    elif shape == 5:
        run = "_".join([word(), num(1), word(), num(2), word()])
    elif shape == 6:
        run = rng.choice("abcdexyz") * rng.randrange(14, 30) + num(1)
    elif shape == 7:
        run = f"{num(1)}{word()}.{num(2)}{word()}.{num(2)}{word()}"
    elif shape == 8:
        run = "=" * 12 + word() + num(2) + "=" * 6
    elif shape == 9:
        run = f"{word()}.{word()}{num(2)}/{word()}-{word()}"
    elif shape < 13:
        run = rng.choice([str.lower, str.capitalize, str.upper])(spelt())
    elif shape == 13:
        run = rng.choice(["-", "/", "_", ".", "--", "..."]).join(spelt() for _ in range(rng.randrange(2, 4)))
    elif shape == 14:
        run = rng.choice([num(rng.randrange(8, 16)), f"{num(4)}-{num(2)}-{num(2)}", f"{num(3)}-{num(3)}-{num(4)}",
                          f"{num(2)}.{num(2)}.{num(4)}", f"+{num(2)}-{num(3)}-{num(7)}", f"{num(3)}.{num(1)}.{num(2)}.{num(3)}"])
    else:
        run = rng.choice("=-_.+") * rng.randrange(6, 40) + rng.choice(["", "+", "=", spelt()])
    while len(run.rstrip(".-_/")) < MIN_RUN:
        run += word()
    if run.isupper() and run.isalpha():  # mostly among others
        return run, " ".join(spelt().upper() for _ in range(rng.randrange(4))) + rng.choice([" ", "!! "])
    return run, rng.choice(
        ["see ", "file ", "on ", "at ", "version ", rng.choice(_WORDS) + " ", "http://", "", "(", "id "])


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """``n`` rows ``(text, start, end, label)``; half are keys."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        run, lead = (_secret if i % 2 else _harmless)(rng)
        before = " ".join(rng.choice(_WORDS) for _ in range(rng.randrange(0, 6)))
        before = (before + " " if before else "") + lead
        after = rng.choice([" ", '" ', "\n", ". ", ") "]) + " ".join(rng.choice(_WORDS) for _ in range(4))
        rows.append((before + run + after, len(before), len(before) + len(run), i % 2))
    return rows


def _cut(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Views, the row of each view, labels, and whether a row's run is for the network to judge.

    The views are those of the candidates that the scan cuts there; a run that
    base findings cover has the views of its written span.
    """
    views, owner, judged = [], [], []
    for i, (text, start, end, _) in enumerate(rows):
        base = base_findings(text)
        judged.append(not any(a <= start and end <= b for a, _, b in base))
        spans = [(a, b) for a, b in extra_candidates(text, base) if a < end and start < b] if judged[-1] else [(start, end)]
        views.append(encode_spans(text, spans)[0])
        owner += [i] * len(views[-1])
    return np.concatenate(views), np.array(owner), np.array([r[3] for r in rows], float), np.array(judged)


@lru_cache(maxsize=2)
def trained(n: int = 3000, epochs: int = 6, recall: float = RECALL, seed: int = 7) -> CharNet:
    """The network, trained on ``n`` labelled findings, as written and as cut, and calibrated on ``n`` others."""
    net = CharNet(seed)
    rows = labelled_findings(n, seed)
    x, owner, y, _ = _cut(rows)
    written = [encode_spans(t, [(a, b)])[0] for t, a, b, _ in rows]
    labels = np.concatenate([y[owner], np.repeat(y, [len(v) for v in written])])
    net.train(np.concatenate([x, *written]), labels, epochs)
    x, owner, y, judged = _cut(labelled_findings(n, seed + 1))
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, owner, net.logits(x))
    net.calibrate(best, y, judged, recall)
    return net


def findings(texts: list[str], net: CharNet) -> list[list[tuple[int, int, int, float]]]:
    """Per text ``(start, kind, end, probability)``, sorted by start and kind."""
    out = []
    for text in texts:
        base = base_findings(text)
        spans = [*base, *((a, 3, b) for a, b in extra_candidates(text, base))]
        best = np.zeros(len(spans))
        for i in range(0, len(spans), VIEWS):  # bounds the views held at a time
            views, owner = encode_spans(text, [(a, b) for a, _, b in spans[i:i + VIEWS]])
            np.maximum.at(best, i + owner, net.probabilities(views))
        out.append(sorted((a, k, b, p) for (a, k, b), p in zip(spans, best.tolist(), strict=True)
                          if k < 3 or p >= net.threshold))
    return out


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                             ("probability", pa.float64())]))


def scan(docs: DataFrame, net: CharNet | None = None) -> DataFrame:
    """``doc_id, findings`` per row; findings are ordered by start, then kind."""
    net = net or trained()

    def run(it):
        for batch in it:
            found = findings([t or "" for t in values(batch, "text")], net)
            rows = [[dict(kind=KINDS[k], start=a, end=b, probability=p) for a, k, b, p in row] for row in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _FOUND)], ["doc_id", "findings"])

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                    "doc_id long, findings array<struct<kind:string,start:long,end:long,probability:double>>")


MASK = "[secret]"


def redacted(text: str, row) -> str:
    out, at = [], 0
    for start, _, end, _ in row:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], MASK]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, net: CharNet | None = None) -> DataFrame:
    """``docs`` with every finding in ``text`` masked and ``n_chars`` counted anew."""
    net = net or trained()
    names = docs.columns

    def run(it):
        for batch in it:
            texts = values(batch, "text")
            found = findings([t or "" for t in texts], net)
            if any(found):
                new = [redacted(t, row) if row else t for t, row in zip(texts, found, strict=True)]
                at = batch.schema.get_field_index("text")
                batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
                if "n_chars" in names:
                    at = batch.schema.get_field_index("n_chars")
                    field = batch.schema.field(at)
                    counts = [len(t) if row else n for t, row, n in zip(new, found, values(batch, "n_chars"), strict=True)]
                    batch = batch.set_column(at, field, pa.array(counts, field.type))
            yield batch

    return map_rows(docs, run, docs.schema)
