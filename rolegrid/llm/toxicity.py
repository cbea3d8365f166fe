"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (label 1, rows of the training folds) are the positives,
a sample of all training rows is the unlabelled set, and the class prior is
the share of toxic labels among the labelled training rows. A linear model on
word and word-beginning features minimises the class-prior-corrected risk

    prior * loss(P, +) + max(0, loss(U, -) - prior * loss(P, -))

whose second term must not become negative: where it does, the step goes up
that term instead (Kiryo et al. 2017). Features that positives and unlabelled
texts hold equally often are left out before. The score is scaled to a
probability on labelled training rows.

Bounded samples, documented parameters: ``positives``, ``unlabelled`` and
``calibration`` rows, chosen by the hash of their id. Scoring reads every
whole text and uses the text only.

Rows without id are never used for training and count as held out. Null and
empty texts have no feature and get the score of the intercept. Without a
positive example every score is 0. Repeated rows all stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.common import MEMO_WORDS, map_rows, raw_texts, values

POSITIVES, UNLABELLED, CALIBRATION = 3000, 6000, 3000
FOLDS = 5
BUCKET_BITS = 20
STARTS = (4, 5, 6)
MIN_Z = 4.0
STEPS = 400

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def fold(doc_id="doc_id"):
    """``crc32`` of the id as text, modulo the number of folds; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0))


class Features(dict):
    """Feature buckets of a word: the word and its beginnings, remembered.

    ``weights`` (if given) leaves out buckets without a weight.
    """

    def __init__(self, weights: dict[int, float] | None = None):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        text = word.decode("utf-8", "replace")
        parts = [f"={text}"] + [f"<{text[:n]}" for n in STARTS if len(text) >= n]
        found = {xxhash.xxh3_64_intdigest(p) & ((1 << BUCKET_BITS) - 1) for p in parts}
        if self.weights is not None:
            found = {b for b in found if b in self.weights}
        out = self[word] = tuple(sorted(found))
        return out

    def of(self, raw: bytes | None) -> set[int]:
        out: set[int] = set()
        for buckets in filter(None, map(self.__getitem__, set((raw or b"").translate(_LETTERS).split()))):
            out.update(buckets)
        return out

    def trim(self) -> None:
        if len(self) > MEMO_WORDS:
            self.clear()


@dataclass
class Model:
    weights: dict[int, float]
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def raw(self, features) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features)

    def score(self, features) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.raw(features) + self.shift, -40, 40))))


def _matrix(docs: list[np.ndarray], column: dict[int, int]):
    """Row and column numbers of the chosen features."""
    rows, cols = [], []
    for i, d in enumerate(docs):
        own = [column[f] for f in d.tolist() if f in column]
        rows += [i] * len(own)
        cols += own
    return np.array(rows, np.int64), np.array(cols, np.int64), len(docs)


def telling_features(pos: list[np.ndarray], unl: list[np.ndarray], min_z: float = MIN_Z) -> list[int]:
    """Buckets whose shares among positives and unlabelled texts differ clearly."""
    size = 1 << BUCKET_BITS
    a = np.bincount(np.concatenate([*pos, np.zeros(0, np.int32)]), minlength=size)
    b = np.bincount(np.concatenate([*unl, np.zeros(0, np.int32)]), minlength=size)
    n, m = max(len(pos), 1), max(len(unl), 1)
    share = (a + b + 1) / (n + m + 2)
    z = (a / n - b / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m))
    return np.flatnonzero(np.abs(z) >= min_z).tolist()


def train_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, steps: int = STEPS,
               rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Linear model by the non-negative risk with logistic loss; full-batch Adam."""
    chosen = telling_features(pos, unl)
    column = {f: i for i, f in enumerate(chosen)}
    (pr, pc, n), (ur, uc, m) = _matrix(pos, column), _matrix(unl, column)
    k = len(chosen)
    theta = np.zeros(k + 1)
    theta[k] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    first, second = np.zeros(k + 1), np.zeros(k + 1)

    def margin(rows, cols, size):
        return np.bincount(rows, weights=theta[cols], minlength=size) + theta[k]

    def gradient(rows, cols, d):
        return np.append(np.bincount(cols, weights=d[rows], minlength=k), d.sum())

    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    loss = lambda x: np.logaddexp(0, -x)
    for step in range(1, steps + 1):
        gp, gu = margin(pr, pc, n), margin(ur, uc, m)
        negative = loss(-gu).mean() - prior * loss(-gp).mean()
        down = gradient(ur, uc, sigmoid(gu) / m) - prior * gradient(pr, pc, sigmoid(gp) / n)
        if negative >= 0:
            grad = down - prior * gradient(pr, pc, sigmoid(-gp) / n)
        else:
            grad = -down
        grad[:k] += decay * theta[:k]
        first += 0.1 * (grad - first)
        second += 0.001 * (grad * grad - second)
        theta -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return Model({f: float(theta[i]) for f, i in column.items()}, float(theta[k]))


def calibrate(model: Model, docs: list[np.ndarray], labels: np.ndarray) -> None:
    """Logistic scaling of the margin on labelled rows, by Newton steps."""
    if len(set(labels.tolist())) < 2:
        return
    z = np.array([[model.raw(d.tolist()), 1.0] for d in docs])
    n1 = labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (len(labels) - n1 + 2))
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        w -= np.clip(np.linalg.solve(hess, z.T @ (p - target)), -2, 2)
    if w[0] > 0:
        model.scale, model.shift = float(w[0]), float(w[1])


def _sampled(docs: DataFrame, ids: DataFrame) -> list[tuple[set[str], np.ndarray, int]]:
    """Features of the bounded sample: ``(roles, buckets, label)`` rows."""
    chosen = docs.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])

    def features(it):
        memo = Features()
        for batch in it:
            packed = [np.array(sorted(memo.of(raw)), np.int32).tobytes() for raw in raw_texts(batch)]
            memo.trim()
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in ("pos", "unl", "cal", "label")],
                 pa.array(packed, pa.binary())], ["pos", "unl", "cal", "label", "features"])

    rows = map_rows(chosen.select("text", "pos", "unl", "cal", "label"), features,
                    "pos boolean, unl boolean, cal boolean, label int, features binary")
    table = rows.toArrow().to_pylist()
    return [({r for r in ("pos", "unl", "cal") if row[r]}, np.frombuffer(row["features"], np.int32), row["label"])
            for row in table]


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
        calibration: int = CALIBRATION) -> Model:
    """Train on bounded samples of the training folds (fold 0 is held out)."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
             .where(fold() != 0))
    every = docs.select("doc_id").where(F.col("doc_id").isNotNull() & (fold() != 0))
    first = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    share = known.agg(F.avg("label")).first()[0]
    roles = [first(known.where("label = 1"), positives).select("doc_id", F.lit("pos").alias("role"), "label"),
             first(every.distinct(), unlabelled).select("doc_id", F.lit("unl").alias("role"), F.lit(None).cast("int").alias("label")),
             first(known.withColumn("doc_id", F.col("doc_id")), calibration).select("doc_id", F.lit("cal").alias("role"), "label")]
    ids = roles[0].unionByName(roles[1]).unionByName(roles[2]).groupBy("doc_id").agg(
        *[F.max(F.col("role") == r).alias(r) for r in ("pos", "unl", "cal")], F.max("label").alias("label"))
    rows = _sampled(docs, ids)
    pos = [f for r, f, _ in rows if "pos" in r]
    unl = [f for r, f, _ in rows if "unl" in r]
    if not pos or not share:
        return Model({}, 0.0, 0.0, -40.0)
    model = train_nnpu(pos, unl, float(share))
    held = [(f, y) for r, f, y in rows if "cal" in r or "pos" in r]
    # positives beyond the calibration sample are weighed by the class prior through sampling: keep the sample alone
    held = [(f, y) for (r, f, y) in rows if "cal" in r] or held
    calibrate(model, [f for f, _ in held], np.array([y for _, y in held], float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        m = shared.value
        memo = Features(m.weights)
        for batch in it:
            scores = [m.score(memo.of(raw)) for raw in raw_texts(batch)]
            memo.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = map_rows(docs.select("doc_id", "text"), run, "doc_id long, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, **samples: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(docs, fit(docs, labels, **samples))
