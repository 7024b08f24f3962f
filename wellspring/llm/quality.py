"""Quality classifier: Bradley-Terry pairwise ranking.

A document's latent quality is a weighted sum of features of its whole text: the shares of all pairs of neighbouring
character classes (CLASSES), which words, sentences and lines are made of, and a few counts of words and lines. The weights are learned from preference
pairs (a document labelled 1 is preferred to one labelled 0) by logistic loss on the difference of their features. The
threshold is a quantile of the learned scores: the share of label 0 among the labels. score = sigmoid(latent -
threshold), so predicted = 1 just where score >= 0.5.

The fit sees all labelled documents. Where they are more than `group`, they are dealt by a hash of doc_id into groups of about that size; each group draws
its own pairs, some 20 for each of its documents, and Newton's steps sum up the groups' slopes and curvatures in tasks. So what the driver holds doesn't
grow with the labels, but for one array of each task. Scores cover all documents, one pass, nothing shuffled.

Defined results: null or empty text has the features of no words and is scored like any other; repeated rows get equal
scores; a null doc_id is in no fold and held_out is false; without labels of both kinds every score is 0.5; several
labels of one document count each, with one text of it (that of the smallest hash); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, documents, materialize, pieces, scan_offsets, texts_of

#: Characters of each class; all other ASCII signs are one class, all bytes from 0x80 on another, and so are control characters.
CLASSES = (b" ", b"\t\n\r", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b".", b",", b"!?", b"'\"`", b"()[]{}", b"-_", b"|/\\", b";:")
_CLASS = np.full(256, len(CLASSES), np.uint8)
_CLASS[128:], _CLASS[:32], _CLASS[127] = len(CLASSES) + 1, len(CLASSES) + 2, len(CLASSES) + 2
for _k, _signs in enumerate(CLASSES):
    _CLASS[list(_signs)] = _k
#: Number of features; behind them stands how far a text's features count, n / (n + FEW) of its n bytes.
SIZE, FEW = 256 + 6, 30
#: Most steps of Newton's method.
STEPS = 15


def features(text: bytes) -> np.ndarray:
    """Shares of the 16 x 16 pairs of classes (square roots, so that small ones still tell), share of lines that repeat, of
    words that repeat the word before, of distinct words, length of words, number of words, words in a line; and how far they count."""
    words = text.split()
    if not words:
        return np.zeros(SIZE + 1)
    kinds = _CLASS[np.frombuffer(text, np.uint8)]
    pairs = np.bincount((kinds[:-1] << 4) | kinds[1:], minlength=256) / max(1, len(text) - 1)
    lines = [x for x in text.split(b"\n") if x]
    w = len(words)
    more = [(1 - len(set(lines)) / len(lines)) ** 0.5, (sum(map(operator.eq, words, words[1:])) / w) ** 0.5, log(len(set(words)) + 1) / log(w + 1), log(len(text) / w), log(w) / 10, log(w / len(lines)) / 10, len(text) / (len(text) + FEW)]
    return np.concatenate([np.sqrt(pairs), more])


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and an array of features for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8 << 20):
            values = np.array([features(t) for t in texts_of(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.FixedSizeListArray.from_arrays(values.ravel(), SIZE + 1).cast(pa.list_(pa.float64()))], ["doc_id", "features"])

    return documents(docs).mapInArrow(run, "doc_id long, features array<double>")


class BradleyTerry:
    """fit() learns weights from features and the numbers of labels 1 and 0 of each row; score() gives 0 to 1."""

    def __init__(self) -> None:
        self.mean, self.scale, self.weights, self.threshold = np.zeros(SIZE), np.ones(SIZE), np.zeros(SIZE), 0.0

    def fit(self, x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> BradleyTerry:
        if not (good.any() and bad.any()):
            return self
        # features that hardly vary aren't blown up
        self.mean, self.scale = x[:, :SIZE].mean(0), x[:, :SIZE].std(0) + 0.01
        difference = self.pairs(x, good, bad)
        for _ in range(STEPS):
            if self.step(*self.slope(difference)) < 1e-4:
                break
        latent, labels = self._centred(x) @ self.weights, good + bad
        order = np.argsort(latent, kind="stable")
        middle = (np.cumsum(labels[order]) - labels[order] / 2) / labels.sum()
        self.threshold = float(np.interp(bad.sum() / labels.sum(), middle, latent[order]))
        return self

    def pairs(self, x: np.ndarray, good: np.ndarray, bad: np.ndarray, seed: int = 0, others: tuple[np.ndarray, np.ndarray] | None = None, pairs: int = 20000) -> np.ndarray:
        """Differences of centred features of drawn pairs: a document by its labels 1, less one by its labels 0. Where a kind is missing its mean among all
        (`others`) stands for it."""
        x, rng = self._centred(x), np.random.default_rng(seed)
        sides = [x[rng.choice(len(x), pairs, p=n / n.sum())] if n.any() else others[k][None] for k, n in enumerate((good, bad))]
        return sides[0] - sides[1]

    def slope(self, difference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the pairs' log likelihood at the weights."""
        p = 1 / (1 + np.exp(-np.clip(difference @ self.weights, -30, 30)))
        return difference.T @ (1 - p), (difference * (p * (1 - p))[:, None]).T @ difference

    def step(self, gradient: np.ndarray, curvature: np.ndarray, ridge: float = 1.0) -> float:
        """Newton's step on the logistic loss of differences; returns the largest change of a weight."""
        step = np.linalg.solve(curvature + ridge * np.eye(SIZE), gradient - ridge * self.weights)
        self.weights = self.weights + step
        return float(np.abs(step).max())

    def _centred(self, x: np.ndarray) -> np.ndarray:
        """Features less their means in units of their spread; those of short texts are drawn to the mean."""
        return (x[:, :SIZE] - self.mean) / self.scale * x[:, SIZE:]

    def score(self, x: np.ndarray) -> np.ndarray:
        latent = self._centred(x) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(latent, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, group: int = 1000) -> BradleyTerry:
    """Learn from all labelled documents whose crc32(doc_id) mod 3 is not 1."""
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    usable = rows.where("doc_id is not null and quality in (0, 1)").where(crc_mod(3) != 1)
    counted = materialize(usable.groupBy("doc_id").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")), "labels")
    # one text for each id
    texts = documents(docs).join(counted.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = with_features(texts).join(counted, "doc_id")
    n = counted.count()
    if n > group:
        return _fit_groups(rows, -(-n // group))
    got = sorted((r.doc_id, r.good, r.bad, r.features) for r in rows.collect())
    if not got:
        return BradleyTerry()
    good, bad = np.array([r[1:3] for r in got], float).T
    return BradleyTerry().fit(np.array([r[3] for r in got]), good, bad)


def _packed(table: pa.Table) -> pa.Table:
    """A group's labels 1 and 0 and features, in the order of doc_id, as bytes of one row."""
    table = table.sort_by("doc_id")
    x = table.column("features").combine_chunks().flatten().to_numpy()
    good, bad = (table.column(c).to_numpy().astype(float) for c in ("good", "bad"))
    return pa.table({"part": table.column("part").slice(0, 1), **{n: pa.array([v.tobytes()], pa.binary()) for n, v in (("good", good), ("bad", bad), ("x", x))}})


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """part, features, labels 1 and 0 of each packed row."""
    for batch in batches:
        for part, *values in zip(*[batch.column(c) for c in ("part", "x", "good", "bad")], strict=True):
            x, good, bad = (np.frombuffer(v.as_buffer(), float) for v in values)
            yield part.as_py(), x.reshape(-1, SIZE + 1), good, bad


def _summed(groups: DataFrame, of) -> np.ndarray:
    """The sum of the arrays that `of` gives for each group; a task sends one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for one in _groups(batches):
            found = of(*one)
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    return sum(np.frombuffer(r.total, float) for r in groups.mapInArrow(run, "total binary").collect())


def _fit_groups(rows: DataFrame, parts: int) -> BradleyTerry:
    """The fit over groups of labelled documents: doc_id, features, good, bad."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    groups = materialize(dealt.groupBy("part").applyInArrow(_packed, "part int, good binary, bad binary, x binary"), "groups")
    model = BradleyTerry()
    sums = _summed(groups, lambda part, x, good, bad: np.concatenate([[len(x), good.sum(), bad.sum()], x[:, :SIZE].sum(0)]))
    if not np.ndim(sums) or not (sums[1] and sums[2]):
        return model
    model.mean = sums[3:] / sums[0]
    model.scale = np.sqrt(_summed(groups, lambda part, x, good, bad: ((x[:, :SIZE] - model.mean) ** 2).sum(0)) / sums[0]) + 0.01
    means = _summed(groups, lambda part, x, good, bad: (np.stack([good, bad]) @ model._centred(x)).ravel()).reshape(2, SIZE) / sums[1:3, None]

    def slopes(part: int, x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        gradient, curvature = model.slope(model.pairs(x, good, bad, part, means))
        return np.concatenate([gradient, curvature.ravel()])

    for _ in range(STEPS):
        total = _summed(groups, slopes) / parts  # the penalty weighs as in a fit of one group
        if model.step(total[:SIZE], total[SIZE:].reshape(SIZE, SIZE)) < 1e-4:
            break

    def latents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, good, bad in _groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(model._centred(x) @ model.weights), pa.array((good + bad).astype(np.int64))], ["latent", "n"])

    # the share of label 0 lies between two documents' middles, in the order of their scores; ranked in range parts, then by offsets of the parts
    ranked = materialize(groups.mapInArrow(latents, "latent double, n long").repartitionByRange("latent").withColumn("part", F.spark_partition_id()), "latents")
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("latent").rowsBetween(Window.unboundedPreceding, 0))
    middle = ranked.withColumn("upto", upto).join(F.broadcast(scan_offsets(ranked, "part", "n")), "part").select((F.col("base") + F.col("upto") - F.col("n") / 2).alias("at"), "latent")
    around = F.struct("at", "latent")
    below, above = middle.agg(F.max(F.when(F.col("at") <= sums[2], around)), F.min(F.when(F.col("at") >= sums[2], around))).first()
    ends = [tuple(e) for e in (below, above) if e is not None]
    model.threshold = float(np.interp(sums[2], [e[0] for e in ends], [e[1] for e in ends]))
    return model


def score(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """doc_id, held_out, score and predicted for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8 << 20):
            values = model.score(np.array([features(t) for t in texts_of(batch)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "score"])

    scored = documents(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (crc_mod(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """The rows of docs, all columns, whose predicted label is 1."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8 << 20):
            kept = model.score(np.array([features(t) for t in texts_of(batch)])) >= 0.5
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, schema)
