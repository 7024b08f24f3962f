"""Hard negatives of anchors by a secondary-sort shuffle of pair scores.

Anchors are a stated query set that meets all rows in blocks: rows fall into chunks of about `chunk` by a hash, anchors into
blocks of about `block`, and each block meets each chunk in a group of its own. A first run of blocks, of rows of the anchor's label
only, sends each anchor's best positives; they fix its score windows. A second run sends, for each window, the best
negatives in it that the chunk has. What a chunk leaves out has enough better rows in the same chunk, so nothing that could be asked for is lost,
and the shuffle carries rows by the chunk and not by the row.

Then the pairs are dealt out by anchor and sorted by (anchor, descending score, id) in the shuffle, and an iterator streams
over them: a positive opens its window, a negative goes to each open window that holds its score and still has room. It keeps an
anchor's open windows and the negatives of the present score, never an anchor's rows.

Components become floor(256 x); scores are exact integers (doubles where all sums stay under 2^53, Python's integers beyond), held
at the bounds of a long.

Defined results: rows with a null id or label, a null or empty vector, or a null or non-finite component take no part; rows meet anchors of the
same length of vector only; of repeated ids each row is a candidate (but none for an anchor of that id), and the anchor is the smallest by
label and vector; a positive with a negative score has an empty window, one of score 0 that of score 0; ties go to the smaller id;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_parts

MOST = (1 << 63) - 1
PAIR = "anchor_id long, score long, vec_id long, positive boolean"


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, embedding (array<double>) and its length d, of the rows that take part."""
    v = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), label.cast("long").alias("label"), vectors["embedding"].cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.where("vec_id is not null and label is not null and size(embedding) > 0").where(F.coalesce(finite, F.lit(False))).withColumn("d", F.size("embedding"))


def _matrix(table: pa.Table) -> np.ndarray:
    return table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as Python's integers; where 256 x has no fraction it is exact however large x is."""
    return np.array([[int(v) * 256 if abs(v) >= 1 << 53 else floor(256 * v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of floor(256 x), as long integers."""
    with np.errstate(over="ignore"):
        fa, fb = np.floor(256.0 * a), np.floor(256.0 * b)
        bound = np.abs(fa).max(initial=0) * np.abs(fb).max(initial=0) * a.shape[1]
    if bound < 1 << 53:
        return (fa @ fb.T).astype(np.int64)
    return np.clip(_whole(a) @ _whole(b).T, -MOST, MOST).astype(np.int64)


def window(score: int, low: int, high: int, scale: int) -> tuple[int, int]:
    """Smallest and largest integer n with low * score <= scale * n <= high * score."""
    return -((-low * score) // scale), (high * score) // scale


def _pairs(columns: list[list[np.ndarray]], positive: bool) -> pa.Table:
    ids, scores, others = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
    return pa.table({"anchor_id": ids, "score": scores, "vec_id": others, "positive": np.full(len(ids), positive)})


def _blocks(asked: pa.Table, rows: pa.Table, same: bool, sliced: int = 128) -> Iterator[tuple]:
    """For a slice of anchors: their first place, and for each its scores in descending order (ties by id), the rows' ids, of rows that count."""
    ids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
    order = np.argsort(ids, kind="stable")
    ids, labels, v = ids[order], labels[order], _matrix(rows)[order]
    a, a_ids, a_labels = _matrix(asked), asked.column("vec_id").to_numpy(), asked.column("label").to_numpy()
    for at in range(0, len(a), sliced):
        scores = products(a[at : at + sliced], v)
        for i, own in enumerate(scores, at):
            counts = np.flatnonzero(((labels == a_labels[i]) == same) & (ids != a_ids[i]))
            yield i, own[counts], ids[counts]


def _best_positives(k: int):
    def run(key, asked: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        if asked.num_rows and rows.num_rows:
            a_ids = asked.column("vec_id").to_numpy()
            for i, scores, ids in _blocks(asked, rows, True):
                best = np.argsort(-scores, kind="stable")[:k]
                for c, x in zip(found, (np.full(len(best), a_ids[i]), scores[best], ids[best]), strict=True):
                    c.append(x)
        return _pairs(found, True)

    return run


def _best_negatives(k: int, low: int, high: int, scale: int):
    def run(key, asked: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        if asked.num_rows and rows.num_rows:
            a_ids, opened = asked.column("vec_id").to_numpy(), asked.column("opened").to_pylist()
            for i, scores, ids in _blocks(asked, rows, False):
                spans = [window(s, low, high, scale) for s in set(opened[i]) if s >= 0]
                if not spans:
                    continue
                inside = np.flatnonzero((scores >= min(s[0] for s in spans)) & (scores <= max(s[1] for s in spans)))
                inside = inside[np.argsort(-scores[inside], kind="stable")]
                falling = -scores[inside]
                takes = np.zeros(len(inside), bool)
                for least, most in spans:
                    begin, end = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
                    takes[begin : min(begin + k, end)] = True
                best = inside[takes]
                for c, x in zip(found, (np.full(len(best), a_ids[i]), scores[best], ids[best]), strict=True):
                    c.append(x)
        return _pairs(found, False)

    return run


def stream(positives: int, negatives: int, low: int, high: int, scale: int):
    """Pairs in the order of (anchor, descending score, id) -> a row for each positive and each negative that its window takes."""
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, opened, met, tied = None, [], 0, []
        for batch in batches:
            out: list[tuple] = []

            def offer(w: list, score: int, vec_id: int, out: list = out) -> None:
                if w[4] < negatives and w[2] <= score <= w[3]:
                    w[4] += 1
                    out.append((w[5], w[0], w[4], vec_id, w[1], score))

            for own, score, vec_id, positive in zip(*[batch.column(c).to_pylist() for c in ("anchor_id", "score", "vec_id", "positive")], strict=True):
                if own != anchor:
                    anchor, opened, met, tied = own, [], 0, []
                if tied and tied[0][0] != score:
                    tied = []
                if positive:
                    met += 1
                    if met <= positives and score >= 0:
                        opened.append([vec_id, score, *window(score, low, high, scale), 0, anchor])
                        for s, other in tied:  # negatives of the positive's own score come before it where their ids are smaller
                            offer(opened[-1], s, other)
                else:
                    if len(tied) < negatives:
                        tied.append((score, vec_id))
                    for w in opened:
                        offer(w, score, vec_id)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 100, chunk: int = 8192, block: int = 4096) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: the first `negatives` rows of another label with
    low * positive_score <= scale * score <= high * positive_score, for each anchor's first `positives` rows of its own label."""
    if not 0 <= low <= high <= scale:
        raise ValueError("a window lies between 0 and the positive's score")
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, label), "vectors")
    least = F.min(F.struct("label", "embedding", "d")).alias("a")
    anchors = materialize(rows.where(is_anchor).groupBy("vec_id").agg(least).select("vec_id", "a.*"), "anchors")
    chunks, blocks = max(1, -(-rows.count() // chunk)), max(1, -(-anchors.count() // block))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def met(asked: DataFrame, keys: tuple[str, ...], function) -> DataFrame:
        left = asked.withColumn("block", part(blocks)).withColumn("chunk", every(chunks))
        right = rows.withColumn("chunk", part(chunks)).withColumn("block", every(blocks))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(function, PAIR)

    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    near = met(anchors, ("d", "label", "block", "chunk"), _best_positives(positives))
    near = materialize(near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives).drop("n"), "positives")
    opened = near.groupBy("anchor_id").agg(F.collect_list("score").alias("opened")).withColumnRenamed("anchor_id", "vec_id")
    far = met(anchors.join(opened, "vec_id"), ("d", "block", "chunk"), _best_negatives(negatives, low, high, scale))
    pairs = near.select("anchor_id", "score", "vec_id", "positive").union(far).withColumn("falling", -F.col("score"))
    dealt = pairs.repartition(shuffle_parts(spark), "anchor_id").sortWithinPartitions("anchor_id", "falling", "vec_id")
    return dealt.mapInArrow(stream(positives, negatives, low, high, scale), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
