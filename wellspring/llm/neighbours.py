"""Approximate nearest neighbours: hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample (`sample` vectors, those with the smallest hash of vec_id); its size is bounded
by that sample, so it can be broadcast. Every row is put into a leaf. A query walks the tree with a priority queue:
the most promising branch first, by inner product of the query and the branch's centre plus a bound on what its
members can add. How many leaves each query visits is calibrated: visits widen until the recall of a sample of
queries against brute force reaches `recall`. Queries meet rows by leaf in a grouped join; a leaf's rows are salted into chunks of about `chunk` rows, so that a hot
leaf is split, and its queries into blocks of about `query_block`; each block meets each chunk, which gives each query its best `k` only.

Nearness is the inner product in double precision; scores are computed on the original vectors, for the rows that are kept once more by a sum of fixed order,
so that equal vectors have equal scores. Vectors that are null, zero, or hold null or non-finite components take no part. The tree is for the
commonest length; queries of another length meet all rows of that length, as one leaf for each length.

Defined results: rows with a null id take no part; of repeated ids each row is a candidate (but none for a query of
the same id), and the query is the smallest of its vectors; ties go to the smaller vec_id; fewer candidates than k give fewer rows; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drawn, materialize, shuffle_parts


def usable(vectors: DataFrame, dims: int | None = None) -> DataFrame:
    """vec_id and embedding (array<double>) of the rows that take part."""
    v = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    v = v.where("vec_id is not null and embedding is not null and size(embedding) > 0").where(F.coalesce(good, F.lit(False)))
    return v if dims is None else v.where(F.size("embedding") == dims)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


class KMeansTree:
    """Inner nodes hold the centres of their branches; leaves are numbered."""

    def __init__(self, x: np.ndarray, branching: int = 8, leaf_size: int = 64, rounds: int = 8, seed: int = 0) -> None:
        self.rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []  # (centres, radii, children); a child below zero is leaf -1 - child
        self.leaves = 0
        self.root = self._grow(x, branching, leaf_size, rounds)

    def _grow(self, x: np.ndarray, branching: int, leaf_size: int, rounds: int) -> int:
        if len(x) <= leaf_size or (x == x[0]).all():
            self.leaves += 1
            return -self.leaves
        centres = x[self.rng.choice(len(x), min(branching, len(x)), replace=False)]
        for _ in range(rounds):
            near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
            used = np.unique(near)
            centres = np.array([x[near == c].mean(0) for c in used])
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        if len(np.unique(near)) < 2:
            self.leaves += 1
            return -self.leaves
        number = len(self.nodes)
        self.nodes.append(())
        radii = np.array([np.sqrt(((x[near == c] - centres[c]) ** 2).sum(1)).mean() if (near == c).any() else 0.0 for c in range(len(centres))])
        children = [self._grow(x[near == c], branching, leaf_size, rounds) if (near == c).any() else self._empty() for c in range(len(centres))]
        self.nodes[number] = (centres, radii, children)
        return number

    def _empty(self) -> int:
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: at each node the nearest centre."""
        out = np.zeros(len(x), np.int32)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                centres, _, children = self.nodes[node]
                near = ((centres**2).sum(1) - 2 * x[rows] @ centres.T).argmin(1)
                stack += [(child, rows[near == c]) for c, child in enumerate(children)]
        return out

    def best_leaves(self, q: np.ndarray, most: int, spread: float = 2.0) -> list[int]:
        """Leaves in best-bin-first order, `most` at most."""
        size = float(np.sqrt(q @ q))
        queue, found = [(0.0, self.root)], []
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            if node < 0:
                found.append(-1 - node)
                continue
            centres, radii, children = self.nodes[node]
            hopes = centres @ q + spread * size * radii / np.sqrt(len(q))
            for hope, child in zip(hopes.tolist(), children, strict=True):
                heapq.heappush(queue, (-hope, child))
        return found


def calibrate(tree: KMeansTree, x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, recall: float) -> int:
    """The number of leaf visits at which the sample's recall of its own k best reaches `recall`."""
    if not len(queries) or tree.leaves <= 1:
        return max(1, tree.leaves)
    leaf = tree.leaf_of(x)
    place = []
    for q, own in zip(queries, query_ids, strict=True):
        scores = np.where(ids == own, -np.inf, x @ q)
        best = np.argsort(-scores, kind="stable")[:k]
        best = best[scores[best] > -np.inf]
        order = np.full(tree.leaves, tree.leaves)
        visited = tree.best_leaves(q, tree.leaves)
        order[visited] = np.arange(len(visited))
        place.append(order[leaf[best]])
    place = np.concatenate(place) if place else np.zeros(0, int)
    if not len(place):
        return max(1, tree.leaves)
    visits = 1
    while visits < tree.leaves and (place < visits).mean() < recall:
        visits += max(1, visits // 8)
    return min(visits, tree.leaves)


def search(vectors: DataFrame, is_query, k: int = 20, recall: float = 0.97, sample: int = 20000, calibration: int = 200, leaf_size: int = 64, chunk: int = 4096, query_block: int = 32768) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows found for each row where the column is_query holds."""
    spark = vectors.sparkSession
    sized = usable(vectors).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sized is None:
        return spark.createDataFrame([], schema)
    rows, other = usable(vectors, sized.d), usable(vectors).where(F.size("embedding") != sized.d)
    total = sized["count"]
    known = drawn(rows, sample, "vec_id")
    x, ids = np.array([r.embedding for r in known]), np.array([r.vec_id for r in known])
    asked = drawn(rows.where(is_query), calibration, "vec_id")
    tree = KMeansTree(x, leaf_size=leaf_size)
    # the sample's k best stand for k * total / sample of all rows' best, so the same share of them is asked for
    near = max(1, round(k * len(x) / total)) if total else k
    visits = calibrate(tree, x, ids, np.array([r.embedding for r in asked]), np.array([r.vec_id for r in asked]), near, recall)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.leaf_of(_matrix(batch.column("embedding")))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", "vec_id", "embedding"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [shared.value.best_leaves(q, visits) for q in _matrix(batch.column("embedding"))]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), *batch.columns], ["leaves", "vec_id", "embedding"])

    def nearest(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        found: list[list[np.ndarray]] = []
        if left.num_rows and right.num_rows:
            q, v = (_matrix(t.column("embedding").combine_chunks()) for t in (left, right))
            q_ids, v_ids = (t.column("vec_id").to_numpy() for t in (left, right))
            order = np.argsort(v_ids, kind="stable")
            v, v_ids = v[order], v_ids[order]
            # equal vectors are multiplied once, so they tie whatever their places in the block
            seen: dict[bytes, int] = {}
            of_row = np.array([seen.setdefault(r.tobytes(), len(seen)) for r in v])
            single = v[np.unique(of_row, return_index=True)[1]]
            for at in range(0, len(q), 256):
                own = q[at : at + 256]
                scores = np.where(v_ids == q_ids[at : at + 256, None], -np.inf, (own @ single.T)[:, of_row])
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                row, col = np.nonzero(np.take_along_axis(scores, best, 1) > -np.inf)
                near = best[row, col]
                found.append([q_ids[at : at + 256][row], v_ids[near], np.einsum("ij,ij->i", own[row], v[near])])
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(names, columns, strict=True)))

    leaf_schema = "leaf int, vec_id long, embedding array<double>"
    by_length = (-F.size("embedding")).alias("leaf")  # below all leaves' numbers
    placed = materialize(rows.mapInArrow(place, leaf_schema).unionByName(other.select(by_length, "vec_id", "embedding")), "leaves")
    queries = usable(vectors).where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # by another hash than the groups have, or the repartition would be left out
    queries = queries.repartition(shuffle_parts(spark), F.xxhash64("vec_id"))
    walked = queries.where(F.size("embedding") == sized.d).mapInArrow(visit, "leaves array<int>, vec_id long, embedding array<double>")
    others = queries.where(F.size("embedding") != sized.d).select(F.array(by_length).alias("leaves"), "vec_id", "embedding")
    visited = materialize(walked.unionByName(others).withColumn("row", F.monotonically_increasing_id()), "visits")
    chunks = placed.groupBy("leaf").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    blocks = visited.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks"))
    # one row for each leaf, whose number is bounded by the sample, and for each other length
    parts = F.broadcast(chunks.join(blocks, "leaf"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    salted = placed.join(parts, "leaf").select("leaf", some("vec_id", "chunks").alias("salt"), every("blocks").alias("block"), "vec_id", "embedding")
    asked = visited.select(F.explode("leaves").alias("leaf"), "row", "vec_id", "embedding").join(parts, "leaf")
    asked = asked.select("leaf", every("chunks").alias("salt"), some("row", "blocks").alias("block"), "vec_id", "embedding")
    keys = ("leaf", "salt", "block")
    pairs = asked.groupBy(*keys).cogroup(salted.groupBy(*keys)).applyInArrow(nearest, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
