"""Counts in ranges without pairs: a wavelet matrix in numpy, and points in boxes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RangeCounts:
    """Values in places 0 .. n - 1; counts those in a stretch of places that are below a bound, by bits of their ranks. Equal values share a rank, so
    few distinct values (days, months) make few levels."""

    AT_ONCE = 1 << 16  # asked at a time, so few that they stay in a cache

    def __init__(self, values: np.ndarray) -> None:
        self.ordered, ranks = np.unique(values, return_inverse=True)
        self.levels: list[tuple[int, int, np.ndarray]] = []  # bit, zeros in all, zeros before each place
        for bit in range(len(self.ordered).bit_length() - 1, -1, -1):
            ones = (ranks >> bit) & 1 == 1
            zeros = np.concatenate([[0], np.cumsum(~ones)]).astype(np.int32)
            self.levels.append((bit, int(zeros[-1]), zeros))
            ranks = np.concatenate([ranks[~ones], ranks[ones]])

    def rank(self, bound: np.ndarray, side: str = "left") -> np.ndarray:
        """Number of distinct values below the bound (`right`: or equal to it): what `below` takes."""
        return np.searchsorted(self.ordered, bound, side)

    def below(self, first: np.ndarray, end: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many of the places first .. end - 1 hold a rank below the given one."""
        found = np.zeros(len(first), np.int64)
        for begin in range(0, len(first), self.AT_ONCE):
            part = slice(begin, begin + self.AT_ONCE)
            a, b, r, n = first[part].astype(np.intp), end[part].astype(np.intp), rank[part], found[part]
            for bit, all_zeros, zeros in self.levels:
                one = (r >> bit) & 1 == 1
                za, zb = zeros[a], zeros[b]
                n += np.where(one, zb - za, 0)
                a, b = np.where(one, all_zeros + a - za, za), np.where(one, all_zeros + b - zb, zb)
        return found


def _count_boxes(left: pa.Table, right: pa.Table) -> pa.Table:
    """Boxes and points of one group -> box, number of its points."""
    col = lambda t, c: t.column(c).to_numpy()
    order = np.argsort(col(right, "x"), kind="stable")
    xs, counts = col(right, "x")[order], RangeCounts(col(right, "y")[order])
    first, end = np.searchsorted(xs, col(left, "west"), "left"), np.searchsorted(xs, col(left, "east"), "right")
    n = counts.below(first, end, counts.rank(col(left, "north"), "right")) - counts.below(first, end, counts.rank(col(left, "south"), "left"))
    return pa.table({c: left.column(c) for c in ("west", "east", "south", "north")} | {"n": pa.array(n, pa.int64())})


def points_in_boxes(points: DataFrame, boxes: DataFrame, most_points: int = 1 << 17, most_boxes: int = 1 << 17) -> DataFrame:
    """(west, east, south, north, n) of each distinct box with any of the points (longitude, latitude), borders included.

    Points are dealt to slabs of longitude of about `most_points`, a slab of many equal longitudes to parts; a box asks each part of the slabs that it touches.
    """
    known = points.where("latitude is not null and longitude is not null").select(F.col("longitude").cast("double").alias("x"), F.col("latitude").cast("double").alias("y"))
    slabs = -(-known.count() // most_points)
    cuts = sorted(set(known.approxQuantile("x", [k / slabs for k in range(1, slabs)], 0.001))) if slabs > 1 else []
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
    slab = lambda c: F.size(F.filter(bounds, lambda b: b <= c))
    dealt = known.withColumn("slab", slab(F.col("x")))
    sizes = {r["slab"]: r["count"] for r in dealt.groupBy("slab").count().collect()}
    parts = F.array(*[F.lit(-(-sizes.get(k, 0) // most_points)) for k in range(len(cuts) + 1)])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("y"), F.greatest(parts[F.col("slab")], F.lit(1))).cast("int"))
    box = ["west", "east", "south", "north"]
    asked = boxes.select(*[F.col(c).cast("double").alias(c) for c in box]).where("west <= east and south <= north").distinct()
    chunks = -(-asked.count() // most_boxes)
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64(*box), F.lit(max(1, chunks))).cast("int"))
    asked = asked.withColumn("slab", F.explode(F.sequence(slab(F.col("west")), slab(F.col("east"))))).where(parts[F.col("slab")] > 0)
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts[F.col("slab")] - 1)))
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(max(1, chunks) - 1))))
    keys = ["slab", "part", "chunk"]
    counted = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_count_boxes, "west double, east double, south double, north double, n long")
    return counted.groupBy(*box).agg(F.sum("n").alias("n")).where("n > 0")
