"""Sharding: minimax contiguous partition of ordered atomic groups.

Groups are equal texts, ordered by their smallest doc_id; a group is never cut. The smallest capacity under which a
greedy walk needs at most `shards` shards is found by binary search, and the shards are cut there.

The walk needs only "the largest group boundary at or before x" for a few x. The driver holds a directory of at most
about 2 * `directory` boundaries: first one boundary for each equal slice of the bytes, which bounds the walk from
below and from above; then only the slices in which the two walks can differ are looked up more finely, until every
boundary that matters is known and the answer is exact. Each round is one aggregation of (slice, last boundary) rows.

Defined results: null text has size 8 and is a group of its own with all other null texts; its text_crc32 is that of
no bytes, 0; repeated rows are each placed; a null doc_id sorts first; an empty table gives no rows; with fewer groups
than shards the last shards stay empty; other columns are ignored.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize, scan_offsets


def greedy(capacity: int, shards: int, total: int, floor) -> list[int] | None:
    """Ends of the shards when each takes all groups that fit; None if `shards` don't suffice. floor(x): the largest boundary <= x."""
    ends, at = [], 0
    for _ in range(shards):
        if at >= total:
            break
        nxt = floor(min(at + capacity, total))
        if nxt <= at:
            return None
        ends.append(nxt)
        at = nxt
    return ends if at >= total else None


def smallest_capacity(shards: int, total: int, largest: int, floor) -> int:
    """Binary search between what the mean and the largest group ask for and one shard for all; floor must be exact or a bound to one side."""
    low = max(-(-total // shards), largest, 1)
    high = max(low, total)
    while low < high:
        mid = (low + high) // 2
        if greedy(mid, shards, total, floor) is None:
            low = mid + 1
        else:
            high = mid
    return low


class Directory:
    """Known boundaries, and the open stretches between two of them in which more may lie."""

    def __init__(self, total: int) -> None:
        self.known, self.open = [0, total], [(0, total)] if total else []

    def exact_floor(self, x: int) -> int:
        return self.known[bisect.bisect_right(self.known, x) - 1]

    def hopeful_floor(self, x: int) -> int:
        """As if there were a boundary at every byte of an open stretch."""
        k = bisect.bisect_right(self.open, (x, float("inf"))) - 1
        return x if k >= 0 and self.open[k][0] <= x < self.open[k][1] else self.exact_floor(x)


def cut(bounds: DataFrame, shards: int, total: int, largest: int, directory: int = 65536) -> list[int]:
    """Ends of the shards by the smallest capacity. bounds: a table with the column `ending` (long), the end of each group in the order."""
    if not total:
        return []
    here = Directory(total)
    grid = max(1, -(-total // directory))
    cell = F.floor((F.col("ending") - 1) / grid).alias("cell")
    need, width = here.open, grid
    inner = bounds.select("ending", cell, F.lit(0).alias("a"))
    while need:
        slices = inner.groupBy("a", F.floor((F.col("ending") - F.col("a") - 1) / width).alias("i")).agg(F.min("ending").alias("first"), F.max("ending").alias("last"), F.count("*").alias("n"))
        rows = slices.select("first", "last", "n").collect()
        here.known = sorted({*here.known, *(r.first for r in rows), *(r.last for r in rows)})
        here.open = sorted({*here.open} - {*need} | {(r.first, r.last) for r in rows if r.n > 2})
        sure = smallest_capacity(shards, total, largest, here.exact_floor)
        least = smallest_capacity(shards, total, largest, here.hopeful_floor)
        # the k-th end of the true answer lies between the walk that hopes least and the one that hopes most
        low, high = _walk(least, shards, total, here.exact_floor), _walk(sure, shards, total, here.hopeful_floor)
        need = [(a, b) for a, b in here.open if any(a <= y and b >= x for x, y in zip(low, high, strict=True))]
        width = max(1, -(-sum(b - a for a, b in need) // directory))
        # an open stretch lies in one cell of the first grid, which makes the lookup a hash join
        table = bounds.sparkSession.createDataFrame([(a // grid, a, b) for a, b in need], "cell long, a long, b long")
        inner = bounds.select("ending", cell).join(F.broadcast(table), "cell").where("ending > a and ending < b")
    return greedy(sure, shards, total, here.exact_floor) or []


def _walk(capacity: int, shards: int, total: int, floor) -> list[int]:
    ends, at = [], 0
    for _ in range(shards):
        at = max(at, floor(min(at + capacity, total)))
        ends.append(at)
    return ends


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law ("bytes"), shard, slot (its place in the shard, gapless from 0),
    grown_shard (null under this law), group_first (smallest doc_id of its group) and capacity (bytes)."""
    rows = documents(docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
        F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")).alias("key"),
    )
    rows = materialize(rows, "shard-rows")
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("group_first"), F.sum("size").alias("bytes"), F.count("*").alias("members"))
    groups = groups.repartitionByRange("group_first", "key").sortWithinPartitions("group_first", "key").withColumn("part", F.spark_partition_id())
    groups = materialize(groups, "shard-groups")
    own = Window.partitionBy("part").orderBy("group_first", "key").rowsBetween(Window.unboundedPreceding, 0)
    sums = groups.select("*", F.sum("bytes").over(own).alias("upto"), (F.sum("members").over(own) - F.col("members")).alias("rows_before"))
    places = sums.join(F.broadcast(scan_offsets(groups, "part", "bytes")), "part").withColumn("ending", F.col("base") + F.col("upto")).drop("base")
    rank = scan_offsets(groups, "part", "members")
    places = materialize(places.join(F.broadcast(rank), "part").withColumn("first_row", F.col("base") + F.col("rows_before")).select("key", "group_first", "bytes", "members", "ending", "first_row"), "shard-places")
    total, largest = places.agg(F.max("ending"), F.max("bytes")).first()
    ends = cut(places.select("ending"), shards, total or 0, largest or 0)
    capacity = max((b - a for a, b in zip([0, *ends], ends, strict=False)), default=0)
    number = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]) if ends else F.array().cast("array<long>"), lambda e: e < F.col("ending")))
    places = places.withColumn("shard", number.cast("int"))
    starts = places.groupBy("shard").agg(F.min("first_row").alias("shard_first"))
    places = places.join(F.broadcast(starts), "shard").select("key", "group_first", "shard", (F.col("first_row") - F.col("shard_first")).alias("group_slot"), "members")
    return _slots(rows, places).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_first", F.lit(capacity).cast("long").alias("capacity")
    )


def _slots(rows: DataFrame, places: DataFrame) -> DataFrame:
    """slot = the group's first slot + the row's place in its group. A group may hold a third of all rows, so that
    place is counted in two steps: rows are range-parted by (key, doc_id), then parts of one group are added up."""
    joined = rows.join(places, "key")
    single = joined.where("members = 1").select("doc_id", "size", "text_crc32", "shard", F.col("group_slot").alias("slot"), "group_first")
    many = joined.where("members > 1").repartitionByRange("key", "doc_id", "size").withColumn("part", F.spark_partition_id())
    many = materialize(many, "shard-copies")
    counts = many.groupBy("key", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("key", "part", before.alias("earlier"))
    local = Window.partitionBy("key", "part").orderBy("doc_id")
    many = many.withColumn("k", F.row_number().over(local) - 1).join(counts, ["key", "part"])
    return single.unionByName(many.select("doc_id", "size", "text_crc32", "shard", (F.col("group_slot") + F.col("earlier") + F.col("k")).alias("slot"), "group_first"))
