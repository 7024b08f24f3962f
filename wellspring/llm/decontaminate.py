"""Benchmark decontamination by greedy string tiling.

Texts are words (letters lower-cased, digits, and all other characters outside ASCII). Every run of `least` words of a document is
looked up, by its Karp-Rabin hash, among the runs of the benchmark items: shared seeds. Items whose words the seeds
could cover to `threshold` are tiled: the longest common unmarked run of item and document is found by hashes of
running windows, checked word by word, marked on both sides, and so on down to `least` words. The tiles' share of the
item's words is its coverage, whatever the order in which the passages stand; `threshold` and more is contamination.

The benchmark is the query set: it is taken in blocks of at most `block_words` words, each broadcast (that is its size
bound) and held against all documents in one pass; nothing else is shuffled or collected.

Defined results: null or empty texts and items match nothing; items shorter than `least` words must occur whole; repeated rows are each
reported; a null id is reported as null; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, pieces, texts_of
from .licenses import words_of as _ascii_words

TILES = "doc_id long, item_id long, coverage double, matched_words long, item_words long, longest long, tiles array<struct<item_start:long,doc_start:long,length:long>>"
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(text: bytes) -> list[bytes]:
    return _ascii_words(text if text.isascii() else text.decode("utf-8", "replace").lower().encode())


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Karp-Rabin hashes (modulo 2^64) of the windows of one sequence of word numbers; numbers below zero match nothing."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * _powers(_BASE, n), dtype=np.uint64)])
        self.back = _powers(_INVERSE, n + 1)
        self.unknown = np.concatenate([[0], np.cumsum(words < 0)])

    def windows(self, size: int, marked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows of `size` words without unknown or marked words."""
        n = len(self.sums) - 1 - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        free = self.unknown[size:] == self.unknown[:-size]
        if marked is not None:
            m = np.concatenate([[0], np.cumsum(marked)])
            free &= m[size:] == m[:-size]
        starts = np.flatnonzero(free)
        return starts, (self.sums[starts + size] - self.sums[starts]) * self.back[starts]


def tile(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in text, length), longest first, none overlapping another on either side."""
    a, b = Hashes(item), Hashes(text)
    marked_a, marked_b = np.zeros(len(item), bool), np.zeros(len(text), bool)
    out: list[tuple[int, int, int]] = []
    most = min(len(item), len(text))

    def common(size: int):
        starts_a, ha = a.windows(size, marked_a)
        starts_b, hb = b.windows(size, marked_b)
        return (starts_a, ha, starts_b, hb, np.isin(hb, ha)) if len(ha) and len(hb) else None

    while most >= least:
        low, high, found = least - 1, most, None
        while low < high:  # a common run of some length has common runs of all smaller lengths
            mid = (low + high + 1) // 2
            if (got := common(mid)) is not None and got[4].any():
                low, found = mid, got
            else:
                high = mid - 1
        if found is None:
            break
        starts_a, ha, starts_b, hb, hit = found
        places = defaultdict(list)
        for s, h in zip(starts_a.tolist(), ha.tolist(), strict=True):
            places[h].append(s)
        before = len(out)
        for s, h in zip(starts_b[hit].tolist(), hb[hit].tolist(), strict=True):
            if marked_b[s : s + low].any():
                continue
            for p in places[h]:
                if not marked_a[p : p + low].any() and (item[p : p + low] == text[s : s + low]).all():
                    marked_a[p : p + low] = marked_b[s : s + low] = True
                    out.append((p, s, low))
                    break
        most = low if len(out) > before else low - 1
    return out


class BenchmarkIndex:
    """A block of benchmark items: word numbers, and the hashes of their seeds."""

    def __init__(self, items: list[tuple], least: int, threshold: float) -> None:
        self.least, self.threshold = least, threshold
        self.numbers: dict[bytes, int] = {}
        self.ids, self.items = [], []
        seeds = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            item = np.fromiter((self.numbers.setdefault(w, len(self.numbers)) for w in words), np.int64, len(words))
            size = min(least, len(item))
            starts, hashes = Hashes(item).windows(size)
            seeds[size] += [(h, len(self.items), s) for s, h in zip(starts.tolist(), hashes.tolist(), strict=True)]
            self.ids.append(item_id)
            self.items.append(item)
        self.seeds = {}
        for size, rows in seeds.items():
            rows.sort()
            self.seeds[size] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))

    def find(self, text: bytes) -> list[tuple]:
        """(item id, coverage, matched words, item words, longest tile, tiles) of each item that the text holds to the threshold."""
        words = words_of(text)
        numbers = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        if not (numbers >= 0).any():
            return []
        hashes, out = Hashes(numbers), []
        for size, (known, owners, places) in self.seeds.items():
            starts, own = hashes.windows(size)
            low, high = np.searchsorted(known, own, "left"), np.searchsorted(known, own, "right")
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            found: dict[int, tuple[set, set]] = {}
            for s, i, j in zip(starts[hit].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                for k in range(i, j):
                    in_item, in_text = found.setdefault(int(owners[k]), (set(), set()))
                    in_item.add(int(places[k]))
                    in_text.add(s)
            for k, (in_item, in_text) in sorted(found.items()):
                item = self.items[k]
                reach = len({p + d for p in in_item for d in range(size)})
                if reach < self.threshold * len(item):
                    continue
                # only stretches of seeds can hold tiles; an unknown word stands between them
                at = np.unique((np.array(sorted(in_text))[:, None] + np.arange(size)).ravel())
                gaps = np.flatnonzero(np.diff(at) > 1) + 1
                places_in_text = np.insert(at, gaps, -1)
                part = np.insert(numbers[at], gaps, -1)
                tiles = [(p, int(places_in_text[s]), n) for p, s, n in tile(item, part, size)]
                matched = sum(n for _, _, n in tiles)
                if tiles and matched >= self.threshold * len(item):
                    out.append((self.ids[k], matched / len(item), matched, len(item), max(n for _, _, n in tiles), tiles))
        return out


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size; a single longer item is a block of its own."""
    rows = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("text is not null").orderBy("item_id", "text")
    block, words = [], 0
    for r in rows.toLocalIterator():
        text = r.text.encode()
        n = len(words_of(text))
        if block and words + n > block_words:
            yield block
            block, words = [], 0
        block.append((r.item_id, text))
        words += n
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = 4, threshold: float = 0.6, block_words: int = 500_000) -> DataFrame:
    """One row for each document and benchmark item that it holds to the threshold."""
    spark, docs = docs.sparkSession, documents(docs)
    parts = []
    for block in _blocks(benchmark, block_words):
        shared = spark.sparkContext.broadcast(BenchmarkIndex(block, least, threshold))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("item_start", pa.int64()), ("doc_start", pa.int64()), ("length", pa.int64())]))
            for batch in pieces(batches, 8 << 20):
                rows = [(i, *r) for i, t in enumerate(texts_of(batch)) for r in shared.value.find(t)]
                row, item, coverage, matched, size, longest, tiles = zip(*rows, strict=True) if rows else ([],) * 7
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(coverage, pa.float64()), *(pa.array(x, pa.int64()) for x in (matched, size, longest)), pa.array([[dict(zip(("item_start", "doc_start", "length"), x, strict=True)) for x in t] for t in tiles], kind)],
                    ["doc_id", "item_id", "coverage", "matched_words", "item_words", "longest", "tiles"],
                )

        parts.append(docs.mapInArrow(run, TILES))
    out = spark.createDataFrame([], TILES) if not parts else parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: int = 4, threshold: float = 0.6, block_words: int = 500_000) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item to the threshold."""
    spark, out = docs.sparkSession, docs
    for block in _blocks(benchmark, block_words):
        shared = spark.sparkContext.broadcast(BenchmarkIndex(block, least, threshold))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, 8 << 20):
                yield batch.filter(pa.array([not shared.value.find(t) for t in texts_of(batch)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def summary(leaks: DataFrame) -> DataFrame:
    """The pairs without their tiles, and how many tiles there were."""
    return leaks.select("doc_id", "item_id", "coverage", "matched_words", "item_words", "longest", F.size("tiles").cast("long").alias("n_tiles"))
