"""SimHash near-dedup by anchor-point covering.

A document's fingerprint has 64 bits: a bit is set if it is set in over half the XXH64 hashes (seed 42) of its word
shingles, repeats included. To find all fingerprints within `threshold` bits of each other without comparing all pairs,
the first 46 bits are seen as two words of 23 bits, and the anchors are pairs of words of the binary Golay code. That
code is perfect: every 23-bit word is within its covering radius, 3, of exactly one code word. A fingerprint has one
home anchor, and visits every anchor within the covering radius plus the threshold (where the two halves together
exceed the radius by no more than the threshold, which is all that a partner's home can be): about 61 for 2 bits.
Visitors meet those at home at each of 2^24 anchors, and the pair is kept if all 64 bits differ in few enough places.

Equal fingerprints are one fingerprint here, so a group of copies of any size is one row; a pair is looked up from its
larger fingerprint only. Links become classes by connected components over distinct fingerprints.

Defined results: null or empty text has fingerprint zero and links like any other; repeated rows share their class; a
null doc_id has its class, but no class is named after it (null if it has none but null ids); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, documents, materialize, pieces, shuffle_parts, texts_of, unused
from .components import components

#: Generator of the binary Golay code of length 23: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY, LENGTH, RADIUS = 0xAE3, 23, 3
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.float64)


def fingerprint(text: bytes, words: int = 3) -> bytes:
    """8 bytes, the highest bit first."""
    import xxhash

    found = text.translate(LOWER).split()
    if not found:
        return bytes(8)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    if len(found) <= words:
        digests = xxhash.xxh64_digest(joined, 42)
    else:
        starts = np.concatenate([[0], ends[: len(found) - words] + 1]).tolist()
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)])
    values = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    n = len(values)
    counts = np.zeros((8, 256))
    for at in range(0, n, 1 << 16):  # so that a very long text needs little besides itself
        part = values[at : at + (1 << 16)]
        counts += np.bincount((part + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    return np.packbits((counts @ _BITS > n / 2).astype(np.uint8)).tobytes()


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8 << 20):
            fps = np.frombuffer(b"".join([fingerprint(t, words) for t in texts_of(batch)]), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return documents(docs).mapInArrow(run, "doc_id long, fp long")


@cache
def _cosets(most: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Syndrome of each byte at each of three places; for each syndrome its error patterns by what their weight exceeds the radius by (0 .. most)."""
    remainder = [1]
    for _ in range(LENGTH - 1):
        r = remainder[-1] << 1
        remainder.append(r ^ GOLAY if r >> 11 else r)
    remainder = np.array(remainder)
    by_byte = np.zeros((3, 256), np.int64)
    for place in range(3):
        for bit in range(8):
            if (k := 8 * place + bit) < LENGTH:
                by_byte[place] ^= np.where((np.arange(256) >> bit) & 1, remainder[k], 0)
    patterns: list[list[list[int]]] = [[[] for _ in range(2048)] for _ in range(most + 1)]
    for weight in range(RADIUS + most + 1):
        for bits in combinations(range(LENGTH), weight):
            patterns[max(0, weight - RADIUS)][int(np.bitwise_xor.reduce(remainder[list(bits)])) if bits else 0].append(sum(1 << b for b in bits))
    return by_byte, [[np.array(p, np.int64) for p in level] for level in patterns]


def _by_anchor(half: np.ndarray, excess: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of all anchors whose distance exceeds the radius by just `excess` (0: within it)."""
    by_byte, patterns = _cosets(most)
    syndrome = by_byte[0][half & 255] ^ by_byte[1][half >> 8 & 255] ^ by_byte[2][half >> 16]
    found = patterns[excess]
    sizes = np.array([len(p) for p in found])
    flat, first = np.concatenate(found), np.cumsum(sizes) - sizes
    n = sizes[syndrome]
    row = np.repeat(np.arange(len(half)), n)
    return row, half[row] ^ flat[np.repeat(first[syndrome] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def anchors(fps: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of all pairs of code words that each fingerprint reaches when both halves exceed the radius by `excess` bits together at most."""
    high, low = fps >> 41 & (1 << 23) - 1, fps >> 18 & (1 << 23) - 1
    rows, found = [], []
    for one in range(excess + 1):
        r1, a1 = _by_anchor(high, one, excess)
        for other in range(excess + 1 - one):
            r2, a2 = _by_anchor(low, other, excess)
            n2 = np.bincount(r2, minlength=len(fps))
            # every anchor of the first half beside every anchor of the second
            again = np.repeat(np.arange(len(r1)), n2[r1])
            first2 = (np.cumsum(n2) - n2)[r1]
            inner = np.arange(len(again)) - np.repeat(np.cumsum(n2[r1]) - n2[r1], n2[r1])
            rows.append(r1[again])
            found.append(a1[again] << 23 | a2[np.repeat(first2, n2[r1]) + inner])
    return np.concatenate(rows), np.concatenate(found)


def _place(fps: DataFrame, excess: int) -> DataFrame:
    """(anchor, fp) of each fingerprint for each of its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy()
            for at in range(0, len(values), 4096):
                part = values[at : at + 4096]
                rows, found = anchors(part, excess)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(part[rows])], ["anchor", "fp"])

    return fps.mapInArrow(run, "anchor long, fp long")


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """All pairs u > v of distinct fingerprints (column fp, no repeats) that differ in at most `threshold` bits."""
    home = _place(fps, 0).select("anchor", F.col("fp").alias("v"))
    visits = _place(fps, threshold).select("anchor", F.col("fp").alias("u"))
    near = visits.join(home.hint("shuffle_hash"), "anchor").where((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold))
    return near.select("u", "v")


def near_duplicates(docs: DataFrame, words: int = 3, threshold: int = 2) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links) and copies (rows in its class)."""
    rows = materialize(fingerprints(docs, words), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("members")), "distinct")
    # few fingerprints give many anchors, so they are dealt out first, in a number that isn't made smaller again
    roots = components(links(distinct.select("fp").repartition(shuffle_parts(docs.sparkSession), "fp"), threshold))
    joined = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", "members", F.coalesce("root", "fp").alias("root"))
    classes = joined.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("members").alias("copies"))
    named = joined.join(classes, "root").select("fp", "component_id", "copies")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")


# Similarity search on wider fingerprints, for groups of near copies whose shingles differ in up to a fifth.

#: Long numbers of a word fingerprint (each is one table of anchors) and of a shingle fingerprint.
TABLES, WIDE = 8, 6


def _majority(digests: list[bytes], size: int) -> bytes:
    values = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, size)
    counts = np.zeros((size, 256))
    for at in range(0, len(values), 1 << 14):
        part = values[at : at + (1 << 14)]
        counts += np.bincount((part + np.arange(0, 256 * size, 256)).ravel(), minlength=256 * size).reshape(size, 256)
    return np.packbits((counts @ _BITS > len(values) / 2).astype(np.uint8)).tobytes()


def wide_fingerprint(text: bytes, words: int = 5) -> tuple[bytes, bytes]:
    """(of the distinct words, TABLES longs; of the word shingles, repeats included, WIDE longs). Few words give one shingle."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    found = text.translate(LOWER).split()
    if not found:
        return bytes(8 * TABLES), bytes(8 * WIDE)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    if len(found) <= words:
        shingles = [joined]
    else:
        starts = np.concatenate([[0], ends[: len(found) - words] + 1]).tolist()
        shingles = [joined[a:b] for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    return _majority([digest(w, s) for w in {w.strip(b".,;:!?") for w in found} for s in range(1, 1 + TABLES // 2)], 8 * TABLES), _majority([digest(x, s) for x in shingles for s in range(11, 11 + WIDE // 2)], 8 * WIDE)


def wide_fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text, null of a null one), of_words and of_shingles (binary) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8 << 20):
            one, other = zip(*(wide_fingerprint(t, words) for t in texts_of(batch)), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(one, pa.binary()), pa.array(other, pa.binary())], ["doc_id", "text_hash", "of_words", "of_shingles"])

    rows = documents(docs).withColumn("text_hash", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    return rows.mapInArrow(run, "doc_id long, text_hash long, of_words binary, of_shingles binary")


def _forest(bits: np.ndarray, most: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links of the rows of `bits` (n x WIDE unsigned longs) that differ in at most `most` bits: as few as n - 1, whatever the number of pairs.
    A row is linked to the row of each class that differs least. known: the class that each row is already in; only links between classes are given."""
    n = len(bits)
    class_of = np.arange(n) if known is None else np.unique(known, return_inverse=True)[1]
    out = []
    for i in range(1, n):
        apart = np.bitwise_count(bits[:i] ^ bits[i]).sum(1)
        near = np.flatnonzero((apart <= most) & (class_of[:i] != class_of[i]))
        near = near[np.argsort(apart[near], kind="stable")]
        _, one = np.unique(class_of[near], return_index=True)
        for j in near[one].tolist():
            out.append((i, j))
            class_of[class_of == class_of[j]] = class_of[i]
    return out


def similar_links(distinct: DataFrame, most: int, block: int = 4096, pivots: int = 64) -> DataFrame:
    """Links (u, v) between rows (number, of_words, of_shingles) that share an anchor of one of the tables and whose shingle
    fingerprints differ in at most `most` bits. Both go to all anchors within the covering radius plus 1, so two rows
    within 2 of a table's 46 bits surely meet; an anchor gives a spanning set of its links.

    An anchor of more than `block` rows goes through memory in blocks, each compared within itself and with the anchor's
    first `pivots` rows. If that leaves its rows in more than one component, all pairs of its blocks meet, in groups of two blocks, and
    only rows of different components are compared. So no task holds more than two blocks of an anchor, and no link between components is lost."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                longs = np.frombuffer(b"".join(part.column("of_words").to_pylist()), ">i8").astype(np.int64).reshape(-1, TABLES)
                for t in range(TABLES):
                    rows, found = anchors(longs[:, t], 1)
                    pick = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(found | t << 46), part.column("number").take(pick), part.column("of_shingles").take(pick)], ["anchor", "number", "of_shingles"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, prints = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WIDE), np.uint64)

        hot, kept = None, None  # the anchor of which blocks are gone, and its first rows

        def pairs(keys, numbers, prints) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, len(keys)))
            two = starts[sizes == 2]
            two = two[np.bitwise_count(prints[two] ^ prints[two + 1]).sum(1) <= most]
            u, v = [numbers[two]], [numbers[two + 1]]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if found := _forest(prints[s : s + n], most):
                    i, j = np.array(found).T
                    u.append(numbers[s + i])
                    v.append(numbers[s + j])
            u, v = np.concatenate(u), np.concatenate(v)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.zeros(len(u), bool))], ["u", "v", "hot"])

        for batch in batches:
            for a in range(0, batch.num_rows, block):
                part = batch.slice(a, block)
                own = np.frombuffer(b"".join(part.column("of_shingles").to_pylist()), np.uint64).reshape(-1, WIDE)
                keys, numbers, prints = np.concatenate([keys, part.column("anchor").to_numpy()]), np.concatenate([numbers, part.column("number").to_numpy()]), np.concatenate([prints, own])
                done = int(np.searchsorted(keys, keys[-1]))  # the last anchor may go on
                if done:
                    yield from pairs(keys[:done], numbers[:done], prints[:done])
                    keys, numbers, prints = keys[done:], numbers[done:], prints[done:]
                if len(keys) > block + pivots:
                    yield from pairs(keys, numbers, prints)
                    if keys[0] != hot:
                        hot, kept = keys[0], (keys[:pivots], numbers[:pivots], prints[:pivots])
                        yield pa.RecordBatch.from_arrays([pa.array([hot]), pa.array([hot]), pa.array([True])], ["u", "v", "hot"])
                    keys, numbers, prints = kept
        if len(keys):
            yield from pairs(keys, numbers, prints)

    def meet_again(group: pa.Table) -> pa.Table:
        prints = np.frombuffer(b"".join(group.column("of_shingles").to_pylist()), np.uint64).reshape(-1, WIDE)
        numbers, known = group.column("number").to_numpy(), group.column("root").to_numpy()
        i, j = np.array(_forest(prints, most, known) or np.zeros((0, 2)), np.int64).T
        return pa.table({"u": numbers[i], "v": numbers[j]})

    placed = distinct.repartition(shuffle_parts(distinct.sparkSession), "number").mapInArrow(place, "anchor long, number long, of_shingles binary")
    met = materialize(placed.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(meet, "u long, v long, hot boolean"), "wide-links")
    links, hot = met.where("not hot").select("u", "v").distinct(), met.where("hot").select(F.col("u").alias("anchor")).distinct()
    if hot.isEmpty():
        return links
    roots = components(links)
    known = distinct.join(roots, distinct.number == roots.node, "left").select("number", F.coalesce("root", "number").alias("root"))
    held = materialize(placed.join(hot, "anchor").join(known, "number").select("anchor", "number", "of_shingles", "root"), "wide-hot")
    sizes = held.groupBy("anchor").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), (F.min("root") < F.max("root")).alias("open")).where("open")
    dealt = held.join(sizes, "anchor").withColumn("own", F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = dealt.select("anchor", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "number", "of_shingles", "root")
    return links.union(groups.groupBy("anchor", "one", "two").applyInArrow(meet_again, "u long, v long")).distinct()


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Distinct hashes of the shingles, as signed longs: those that wide_fingerprint takes."""
    import xxhash

    found = text.translate(LOWER).split()
    if not found:
        return np.zeros(0, np.int64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh3_64_intdigest(joined)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(found) - words] + 1]).tolist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    return np.unique(hashes).view(np.int64)


def alike(links: DataFrame, rows: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The links (u, v) whose documents' sets of shingles have a Jaccard similarity of `similarity` or more. rows: doc_id, text_hash, number. Only
    documents that a link names are read again, one for each number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8 << 20):
            sets = [shingle_set(t, words) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array(sets, pa.list_(pa.int64()))], ["number", "shingles"])

    named = links.select(F.col("u").alias("number")).union(links.select(F.col("v").alias("number"))).distinct()
    first = rows.join(named, "number").groupBy("number").agg(F.min(F.struct("text_hash", "doc_id")).alias("r")).select("number", F.col("r.text_hash").alias("h"), F.col("r.doc_id").alias("d"))
    texts = documents(docs).withColumn("text_hash", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    texts = texts.join(first, texts.text_hash.eqNullSafe(first.h) & texts.doc_id.eqNullSafe(first.d)).select("number", "text")
    sets = materialize(texts.mapInArrow(run, "number long, shingles array<long>").dropDuplicates(["number"]), "wide-sets")
    both = links.join(sets.select(F.col("number").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("number").alias("v"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common + 1e-9 >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, slack: float = 2.5) -> DataFrame:
    """One row for each document: doc_id, text_hash (XXH64 of the text) and root (the number of its group): documents whose word shingles are alike
    by `similarity` or more. Candidates are fingerprints within the angle that this means for two sets, J = `similarity`: cosine 2 J / (1 + J); the bits in which
    two fingerprints differ scatter about that angle, and `slack` standard deviations more still make a candidate. The shingle sets of candidates
    are compared exactly. Documents of equal fingerprints are one group without that."""
    bits = 64 * WIDE
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    most = int(bits * share + slack * np.sqrt(bits * share * (1 - share)))
    rows = materialize(wide_fingerprints(docs, words), "wide")
    # documents with equal fingerprints are one, numbered by their hash
    rows = rows.withColumn("number", F.xxhash64("of_words", "of_shingles"))
    distinct = materialize(rows.groupBy("number").agg(F.first("of_words").alias("of_words"), F.first("of_shingles").alias("of_shingles")), "wide-distinct")
    candidates = materialize(similar_links(distinct, most), "wide-candidates")
    roots = components(alike(candidates, rows.select("doc_id", "text_hash", "number"), docs, words, similarity))
    return rows.join(roots, rows.number == roots.node, "left").select("doc_id", "text_hash", F.coalesce("root", "number").alias("root"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, slack: float = 2.5) -> DataFrame:
    """The rows of docs, all columns, one of each group: that of the smallest doc_id (null last), of repeated ids that of the smallest text hash (a null text first).
    Rows are told apart by doc_id and text; of rows that repeat both one stays, that of the smallest hash of all its columns."""
    named = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    best = similar_groups(named, words, similarity, slack).groupBy("root").agg(F.min(order).alias("best")).select("best.doc_id", "best.text_hash")
    hashed, rank = unused(docs, "text_hash"), unused(docs, "rank")
    own = named.withColumn(hashed, F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    best = best.select(F.col("doc_id").alias(unused(docs, "best_id")), F.col("text_hash").alias(unused(docs, "best_hash")))
    kept = own.join(best, own.doc_id.eqNullSafe(best[best.columns[0]]) & own[hashed].eqNullSafe(best[best.columns[1]]), "left_semi")
    simple = [f.name for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)]
    first = Window.partitionBy("doc_id", hashed).orderBy(F.xxhash64(*simple))
    return kept.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).select(*docs.columns)
