"""Exact dedup over an extendible-hash index on shared files.

1. Local pass: each task normalises its texts, compares them byte for byte with those it has met lately (a generation of
   bounded bytes), and writes a row for each document; the first row of each distinct text, its representative, also
   carries the text, its 64-bit hash, and count and smallest doc_id of the rows behind it. Copies that one text has by the
   million leave a row of text for each task and generation only.
2. Directory: starts as one bucket over all hashes; rounds count what hangs under each further bit of overfull buckets, and
   these are split and the directory doubled until each bucket fits `capacity` or holds one hash only. Buckets are ranges
   of hashes; directory entries that point to one bucket are kept once, as its start.
3. Owner tasks own buckets: representatives come sorted by hash, so a task streams through its buckets and holds the chain
   of one hash at a time. A representative joins the place of the chain whose bytes are equal, or a new place at its end.
   The index (bucket, hash, place in the chain, representative, group) is written to the shared folder.
4. Each document takes its group from the index by its representative's number; no key there has more rows than a task read.

Defined results: a null text is an empty one; null doc_ids come after all others; of rows that repeat doc_id and text one is
kept; an empty table gives no rows; other columns are ignored, whatever their names. Whole texts are hashed and compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, pieces, shuffle_parts, texts_of

#: Tab, line feed, vertical tab, form feed and carriage return become spaces.
SPACED = bytes(32 if 9 <= b <= 13 else b for b in range(256))
LOCAL = "doc_id long, row long, rep long, hash long, bytes long, rows long, first_doc long, first_row long, sha256 binary, text binary"
CHAINED = "rep long, bucket int, hash long, place int, keep_id long, keep_row long, group_size long, sha256 binary"


def normalise(text: bytes) -> bytes:
    """Each run of white space becomes one space."""
    text = text.translate(SPACED)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def _order(doc_id: int | None, row: int) -> tuple:
    return doc_id is None, doc_id or 0, row


def _local_pass(generation: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("rep", pa.int64()), ("hash", pa.int64()), ("bytes", pa.int64()), ("rows", pa.int64()), ("first_doc", pa.int64()), ("first_row", pa.int64()), ("sha256", pa.binary()), ("text", pa.binary())])
        row = TaskContext.get().partitionId() << 33
        seen: dict[bytes, list] = {}  # text -> representative's row, count, first id and row
        rows: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            by_rep = {g[0]: (t, g) for t, g in seen.items()}
            for at in range(0, len(rows), 4096):
                out = []
                for doc_id, number, rep in rows[at : at + 4096]:
                    if number == rep:
                        t, (_, n, first, first_row) = by_rep[rep]
                        out.append((doc_id, number, rep, np.uint64(xxhash.xxh64_intdigest(t)).astype(np.int64), len(t), n, first, first_row, hashlib.sha256(t).digest(), t))
                    else:
                        out.append((doc_id, number, rep, None, None, None, None, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in pieces(batches, 4 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                text = normalise(text)
                group = seen.get(text)
                if group is None:
                    group = seen[text] = [row, 0, doc_id, row]
                    size += len(text)
                group[1] += 1
                if _order(doc_id, row) < _order(*group[2:]):
                    group[2:] = doc_id, row
                rows.append((doc_id, row, group[0]))
                row += 1
            if size >= generation or len(rows) >= 1 << 17:
                yield from flush()
                seen, rows, size = {}, [], 0
        yield from flush()

    return run


def grow_directory(hashes: DataFrame, capacity_bytes: int, capacity_rows: int, step: int = 4) -> tuple[np.ndarray, int]:
    """Ascending starts (unsigned) of the buckets, and the directory's depth in bits. hashes: hash, bytes.

    A bucket over capacity is split at its next bit unless it holds one hash only; a round counts `step` bits further.
    """
    spark = hashes.sparkSession
    starts, depth, deepest, open_ = [], 0, 0, [0]
    while open_:
        below = min(64, depth + (8 if depth == 0 else step))
        cells = hashes.withColumn("bucket", F.shiftrightunsigned("hash", 64 - depth) if depth else F.lit(0).cast("long"))
        if depth:  # open buckets number at most as the bounded directory does
            cells = cells.join(F.broadcast(spark.createDataFrame([(p,) for p in open_], "bucket long")), "bucket", "left_semi")
        cell = F.shiftrightunsigned("hash", 64 - below) if below < 64 else F.col("hash")
        counted = cells.groupBy("bucket", cell.alias("cell")).agg(F.count("*").alias("n"), F.sum("bytes").alias("size"), F.min("hash").alias("lo"), F.max("hash").alias("hi")).collect()
        under: dict[int, list] = {p: [] for p in open_}
        for bucket, place, n, size, lo, hi in counted:
            under[bucket].append((place & (1 << 64) - 1, n, size, lo, hi))
        left = []

        def settle(prefix: int, bits: int, own: list, below: int = below, left: list = left) -> None:
            nonlocal deepest
            deepest = max(deepest, bits)
            fits = sum(c[1] for c in own) <= capacity_rows and sum(c[2] for c in own) <= capacity_bytes
            if fits or min(c[3] for c in own) == max(c[4] for c in own):
                starts.append(prefix << (64 - bits))
            elif bits == below:
                left.append(prefix)
            else:
                for half in (2 * prefix, 2 * prefix + 1):
                    settle(half, bits + 1, [c for c in own if c[0] >> (below - bits - 1) == half])

        for prefix, own in under.items():
            settle(prefix, depth, own)
        depth, open_ = below, left
    return np.array(sorted(starts) or [0], np.uint64), deepest


def _owned(starts) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("hash").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bucket = np.searchsorted(starts.value, keys, "right").astype(np.int32) - 1
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *batch.columns], ["bucket", *batch.schema.names])

    return run


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of bucket and hash -> a row of the index for each of them."""
    schema = pa.schema([("rep", pa.int64()), ("bucket", pa.int32()), ("hash", pa.int64()), ("place", pa.int32()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64()), ("sha256", pa.binary())])
    chain: list[list] = []  # text, first id, first row, rows, sha256, representatives
    key, out = None, []

    def close() -> None:
        for place, (_, first, first_row, n, sha, reps) in enumerate(chain):
            out.extend((rep, *key, place, first, first_row, n, sha) for rep in reps)
        chain.clear()

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("bucket", "hash", "rep", "rows", "first_doc", "first_row", "sha256")]
        texts = batch.column("text")
        for i, (bucket, h, rep, n, first, first_row, sha) in enumerate(zip(*cols, strict=True)):
            if (bucket, h) != key:
                close()
                key = (bucket, h)
            text = texts[i].as_py()
            for entry in chain:
                if entry[0] == text:
                    entry[3] += n
                    entry[5].append(rep)
                    if _order(first, first_row) < _order(entry[1], entry[2]):
                        entry[1], entry[2] = first, first_row
                    break
            else:
                chain.append([text, first, first_row, n, sha, [rep]])
        while len(out) >= 8192:
            yield batch_of(out[:8192])
            del out[:8192]
    close()
    for at in range(0, len(out), 8192):
        yield batch_of(out[at : at + 8192])


def build(docs: DataFrame, capacity_bytes: int = 16 << 20, capacity_rows: int = 1 << 16, generation: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """(rows, index), both in the shared folder: doc_id, row and representative of each document; the index by bucket.

    The directory has some 2^17 buckets at most, since a bucket's capacity is at least a 2^16th of all; small tables have some buckets
    for each owner task.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    local = materialize(documents(docs).mapInArrow(_local_pass(generation), LOCAL), "local")
    reps = local.where("row = rep")
    load = reps.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    fit = lambda most, total: max(min(most, total // (4 * parts)), total >> 16, 1)
    starts, _ = grow_directory(reps.select("hash", "bytes"), fit(capacity_bytes, load[1]), fit(capacity_rows, load[0])) if load[0] else (np.zeros(1, np.uint64), 0)
    owned = reps.select("hash", "rep", "rows", "first_doc", "first_row", "sha256", "text").mapInArrow(_owned(spark.sparkContext.broadcast(starts)), "bucket int, hash long, rep long, rows long, first_doc long, first_row long, sha256 binary, text binary")
    index = owned.repartition(parts, "bucket").sortWithinPartitions("bucket", "hash", "rep").mapInArrow(_chains, CHAINED)
    return local.select("doc_id", "row", "rep"), materialize(index, "index")


def groups(docs: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 (lower-case hex of the normalised text) of every document."""
    rows, index = build(docs, **sizes)
    found = rows.join(index.select("rep", "keep_id", "keep_row", "group_size", "sha256"), "rep")
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"))
