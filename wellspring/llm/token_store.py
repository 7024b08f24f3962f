"""Token-id / binary output: each document compressed by itself against one shared zstandard dictionary.

The dictionary is trained on serialized id arrays of a bounded sample: of the `sample` documents with the smallest hash of doc_id
and text, a text beyond `sample_bytes` bytes gives an excerpt of that size at a place that the hash picks. Every document is written, whole. A store is a Parquet folder, so that any file system that Spark
writes to will do and the committer deals with lost executors. Each row holds one container, about `container_bytes` long:

    magic "WTOK1\\0\\0\\0" | SHA-256 of the dictionary (32) | bytes of an id, 2 or 4 (u32) | documents n (u32)
    | doc ids (i64 x n) | null flags (u8 x n) | id counts (u64 x n) | offsets of the frames (u64 x n+1) | frames

Numbers are little-endian. A short document is read by its offset alone, without what stands before it. Containers
and the documents in them are in ascending doc_id order (null first); `part` and `seq` give the order of containers, `inner_start` the ids before one in its part.

Defined results: null or empty text has the end id only; repeated rows are written each, in any order among
themselves; an empty table gives an empty store; other columns are ignored. Rows of one doc_id, or equal rows, may fill many containers. An id that doesn't fit `width` raises.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drawn, materialize, pieces, scan_offsets, scratch
from .tokens import encoder

MAGIC = b"WTOK1\0\0\0"
FRAMES = "doc_id long, n_tokens long, frame binary, place long"
CONTAINERS = "part int, seq int, inner_start long, n_docs long, n_tokens long, container binary"
_HEAD = struct.Struct("<8s32sII")


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; of too few samples, their end as raw content; of none, nothing."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@cache
def _codecs(dictionary: bytes) -> tuple:
    shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=3, write_checksum=True, **shared), zstandard.ZstdDecompressor(**shared)


def write_container(width: int, dictionary: bytes, doc_ids: list, counts: list[int], frames: list[bytes]) -> bytes:
    n = len(frames)
    return b"".join(
        [
            _HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest(), width, n),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], "u1").tobytes(),
            np.array(counts, "<u8").tobytes(),
            np.concatenate([[0], np.cumsum([len(x) for x in frames])]).astype("<u8").tobytes(),
            *frames,
        ]
    )


class Container:
    """Reads a container; ids(k) decompresses the k-th document only."""

    def __init__(self, blob: bytes, dictionary: bytes) -> None:
        magic, digest, self.width, self.n = _HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token container")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the container was written with another dictionary")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(blob, "<i8", self.n, at)
        self.null = np.frombuffer(blob, "u1", self.n, at + 8 * self.n)
        self.counts = np.frombuffer(blob, "<u8", self.n, at + 9 * self.n)
        self.offsets = np.frombuffer(blob, "<u8", self.n + 1, at + 17 * self.n)
        self.blob, self.base = memoryview(blob), at + 17 * self.n + 8 * (self.n + 1)
        self.decompress = _codecs(dictionary)[1].decompress

    def ids(self, k: int) -> np.ndarray:
        a, b = self.base + int(self.offsets[k]), self.base + int(self.offsets[k + 1])
        return np.frombuffer(self.decompress(self.blob[a:b], max_output_size=int(self.counts[k]) * self.width), f"<u{self.width}")


def _serial(ids: np.ndarray, width: int) -> bytes:
    if ids.size and int(ids.max()) >> (8 * width):
        raise ValueError(f"id {int(ids.max())} doesn't fit {width} bytes")
    return ids.astype(f"<u{width}").tobytes()


def write_store(docs: DataFrame, path: str, tokenizer: str, kind: str = "dropped", end_id: int = 2, width: int = 2, dictionary_bytes: int = 65536, sample: int = 1000, sample_bytes: int = 65536, container_bytes: int = 16 << 20) -> None:
    """Encode all documents and write them to the folder `path`, with the dictionary in the folder `path`_dictionary.

    width: bytes of an id; 2 if every id of the vocabulary is under 65536. `sample` bounds what the dictionary sees.
    """
    spark, docs = docs.sparkSession, documents(docs)
    # an excerpt is cut by characters, of four bytes at most
    key, most = F.xxhash64("doc_id", "text").alias("key"), sample_bytes // 4
    start = F.pmod(F.xxhash64("key"), F.char_length("text") - most + 1).cast("int") + 1
    excerpt = F.when(F.octet_length("text") <= sample_bytes, F.col("text")).otherwise(F.when(F.char_length("text") <= most, F.col("text")).otherwise(F.substring(F.col("text"), start, F.lit(most))))
    chosen = drawn(docs.where("text IS NOT NULL").select(key, "text").select("key", excerpt.alias("text")), sample, "key")
    encode = encoder(tokenizer, kind, end_id).encode
    ids, counts, _ = encode([r.text for r in chosen])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    samples = [_serial(ids[a:b], width) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    dictionary = train_dictionary(samples, dictionary_bytes)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}_dictionary")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack = encoder(tokenizer, kind, end_id).encode, _codecs(dictionary)[0].compress
        place = TaskContext.get().partitionId() << 36
        for batch in pieces(batches, 4 << 20):
            ids, counts, _ = encode([t or "" for t in batch.column("text").to_pylist()])
            data, bounds = _serial(ids, width), np.concatenate([[0], np.cumsum(counts)]) * width
            frames = [pack(data[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(frames, pa.binary()), pa.array(np.arange(place, place + len(frames)))], ["doc_id", "n_tokens", "frame", "place"])
            place += len(frames)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        counts: list[int] = []
        frames: list[bytes] = []
        size = 0

        def row():
            blob = write_container(width, dictionary, doc_ids, counts, frames)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([len(frames)], pa.int64()), pa.array([sum(counts)], pa.int64()), pa.array([blob], pa.binary())], ["part", "seq", "inner_start", "n_docs", "n_tokens", "container"])

        for batch in batches:
            for doc_id, n, frame in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                doc_ids.append(doc_id)
                counts.append(n)
                frames.append(frame)
                size += len(frame)
                if size >= container_bytes:
                    yield row()
                    before += sum(counts)
                    seq, doc_ids, counts, frames, size = seq + 1, [], [], [], 0
        if frames:
            yield row()

    # written first: range parting reads its input twice, and encoding is the costly part; the place lets a doc_id of many rows be parted
    ordered = materialize(docs.mapInArrow(compress, FRAMES), "frames").repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "n_tokens", "frame")
    ordered.mapInArrow(gather, CONTAINERS).write.option("compression", "none").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document: doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit)."""
    rows = spark.read.parquet(f"{path}_dictionary").collect()
    dictionary = bytes(rows[0].dictionary)
    if hashlib.sha256(dictionary).hexdigest() != rows[0].sha256:
        raise ValueError("the dictionary doesn't match its hash")
    boxes = spark.read.schema(CONTAINERS).parquet(path)
    bases = scan_offsets(boxes.select("part", "n_tokens"), "part", "n_tokens")
    placed = boxes.join(F.broadcast(bases), "part").select((F.col("base") + F.col("inner_start")).alias("base"), "container")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, blob in zip(batch.column("base").to_pylist(), batch.column("container"), strict=True):
                box = Container(blob.as_py(), dictionary)
                counts = box.counts.astype(np.int64)
                starts = base + np.cumsum(counts) - counts
                for a in range(0, box.n, 2000):
                    b = min(a + 2000, box.n)
                    ids = [box.ids(k).astype("<u4").tobytes() for k in range(a, b)]
                    doc_ids = pa.array(box.doc_ids[a:b], mask=box.null[a:b].astype(bool))
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts[a:b]), pa.array(counts[a:b]), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


def store_and_read(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write all documents to a fresh store in the shared scratch folder and read it back."""
    path = scratch(docs.sparkSession, "tokens")
    write_store(docs, path, tokenizer, **options)
    return read_store(docs.sparkSession, path)
