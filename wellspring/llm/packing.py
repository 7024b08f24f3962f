"""Packing: order-preserving dynamic programming over window cuts, with a monotone queue.

Each task reads its documents in order, encodes them and cuts the stream of ids into windows of at most `window` ids.
A cut may fall at a document end (free), at a sentence end, or on a lattice of every `lattice`-th id (so that a long
sentence can be cut at all). f(j) = penalty(j) + min over i of f(i) + padding(j - i), and as padding(L) = window - L,
the minimum over the last `window` ids is the front of a monotone queue keyed by f(i) + i. Windows whose length is a
power of two are not padded; those few predecessors are tried besides.

Stretches of about `segment` ids are solved one after the other, so memory is bounded and nothing is shuffled; a
stretch's last window may stay part-filled, less than 0.1 % of its ids at the default.

Defined results: null or empty text is a document with the end id only; repeated rows are packed each; a null doc_id
stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import documents, pieces
from .tokens import encoder

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Unpadded lengths that are tried besides the full window.
POWERS = (64, 128, 256, 512)


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int, powers=POWERS, each: float = 1.0) -> list[int]:
    """Places of the best cuts, the first and last of `at` included. at: ascending places, no gap over `window`; each: cost of a window as such."""
    n = len(at)
    p = at.tolist()
    costs = (penalty + each).tolist()
    earlier: dict[int, list[int]] = {}
    for size in powers:
        if size < window:
            i = np.searchsorted(at, at - size)
            for j in np.flatnonzero((at[i] == at - size) & (i < np.arange(n))).tolist():
                earlier.setdefault(j, []).append(int(i[j]))
    f, back, key = [0.0] * n, [0] * n, [0.0] * n
    key[0] = p[0]
    queue = deque([0])
    for j in range(1, n):
        x = p[j]
        while p[queue[0]] < x - window:
            queue.popleft()
        i = queue[0]
        best = key[i] + window - x
        for other in earlier.get(j, ()):
            if f[other] < best:
                best, i = f[other], other
        f[j] = best = best + costs[j]
        back[j] = i
        key[j] = k = best + x
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return [p[j] for j in reversed(cuts)]


def _tail(length: int, window: int, powers=POWERS) -> int:
    """Length after padding."""
    return length if length & (length - 1) == 0 else window


class _Packer:
    def __init__(self, path: str, kind: str, end_id: int, window: int, lattice: int, sentence: float, hard: float, segment: int) -> None:
        self.encoder = encoder(path, kind, end_id)
        self.window, self.lattice, self.sentence, self.hard, self.segment = window, min(lattice, window), sentence, hard, segment
        context = TaskContext.get()
        self.sequence = (context.partitionId() if context else 0) << 32

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0
        for batch in pieces(batches, 4 << 20):
            held.append((batch.column("doc_id"), *self.encoder.encode([t or "" for t in batch.column("text").to_pylist()])))
            total += len(held[-1][1])
            if total >= self.segment:
                yield self.solve(held)
                held, total = [], 0
        if held:
            yield self.solve(held)

    def solve(self, held: list[tuple]) -> pa.RecordBatch:
        ids = np.concatenate([x[1] for x in held])
        counts = np.concatenate([x[2] for x in held])
        shift = np.cumsum([0, *[len(x[1]) for x in held[:-1]]])
        sentences = np.concatenate([x[3] + s for x, s in zip(held, shift, strict=True)])
        doc_ends = np.cumsum(counts)
        total = len(ids)
        at = np.unique(np.concatenate([[0], np.arange(self.lattice, total, self.lattice), sentences, doc_ends]))
        penalty = np.full(len(at), self.hard)
        penalty[np.searchsorted(at, sentences)] = self.sentence
        penalty[np.searchsorted(at, doc_ends)] = 0
        cuts = np.array(best_cuts(at, penalty, self.window))
        bounds = np.union1d(cuts, np.concatenate([[0], doc_ends]))
        start, size = bounds[:-1], np.diff(bounds)
        doc = np.searchsorted(doc_ends, start, side="right")
        window = np.searchsorted(cuts, start, side="right") - 1
        first = self.sequence
        self.sequence += len(cuts) - 1
        doc_ids = pa.concat_arrays([x[0] for x in held]).take(pa.array(doc))
        if bounds[-1] * 4 < 2**31:
            data = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((bounds * 4).astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
        else:
            data = pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays(
            [doc_ids, *(pa.array(x.astype(np.int64)) for x in (start - (doc_ends - counts)[doc], size, counts[doc], first + window, start - cuts[window])), data],
            ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )


def pack(docs: DataFrame, path: str, kind: str = "spaced", end_id: int = 0, window: int = 1024, lattice: int = 64, sentence: float = 2.0, hard: float = 12.0, segment: int = 1_000_000) -> DataFrame:
    """One row for each piece of a document in a window: doc_id, start (in the document), length, doc_tokens (with the end id),
    sequence_id, offset (in the window) and the ids themselves (little-endian unsigned 32-bit). sentence, hard: penalties,
    in ids of padding, for a cut at a sentence end and inside a sentence."""

    def run(batches):
        return _Packer(path, kind, end_id, window, lattice, sentence, hard, segment)(batches)

    return documents(docs).mapInArrow(run, PIECES)
