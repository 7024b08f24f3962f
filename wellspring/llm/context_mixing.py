"""LM scoring by online logistic context mixing, and a unigram base score.

Model. A text is a sequence of bytes and one end. Each symbol is coded as the bits of a Huffman code of the training
bytes that follow the byte before, so a symbol takes about 3.5 binary predictions. Each context (the last 3 and 5 bytes, and the
word so far) has a hashed table of bit counts: a slot is picked by a hash of the context and the
code's inner node. A slot's prediction is the log-odds of its counts, and how often it was seen is its level. The
predictions are mixed in the logistic domain with weights that are gated by the levels of the contexts. The mix is refined by an adaptive probability map of (gate, mixed log-odds). While a text is scored, its own
gated weights, biases and map are learned online: after every stride of 128 bytes they move along the coding loss's gradient (the map by its counts), so
each stride is predicted from what stood before it only. bits = minus the sum of log2 of the bits' probabilities.

What is learned where. Byte and bit counts cover all training documents: each task counts its own, the slices of the
tables are added up by shuffles. The tables have the size of `ORDERS`, doubled with the training bytes up to `GROWN` times (they are
broadcast). Gated weights and the probability map are fitted on every bit of all training documents, of any length, in the same pass: a
task predicts each stretch of its texts from what it counted before, then counts it, and adds up (gate, cell of each
context's log-odds, bit). From these sums each gate's weights are fitted by Newton's method. So bit counts don't depend on how the input is
parted, weights do a little: a small task meets more contexts that it doesn't know, which are other gates.

Base. Token counts are exact: each task numbers the distinct tokens of a block of documents (about `block_bytes` of
text), (block, token hash, count) rows are added up by 64-bit hash, and each block's totals return to its
documents. The rows grow with the blocks' distinct tokens, not with all tokens.

Defined results: null or empty text has the end only; repeated rows are scored each (and count each in training); a
null doc_id is in no fold, so it trains and held_out is false; with no training rows every bit is a fair coin; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, crc_mod, documents, materialize, pieces, texts_of

#: Context (bytes before, or the word so far) -> bits of the number of a slot, for up to FULL training bytes.
ORDERS = {3: 20, 5: 21, "word": 22}
#: Each doubling of FULL adds a bit to each order, GROWN at most.
FULL, GROWN = 1 << 27, 2
#: Nodes of a path whose slots are neighbours: 2 ** NEAR slots are one line of memory.
NEAR = 3
#: Symbol of a text's end; numbers of a table in one row; bytes before a place that its contexts can reach, and of a word.
END, SLICE, PAD, WORD = 256, 1 << 17, 24, 16
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93
_LOWERED = np.frombuffer(LOWER, np.uint8)
#: Buckets of mixed log-odds in the probability map, from -LIMIT to LIMIT.
LIMIT, BUCKETS = 8.0, 33
#: Cells of a context's log-odds when weights are fitted, even in asinh up to REACH; bits that the map's prior is worth.
CELLS, REACH, PRIOR = 27, 3.4, 20


def _huffman(counts: list[int]) -> list[list[tuple[int, int]]]:
    """For each symbol its path of (inner node, bit) from the root."""
    n = len(counts)
    heap = [(c + 1, k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    number = n
    while len(heap) > 1:
        (c0, a), (c1, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a], parent[b] = (number, 0), (number, 1)
        heapq.heappush(heap, (c0 + c1, number))
        number += 1
    paths = []
    for at in range(n):
        path = []
        while at in parent:
            at, bit = parent[at]
            path.append((at - n, bit))
        paths.append(path[::-1])
    return paths


class Code:
    """A Huffman code of the 257 symbols for each byte before. counts: 256 x 257.

    length, start: by 257 * byte before + symbol; steps: along the paths, a random number of the inner node times 2 plus the bit.
    """

    def __init__(self, counts: np.ndarray) -> None:
        grown = min(GROWN, max(0, int(counts.sum()) // FULL).bit_length())
        self.orders = {order: width + grown for order, width in ORDERS.items()}
        scatter = (np.random.default_rng(7).integers(0, 1 << (min(ORDERS.values()) - NEAR), (256, 256)) << NEAR).tolist()
        steps, length = [], []
        for before in range(256):
            for path in _huffman(counts[before].tolist()):
                length.append(len(path))
                for depth, (node, bit) in enumerate(path):
                    # NEAR nodes on a path lie beside each other in the tables, so a symbol takes few lines of memory
                    if depth % NEAR == 0:
                        base, place = scatter[before][node] if depth else 0, 1
                    steps.append((base | place) << 1 | bit)
                    place = place * 2 + bit
        self.length, self.steps = np.array(length), np.array(steps)
        self.start = np.cumsum(self.length) - self.length


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with PAD zeros before each text and one place for its end, first place of each text, place of its end)."""
    gap = bytes(PAD)
    buffer = np.frombuffer(b"".join([x for t in texts for x in (gap, t, b"\0")]), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes + PAD + 1) - sizes - 1
    return buffer, first, first + sizes


#: Base -> its powers, as many as any stretch of this worker needed; stretches are short.
_KNOWN_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_KNOWN_POWERS.get(base, ())) < n:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        _KNOWN_POWERS[base] = np.multiply.accumulate(out)
    return _KNOWN_POWERS[base][:n]


def contexts(code: Code, buffer: np.ndarray) -> list[np.ndarray]:
    """For each context the hash (bits of a slot's number) before every place of the buffer; good from PAD bytes after its begin on."""
    n = len(buffer)
    led = np.concatenate([np.zeros(8, np.uint8), buffer])
    history = np.ndarray((n,), "<u8", led.data, 0, (1,)).copy()  # the 8 bytes before each place, the last one highest
    place = np.arange(n)
    # rolling hashes of word parts: sums of byte times power, shifted back to the part's start
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWERED[buffer].astype(np.uint64) + np.uint64(1)) * _powers(_STEP, n), out=sums[1:])
    start = np.zeros(n, np.int64)  # behind the last white space before each place
    np.maximum.accumulate(np.where(buffer[:-1] <= 32, place[1:], 0), out=start[1:])
    np.maximum(start, place - WORD, out=start)
    word = sums[:-1]
    word -= word[start]
    word *= _powers(pow(_STEP, -1, 1 << 64), n)[start]
    word += np.uint64(77)
    out = []
    for order, width in code.orders.items():
        value = word if order == "word" else (history >> np.uint64(64 - 8 * order)) + np.uint64(order)
        value *= _MULTIPLY
        value ^= value >> np.uint64(31)
        value *= _MULTIPLY
        value >>= np.uint64(64 - width)
        out.append(value.view(np.int64))
    return out


def bits_at(code: Code, buffer: np.ndarray, hashes: list[np.ndarray], places: np.ndarray, is_end: np.ndarray):
    """For the symbols at the places: (number of bits of each, the bits, slot of each context)."""
    symbol = buffer[places - 1] * np.int64(257) + np.where(is_end, END, buffer[places].astype(np.int64))
    length = code.length[symbol]
    total = int(length.sum())
    step = code.steps[np.arange(total) + np.repeat(code.start[symbol] - (np.cumsum(length) - length), length)]
    bit = (step & 1).astype(np.int8)
    step >>= 1
    slots = []
    for h in hashes:
        slot = np.repeat(h.take(places, mode="clip"), length)
        slot ^= step
        slots.append(slot)
    return length, bit, slots


def all_places(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all symbols of all texts, and which are ends."""
    size = last - first + 1
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    is_end = np.zeros(len(at), bool)
    is_end[np.cumsum(size) - 1] = True
    return at, is_end


#: Number of bits seen -> level.
_LEVEL_OF = np.array([0, 1, 1, 2, 2, 2, 2, 2, 2, 2, 3])
#: Cells of a slot's log-odds when texts are scored, even in asinh up to FAR; a code is cell times 4 plus level, one byte.
FINE, FAR = 63, 3.4
_VALUE_OF = np.repeat(np.sinh(np.linspace(-FAR, FAR, FINE)), 4).astype(np.float32)


def codes_of(counts: np.ndarray) -> np.ndarray:
    """Code of each slot by its counts of bit 0 and 1 (n x 2): log-odds, and the level of their sum (0, 1 to 2, 3 to 9, more)."""
    out = np.empty(len(counts), np.uint8)
    for a in range(0, len(counts), 1 << 20):
        n0, n1 = counts[a : a + (1 << 20), 0].astype(np.float32), counts[a : a + (1 << 20), 1].astype(np.float32)
        cell = np.rint((np.clip(np.arcsinh(np.log((n1 + 0.4) / (n0 + 0.4))), -FAR, FAR) + FAR) * ((FINE - 1) / (2 * FAR))).astype(np.uint8)
        out[a : a + (1 << 20)] = cell * 4 + _LEVEL_OF.take((n0 + n1).astype(np.int64), mode="clip").astype(np.uint8)
    return out


class Mixer:
    """Weights and bias for each gate, and the probability map; tables: one array of codes (`codes_of`) for each context."""

    def __init__(self, code: Code, tables: list[np.ndarray]) -> None:
        self.code, self.tables, self.gates = code, tables, 4 ** len(ORDERS)
        self.weights = np.full((len(ORDERS), self.gates), 0.3, np.float32)
        self.bias = np.zeros(self.gates, np.float32)
        self.map = np.zeros((self.gates, BUCKETS, 2))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": [zstandard.compress(t.tobytes(), 1) for t in self.tables]}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"tables": [np.frombuffer(zstandard.decompress(t), np.uint8) for t in state["tables"]]}

    def _bucket(self, z: np.ndarray) -> np.ndarray:
        at = z * np.float32((BUCKETS - 1) / (2 * LIMIT))
        at += np.float32(BUCKETS / 2)
        np.maximum(at, 0, out=at)
        np.minimum(at, np.float32(BUCKETS - 0.5), out=at)
        return at.astype(np.int64)

    def fit(self, cells: np.ndarray, n: np.ndarray, rounds: int = 12, ridge: float = 10.0) -> None:
        """Weights of each gate by Newton's method, drawn to the start weights by `ridge`, then the map. cells: numbers of `cell_of`, n: how often with bit 0 and 1."""
        gate = cells // CELLS ** len(ORDERS)
        x = np.stack([_CENTRES[cells // CELLS**k % CELLS] for k in range(len(ORDERS) - 1, -1, -1)] + [np.ones(len(cells))], 1)
        for g in np.unique(gate):
            own = gate == g
            xs, zeros, ones = x[own], n[own, 0].astype(float), n[own, 1].astype(float)
            start = w = np.array([*self.weights[:, g], self.bias[g]], float)

            def loss(w, xs=xs, zeros=zeros, ones=ones, start=start):
                z = xs @ w
                return ((zeros + ones) * np.logaddexp(0, z) - ones * z).sum() + ridge / 2 * ((w - start) ** 2).sum()

            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(xs @ w, -30, 30)))
                slope = xs.T @ (ones - (zeros + ones) * p) - ridge * (w - start)
                step = np.linalg.solve((xs.T * ((zeros + ones) * p * (1 - p))) @ xs + ridge * np.eye(len(w)), slope)
                pace = 1.0
                while pace > 1e-3 and loss(w + pace * step) > loss(w):
                    pace /= 2
                w = w + pace * step if pace > 1e-3 else w
            self.weights[:, g], self.bias[g] = w[:-1], w[-1]
            bucket = self._bucket(np.clip(xs @ w, -12, 12))
            self.map[g, :, 0] += np.bincount(bucket, zeros, BUCKETS)
            self.map[g, :, 1] += np.bincount(bucket, ones, BUCKETS)

    def freeze(self) -> None:
        """The map as probabilities of a 1; its prior is the bucket's own middle."""
        middle = 1 / (1 + np.exp(-np.linspace(-LIMIT, LIMIT, BUCKETS)))
        self.refined = ((self.map[:, :, 1] + PRIOR * middle) / (self.map.sum(2) + PRIOR)).astype(np.float32).ravel()

    def score(self, texts: list[bytes], stride: int = 128, rate: float = 0.05, group: int = 256, group_bytes: int = 2 << 20) -> np.ndarray:
        """Total bits of each text. Texts of about one length go side by side in a group, `stride` bytes at a time."""
        total = np.zeros(len(texts))
        sizes = np.array([len(t) for t in texts], np.int64)
        own: list[int] = []
        for k in np.argsort(sizes, kind="stable").tolist():
            if len(own) == group or (own and sizes[own].sum() + sizes[k] > group_bytes):
                total[own] = self._score([texts[i] for i in own], stride, rate)
                own = []
            own.append(k)
        if own:
            total[own] = self._score([texts[i] for i in own], stride, rate)
        return total

    def _score(self, texts: list[bytes], stride: int, rate: float) -> np.ndarray:
        """Each text has its own copy of weights, biases and map; what a stride teaches is for the text's later strides only."""
        buffer, first, last = lay_out(texts)
        total = np.zeros(len(texts))
        n_gates = len(texts) * self.gates
        weights, bias = [np.tile(w, len(texts)) for w in self.weights], np.tile(self.bias, len(texts))
        hits, ones = np.full(n_gates * BUCKETS, PRIOR, np.float32), np.tile(self.refined * np.float32(PRIOR), len(texts))
        at, alive, row = first.copy(), np.arange(len(texts)), np.arange(-PAD, stride)
        while len(alive):
            # the next stride of each text with the PAD bytes before it
            near = np.minimum(at[alive][:, None] + row, len(buffer) - 1)
            part = buffer[near].ravel()
            size = np.minimum(stride, last[alive] + 1 - at[alive])
            places, is_last = all_places(begin := np.arange(len(alive)) * (PAD + stride) + PAD, begin + size - 1)
            ending = np.repeat(at[alive] + size > last[alive], size)
            length, bit, slots = bits_at(self.code, part, contexts(self.code, part), places, is_last & ending)
            starts = np.concatenate([[0], np.cumsum(length)[np.cumsum(size) - 1]])
            of_text = np.diff(starts)
            starts = starts[:-1]
            codes = [table.take(s, mode="clip") for table, s in zip(self.tables, slots, strict=True)]
            inputs = [_VALUE_OF.take(c, mode="clip") for c in codes]
            level = codes[0] & 3
            for c in codes[1:]:
                level = level << 2 | c & 3
            gate = np.repeat(alive * self.gates, of_text)
            gate += level
            mixed = bias.take(gate, mode="clip")
            for w, x in zip(weights, inputs, strict=True):
                step = w.take(gate, mode="clip")
                step *= x
                mixed += step
            cell = gate * BUCKETS
            cell += self._bucket(mixed)
            p = np.negative(mixed, out=mixed)
            with np.errstate(over="ignore"):
                np.exp(p, out=p)
            p += 1
            np.reciprocal(p, out=p)
            final = ones.take(cell, mode="clip")
            final /= hits.take(cell, mode="clip")
            final += p
            final *= 0.5
            np.maximum(final, 1e-5, out=final)
            np.minimum(final, 1 - 1e-5, out=final)
            truth = bit.astype(np.float32)
            final += truth
            final -= 1  # p - 1 or p: less its sign, what was given to the bit that came
            np.abs(final, out=final)
            total[alive] -= np.add.reduceat(np.log2(final, out=final), starts)
            at[alive] += size
            more = at[alive] <= last[alive]
            if more.any():
                error = np.subtract(truth, p, out=p)
                pace = (rate / np.sqrt(np.bincount(gate, minlength=n_gates) + 1.0)).astype(np.float32)
                for w, x in zip(weights, inputs, strict=True):
                    x *= error
                    w += pace * np.bincount(gate, x, n_gates)
                bias += pace * np.bincount(gate, error, n_gates)
                np.add.at(hits, cell, np.float32(1))
                np.add.at(ones, cell, truth)
            alive = alive[more]
        return total


_CENTRES = np.sinh(np.linspace(-REACH, REACH, CELLS))


#: Sixteenths of an octave (of the counts' ratio, from -32 to 32 octaves) -> cell.
_CELL_OF = np.rint((np.clip(np.arcsinh(np.arange(-512, 513) * (np.log(2) / 16)), -REACH, REACH) + REACH) * ((CELLS - 1) / (2 * REACH))).astype(np.int64)


def cell_of(pairs: list[np.ndarray]) -> np.ndarray:
    """(gate, cell of each context's log-odds) as one number; pairs: counts of bit 0 and 1 (n x 2) for each context.
    The log of a count is read from the exponent and the highest bits of its float."""
    gate, out = 0, 0
    for n in pairs:
        log = n.astype(np.float32)
        log += np.float32(0.4)
        log = log.view(np.int32)
        log >>= 19
        seen = n[:, 0] + n[:, 1]
        gate = gate * 4 + _LEVEL_OF.take(seen, mode="clip")
        out = out * CELLS + _CELL_OF.take(log[:, 1] - log[:, 0] + 512, mode="clip")
    return gate * CELLS ** len(pairs) + out


def byte_counts(train: DataFrame) -> np.ndarray:
    """How often each byte and the end follow each byte (none: 0) in all training texts: 256 x 257."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(256 * 257, np.int64)
        for batch in pieces(batches, 1 << 20):
            buffer, first, last = lay_out(texts_of(batch))
            at, is_end = all_places(first, last)
            held += np.bincount(buffer[at - 1] * np.int64(257) + np.where(is_end, END, buffer[at].astype(np.int64)), minlength=len(held))
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(held[seen])], ["symbol", "n"])

    out = np.zeros(256 * 257, np.int64)
    for r in train.mapInArrow(count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        out[r.symbol] = r.n
    return out.reshape(256, 257)


def _row(key, total):
    # one byte says how many bytes a number has
    width = next(w for w in (1, 2, 4, 8) if total.max(initial=0) < 1 << (8 * w - 1))
    packed = bytes([width]) + zstandard.compress(total.astype(f"<i{width}").tobytes(), 1)
    return pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in key] + [pa.array([packed], pa.binary())], ["order", "slice", "salt", "counts"])


def _numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed[1:]), f"<i{packed[0]}").astype(np.int64)


def _sliced(number: int, slices: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A task's counts as rows of 2 * SLICE numbers; a slice without any count is left out."""
    part = TaskContext.get().partitionId() % 8
    for k, own in enumerate(slices):
        if own.any():
            yield _row((number, k, part), own)


def _summed(train: DataFrame, count, sizes: list[int]) -> list[np.ndarray]:
    """The sums over all tasks of what `count` gives as `_sliced` rows: for each number an array of `sizes` x 2."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted, so one running sum is held at a time."""
        key, total = None, None
        for batch in batches:
            for order, k, salt, counts in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if key != (order, k, salt):
                    if key:
                        yield _row(key, total)
                    key, total = (order, k, salt), np.zeros(2 * SLICE, np.int64)
                own = _numbers(counts)
                total[: len(own)] += own
        if key:
            yield _row(key, total)

    schema, keys = "order int, slice int, salt int, counts binary", ("order", "slice", "salt")
    rows = train.mapInArrow(count, schema)
    for salted in (True, False):
        rows = rows if salted else rows.withColumn("salt", F.lit(0))
        rows = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, schema)
    out = [np.zeros((size, 2), np.int32) for size in sizes]
    for r in rows.toLocalIterator():
        own = out[r.order][SLICE * r.slice : SLICE * (r.slice + 1)]
        own[:] = np.minimum(_numbers(r.counts).reshape(-1, 2)[: len(own)], 2**31 - 1)
    return out


#: Symbols that are counted at once, at most: no 16-bit count overflows in between.
MOST = 1 << 13


class _Counts:
    """A task's counts of bits by slot in 16 bits each. Of a slot that has many, half of both counts go to a list, so that nothing is lost and their ratio stays."""

    def __init__(self, width: int) -> None:
        self.table, self.gone = np.zeros((1 << width, 2), np.int16), [(np.zeros(0, np.int64), np.zeros((0, 2), np.int16))]

    def known(self, slot: np.ndarray) -> np.ndarray:
        """Counts of bit 0 and 1 of each slot (n x 2); both are read at once."""
        out = self.table.view(np.int32).ravel().take(slot, mode="clip").view(np.int16).reshape(-1, 2)
        if out.max(initial=0) > 2 * MOST:
            many = np.unique(slot[out.max(1) > 2 * MOST])
            self.gone.append((many, self.table[many] >> 1))
            self.table[many] -= self.gone[-1][1]
        return out

    def add(self, slot: np.ndarray, bit: np.ndarray) -> None:
        slot *= 2
        slot += bit
        np.add.at(self.table.reshape(-1), slot, np.int16(1))

    def slices(self) -> Iterator[np.ndarray]:
        """All counts, SLICE slots at a time."""
        slots, halves = (np.concatenate(x) for x in zip(*self.gone, strict=True))
        for a in range(0, len(self.table), SLICE):
            own = self.table[a : a + SLICE].astype(np.int64)
            here = (slots >= a) & (slots < a + SLICE)
            np.add.at(own, slots[here] - a, halves[here])
            yield own.ravel()


def learn(train: DataFrame, code: Code) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the counts (slot x 2) of bits over all training texts, and how often each cell (`cell_of`) came with each bit."""
    cells = 4 ** len(ORDERS) * CELLS ** len(ORDERS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_Counts(width) for width in code.orders.values()]
        came, one, most = np.zeros(2 * cells, np.int32), np.int32(1), 1 << 12
        empty = True
        for batch in pieces(batches, 1 << 20):
            empty = False
            buffer, first, last = lay_out(texts_of(batch))
            at, is_end = all_places(first, last)
            a = 0
            while a < len(at):
                here = at[a : a + most]
                low = int(here[0]) - PAD
                part = buffer[low : int(here[-1]) + 1]
                _, bit, slots = bits_at(code, part, contexts(code, part), here - low, is_end[a : a + most])
                cell = cell_of([counts.known(slot) for counts, slot in zip(held, slots, strict=True)])
                cell *= 2
                cell += bit
                np.add.at(came, cell, one)
                for counts, slot in zip(held, slots, strict=True):
                    counts.add(slot, bit)
                a, most = a + len(here), min(2 * most, MOST)
        if not empty:
            for k, counts in enumerate(held):
                yield from _sliced(k, counts.slices())
            yield from _sliced(len(held), (came[k : k + 2 * SLICE] for k in range(0, len(came), 2 * SLICE)))

    *tables, came = _summed(train, count, [1 << width for width in code.orders.values()] + [cells])
    return tables, came


def fit(docs: DataFrame) -> Mixer:
    """Learn from the documents whose crc32(doc_id) mod 5 is not 1."""
    train = documents(docs).where(crc_mod(5) != 1)
    code = Code(byte_counts(train))
    counts, found = learn(train, code)
    mixer = Mixer(code, [codes_of(c) for c in counts])
    cells = np.flatnonzero(found.any(1))
    mixer.fit(cells, found[cells])
    mixer.freeze()
    return mixer


class _Block:
    """The distinct tokens of some documents, in order of appearance."""

    def __init__(self) -> None:
        self.rows = _Numbers()
        self.rows[b" "] = 0  # the end of a text; a space is in no word
        self.docs: list[tuple] = []
        self.bytes = 0
        self.counts = np.zeros(1, np.int64)

    def add(self, doc_id, train: bool, bits: float, text: bytes) -> None:
        words = text.translate(LOWER).split()
        numbers = np.fromiter(map(self.rows.__getitem__, words), np.int32, len(words))
        if len(self.rows) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(max(len(self.rows), len(self.counts)), np.int64)])
        if train:
            self.counts[0] += 1
            self.counts[: len(self.rows)] += np.bincount(numbers, minlength=len(self.rows)) if len(words) * 8 > len(self.rows) else 0
            if len(words) * 8 <= len(self.rows):
                np.add.at(self.counts, numbers, 1)
        self.docs.append((doc_id, train, bits, len(text), len(words) + 1, numbers.tobytes()))
        self.bytes += len(text)


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


_ROWS = "block long, kind string, hash long, number int, n long, doc_id long, train boolean, bits double, n_bytes long, n_tokens long, numbers binary"


def score(docs: DataFrame, model: Mixer, block_bytes: int = 32 << 20) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, bits, n_bytes, bits_per_byte."""
    import xxhash

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = [x.split()[0] for x in _ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, number, block = shared.value, TaskContext.get().partitionId() << 24, _Block()

        def flush() -> Iterator[pa.RecordBatch]:
            n = len(block.rows)
            hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(w, 42) for w in block.rows]), ">i8").astype(np.int64)
            none = lambda kind, k: pa.nulls(k, kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(["token"] * n), pa.array(hashes), pa.array(np.arange(n, dtype=np.int32)), pa.array(block.counts[:n]), none(pa.int64(), n), none(pa.bool_(), n), none(pa.float64(), n), none(pa.int64(), n), none(pa.int64(), n), none(pa.binary(), n)], names)
            for a in range(0, len(block.docs), 1000):
                part = block.docs[a : a + 1000]
                m = len(part)
                own = [pa.array([r[k] for r in part], kind) for k, kind in enumerate((pa.int64(), pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number)), pa.array(["doc"] * m), none(pa.int64(), m), none(pa.int32(), m), none(pa.int64(), m), *own], names)

        for batch in pieces(batches, 8 << 20):
            texts = texts_of(batch)
            bits = mixer.score(texts)
            for doc_id, train, b, text in zip(batch.column("doc_id").to_pylist(), batch.column("train").to_pylist(), bits.tolist(), texts, strict=True):
                block.add(doc_id, train, b, text)
            if block.bytes >= block_bytes:
                yield from flush()
                number, block = number + 1, _Block()
        if block.docs:
            yield from flush()

    seen = materialize(documents(docs).withColumn("train", crc_mod(5) != 1).mapInArrow(run, _ROWS), "lm-rows")
    tokens = seen.where("kind = 'token'").select("block", "hash", "number", "n")
    sums = materialize(tokens.groupBy("hash").agg(F.sum("n").alias("c")), "lm-totals")
    n, v = sums.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    totals = tokens.select(F.col("block").alias("of_block"), "hash", "number").join(sums, "hash").select("of_block", "number", "c")
    norm = log10(n + 0.5 * (v + 1))

    def base(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """left: the block's token totals; right: its documents."""
        c = np.zeros(left.num_rows, np.int64)
        c[left.column("number").to_numpy()] = left.column("c").to_numpy()
        logs, known = np.log10(c + 0.5), c > 0
        sums, hits = [], []
        for numbers in right.column("numbers"):
            k = np.frombuffer(numbers.as_py(), np.int32)
            sums.append(float(logs[k].sum() + logs[0]))
            hits.append(int(known[k].sum() + known[0]))
        n_tokens = right.column("n_tokens").to_numpy()
        return pa.table({"doc_id": right.column("doc_id"), "train": right.column("train"), "n_tokens": right.column("n_tokens"), "n_known": pa.array(hits, pa.int64()), "base_score": pa.array(np.array(sums) - n_tokens * norm), "bits": right.column("bits"), "n_bytes": right.column("n_bytes")})

    rows = seen.where("kind = 'doc'").select("block", "doc_id", "train", "bits", "n_bytes", "n_tokens", "numbers")
    based = totals.groupBy("of_block").cogroup(rows.groupBy("block"))
    got = based.applyInArrow(base, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, bits double, n_bytes long")
    return got.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "bits", "n_bytes", (F.col("bits") / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"))
