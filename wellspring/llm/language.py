"""Language identification: a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on the driver, on a bounded sample of labelled rows
(`per_language` documents of each language, of each at most `excerpt` bytes around a place that its hash picks; windows are drawn from all places of
them). It labels every byte of every text: a text is cut into windows of `window` bytes, many windows go through the
network at once, and a document's probabilities are the mean over all its letter positions. One pass, nothing shuffled.
The squashing function is x (27 + x^2) / (27 + 9 x^2), 1 from 3 on: near tanh, and quick in numpy.

Defined results: null text and text without a letter give `und` with score 0; so does every text if nothing could be
learned; repeated rows get equal results; a null doc_id is in no fold and held_out is false; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, documents, pieces, texts_of

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_NO_ASCII_LETTER = bytes(c for c in range(256) if not (65 <= c < 91 or 97 <= c < 123))


def has_letter(text: bytes) -> bool:
    if text.translate(None, _NO_ASCII_LETTER):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _squash(x: np.ndarray, slope: bool = False) -> np.ndarray:
    """In place x (27 + x^2) / (27 + 9 x^2), 1 beyond 3; with slope the derivative is given back."""
    np.maximum(x, -3, out=x)
    np.minimum(x, 3, out=x)
    s = x * x
    s += 3
    d = (1 / 9 - 8 / 3 / s + 16 / (s * s)).astype(x.dtype) if slope else x
    np.divide(8 / 3, s, out=s)
    s += 1 / 9
    x *= s
    return d


class ByteGRU:
    """Gates z (keep), r (reset) and candidate n for each direction: h' = (1 - z) n + z h."""

    def __init__(self, languages: list[str], hidden: int = 12, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.languages, self.hidden, k = languages, hidden, len(languages)
        draw = lambda *shape, by: (rng.normal(size=shape) * by).astype(np.float32)
        self.p = {"V": draw(2 * hidden, k, by=0.2), "c": np.zeros(k, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": draw(256, 3 * hidden, by=0.3), f"U{d}": draw(hidden, 3 * hidden, by=hidden**-0.5), f"b{d}": np.zeros(3 * hidden, np.float32)}

    def _run(self, x: np.ndarray, d: str):
        """Hidden states of one direction over x (bytes, T x B), and what backpropagation needs."""
        steps, batch = x.shape
        n = self.hidden
        table, u = self.p[f"W{d}"] + self.p[f"b{d}"], self.p[f"U{d}"]
        h = np.zeros((batch, n), np.float32)
        states, saved = np.empty((steps, batch, n), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = table[x[t]]
            a = h @ u
            gates = (g[:, : 2 * n] + a[:, : 2 * n]) / 2
            gate_slopes = _squash(gates, True) / 4
            gates += 1
            gates /= 2
            z, r = gates[:, :n], gates[:, n:]
            cand = g[:, 2 * n :] + r * a[:, 2 * n :]
            slopes = _squash(cand, True)
            before, h = h, cand + z * (h - cand)
            states[t] = h
            saved.append((t, before, z, r, cand, a[:, 2 * n :], gate_slopes[:, :n], gate_slopes[:, n:], slopes))
        return states, saved

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Of each language at each position (T x languages x B). Columns are windows, so that every part of a gate lies in one piece of memory."""
        steps, batch = x.shape
        n, k = self.hidden, len(self.languages)
        out = np.empty((steps, k, batch), np.float32)
        g, a, own, more = np.empty((3 * n, batch), np.float32), np.empty((3 * n, batch), np.float32), np.empty((n, batch), np.float32), np.empty((k, batch), np.float32)
        half = np.repeat(np.float32([0.5, 0.5, 1]), n)[:, None]
        for d in "fb":
            table = np.ascontiguousarray((self.p[f"W{d}"] + self.p[f"b{d}"]).T * half)
            u, v = np.ascontiguousarray(self.p[f"U{d}"].T * half), np.ascontiguousarray(self.p["V"][:n].T if d == "f" else self.p["V"][n:].T)
            h = np.zeros((n, batch), np.float32)
            gates, z, r, cand, inner = g[: 2 * n], g[:n], g[n : 2 * n], g[2 * n :], a[2 * n :]
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                np.take(table, x[t], axis=1, out=g, mode="clip")
                np.matmul(u, h, out=a)
                gates += a[: 2 * n]
                _squash(gates)
                gates += 1
                gates *= 0.5
                np.multiply(r, inner, out=own)
                cand += own
                _squash(cand)
                h -= cand
                h *= z
                h += cand
                if d == "f":
                    np.matmul(v, h, out=out[t])
                else:
                    np.matmul(v, h, out=more)
                    out[t] += more
        out += self.p["c"][:, None]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each language at each position (T x languages x B)."""
        out = self.logits(x)
        out -= out.max(1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(1, keepdims=True)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over masked positions and its gradients. x: T x B bytes; y: label of each column."""
        n = self.hidden
        kept = {d: self._run(x, d) for d in "fb"}
        both = np.concatenate([kept["f"][0], kept["b"][0]], 2)
        out = both @ self.p["V"] + self.p["c"]
        out -= out.max(2, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(2, keepdims=True)
        total = max(float(mask.sum()), 1)
        loss = -float((np.log(out[:, np.arange(x.shape[1]), y] + 1e-12) * mask).sum()) / total
        d_out = out
        d_out[:, np.arange(x.shape[1]), y] -= 1
        d_out *= (mask / total)[:, :, None]
        grads = {"V": np.einsum("tbi,tbk->ik", both, d_out), "c": d_out.sum((0, 1))}
        d_both = d_out @ self.p["V"].T
        for k, d in enumerate("fb"):
            u = self.p[f"U{d}"]
            d_w, d_u, d_h = np.zeros_like(self.p[f"W{d}"]), np.zeros_like(u), np.zeros((x.shape[1], n), np.float32)
            d_b = np.zeros(3 * n, np.float32)
            for t, before, z, r, cand, inner, z_slope, r_slope, slope in reversed(kept[d][1]):
                d_h = d_h + d_both[t, :, k * n : (k + 1) * n]
                d_cand = d_h * (1 - z) * slope
                d_z = d_h * (before - cand) * z_slope
                d_r = d_cand * inner * r_slope
                d_in = np.concatenate([d_z, d_r, d_cand], 1)
                d_rec = np.concatenate([d_z, d_r, d_cand * r], 1)
                np.add.at(d_w, x[t], d_in)
                d_b += d_in.sum(0)
                d_u += before.T @ d_rec
                d_h = d_h * z + d_rec @ u.T
            grads |= {f"W{d}": d_w, f"U{d}": d_u, f"b{d}": d_b}
        return loss, grads

    def train(self, texts: list[bytes], labels: list[int], steps: int = 260, window: int = 48, batch: int = 192, rate: float = 0.02, seed: int = 0) -> ByteGRU:
        """Adam on windows drawn alike from each language and from any place of its texts."""
        rng = np.random.default_rng(seed)
        by_label = [[t for t, y in zip(texts, labels, strict=True) if y == k] for k in range(len(self.languages))]
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            y = rng.integers(0, len(by_label), batch)
            x, mask = np.zeros((window, batch), np.uint8), np.zeros((window, batch), np.float32)
            for b, k in enumerate(y):
                text = by_label[k][rng.integers(len(by_label[k]))]
                at = int(rng.integers(max(1, len(text) - window + 1)))
                part = np.frombuffer(text[at : at + window], np.uint8)
                x[: len(part), b], mask[: len(part), b] = part, _LETTER[part]
            _, grads = self.gradients(x, y, mask)
            norm = sum(float((g * g).sum()) for g in grads.values()) ** 0.5
            pace = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
            for key, g in grads.items():
                g = g * min(1.0, 1 / (norm + 1e-9))
                m[key] = 0.9 * m[key] + 0.1 * g
                v[key] = 0.99 * v[key] + 0.01 * g * g
                self.p[key] = (self.p[key] - pace * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, texts: list[bytes], window: int = 64, at_once: int = 2048) -> tuple[list[str], np.ndarray]:
        """(language, pooled probability) of each text; every byte of every text goes through the network."""
        k = len(self.languages)
        sums, letters = np.zeros((len(texts), k)), np.zeros(len(texts))
        sizes = np.array([-(-len(t) // window) for t in texts])
        owner = np.repeat(np.arange(len(texts)), sizes)
        joined = np.frombuffer(b"".join(t + bytes(-len(t) % window) for t in texts), np.uint8).reshape(-1, window)
        for at in range(0, len(joined) if k else 0, at_once):
            x = np.ascontiguousarray(joined[at : at + at_once].T)
            mask = _LETTER[x]
            own = owner[at : at + at_once]
            p = self.probabilities(x)
            p *= mask[:, None, :]
            found = p.sum(0).T
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sums[own[first]] += np.add.reduceat(found, first)
            letters[own[first]] += np.add.reduceat(mask.sum(0), first)
        languages, scores = ["und"] * len(texts), np.zeros(len(texts))
        for i, text in enumerate(texts):
            if k and has_letter(text):
                if letters[i]:
                    best = int(sums[i].argmax())
                    languages[i], scores[i] = self.languages[best], min(1.0, sums[i][best] / letters[i])
        return languages, scores


def fit(docs: DataFrame, per_language: int = 300, excerpt: int = 2048, most_languages: int = 200) -> ByteGRU:
    """Learn from text and lang of documents whose crc32(doc_id) mod 4 is not 2: at most `per_language` rows (those with the
    smallest hash of doc_id) of each of the `most_languages` commonest languages, and of each row `excerpt` characters from
    a place that its hash picks. That bounds what comes to the driver, whatever repeats and however long texts are."""
    rows = documents(docs, "lang").where("lang is not null and doc_id is not null").where(crc_mod(4) != 2).where(F.length("text") > 0)
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    chances = counts.select("lang", (F.lit(1.5 * per_language) / F.col("count")).alias("chance"))
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - excerpt + 1, F.lit(1))).cast("int") + 1
    drawn = rows.select((hashed / (1 << 30)).alias("u"), "doc_id", F.substring("text", place, F.lit(excerpt)).alias("text"), "lang").join(F.broadcast(chances), "lang").where("u <= chance")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id", "text"))
    by: dict[str, list[bytes]] = {}
    for r in drawn.withColumn("__rank", first).where(F.col("__rank") <= per_language).select("lang", "text").orderBy("lang", "__rank").collect():
        text = r.text.encode()
        if has_letter(text):
            by.setdefault(r.lang, []).append(text)
    languages = sorted(by)
    model = ByteGRU(languages)
    if languages:
        model.train([t for k in languages for t in by[k]], [i for i, k in enumerate(languages) for _ in by[k]])
    return model


def predict(docs: DataFrame, model: ByteGRU) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2 << 20):
            languages, scores = model.label(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    got = documents(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return got.select("doc_id", (crc_mod(4) == 2).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, model: ByteGRU, least: float = 0.4) -> DataFrame:
    """The rows of docs, all columns, whose language is known with a pooled probability of `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2 << 20):
            languages, scores = model.label(texts_of(batch))
            yield batch.filter(pa.array([k != "und" and s >= least for k, s in zip(languages, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
