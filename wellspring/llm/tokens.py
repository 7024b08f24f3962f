"""Exact token ids at the speed of a lookup: texts are cut where the tokenizer's own pre-tokenizer always cuts, and
only cuts that were not met lately are encoded by the tokenizers library."""

from __future__ import annotations

import re
import unicodedata
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_INNER, _RUN = re.compile(r"(?<=\S) (?=\S)"), re.compile(r" \s")
#: Marks inside a batch: the next unit follows no space; between units; the end of a text. Texts that hold one are encoded by the library alone.
ALONE, BETWEEN, END = "\x00", "\x01", "\x02"
#: A cut at a line end that begins a word, so that "one.\nTwo" is two units.
_LINE, _LINE_CUT = re.compile(r"\.\n(?=[A-Za-z])"), ".\n" + BETWEEN + ALONE
#: Latin text, for which lower-casing and composing in Python and in the library are the same; a word of Latin letters is one piece (U+0130 has two letters in lower case).
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ‐-‧]*\\Z")
_LATIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ]+\\Z")
_SIGNS, _WORD = ".,;:!?\n", "^\\x00?[A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{12f}\\x{131}-\\x{24f}]+$"
#: The characters that byte-level BPE writes for bytes.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = dict(zip(_SHOWN + [b for b in range(256) if b not in _SHOWN], _SHOWN + [*range(256, 324)], strict=True))
#: (path, kind, end id) -> encoder, kept while the Python worker lives.
_ENCODERS: dict = {}


class _Units:
    """Units and their ids. Row k has length[k] ids from flat[first[k]] on; cut[k] of them stand before a sentence end (-1: none)."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.flat, self.first, self.length, self.cut = np.zeros(0, np.uint32), *(np.zeros(0, np.int64) for _ in range(3))

    def add(self, units: list[str], flat: np.ndarray, length: np.ndarray, cut: np.ndarray) -> None:
        self.rows.update(zip(units, range(len(self.rows), len(self.rows) + len(units)), strict=True))
        first = len(self.flat) + np.cumsum(length) - length
        self.flat, self.first, self.length, self.cut = (np.concatenate(x) for x in ((self.flat, flat), (self.first, first), (self.length, length), (self.cut, cut)))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids one after the other, length of each row, cut of each row)."""
        length = self.length[rows]
        return _gather(self.flat, self.first[rows], length), length, self.cut[rows]


def _gather(flat: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[first[k] : first[k] + length[k]] for each k, one after the other."""
    return flat[np.repeat(first - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]


class UnitEncoder:
    """Encodes many texts at once.

    kind "spaced" (byte-level BPE whose tokens may begin with a space): a unit is what follows a single space, and
    is encoded with it; a unit after ALONE is encoded as it is.
    kind "dropped" (white space only separates): a unit is what stands between spaces or line ends, in lower case.
    A Latin word with signs behind it is two units, since the word ends a piece there.
    An added token's string in a text is that token, as the library has it (ordinary text where the tokenizer's
    encode_special_tokens is set). end_id is appended to each text. Units are kept in two generations: when the younger
    has `most_units` it becomes the older one, which is dropped at the next turn; a unit met again moves to the younger.
    So the store follows the text and its memory is bounded.
    """

    def __init__(self, path: str, kind: str, end_id: int, most_units: int = 300_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.normalize = t.normalizer.normalize_str if t.normalizer else str
        self.pre, self.model = t.pre_tokenizer.pre_tokenize_str, t.model.tokenize
        self.kind, self.end_id, self.most_units = kind, end_id, most_units
        self.young, self.old = _Units(), _Units()
        found = t.get_added_tokens_decoder()
        assert not any(a.single_word or a.lstrip or a.rstrip or a.normalized for a in found.values()), "only added tokens that stand for just their own string are known"
        self.added = {a.content: (k, a.special) for k, a in found.items()}

    def _mark(self, text: str) -> str:
        """The text with BETWEEN between its units."""
        if self.kind == "dropped":
            if text.isascii():
                text = text.lower()
            elif _PLAIN.match(text):
                text = unicodedata.normalize("NFC", text).lower()
            return f"{text.replace(' ', BETWEEN).replace(chr(10), BETWEEN)}{BETWEEN}{END}"
        text = BETWEEN.join(_INNER.split(text)) if _RUN.search(text) else text.replace(" ", BETWEEN)
        return f"{ALONE}{_LINE.sub(_LINE_CUT, text)}{BETWEEN}{END}"

    def _pieces(self, text: str) -> list[int]:
        """Ids of a unit by all of the library's own steps."""
        return [x.id for y, _ in self.pre(self.normalize(text)) for x in self.model(y)]

    def _learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, lengths, cuts) of units that are new."""
        model, spaced = self.model, self.kind == "spaced"
        ids: list[int] = []
        bounds, cuts = [0], {}
        for u in units:
            alone = u[:1] == ALONE
            text = u[1:] if alone else u
            if text.isascii() and text.isalpha():
                if not spaced:
                    text = text.lower()
                ids += [x.id for x in model("\u0120" + text if spaced and not alone else text)]
            elif _LATIN.match(text):
                piece = (text if spaced else text.lower()).encode().decode("latin-1").translate(_BYTES)
                ids += [x.id for x in model("\u0120" + piece if spaced and not alone else piece)]
            elif text == END:
                ids.append(self.end_id)
            else:
                own = self._pieces(text if alone or not spaced else " " + text)
                ids += own
                if text[-1:] in (".", "!", "?", "\n"):
                    cuts[len(bounds) - 1] = len(own)
                elif "\n" in text:
                    cuts[len(bounds) - 1] = len(own) - len(self._pieces(text[text.rindex("\n") + 1 :]))
            bounds.append(len(ids))
        cut = np.full(len(units), -1)
        cut[list(cuts)] = list(cuts.values())
        return np.array(ids, np.uint32), np.diff(bounds), cut

    def _rows(self, units: list[str]) -> np.ndarray:
        """Rows of distinct units among the younger ones, to which all are brought."""
        known, older = self.young.rows, self.old.rows
        rows = np.fromiter(map(known.get, units, repeat(-1)), np.int64, len(units))
        if len(missing := np.flatnonzero(rows < 0)):
            unknown = [units[k] for k in missing.tolist()]
            found = np.fromiter(map(older.get, unknown, repeat(-1)), np.int64, len(unknown))
            # those of the older generation first, then the new ones
            order = np.argsort(found < 0, kind="stable")
            moved = int((found >= 0).sum())
            rows[missing[order]] = len(known) + np.arange(len(order))
            self.young.add([unknown[k] for k in order[:moved].tolist()], *self.old.take(found[order[:moved]]))
            new = [unknown[k] for k in order[moved:].tolist()]
            self.young.add(new, *self._learn(new))
        return rows

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids one after the other, number of ids of each text with its end, places of sentence ends among all ids)."""
        added = {c: k for c, (k, special) in self.added.items() if not (special and self.tokenizer.encode_special_tokens)}
        if not any(c in t for c in added for t in texts):
            return self._encode(texts)
        # what stands between added tokens is encoded by itself, as the library does; the token takes the place of its end
        longest = re.compile("(" + "|".join(re.escape(c) for c in sorted(added, key=len, reverse=True)) + ")")
        cut = [longest.split(t) for t in texts]
        ids, counts, ends = self._encode([x for c in cut for x in c[::2]])
        ids[np.cumsum(counts) - 1] = [k for c in cut for k in (*[added[x] for x in c[1::2]], self.end_id)]
        first = np.cumsum([0, *[(len(c) + 1) // 2 for c in cut[:-1]]])
        return ids, np.add.reduceat(counts, first), ends

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As encode, of texts without added tokens."""
        odd = [any(c in t for c in (ALONE, BETWEEN, END)) for t in texts]
        if any(odd):
            got = [self._alone(t) if o else self._encode([t]) for t, o in zip(texts, odd, strict=True)]
            before = np.cumsum([0, *[len(x[0]) for x in got[:-1]]])
            return np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]), np.concatenate([x[2] + b for x, b in zip(got, before, strict=True)])
        units = pc.split_pattern(pa.array([self._mark(t) for t in texts], pa.string()), BETWEEN)
        found = units.flatten().dictionary_encode()
        place = found.indices.to_numpy()
        ids, first, length, cut = self._distinct(found.dictionary)
        size, cut = length[place], cut[place]
        whole = np.concatenate([[0], np.cumsum(size)])
        return _gather(ids, first[place], size), np.diff(whole[units.offsets.to_numpy()]), (whole[:-1] + cut)[cut >= 0]

    def _distinct(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first of each unit's ids, their number, their sentence cut) of distinct units."""
        if len(self.young.rows) > self.most_units:
            self.old, self.young = self.young, _Units()
        words = pc.utf8_rtrim(units, _SIGNS)
        is_signed = pc.and_(pc.not_equal(pc.binary_length(words), pc.binary_length(units)), pc.match_substring_regex(words, _WORD))
        signed = np.flatnonzero(is_signed.to_numpy(zero_copy_only=False))
        at, mark = pa.array(signed), ALONE if self.kind == "spaced" else ""
        signs = [mark + u[len(w) :] for u, w in zip(_listed(units.take(at)), _listed(words.take(at)), strict=True)]
        parts = pa.concat_arrays([pc.if_else(is_signed, words, units), pa.array(signs, pa.string())]).dictionary_encode()
        ids, length, cut = self.young.take(self._rows(_listed(parts.dictionary)))
        first = np.cumsum(length) - length
        # two parts for each unit: itself or its word, and its signs or nothing
        part = parts.indices.to_numpy()
        n = len(units)
        firsts, lengths = np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64)
        firsts[:, 0], lengths[:, 0] = first[part[:n]], length[part[:n]]
        firsts[signed, 1], lengths[signed, 1] = first[part[n:]], length[part[n:]]
        cuts = cut[part[:n]]
        cuts[signed] = np.where(cut[part[n:]] >= 0, lengths[signed, 0] + cut[part[n:]], -1)
        size = lengths.sum(1)
        return _gather(ids, firsts.ravel(), lengths.ravel()), np.cumsum(size) - size, size, cuts

    def _alone(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A text that holds a mark, by the library alone."""
        ids = np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, self.end_id], np.uint32)
        return ids, np.array([len(ids)]), np.zeros(0, np.int64)


def _listed(column: pa.Array) -> list[str]:
    """The strings of a column, none of which holds BETWEEN."""
    if not len(column):
        return []
    return pc.binary_join(pa.ListArray.from_arrays([0, len(column)], column), BETWEEN)[0].as_py().split(BETWEEN)


def encoder(path: str, kind: str, end_id: int) -> UnitEncoder:
    """This worker's encoder for a tokenizer file."""
    if (key := (path, kind, end_id)) not in _ENCODERS:
        _ENCODERS[key] = UnitEncoder(path, kind, end_id)
    return _ENCODERS[key]
