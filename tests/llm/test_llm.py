"""Operators of the training-data subpackage against brute force, on small tables with nulls, ties, repeats and clashing names."""

import random
import zlib
from math import exp, log, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.llm import components, context_mixing, decontaminate, language, licenses, neighbours, packing, quality, sharding, simhash, token_store
from wellspring.llm.common import scratch
from wellspring.llm.tokens import UnitEncoder

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = "the of and tion ing schön haus église maison niño casa reed ndsh erhe onth".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [prose(rng, rng.randint(1, 60)) for _ in range(60)]
    return out + [out[0], out[0], out[3], None, "", " ", "\n", "a  b   c \n \n", "x" * 5000, prose(rng, 4000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", i, "other", 7) for i, t in enumerate(texts)] + [(None, "no id here.", None, None, None, None, None), (5, texts[5], "en", "s", 1, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, start string, size long")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize(("name", "kind", "end"), [("byte_bpe_50k.json", "spaced", 0), ("word_bpe_49k.json", "dropped", 2)])
def test_units_give_the_tokenizers_ids(name, kind, end, texts):
    rng = random.Random(1)
    signs = " \n\t  ab.'sé́!?1  \x1c\x85ΣAİ-ñ"
    many = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [t or "" for t in texts] + ["a<|endoftext|>b", "one.\nTwo two, two.\n three\n\nfour.\n", "\x00a \x01b.", "a \x02 b", "\x01", "İstanbul ǅ ſ", "Ça, Çà; ÉTÉ!? a.b,c d"]
    e = UnitEncoder(public_tokenizers.path(name), kind, end, most_units=500)
    e.tokenizer.encode_special_tokens = True
    want = [x.ids + [end] for x in e.tokenizer.encode_batch(many, add_special_tokens=False)]
    for _ in range(2):  # the second time most units are forgotten again
        ids, counts, _ = e.encode(many)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want
    assert len(e.young.rows) + len(e.old.rows) < 20_000  # two generations and a batch


@pytest.mark.parametrize(("name", "kind", "end"), [("byte_bpe_50k.json", "spaced", 0), ("word_bpe_49k.json", "dropped", 2)])
def test_added_tokens_are_as_in_the_tokenizer_as_loaded(name, kind, end, texts):
    rng = random.Random(7)
    parts = [" ", "a", ".", "\n", "É x", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "|>", "<|ENDOFTEXT|>", "two  words. "]
    many = ["end <|endoftext|> next", "<|endoftext|>", *[t or "" for t in texts[:5]], *["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(500)]]
    e = UnitEncoder(public_tokenizers.path(name), kind, end)
    want = [x.ids + [end] for x in e.tokenizer.encode_batch(many, add_special_tokens=False)]
    ids, counts, _ = e.encode(many)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want


def test_best_cuts_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(30):
        at = np.unique(np.concatenate([[0], rng.integers(1, 60, 25), np.arange(0, 60, 7), [60]]))
        penalty = rng.integers(0, 9, len(at)).astype(float)
        window = 16

        def cost(cuts, at=at, penalty=penalty):
            by = dict(zip(at.tolist(), penalty, strict=True))
            return sum((0 if b - a in (2, 4, 8) else window - (b - a)) + by[b] + 1 for a, b in zip(cuts[:-1], cuts[1:], strict=True))

        best = {0: 0.0}
        for j in at[1:].tolist():
            best[j] = min(best[i] + (0 if j - i in (2, 4, 8) else window - (j - i)) + penalty[np.searchsorted(at, j)] + 1 for i in at.tolist() if 0 < j - i <= window)
        cuts = packing.best_cuts(at, penalty, window, (2, 4, 8))
        assert max(np.diff(cuts)) <= window
        assert cost(cuts) == pytest.approx(best[60])


def test_packing_holds_every_id_once(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(docs, path, window=64, lattice=16, segment=500).toPandas()
    e = UnitEncoder(path, "spaced", 0)
    for (doc, total), rows in got[got.doc_id.notna() & (got.doc_id != 5)].groupby(["doc_id", "doc_tokens"]):
        text = docs.where(F.col("doc_id") == int(doc)).first().text
        rows = rows.sort_values("start")
        assert b"".join(map(bytes, rows.ids)) == e.encode([text or ""])[0].astype("<u4").tobytes()
        assert rows.length.sum() == total
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *np.cumsum(rows.length)[:-1]]
        assert rows.length.sum() <= 64
    assert got.doc_id.isna().any()
    assert packing.pack(none, path).count() == 0


def brute_capacity(sizes, shards):
    def fits(c):
        n, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                n, room = n + 1, c
            room -= s
        return n <= shards

    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("directory", [4, 65536])
def test_cut_finds_the_smallest_capacity(spark, directory):
    rng = random.Random(directory)
    sizes = [rng.randint(1, 40) for _ in range(150)] + [300]
    ends = np.cumsum(sizes).tolist()
    got = sharding.cut(spark.createDataFrame([(e,) for e in ends], "ending long"), 7, ends[-1], max(sizes), directory)
    assert max(np.diff([0, *got])) == brute_capacity(sizes, 7)
    assert got[-1] == ends[-1] and set(got) <= set(ends)


def test_sharding(docs, none):
    got = sharding.shard(docs, 5).toPandas()
    assert len(got) == docs.count()
    for _, rows in got.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    rows = docs.select("doc_id", "text").toPandas()
    by_text = rows.dropna(subset="doc_id").merge(got[["doc_id", "shard"]].dropna(), on="doc_id").groupby("text").shard.nunique()
    assert by_text.max() == 1
    assert got[got.doc_id == 63].iloc[0][["size", "text_crc32"]].tolist() == [8, 0]
    assert sharding.shard(none, 5).count() == 0


def test_licenses(spark, none):
    texts = ["Under the MIT License. cc by nc cc by nc", "x " * 50 + licenses.TEMPLATES["mit"][0], "licensed under the apache license, version 2.0 you may", "free charge permission copy", None, "MIT license", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_base for r in got] == [3, 0, 1, 0, 0, 0, 0]
    assert (got[0].first_word, got[0].last_word, got[0].base_labels) == (0, 7, ["cc-by-nc", "mit"])
    assert (got[2].first_word, got[2].base_labels) == (3 - 1 + 1, ["apache-2"])
    assert "mit" in got[1].labels and got[1].spans[0].start == 50
    assert got[6].labels == ["bsd"] and got[3].labels == [] and got[4].n_words == 0
    assert licenses.scan(none).count() == 0


def test_base_phrases_are_those_of_a_word_by_word_search():
    rng = random.Random(21)
    parts = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "x", "Und\u00e9r", "MIT"]
    index = licenses.Index({}, 1)
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice([" ", "-", ", ", "\n", ""]) for _ in range(rng.randint(0, 80)))
        if rng.random() < 0.5:
            text += " Under the MIT license, cc by nc cc-by-nc apache license version 2"
        words, word = [], b""
        for c in text.encode() + b" ":
            if 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128:
                word += bytes([c]).lower() if c < 128 else bytes([c])
            elif word:
                words, word = [*words, word], b""
        hits = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.encode().split()]
        n_words, n_base, first, last, base, *_ = index.scan(text.encode())
        assert (n_words, n_base, first, last, base) == (len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), sorted({x for _, x in hits}))


def test_base_phrases_of_a_long_text_take_one_count(monkeypatch):
    import time

    began = time.process_time()
    assert licenses.Index({}, 1).scan(b"cc by nc " * 100_000)[1] == 100_000
    assert time.process_time() - began < 20


def test_gru_gradients():
    rng = np.random.default_rng(0)
    model = language.ByteGRU(["a", "b"], hidden=4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y, mask = rng.integers(0, 256, (7, 5)).astype(np.uint8), rng.integers(0, 2, 5), np.ones((7, 5))
    _, grads = model.gradients(x, y, mask)
    for key, at in (("Uf", (1, 2)), ("Ub", (0, 9)), ("V", (3, 1)), ("bf", (5,)), ("Wf", (int(x[3, 2]), 1))):
        eps = 1e-2
        kept = model.p[key][at]
        model.p[key][at] = kept + eps
        high = model.gradients(x, y, mask)[0]
        model.p[key][at] = kept - eps
        low = model.gradients(x, y, mask)[0]
        model.p[key][at] = kept
        assert grads[key][at] == pytest.approx((high - low) / (2 * eps), rel=0.05, abs=2e-4)


def test_language(spark, none):
    rng = random.Random(3)
    stems = {"de": ["sch", "ung", "keit", "ver", "ein"], "es": ["ción", "dad", "los", "que", "ñ"]}
    rows = [(i, "".join(rng.choice(stems[k]) + rng.choice(["", " "]) for _ in range(40)), k) for i in range(160) for k in [rng.choice(["de", "es"])]]
    rows += [(900, None, "de"), (901, "123 !?", "de"), (902, "", None), (None, "verein keit", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predict(df, language.fit(df, per_language=60)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    held = [(got[i].lang_pred == k) for i, _, k in rows[:160] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and np.mean(held) > 0.95
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows[:160])
    assert language.predict(none, language.fit(none)).count() == 0


def test_labels_are_those_of_a_plain_forward_pass():
    """One byte, one gate and one window at a time; whole texts, windows cut at 64 bytes, a text without letters between others."""
    rng = np.random.default_rng(4)
    model = language.ByteGRU(["a", "b", "c"], hidden=5, seed=3)
    texts = [b"a" + bytes(rng.integers(32, 256, n).astype(np.uint8)) for n in (0, 62, 63, 64, 500)] + [b"12 3", b"", b"abc" * 700]

    def squash(x):
        x = max(-3.0, min(3.0, x))
        return x * (27 + x * x) / (27 + 9 * x * x)

    def states(window, d):
        h, out = [0.0] * 5, []
        for byte in window if d == "f" else window[::-1]:
            a = np.array(h) @ model.p[f"U{d}"].astype(float)
            g = (model.p[f"W{d}"][byte] + model.p[f"b{d}"]).astype(float)
            new = []
            for i in range(5):
                z, r = (0.5 + 0.5 * squash((g[j] + a[j]) / 2) for j in (i, 5 + i))
                c = squash(g[10 + i] + r * a[10 + i])
                new.append((1 - z) * c + z * h[i])
            h = new
            out.append(h)
        return out if d == "f" else out[::-1]

    languages, scores = model.label(texts, at_once=7)
    for text, got, score in zip(texts, languages, scores, strict=True):
        total, letters = np.zeros(3), 0
        for at in range(0, len(text), 64):
            window = text[at : at + 64].ljust(64, b"\0")
            for byte, f, b in zip(window, states(window, "f"), states(window, "b"), strict=True):
                if language._LETTER[byte]:
                    logit = np.concatenate([f, b]) @ model.p["V"].astype(float) + model.p["c"]
                    p = np.exp(logit - logit.max())
                    total, letters = total + p / p.sum(), letters + 1
        if letters:
            assert (got, score) == (model.languages[int(total.argmax())], pytest.approx(total.max() / letters, abs=1e-5))
        else:
            assert (got, score) == ("und", 0)


def brute_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_licenses_finds_all_notices_of_a_text():
    """All notices one after the other, and one notice in a long text full of other licences' rare words, are found where they stand."""
    frequency = {w: 1 for body, _ in licenses.TEMPLATES.values() for w in body.encode().split()}
    index = licenses.Index(frequency, 1000)
    bodies = {label: body for label, (body, _) in licenses.TEMPLATES.items()}
    spans = index.scan(" some code here ".join(bodies.values()).encode())[7]
    at = 0
    for label, body in bodies.items():
        assert any(s[0] == label and abs(s[1] - at) <= 3 for s in spans), label
        at += len(body.split()) + 3
    for label, body in bodies.items():
        stray = [w for other in bodies for w in bodies[other].split() if w not in body.split()]
        text = " zz ".join(stray * 3) + " " + "zz " * 50 + body + " zz " * 50
        found = index.scan(text.encode())
        assert label in found[5] and any(s[0] == label and s[2] > len(stray) * 3 for s in found[7]), label


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(30)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = brute_components(pairs, {x for p in pairs for x in p})
    assert got == {n: r for n, r in want.items() if n in got} and all(n in got for a, b in pairs if a != b for n in (a, b))


def test_anchor_links_are_complete(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(200)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (1, 2, 3)]
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in base + near})
    got = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2).collect()}
    want = {(max(a, b), min(a, b)) for i, a in enumerate(fps) for b in fps[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert got == want and len(want) > 300


def test_near_duplicates(docs, none):
    import xxhash

    def fp(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.near_duplicates(docs).toPandas()
    rows = docs.select("doc_id", "text").collect()
    prints = {r.doc_id: fp(r.text) for r in rows}
    for r in got.itertuples():
        key = None if r.doc_id != r.doc_id else int(r.doc_id)
        assert r.fingerprint == format(prints[key], "016x")
    ids = [i for i in prints if i is not None]
    want = brute_components([(a, b) for a in ids for b in ids if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2], ids)
    known = got.dropna(subset="doc_id")
    assert {int(r.doc_id): int(r.component_id) for r in known.itertuples()} == want
    assert simhash.near_duplicates(none).count() == 0


def test_similar_groups_by_shingles(spark, none):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(300)] for _ in range(30)]
    rows = []
    for i, words in enumerate(base):
        rows.append((i, " ".join(words)))
        rows.append((100 + i, " ".join(words)))
        changed = list(words)
        for k in rng.sample(range(300), 3):
            changed[k] = rng.choice(vocabulary)
        rows.append((200 + i, " ".join(changed)))
    rows += [(None, "x y"), (None, "x y"), (None, rows[0][1]), (300, None), (301, ""), (302, "a b"), (302, "a b"), (302, "quite another text of the same id"), (303, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_hash", F.lit("x")).withColumn("rank", F.lit("x"))
    kept = simhash.keep_one(df).toPandas()
    ids = kept.doc_id.dropna().astype(int).tolist()
    assert sorted(ids) == [*range(30), 300, 302, 302]
    assert set(kept[kept.doc_id == 302].text) == {"a b", "quite another text of the same id"}
    assert kept[kept.doc_id.isna()].text.tolist() == ["x y"] and kept.columns.tolist() == ["doc_id", "text", "text_hash", "rank"]
    assert simhash.keep_one(none).count() == 0


def test_only_documents_alike_by_shingles_are_dropped(spark):
    """Texts with a stretch replaced, so that similarities lie on both sides of the bound: all groups are those of exact Jaccard links."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    rows = []
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(200)]
        rows.append((10 * i, " ".join(words)))
        for k, n in enumerate((8, 14, 20, 24, 30, 40), 1):
            at = rng.randint(0, 200 - n)
            rows.append((10 * i + k, " ".join(words[:at] + [rng.choice(vocabulary) for _ in range(n)] + words[at + n :])))
    sets = {i: set(simhash.shingle_set(t.encode(), 5).tolist()) for i, t in rows}
    groups = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    root = dict(zip(groups.doc_id, groups.root, strict=True))
    alike = {i: [j for j in sets if j // 10 == i // 10 and j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in sets}
    links = [(i, j) for i, near in alike.items() for j in near]
    assert np.mean([root[i] == root[j] for i, j in links]) > 0.95 and len(links) > 60
    for i in sets:  # whoever is in a group with others is alike to one of them
        assert alike[i] or sum(r == root[i] for r in root.values()) == 1
    assert any(not near for near in alike.values())


def test_similar_links_of_a_hot_anchor(spark, monkeypatch):
    """Rows that all share their anchors are never compared beyond two blocks at a time, and their components are those of all pairs."""
    rng = np.random.default_rng(5)
    size = 64 * simhash.WIDE
    chain = [np.zeros(size, np.uint8)]
    for _ in range(120):  # each row is near the one before; the ends are far apart
        bits = chain[-1].copy()
        bits[rng.choice(size, 12, replace=False)] ^= 1
        chain.append(bits)
    bits = np.array(chain + [b for c in chain[::40] for b in [c ^ (rng.random(size) < 0.3)] * 2], np.uint8)
    numbers = rng.permutation(len(bits)).tolist()
    rows = [(n, bytes(8 * simhash.TABLES), np.packbits(b).tobytes()) for n, b in zip(numbers, bits, strict=True)]
    df = spark.createDataFrame(rows, "number long, of_words binary, of_shingles binary")
    want = brute_components([(numbers[i], numbers[j]) for i in range(len(bits)) for j in range(i) if (bits[i] ^ bits[j]).sum() <= 15], numbers)
    sharing = {n for n in numbers if list(want.values()).count(want[n]) > 1}
    links = simhash.similar_links(df, 15, block=10, pivots=3)
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {n: want[n] for n in sharing}


def test_context_mixing(docs, none):
    from math import log10

    model = context_mixing.fit(docs)
    got = context_mixing.score(docs, model, block_bytes=3000).toPandas()
    rows = docs.select("doc_id", "text").collect()
    held = {r.doc_id: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows}
    tokens = [(r.doc_id, [*(r.text or "").encode().lower().split(), None]) for r in rows]
    counts: dict = {}
    for i, t in tokens:
        for x in t if not held[i] else ():
            counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted(round(sum(log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in t), 6) for _, t in tokens)
    assert sorted(got.base_score.round(6)) == pytest.approx(want)
    assert set(got.train_tokens) == {n} and sorted(got.n_tokens) == sorted(len(t) for _, t in tokens)
    assert sorted(got.n_known) == sorted(sum(x in counts for x in t) for _, t in tokens)
    assert (got.bits > 0).all() and np.isfinite(got.bits).all()
    assert context_mixing.score(none, context_mixing.fit(none)).count() == 0


def test_context_mixing_is_a_probability():
    """Over all texts of one byte or none, and longer ones, the probabilities add up to at most 1, and to nearly 1 with those of two bytes left open."""
    counts = np.ones((256, 257), np.int64)
    code = context_mixing.Code(counts)
    model = context_mixing.Mixer(code, [context_mixing.codes_of(np.zeros((1 << w, 2), np.int64)) for w in context_mixing.ORDERS.values()])
    model.freeze()
    ends = model.score([b"", *[bytes([b]) for b in range(256)]])
    assert 2.0 ** -ends[0] == pytest.approx(2.0 ** -code.length[256], rel=1e-3)
    assert (2.0**-ends).sum() < 1


def test_context_mixing_is_fitted_on_all_texts(spark):
    """Texts over 32 KiB teach the weights and the map, and each bit of every training text is counted once."""
    rng = random.Random(3)
    rows = [(i, prose(rng, 8000)) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert min(len(t) for _, t in rows) > 32768
    model = context_mixing.fit(df)
    assert (model.map > 0).any() and not np.allclose(model.weights, 0.3)
    bits = 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            buffer, first, last = context_mixing.lay_out([t.encode()])
            length, _, _ = context_mixing.bits_at(model.code, buffer, context_mixing.contexts(model.code, buffer), *context_mixing.all_places(first, last))
            bits += int(length.sum())
    assert model.map.sum() == bits


def test_context_mixing_adapts_within_short_texts():
    """Tables that know nothing give each bit of a text's first stride 1 bit; later strides of a short text must cost less, those of long texts all along."""
    code = context_mixing.Code(np.ones((256, 257), np.int64))
    model = context_mixing.Mixer(code, [context_mixing.codes_of(np.zeros((1 << w, 2), np.int64)) for w in context_mixing.ORDERS.values()])
    model.freeze()
    one, four, long = model.score([b"b" * 120, b"b" * 480, b"b" * 60000])
    assert four < 3.9 * one
    assert long < 0.9 * 500 * one  # only one cell is seen, so only the share of ones can be learned


def plain_score(model, text, stride=128, rate=0.05):
    """Bits of one text, bit by bit: contexts, hashes, mixing, map and updates after each stride in plain Python."""
    cm, mask = context_mixing, (1 << 64) - 1
    low = text.translate(cm.LOWER)

    def hashed(value, width):
        value = value * 0x9E3779B97F4A7C15 & mask
        value ^= value >> 31
        return (value * 0x9E3779B97F4A7C15 & mask) >> (64 - width)

    def slots(at):
        out = []
        for order, width in model.code.orders.items():
            if order == "word":
                begin = at
                while begin > max(0, at - cm.WORD) and text[begin - 1] > 32:
                    begin -= 1
                value = (sum((c + 1) * pow(cm._STEP, k, 1 << 64) for k, c in enumerate(low[begin:at])) + 77) & mask
            else:
                value = (int.from_bytes(text[max(0, at - order) : at].rjust(order, b"\0"), "little") + order) & mask
            out.append(hashed(value, width))
        return out

    weights, bias = model.weights.astype(float), model.bias.astype(float)
    hits, ones = np.full(model.gates * cm.BUCKETS, float(cm.PRIOR)), model.refined.astype(float) * cm.PRIOR
    total = 0.0
    for begin in range(0, len(text) + 1, stride):
        seen = []
        for at in range(begin, min(begin + stride, len(text) + 1)):
            symbol = (text[at - 1] if at else 0) * 257 + (text[at] if at < len(text) else cm.END)
            first = model.code.start[symbol]
            for step in model.code.steps[first : first + model.code.length[symbol]].tolist():
                codes = [int(t[h ^ (step >> 1)]) for t, h in zip(model.tables, slots(at), strict=True)]
                x = [cm._VALUE_OF[c] for c in codes]
                gate = 0
                for c in codes:
                    gate = gate * 4 + c % 4
                mixed = float(bias[gate] + sum(weights[k, gate] * float(v) for k, v in enumerate(x)))
                p = 1 / (1 + np.exp(-mixed))
                cell = gate * cm.BUCKETS + int(np.clip(np.floor(mixed * (cm.BUCKETS - 1) / (2 * cm.LIMIT) + cm.BUCKETS / 2), 0, cm.BUCKETS - 1))
                final = min(max((p + ones[cell] / hits[cell]) / 2, 1e-5), 1 - 1e-5)
                total -= np.log2(final if step & 1 else 1 - final)
                seen.append((gate, cell, step & 1, (step & 1) - p, [float(v) for v in x]))
        many = {g: sum(s[0] == g for s in seen) for g in {s[0] for s in seen}}
        for gate, cell, bit, error, x in seen:
            pace = rate / (many[gate] + 1) ** 0.5
            weights[:, gate] += pace * error * np.array(x)
            bias[gate] += pace * error
            hits[cell] += 1
            ones[cell] += bit
    return total


def test_context_mixing_scores_are_those_of_a_plain_loop(docs, texts):
    model = context_mixing.fit(docs)
    some = [t.encode() for t in [*(t for t in texts[:6] if t), "Zwölf Boxkämpfer\tjagen. " * 20, "x" * 300, ""]]
    got = model.score(some, group=4)
    assert got == pytest.approx([plain_score(model, t) for t in some], rel=2e-3)


def test_context_mixing_counts_of_16_bits_lose_nothing():
    rng = np.random.default_rng(6)
    counts, want = context_mixing._Counts(17), np.zeros((1 << 17, 2), np.int64)
    for _ in range(40):
        slot, bit = np.where(rng.random(8000) < 0.8, 5, rng.integers(0, 1 << 17, 8000)), (rng.random(8000) < 0.3).astype(np.int8)
        counts.known(slot)
        np.add.at(want, (slot, bit), 1)
        counts.add(slot.copy(), bit)
    assert counts.table.max() < 1 << 15 and want.max() > 1 << 17
    assert (np.concatenate(list(counts.slices())).reshape(-1, 2) == want).all()


def test_context_mixing_tables_grow():
    few, many = (context_mixing.Code(np.full((256, 257), n)) for n in (1, 4096))
    assert all(many.orders[o] > few.orders[o] == w for o, w in context_mixing.ORDERS.items())


def test_tiling():
    rng = random.Random(9)
    item = [rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(30)]
    shuffled = item[15:] + ["zzz"] + item[:15]
    index = decontaminate.BenchmarkIndex([(7, " ".join(item).encode()), (8, b"short one")], 4, 0.6)
    found = index.find(("intro words " + " ".join(shuffled).upper() + " tail short two").encode())
    assert [(f[0], f[2], f[4]) for f in found] == [(7, 30, 15)]
    assert [f[0] for f in index.find(b"a short one here")] == [8]
    assert index.find(" ".join(item[:10]).encode()) == []
    a, b = np.array([1, 2, 3, 1, 2, 3, 4]), np.array([1, 2, 3, 4, 9, 1, 2, 3])
    assert sorted(n for _, _, n in decontaminate.tile(a, b, 2)) == [3, 4]


def plain_tiles(item, text, least):
    """Greedy string tiling by comparing all pairs of places."""
    marked_a, marked_b, out = set(), set(), []
    while True:
        best = []
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and i + n not in marked_a and j + n not in marked_b:
                    n += 1
                if n >= least:
                    best.append((n, j, i))
        if not best:
            return out
        n = max(best)[0]
        for _, j, i in sorted(b for b in best if b[0] == n):
            if not (marked_a.intersection(range(i, i + n)) or marked_b.intersection(range(j, j + n))):
                marked_a.update(range(i, i + n))
                marked_b.update(range(j, j + n))
                out.append((i, j, n))


def test_tiling_is_that_of_all_pairs_of_places():
    rng = random.Random(22)
    for _ in range(60):
        item, text = (np.array([rng.randint(0, 3) for _ in range(rng.randint(0, n))], np.int64) for n in (25, 40))
        assert sorted(decontaminate.tile(item, text, 3)) == sorted(plain_tiles(item.tolist(), text.tolist(), 3))


def test_found_items_are_those_of_plain_tiling():
    rng = random.Random(23)
    words = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(4, 20)))) for k in range(15)]
    index = decontaminate.BenchmarkIndex([(k, t.encode()) for k, t in items], 3, 0.6)
    for _ in range(60):
        text = []
        for _ in range(4):
            source = rng.choice(items)[1].split()
            a = rng.randrange(len(source))
            text += source[a : a + rng.randint(1, 20)] + [rng.choice(words) for _ in range(rng.randint(0, 3))]
        want = {}
        for k, t in items:
            own = t.split()
            matched = sum(n for _, _, n in plain_tiles(own, text, 3))
            if matched >= 0.6 * len(own):
                want[k] = matched
        assert {f[0]: f[2] for f in index.find(" ".join(text).encode())} == want


def test_decontamination(spark, docs, none):
    rng = random.Random(10)
    items = [(k, " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(25))) for k in range(12)] + [(50, None), (51, ""), (0, "again the same id")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("tiles", F.lit(1))
    leaked = spark.createDataFrame([(1000 + k, f"lead in {t} and out") for k, t in items[:12]] + [(2000, " ".join(items[3][1].split()[:8]))], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(leaked)
    for block in (40, 500_000):
        got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(both, benchmark, block_words=block).collect()}
        assert got == {(1000 + k, k) for k in range(12)}
        kept = decontaminate.drop_leaks(both, benchmark, block_words=block)
        assert kept.count() == both.count() - 12
    assert decontaminate.find_leaks(none, benchmark).count() == 0
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0


def test_quality(spark, none):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(150):
        good = rng.random() < 0.7
        text = prose(rng, 60)
        rows.append((i, text if good else " | ".join(text.upper().split()) + "!!"))
        labels.append((i, int(good), 0))
    rows += [(500, None), (501, ""), (None, "abc"), (7, rows[7][1])]
    labels += [(9, None, 1), (7, labels[7][1], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, table)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(got[i].predicted == y for i, y, _ in labels[:150])
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[500].score == got[501].score
    assert quality.score(none, quality.fit(none, table.limit(0))).count() == 0
    # four labels of a document count four times, with one text of it, however often its id occurs
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality.BradleyTerry, "fit", lambda self, x, good, bad: seen.append((x, good, bad)) or self)
        few = spark.createDataFrame([(0, 1), (0, 1), (0, 0), (0, 1), (2, 0), (3, 1), (3, None), (None, 1)], "doc_id long, quality int")
        quality.fit(docs.unionByName(docs).unionByName(docs), few)
    x, good, bad = seen[0]
    ids = [i for i in (0, 2, 3) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert (good.tolist(), bad.tolist()) == ([{0: 3, 2: 0, 3: 1}[i] for i in ids], [{0: 1, 2: 1, 3: 0}[i] for i in ids]) and len(x) == len(ids)
    assert {r.score for r in quality.score(docs, quality.fit(docs, table.limit(0))).collect()} == {0.5}


def plain_quality_features(text):
    """The features by loops over bytes, words and lines."""
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    if not words:
        return [0.0] * (quality.SIZE + 1)

    def kind(b):
        for k, signs in enumerate(quality.CLASSES):
            if b in signs:
                return k
        return len(quality.CLASSES) + (1 if b >= 128 else 2 if b < 32 or b == 127 else 0)

    shares = [0.0] * 256
    for a, b in zip(text, text[1:], strict=False):
        shares[16 * kind(a) + kind(b)] += 1 / (len(text) - 1)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    more = [sqrt(1 - len(set(lines)) / len(lines)), sqrt(repeats / len(words)), log(len(set(words)) + 1) / log(len(words) + 1), log(len(text) / len(words)), log(len(words)) / 10, log(len(words) / len(lines)) / 10]
    return [sqrt(x) for x in shares] + more + [len(text) / (len(text) + quality.FEW)]


def test_quality_equals_plain_ranking(spark):
    """Features by loops; weights at which the pair loss of differences has no slope; the threshold where the share of label 0 lies; scores from these."""
    rng = random.Random(31)
    texts = ["".join(rng.choice("ab  cd,.AB1|é\n-\x7f\t;") for _ in range(rng.randint(0, 200))) for _ in range(120)]
    for t in texts:
        assert quality.features(t.encode()) == pytest.approx(plain_quality_features(t.encode()))
    labels = [(i, int(t.count("|") < t.count("a")), 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    used = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 != 1]
    x = np.array([plain_quality_features(texts[i].encode()) for i in used])
    y = np.array([labels[i][1] for i in used], float)
    mean, spread = x[:, :-1].mean(0), x[:, :-1].std(0) + 0.01
    centred = lambda v: (v[:-1] - mean) / spread * v[-1]
    z = np.array([centred(v) for v in x])
    draw = np.random.default_rng(0)
    better, worse = draw.choice(len(z), 20000, p=y / y.sum()), draw.choice(len(z), 20000, p=(1 - y) / (1 - y).sum())
    slope = -np.array(model.weights)  # of the log likelihood less half the squared weights
    for a, b in zip(better, worse, strict=True):
        d = z[a] - z[b]
        slope += d / (1 + exp(float(d @ model.weights)))
    assert np.abs(slope).max() < 0.05  # of 20,000 pairs
    latent = sorted(float(v @ model.weights) for v in z)
    below = sum(v < model.threshold for v in latent)
    assert abs(below - (1 - y).sum()) <= 1
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for i, t in enumerate(texts):
        want = 1 / (1 + exp(-float(centred(np.array(plain_quality_features(t.encode()))) @ model.weights - model.threshold)))
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_quality_learns_from_every_label(spark):
    """Labels beyond one group are all seen by the fit, also where a group has one kind only; the threshold is where the share of label 0 lies."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab  cd,.AB1|\n-;") for _ in range(rng.randint(5, 120))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = [(i, int(i >= 12 and t.count("|") < t.count("a"))) for i, t in enumerate(texts)]
    used = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 != 1]
    y = np.array([labels[i][1] for i in used])
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), 40)
    x = np.array([plain_quality_features(texts[i].encode()) for i in used])
    assert model.mean == pytest.approx(x[:, :-1].mean(0)) and model.scale == pytest.approx(x[:, :-1].std(0) + 0.01)
    latent = model._centred(x) @ model.weights
    assert abs((latent < model.threshold).sum() - (1 - y).sum()) <= 1
    whole = quality.BradleyTerry().fit(x, y.astype(float), 1.0 - y)  # all in one group
    assert np.corrcoef(latent, whole._centred(x) @ whole.weights)[0, 1] > 0.9
    # 2 labels 0 among 4 groups: some groups have none of them
    rare = spark.createDataFrame([(i, int(i not in used[:2])) for i in used], "doc_id long, quality int")
    few = quality.fit(docs, rare, 40)
    latent = few._centred(x) @ few.weights
    assert np.isfinite(few.weights).all() and latent[:2].max() < np.median(latent[2:])
    only = quality.fit(docs, spark.createDataFrame([(i, 1) for i in used], "doc_id long, quality int"), 40)
    assert not only.weights.any() and only.threshold == 0


def test_token_store(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_store.store_and_read(docs, path, container_bytes=700).toPandas()
    e = UnitEncoder(path, "dropped", 2)
    rows = sorted(((r.doc_id is not None, r.doc_id), r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id is not None)
    known = got.dropna(subset="doc_id").sort_values(["doc_id", "start"])
    assert [bytes(x) for x in known.ids] == [e.encode([t or ""])[0].astype("<u4").tobytes() for _, t in rows]
    start = int(got[got.doc_id.isna()].n_tokens.sum())
    assert known.start.tolist() == (start + np.concatenate([[0], np.cumsum(known.n_tokens)[:-1]])).tolist()
    assert token_store.store_and_read(none, path).count() == 0
    blob = token_store.write_container(2, b"", [4, None], [1, 2], [token_store._codecs(b"")[0].compress(x) for x in (b"\1\0", b"\2\0\3\0")])
    box = token_store.Container(blob, b"")
    assert box.ids(1).tolist() == [2, 3] and box.null.tolist() == [0, 1]
    with pytest.raises(ValueError, match="another dictionary"):
        token_store.Container(blob, b"other")


def test_token_store_of_long_texts_and_one_id(spark):
    """With long texts only there is a trained dictionary; rows of one doc_id come whole and gapless from many parts; ids beyond the width raise."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(9)
    words = ["river", "stone", "lantern", "Größe", "of", "the", "\U0001f600", "walks"]
    texts = [" ".join(rng.choice(words) for _ in range(900)) + f" {i}" for i in range(60)]
    rows = [(7, t) for t in texts[:40]] + [(None, t) for t in texts[40:]] + [(7, texts[0])] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    folder = scratch(spark, "long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # so few bytes would be one part
    try:
        token_store.write_store(df, folder, path, sample_bytes=1024, dictionary_bytes=2048, container_bytes=500)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"{folder}_dictionary").first().dictionary[:4] == b"\x37\xa4\x30\xec"
    assert spark.read.parquet(folder).select("part").distinct().count() > 1
    got = token_store.read_store(spark, folder).toPandas().sort_values("start")
    e = UnitEncoder(path, "dropped", 2)
    assert sorted(bytes(x) for x in got.ids) == sorted(e.encode([t])[0].astype("<u4").tobytes() for _, t in rows)
    assert got.start.tolist() == np.concatenate([[0], np.cumsum(got.n_tokens)[:-1]]).tolist()
    assert got.doc_id.isna().tolist() == [True] * 20 + [False] * 45
    with pytest.raises(ValueError, match="fit 2 bytes"):
        token_store._serial(np.array([5, 65536]), 2)


def test_neighbours(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    x[100] = x[101]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [1.0, None] * 8, 1), (5020, [1.0], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("leaf", F.lit("clash"))
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, k=20, sample=1000, chunk=100).toPandas()
    hits = 0
    for query, found in got.groupby("query_id"):
        scores = x @ x[query]
        scores[query] = -np.inf
        best = sorted(range(3000), key=lambda i: (-scores[i], i))[:20]
        found = found.sort_values("rank")
        assert found["rank"].tolist() == list(range(1, len(found) + 1))
        assert np.allclose(scores[found.vec_id], found.score)
        assert found.score.tolist() == sorted(found.score, reverse=True)
        hits += len(set(best) & set(found.vec_id))
    assert got.query_id.nunique() == 150 and hits >= 0.9 * 150 * 20
    # a query that occurs often is one query; equal vectors tie, and the smaller ids win
    same = df.where("vec_id < 200").unionByName(df.where("vec_id = 20")).unionByName(df.where("vec_id = 7").crossJoin(spark.range(9000, 9045).select("id")).select(F.col("id").alias("vec_id"), "embedding", "label", "leaf"))
    many = neighbours.search(same, F.col("vec_id") == 20, k=50, chunk=30).toPandas()
    assert many["rank"].tolist() == list(range(1, 51)) and many.vec_id.is_unique
    ties = many[many.score == many[many.vec_id == 7].score.iloc[0]].vec_id.tolist() if (many.vec_id == 7).any() else []
    assert ties == sorted(ties)
    few = df.where("vec_id < 5")
    assert neighbours.search(few, F.col("vec_id") == 0, k=20).count() == 4
    assert neighbours.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_neighbours_of_other_lengths(spark):
    """Vectors of a rarer length are searched among their own, all of them."""
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(300, 8)), rng.normal(size=(90, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v.tolist()) for i, v in enumerate(y)] + [(2000, [1.0, 2.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=20, sample=200, chunk=25).toPandas()
    for i in range(0, 90, 20):
        scores = y @ y[i]
        scores[i] = -np.inf
        assert got[got.query_id == 1000 + i].sort_values("rank").vec_id.tolist() == [1000 + j for j in sorted(range(90), key=lambda j: (-scores[j], j))[:20]]
    assert set(got.query_id) == {*range(0, 300, 20), *range(1000, 1090, 20)}


def test_neighbours_split_the_queries_of_a_leaf(spark, monkeypatch):
    """Small query blocks give the same rows as one block."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 8)))], "vec_id long, embedding array<double>")
    whole, split = (neighbours.search(df, F.col("vec_id") % 2 == 0, k=5, sample=200, chunk=100, query_block=n).orderBy("query_id", "rank").collect() for n in (10**6, 20))
    assert whole == split and len(whole) == 300 * 5
    repeated = df.where("vec_id < 50").unionByName(df.where("vec_id = 2").crossJoin(spark.range(200).select()))
    assert neighbours.search(repeated, F.col("vec_id") == 2, k=5, query_block=20).count() == 5


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    clean = [" ".join(rng.choice(vocabulary) for _ in range(80)) + "." for _ in range(60)]
    item = " ".join(rng.choice(vocabulary) + "q" for _ in range(30))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)] + [(100, clean[0], "en", "s", 1), (101, clean[1] + " " + item, "en", "s", 1), (102, None, "en", "s", 0), (103, "###!!! 123 ###", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert kept == set(range(60))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out.count()


def test_pipeline_of_an_empty_table_and_of_odd_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, rank string, label string"
    odd = [(None, None, None, None, None, "a", "b", None), (1, "", "en", "s", 0, "a", "b", "c"), (2, "word " * 30_000, "en", "s", 1, "a", "b", "c"), (2, "word " * 30_000, "en", "s", 1, "a", "b", "c"), (3, "the house and the reed", "en", "s", 1, None, None, None), (None, "the casa is here", None, None, None, None, None, None)]
    for name, rows in (("none", []), ("odd", odd)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).toPandas()
        # without labels all documents are good; those whose language isn't known go, of the repeated row one stays
        assert set(got.doc_id.dropna()) == (set() if name == "none" else {2, 3})
        assert got[got.doc_id == 2].length.sum() == (0 if name == "none" else got[got.doc_id == 2].doc_tokens.iloc[0])


def test_licence_versions_and_texts_are_told_apart(spark, none):
    """Each notice and text of a version gives its own label and no other version's; a family's notice alone gives no version."""
    index = licenses.Index({}, 1000)
    listed = [(label, body) for label, (body, _) in licenses.VERSIONS.items()] + [(label, body) for label, body, _ in licenses.TEXTS]
    rivals = [{"gpl-2", "gpl-3", "lgpl-2.1", "lgpl-3", "agpl-3"}, {"cc-by", "cc-by-nc", "cc-by-sa", "cc-by-nc-nd"}]
    for label, body in listed:
        for text in (body, "x y " * 500 + body.upper().replace(" ", "\n * ") + " z" * 500):
            found = index.scan(text.encode())[5]
            assert label in found, (label, found)
            for group in rivals:
                if label in group:
                    assert group.intersection(found) == {label}, (label, found)
    assert index.scan(licenses.TEMPLATES["gpl"][0].encode())[5] == ["gpl"]
    own = spark.createDataFrame([("house", "This recipe may be copied by every member of the house for tea only", ["every member of the house"], 1)] * 2, "label string, body string, must array<string>, text int")
    docs = spark.createDataFrame([(1, "a b c: this recipe may be copied by every member of the house, for tea only!"), (2, "every member of the house"), (3, None)], "doc_id long, text string")
    assert [r.labels for r in licenses.scan(docs, templates=own).orderBy("doc_id").collect()] == [["house"], [], []]
    assert licenses.scan(none, templates=own).count() == 0
    for wrong in ([("a", None, ["x"], 1)], [("a", "x y", ["z"], 1)], [(None, "x", None, 1)], [("a", " ", None, 1)]):
        with pytest.raises(ValueError):
            licenses.scan(docs, templates=spark.createDataFrame(wrong, own.schema))
