"""Exact dedup, source divergence and hard negatives against brute force, on small tables with nulls, ties, repeats and clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from wellspring.llm import divergence, exact_dedup, hard_negatives


def equal_texts(rows):
    """doc_id, keep_id, group_size, kept, sha256 of (doc_id, text) rows, in one dictionary."""
    groups = defaultdict(list)
    for place, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append((doc_id is None, doc_id or 0, place))
    out = []
    for text, members in groups.items():
        first = min(members)
        for m in members:
            out.append((None if m[0] else m[1], None if first[0] else first[1], len(members), m == first, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(3)
    words = ["a", "b ", "\t", " ", "é", " \n ", "x\x0by", "\x1c"]
    rows = [(i, "".join(rng.choice(words) for _ in range(rng.randint(0, 4)))) for i in range(300)]
    rows += [(1000 + i, "the same text") for i in range(150)] + [(7, None), (8, ""), (9, " "), (None, "the same text"), (None, "alone"), (1000, "the  same\ttext")]
    return rows + [(2000, "x " * 50_000), (1999, "x\n" * 50_000), (5, rows[5][1]), (5, rows[5][1])]


@pytest.mark.parametrize("sizes", [{}, {"generation": 64, "capacity_bytes": 40, "capacity_rows": 3}])
def test_exact_dedup_is_as_by_dictionary(spark, copies, sizes):
    docs = spark.createDataFrame([(*r, 1, 2, "z") for r in copies], "doc_id long, text string, hash long, bucket int, rep string").repartition(3)
    got = [tuple(r) for r in exact_dedup.groups(docs, **sizes).collect()]
    told = lambda rows: sorted((repr(r[:3] + r[4:]) for r in rows))  # noqa: E731  which of two equal rows stays isn't told
    assert told(got) == told(equal_texts(copies))
    kept = [r for r in got if r[3]]
    assert len(kept) == len({r[4] for r in got}) == len({r[4] for r in kept})  # one row of each text
    assert all(r[0] == r[1] for r in kept)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_chains_tell_texts_of_one_hash_apart(spark, copies, monkeypatch):
    """With a hash of two values, all texts stand in two chains, and bytes alone decide."""
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda t: len(t) % 2)
    local = exact_dedup._local_pass(1 << 20)
    monkeypatch.setattr(exact_dedup, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    ids, texts = zip(*copies, strict=True)
    rows = pa.Table.from_batches(list(local([pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])]))).to_pylist()
    reps = sorted((r for r in rows if r["row"] == r["rep"]), key=lambda r: (r["hash"], r["rep"]))
    assert {r["hash"] for r in reps} == {0, 1}
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(reps), pa.int32()), *[pa.array([r[c] for r in reps]) for c in ("hash", "rep", "rows", "first_doc", "first_row", "sha256", "text")]], ["bucket", "hash", "rep", "rows", "first_doc", "first_row", "sha256", "text"])
    index = {r["rep"]: r for b in exact_dedup._chains([batch]) for r in b.to_pylist()}
    got = sorted(((r["doc_id"], index[r["rep"]]["keep_id"], index[r["rep"]]["group_size"], index[r["rep"]]["keep_row"] == r["row"], index[r["rep"]]["sha256"].hex()) for r in rows), key=repr)
    assert got == equal_texts(copies)
    assert max(r["place"] for r in index.values()) > 20


def test_directory_doubles_until_buckets_fit(spark):
    rng = np.random.default_rng(1)
    hashes = rng.integers(-(1 << 63), (1 << 63) - 1, 3000).tolist() + [123456789] * 2000  # one hash holds many rows
    starts, depth = exact_dedup.grow_directory(spark.createDataFrame([(h, 10) for h in hashes], "hash long, bytes long"), 1 << 40, 50)
    assert starts[0] == 0 and (np.diff(starts.astype(object)) > 0).all() and depth >= 6
    own = np.searchsorted(starts, np.array(hashes, np.int64).view(np.uint64), "right") - 1
    for bucket in np.unique(own):
        inside = [h for h, b in zip(hashes, own, strict=True) if b == bucket]
        assert len(inside) <= 50 or len(set(inside)) == 1


def plain_audit(rows, least=10, ranks=10):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(upper))
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        gap = lambda a, b: (a - b) ** 2 // (a + b)
        q = share(sum((count[lang, s] for s in sources), Counter()))
        p = {s: share(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, values in (("pair", pairs), ("term", terms)):
                values.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(values, 1) if part == "pair" or i <= ranks]
    return sorted(out)


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(9)
    words = ["The", "of", "AND", "é", "Éa", "maison", "日本", "x1y", "don't", "@at", "ſ", "𝒳a"] + [f"w{chr(97 + i)}" for i in range(20)] + [chr(97 + i) * 3 for i in range(26)] * 2
    weight = [1 / (i + 1) for i in range(len(words))]
    rows = [(" ".join(rng.choices(words, weight, k=rng.randint(0, 40))), lang, f"s{rng.randint(0, 5)}") for lang in ("en", "de", None) for _ in range(60)]
    return rows + [(None, "en", "s0"), ("", "en", "empty"), ("alone", "xx", "s1"), ("alone", "xx", None), ("alone", "yy", "s1"), ("THE the " * 3000, "en", None), rows[3], rows[3]]


@pytest.mark.parametrize("sizes", [{}, {"block_terms": 1, "tile_sources": 2, "most_terms": 5}])
def test_divergence_is_as_by_plain_sums(spark, spoken, sizes):
    docs = spark.createDataFrame([(i, *r, 1, "z") for i, r in enumerate(spoken)], "doc_id long, text string, lang string, source string, n int, term string").repartition(3)
    assert sorted(map(tuple, divergence.audit(docs, **sizes).collect())) == plain_audit(spoken)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []


def test_long_texts_are_counted_in_slices():
    text = b"ab cde " * 1000 + b"f" * 5000
    assert b"".join(divergence._slices(text, 100)) == text
    assert Counter(w for s in divergence._slices(text, 100) for w in s.split()) == Counter(text.split())


def plain_negatives(rows, positives=5, negatives=10):
    """rows: (vec_id, vector, label); anchors: ids divisible by 10."""
    good = [(i, [int(np.floor(256 * float(x))) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for anchor in sorted({g[0] for g in good if g[0] % 10 == 0}):
        _, a, label = min((g for g in good if g[0] == anchor), key=lambda g: (g[2], g[1]))
        met = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i, lab) for i, v, lab in good if i != anchor and len(v) == len(a))
        for score, i, _ in [m for m in met if m[2] == label][:positives]:
            inside = [(j, -n) for n, j, lab in met if lab != label and 30 * -score <= 100 * -n <= 90 * -score][:negatives]
            out += [(anchor, i, rank, j, -score, n) for rank, (j, n) in enumerate(inside, 1)]
    return sorted(out)


def vectors(seed, n, scale):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.5, -0.3, 0.0, 0.001, 0.4, 1.0]) * scale for _ in range(4)], rng.randint(0, 2)) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [1.0, None, 0.0, 1.0], 1), (n + 3, [float("nan")] * 4, 1), (n + 4, [float("inf"), 0.0, 0.0, 0.0], 0), (None, [1.0] * 4, 1), (n + 5, [1.0] * 4, None)]
    return rows + [(n + 6, [1.0, 2.0], 1), (10 * n, [1.0, 2.0], 1), (n + 7, [0.5, 1.0], 0), (10 * n + 10, [0.0] * 4, 1), (20, [0.1] * 4, 0), (20, [0.1] * 4, 2), rows[3], rows[4]]


@pytest.mark.parametrize(("n", "scale", "sizes"), [(150, 1.0, {}), (150, 1.0, {"chunk": 20, "block": 4}), (60, 1e6, {"chunk": 10})])
def test_hard_negatives_are_as_by_full_sort(spark, n, scale, sizes):
    rows = vectors(4, n, scale)
    given = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, score int, chunk string").repartition(3)
    got = hard_negatives.mine(given, F.col("vec_id") % 10 == 0, F.col("label"), **sizes)
    want = plain_negatives(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 10 == 0, F.col("label")).collect() == []


def test_window_bounds_and_saturation():
    for score in (0, 1, 7, 99, 12345):
        low, high = hard_negatives.window(score, 30, 90, 100)
        inside = [n for n in range(-5, score + 5) if 30 * score <= 100 * n <= 90 * score]
        assert inside == list(range(low, high + 1))
    big = np.array([[1e300, 0.0]])
    assert hard_negatives.products(big, np.array([[1e300, 1.0], [-1e300, 1.0], [0.0, 1.0]])).tolist() == [[hard_negatives.MOST, -hard_negatives.MOST, 0]]
