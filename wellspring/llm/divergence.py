"""Source divergence audit by count-level bitmaps.

Terms are counted for each (lang, source) group in one Arrow pass with a bounded dictionary, and summed by (lang, term); a language
keeps the terms that enough of its documents hold. A group's share of a term, p = 1 + floor(10^9 (count + 2) / (N + 2 V)), hangs on the
count alone, so the sum of f over all terms of a pair of groups is a sum over joint cells (count here, count there).

Each language's terms are dealt into blocks of bounded size. In a block, terms are numbered by falling frequency, so that equal
counts share words, and each (group, count) has a bitset over these numbers, of which the words with a bit are stored. Word by word
the bitsets of all groups are ANDed and their bits counted, which gives the joint cells of two counts above zero; each is
multiplied by its f. Cells with a zero aren't stored: they follow by complement from the bitsets' own bit counts and the
number of terms. A block sends one sum for each pair of groups. Where a language has many sources, they are
dealt into tiles, and a block's work is parted by pairs of tiles.

All arithmetic is exact: integers, and decimals where 10^9 times a count could pass a long.

Defined results: null text, lang and source are empty ones; a language without kept terms has value 0 for each pair; an empty
table gives no rows; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, documents, materialize, pieces, shuffle_parts, texts_of

#: Letters and bytes above ASCII stay, in lower case as far as A-Z goes; all else is a space.
TERM_BYTES = bytes(LOWER[b] if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
SHARE = 1_000_000_000
TILE = 1024


def _slices(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """The text in pieces of about `most` bytes, cut at spaces."""
    at = 0
    while at < len(text):
        end = at + most
        if end < len(text):
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _counted(most_terms: int):
    """Documents -> lang, source, term, n (occurrences) and docs, summed over what the task met since it last sent its dictionary."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], dict[bytes, list[int]]] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in groups.items():
                words = list(terms)
                for at in range(0, len(words), 1 << 16):
                    own = words[at : at + (1 << 16)]
                    n, docs = zip(*[terms[w] for w in own], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array([source] * len(own)), pa.array(own, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names)

        for batch in pieces(batches, 4 << 20):
            for text, lang, source in zip(texts_of(batch), batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
                terms = groups.setdefault((lang, source), {})
                own: dict[bytes, int] = {}
                for piece in _slices(text.translate(TERM_BYTES)):
                    for word in piece.split():
                        own[word] = own.get(word, 0) + 1
                for word, n in own.items():
                    entry = terms.get(word)
                    if entry is None:
                        terms[word] = [n, 1]
                    else:
                        entry[0] += n
                        entry[1] += 1
            if sum(map(len, groups.values())) >= most_terms:
                yield from send()
                groups = {}
        yield from send()

    return run


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)); 1 without terms."""
    long = lambda c: c.cast("decimal(20,0)")
    part = F.call_function("div", long(count + 2) * F.lit(SHARE).cast("decimal(10,0)"), long(F.greatest(total + 2 * terms, F.lit(1))))
    return F.when(terms > 0, 1 + part).otherwise(F.lit(1)).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most 10^9 + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _block_sums(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """One sum of f over the block's terms for each pair of groups of the key's two tiles. left: source, term, n, lang_n, p; right: source, tile, terms, p0."""
    lang, block, first, second = (k.as_py() for k in key)
    order = sorted(range(right.num_rows), key=lambda i: right.column("source")[i].as_py())
    names = [right.column("source")[i].as_py() for i in order]
    tiles, p0 = (right.column(c).to_numpy()[order] for c in ("tile", "p0"))
    place = {s: i for i, s in enumerate(names)}
    zeros = _gap(p0[:, None], p0[None, :])
    # zeros by complement: all of the language's terms at zero on both sides (once, in its first block), then each group's counts against a zero
    sums = zeros * (right.column("terms")[0].as_py() if block == 0 else 0)
    if left.num_rows:
        terms = left.column("term").combine_chunks().dictionary_encode()
        ids, size = terms.indices.to_numpy(), len(terms.dictionary)
        frequency = np.zeros(size, np.int64)
        frequency[ids] = left.column("lang_n").to_numpy()
        number = np.empty(size, np.int64)
        number[np.argsort(-frequency, kind="stable")] = np.arange(size)
        number = number[ids]
        group = np.array([place[s] for s in left.column("source").to_pylist()])
        n, p = left.column("n").to_numpy(), left.column("p").to_numpy()
        # the bitsets' words: one entry for each word, group and count with a bit
        by = np.lexsort((n, group, number >> 6))
        group, n, p, number = group[by], n[by], p[by], number[by]
        word = number >> 6
        begins = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (group[1:] != group[:-1]) | (n[1:] != n[:-1])]))
        bits = np.bitwise_or.reduceat(np.uint64(1) << (number & 63).astype(np.uint64), begins)
        word, group, p = word[begins], group[begins], p[begins]
        held = np.bitwise_count(bits).astype(np.int64)
        for at in range(0, len(p), TILE):
            own = slice(at, at + TILE)
            against = held[own, None] * (_gap(p[own, None], p0[None, :]) - zeros[group[own]])
            np.add.at(sums, group[own], against)
            np.add.at(sums.T, group[own], against)
        # joint cells of two counts above zero
        edges = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1], [True]]))
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            for a in range(begin, end, TILE):
                for b in range(a, end, TILE):
                    x, y = slice(a, min(a + TILE, end)), slice(b, min(b + TILE, end))
                    both = np.bitwise_count(bits[x, None] & bits[None, y])
                    i, j = np.nonzero(both)
                    cells = both[i, j].astype(np.int64)
                    i, j = i + a, j + b
                    below = group[i] < group[j]  # entries of a word are in the order of groups
                    i, j, cells = i[below], j[below], cells[below]
                    f = _gap(p[i], p[j]) - _gap(p[i], p0[group[j]]) - _gap(p0[group[i]], p[j]) + zeros[group[i], group[j]]
                    np.add.at(sums, (group[i], group[j]), cells * f)
    i, j = np.nonzero(np.triu(np.ones_like(sums, bool), 1))
    asked = (np.minimum(tiles[i], tiles[j]) == first) & (np.maximum(tiles[i], tiles[j]) == second)
    i, j = i[asked], j[asked]
    name = np.array(names, object)
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "a": pa.array(name[i], pa.string()), "b": pa.array(name[j], pa.string()), "value": pa.array(sums[i, j], pa.int64())})


def audit(docs: DataFrame, least_docs: int = 10, ranks: int = 10, block_terms: int = 1024, tile_sources: int = 512, most_terms: int = 1 << 19) -> DataFrame:
    """lang, source, part, item, value and rank: part `pair` has each other source of the language with its divergence, part `term` the
    `ranks` kept terms that the source uses most above the language's share."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    named = documents(docs, "lang", "source").withColumns({c: F.coalesce(c, F.lit("")) for c in ("lang", "source")})
    # dealt out once by (lang, term), which serves the sum by source, the documents by language and the filter
    counts = named.mapInArrow(_counted(most_terms), "lang string, source string, term string, n long, docs long")
    counts = counts.repartition(parts, "lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = counts.withColumns({"lang_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "first": F.min("source").over(of_term) == F.col("source")})
    kept = materialize(kept.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "first"), "terms")

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("firsts"))
    groups = named.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill(0, ["total", "firsts"])
    groups = materialize(groups, "groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("terms"), F.count("*").alias("sources"))
    # blocks get smaller where a language has many sources, so a block's rows stay bounded
    block_size = F.greatest(F.lit(64), F.least(F.lit(block_terms), F.floor(F.lit(1 << 18) / F.col("sources"))))
    langs = langs.withColumns({"blocks": F.greatest(F.lit(1), F.ceil(F.col("terms") / block_size)).cast("int"), "tiles": F.ceil(F.col("sources") / tile_sources).cast("int")})
    groups = materialize(groups.drop("firsts").join(langs, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")), "groups")

    shares = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    tiled = lambda df: df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"tile_a": F.least("tile", "other"), "tile_b": F.greatest("tile", "other")})
    left = tiled(shares.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))).select("lang", "block", "tile_a", "tile_b", "source", "term", "n", "lang_n", "p")
    right = tiled(groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))).select("lang", "block", "tile_a", "tile_b", "source", "tile", "terms", share(F.lit(0), F.col("total"), F.col("terms")).alias("p0"))
    keys = ("lang", "block", "tile_a", "tile_b")
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block_sums, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    terms = shares.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(terms.withColumn("rank", rank).where(F.col("rank") <= ranks))
