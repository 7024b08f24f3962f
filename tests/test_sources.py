"""Readers, sinks and streams on small files."""

import json
import random
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F

from wellspring.sources import readers, sinks
from wellspring.streaming import refresh


def test_read_table_refuses_other_suffixes(spark, tmp_path):
    with pytest.raises(ValueError, match="suffix"):
        readers.read_table(spark, "x.json")
    sinks.write_table(spark.range(3), f"{tmp_path}/a.csv")
    assert readers.read_table(spark, f"{tmp_path}/a.csv").count() == 3


def test_raw_csv_keeps_text_and_drops_the_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Well API,Gas/Oil\n007,1.50\n".encode())
    got = readers.read_raw_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["well_api", "gas_oil"] and got.first()[:] == ("007", "1.50")
    (tmp_path / "b.csv").write_bytes("name\nPe\xf1a\n".encode("latin-1"))
    assert readers.read_raw_csv(spark, str(tmp_path / "b.csv"), "ISO-8859-1").first()[0] == "Peña"
    (tmp_path / "c.csv").write_bytes("\ufeffname,more\nJosé,2\n".encode())
    got = readers.read_raw_csv(spark, [str(tmp_path / x) for x in ("b.csv", "c.csv")])
    assert sorted((r.name, r.more) for r in got.collect()) == [("José", "2"), ("Peña", None)]


def test_manifested_files(spark, tmp_path):
    for p in ("p1", "p2"):
        (tmp_path / f"{p}.csv").write_text(f"gas\n{p[1]}\n")
    manifest = spark.createDataFrame([("p1.csv", "2020-01", "Unconventional"), ("p2.csv", "2020-02", "All")], "file string, period_id string, label string")
    got = readers.read_manifested(spark, manifest, str(tmp_path)).orderBy("gas").collect()
    assert [(r.gas, r.period_id) for r in got] == [("1", "2020-01"), ("2", "2020-02")]


def record(kind, body):
    return (bytes(0xF0 + int(c) for c in kind) + body).ljust(102, b"\x40")


def packed(n):
    return bytes.fromhex(f"{abs(n):09d}" + ("D" if n < 0 else "C"))


def zoned(text):
    return bytes(0xF0 + int(c) for c in text)


def test_mainframe(spark, tmp_path):
    # a root: gas code G, district, lease number; amounts with a sign, a bad digit and a month 13
    root = lambda district, lease: record("01", b"\xc7" + zoned(district) + zoned(lease))
    parts = [root("02", "000042"), record("15", packed(1) * 3), record("14", zoned("2103")), record("15", packed(123) + packed(-5) + packed(0)), root("03", "000042"), record("15", packed(9) * 3), record("14", zoned("9912")), record("15", packed(7) * 3), record("14", zoned("9913")), record("15", packed(8) * 3), record("14", zoned("4901")), record("15", bytes.fromhex("00000A123C") + packed(2) * 2)]
    (tmp_path / "m.bin").write_bytes(b"".join(parts))
    records = readers.read_mainframe(spark, str(tmp_path / "m.bin"))
    names = ("district", "rrc_id", "cycle_key", "production_year", "production_month", "gas_mcf", "gas_lift_mcf", "condensate_bbl")
    got = readers.mainframe_production(records).select(*names).collect()
    want = [("02", "000042", "2103", 2021, 3, 123, -5, 0), ("03", "000042", "4901", 2049, 1, 123, 2, 2), ("03", "000042", "9912", 1999, 12, 7, 7, 7)]
    assert sorted(tuple(r) for r in got) == want
    # the same when headers stand in another part than their records
    order = records.withColumn("part", (F.col("part") * 1000 + F.col("position")).cast("int")).withColumn("position", F.lit(0))
    assert sorted(tuple(r) for r in readers.mainframe_production(order).select(*names).collect()) == want


def test_mainframe_window_has_slim_rows(spark, tmp_path):
    body = lambda x: bytes.fromhex((x + "40" * 102)[:204])
    (tmp_path / "m.bin").write_bytes(body("F0F1C7F0F1F0F0F0F0F0F7") + body("F1F4F2F4F0F1") + body("F1F5000000012C"))
    got = readers.mainframe_production(readers.read_mainframe(spark, str(tmp_path / "m.bin")))
    assert [r.gas_mcf for r in got.collect()] == [12]
    sent = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line]
    assert len(sent) == 1 and "root_no" not in sent[0]


def test_mainframe_files_are_apart(spark, tmp_path):
    """What the first file's last root and cycle say doesn't hold in the second."""
    root = record("01", b"\xc7" + zoned("02") + zoned("000042"))
    (tmp_path / "a.bin").write_bytes(b"".join([root, record("14", zoned("2103")), record("15", packed(1) * 3)]))
    (tmp_path / "b.bin").write_bytes(b"".join([record("15", packed(9) * 3), record("14", zoned("2104")), record("15", packed(8) * 3), root, record("15", packed(7) * 3), record("14", zoned("2105")), record("15", packed(2) * 3)]))
    got = readers.mainframe_production(readers.read_mainframe(spark, str(tmp_path), batch=2)).select("cycle_key", "gas_mcf").collect()
    assert sorted(tuple(r) for r in got) == [("2103", 1), ("2105", 2)]


def test_collections_are_cut_anywhere(spark, tmp_path):
    """Small byte ranges, braces and quotes in texts, members before and after the features, other arrays of objects."""
    rng = random.Random(4)
    odd = ["}", "{", '"', "\\", "]", "[", "a", "é", "\n", ",", '"features": [', "x" * 50]
    features = [{"type": "Feature", "properties": {"k": i, "Some Text": "".join(rng.choice(odd) for _ in range(rng.randint(0, 40))), "inner": None}, "geometry": {"type": "Point", "coordinates": [i / 8, -i / 4]}} for i in range(300)]
    one = {"type": "FeatureCollection", "crs": {"a": {"b": [1, 2]}}, "features": features[:200], "links": [{"rel": "next", "type": "text"}, {"rel": "x"}], "n": {"z": 1}}
    two = {"features": features[200:]}
    for name, c in (("a", one), ("b", two), ("c", {"type": "FeatureCollection", "features": []})):
        (tmp_path / f"{name}.json").write_text(json.dumps(c, indent=rng.choice([None, 2]), ensure_ascii=False))
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("777b", had):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = readers.read_features(spark, str(tmp_path)).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", had)
        assert sorted((r.k, r.some_text, r.longitude, r.latitude) for r in got) == [(f["properties"]["k"], f["properties"]["Some Text"], *f["geometry"]["coordinates"]) for f in features]


def test_replacing_an_index(spark, tmp_path):
    path = f"{tmp_path}/index"
    assert sinks.index_version(spark, path) == 0
    assert sinks.replace_index(spark.range(3), path, 0) == 1
    old = sinks.read_index(spark, path)
    assert sinks.replace_index(spark.range(5), path, 1) == 2
    for stale in (0, 1):
        with pytest.raises(sinks.Conflict):
            sinks.replace_index(spark.range(9), path, stale)
    assert (old.count(), sinks.read_index(spark, path).count(), sinks.read_index(spark, path, 1).count()) == (3, 5, 3)


def test_upsert_stream_writes_batches_and_compacts(spark, tmp_path):
    path, key = f"{tmp_path}/catalog", ["id"]
    spark.range(1000).selectExpr("id", "0L as v").write.parquet(f"{tmp_path}/in")
    for i in range(1, 5):
        stream = spark.readStream.schema("id long, v long").parquet(f"{tmp_path}/in")
        refresh.upsert_stream(stream, path, key, f"{tmp_path}/p", buckets=2, compact_every=3).trigger(availableNow=True).start().awaitTermination()
        spark.sql(f"select {i}L as id, {i}L as v union all select {1000 + i}L, {i}L").write.mode("append").parquet(f"{tmp_path}/in")
        if i == 2:  # two batches so far: the second wrote its two rows, not the catalog
            assert spark.read.parquet(f"{path}/delta/v=1").count() == 2
            assert refresh.catalog(spark, path, key).count() == 1001
    got = {r.id: r.v for r in refresh.catalog(spark, path, key).collect()}
    assert len(got) == 1003 and (got[1], got[3], got[4], got[1003]) == (1, 3, 0, 3)
    # the third batch made a new base, and what it replaced is gone
    assert not (tmp_path / "catalog/delta/v=1").exists() and spark.read.parquet(f"{path}/base/v=2").count() == 1002
    # a replay changes nothing
    before = refresh._state(spark, path)
    shutil.rmtree(tmp_path / "p/commits")
    stream = spark.readStream.schema("id long, v long").parquet(f"{tmp_path}/in")
    refresh.upsert_stream(stream, path, key, f"{tmp_path}/p", buckets=2, compact_every=99).trigger(availableNow=True).start().awaitTermination()
    again = {r.id: r.v for r in refresh.catalog(spark, path, key).collect()}
    assert {k: v for k, v in again.items() if k not in (4, 1004)} == {k: v for k, v in got.items() if k not in (4, 1004)} and refresh._state(spark, path)[0] == before[0]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("Ref Table.csv", "Some Name,v\nx,1\n")
        z.writestr("note.txt", "hello")
    got = readers.archive_inventory(spark, f"{tmp_path}/*.zip").orderBy("member").collect()
    assert [(r.member, r.size) for r in got] == [("Ref Table.csv", 16), ("note.txt", 5)]
    tables = readers.archive_tables(spark, f"{tmp_path}/*.zip", f"{tmp_path}/scratch")
    assert list(tables) == ["ref_table"] and tables["ref_table"].first().some_name == "x"


def test_stream_deduplication(spark, tmp_path):
    schema = "id long, at timestamp"
    spark.sql("select 1L id, timestamp'2024-01-01 00:00:00' at union all select 1L, timestamp'2024-01-01 01:00:00' union all select 2L, timestamp'2024-01-01 00:00:00'").write.parquet(f"{tmp_path}/in")
    stream = refresh.first_seen(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "at", ["id"])
    stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("select count(*) from seen").first()[0] == 2


def test_pieces_are_told_without_arrays(spark, tmp_path, monkeypatch):
    """Quotes, escapes and depths of a piece come from its text alone: no array of its parts goes through lambda functions."""
    from wellspring.sources import collections

    (tmp_path / "a.json").write_text('{"a": "x\\"[{", "b": [{"c": "\\\\"}], "d')
    monkeypatch.setattr(collections, "materialize", lambda df, name: df)
    got = collections._pieces(spark, str(tmp_path / "a.json"))
    assert [(r.quotes, r.r0, r.r1) for r in got.orderBy("seq").collect()] == [(10, 2, 2), (1, 1, 1)]
    assert "lambda" not in got._jdf.queryExecution().toString()
