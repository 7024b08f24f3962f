"""Large JSON feature collections, read by many tasks.

A collection is one JSON document, which a JSON reader gives to one task. Here Spark's text source cuts it at closing braces, so any byte range
of a file can be a task's. What a brace means hangs on whether it stands in a string and how deep: each piece tells both for a
start inside and outside of a string, the blocks of a file are chained by these few numbers, and pieces between two closings at the
features' depth are one feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import materialize, scratch


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _rise(text: Column) -> Column:
    """Opened minus closed braces and brackets; the pieces hold no closing brace, since they are cut there."""
    return _count(text, "{") + _count(text, "[") - _count(text, "]")


def _pieces(spark: SparkSession, path) -> DataFrame:
    """file, block, seq, value; rp: parity of quotes before the piece in its block; quotes; r0, r1: depth after the piece for a block that begins outside or inside a string."""
    raw = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    plain = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    string = '"[^"]*(?:"|$)'  # a whole one, or one that goes on in the next piece
    parts = raw.withColumn("plain", plain).withColumn("quotes", _count(F.col("plain"), '"'))
    # what stands outside of strings, if the piece begins outside (0) or inside (1) of one
    parts = parts.withColumns({"t0": F.regexp_replace("plain", string, " "), "t1": F.regexp_replace("plain", f'^[^"]*(?:"|$)|{string}', " ")})
    outside = lambda odd: _rise(F.col(f"t{odd}"))
    # the brace at the piece's end counts if it stands outside of strings
    parts = parts.withColumns({"d0": outside(0) - F.when(F.col("quotes") % 2 == 0, 1).otherwise(0), "d1": outside(1) - F.when(F.col("quotes") % 2 == 1, 1).otherwise(0)}).drop("plain", "t0", "t1")
    own = Window.partitionBy("file", "block").orderBy("seq")
    parts = parts.withColumn("rp", F.coalesce(F.sum("quotes").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumns({"r0": F.sum(F.when(F.col("rp") == 0, F.col("d0")).otherwise(F.col("d1"))).over(upto), "r1": F.sum(F.when(F.col("rp") == 0, F.col("d1")).otherwise(F.col("d0"))).over(upto)})
    return materialize(parts.drop("d0", "d1"), "pieces")


def feature_lines(spark: SparkSession, path) -> str:
    """Path of a folder of text files with one feature a line: every object of a collection's arrays that is of type Feature, or of none
    but with properties, from all files of path."""
    pieces = _pieces(spark, path)
    ends = pieces.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("p"), F.max_by("r0", "seq").alias("e0"), F.max_by("r1", "seq").alias("e1"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = ends.withColumn("s", sofar("p") % 2).withColumn("e", F.when(F.col("s") == 0, F.col("e0")).otherwise(F.col("e1")))
    starts = starts.withColumn("depth", sofar("e")).select("file", "block", "s", "depth")
    placed = pieces.join(starts, ["file", "block"]).withColumn("after", F.col("depth") + F.when(F.col("s") == 0, F.col("r0")).otherwise(F.col("r1")))
    placed = placed.withColumn("ends", ((F.col("s") + F.col("rp") + F.col("quotes")) % 2 == 0) & (F.col("after") == 2))
    counted = placed.groupBy("file", "block").agg(F.count_if("ends").alias("n")).withColumn("base", sofar("n")).select("file", "block", "base")
    own = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("inner", F.coalesce(F.sum(F.col("ends").cast("long")).over(own), F.lit(0))).join(counted, ["file", "block"])
    grouped = numbered.groupBy("file", (F.col("base") + F.col("inner")).alias("n")).agg(F.sort_array(F.collect_list(F.struct("block", "seq", "value"))).alias("p"), F.max("ends").alias("whole")).where("whole")
    text = F.concat(F.array_join(F.transform("p", lambda x: x["value"]), "}"), F.lit("}"))
    # before a feature stand a comma, or the collection's own members up to its array
    head = F.when(F.col("n") == 0, F.regexp_extract("text", r'(?s)^(?:\s*\{.*?"features"\s*:\s*\[)?[^{]*(\{.*)$', 1)).when(F.contains("text", F.lit("{")), F.substr("text", F.instr("text", "{"))).otherwise("")
    lines = grouped.select("n", text.alias("text")).select(head.alias("value")).select(F.when(F.col("value").rlike(r"[\r\n]"), F.regexp_replace("value", r"[\r\n]+", " ")).otherwise(F.col("value")).alias("value"))
    kind = F.get_json_object("value", "$.type")
    lines = lines.where((kind == "Feature") | (kind.isNull() & F.get_json_object("value", "$.properties").isNotNull()))
    out = scratch(spark, "features")
    lines.write.text(out)
    return out
