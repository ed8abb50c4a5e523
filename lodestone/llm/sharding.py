"""Shards of bounded bytes by extendible hashing, in DataFrame functions alone.

A row's key is a 60-bit hash of its doc_id and text. A shard is a prefix of bits; a shard of more bytes than the
limit whose rows have different hashes is split on one more bit, and only such a shard. The directory of a row
is thus the shortest prefix whose rows fit, so shards of different depths stand side by side.

Bytes are added up once by cell, a prefix a few bits finer than the expected depth, and the directory is made
from cells; only rows of cells that are still too large are looked at bit by bit. So the text is read once, and
what moves are numbers. A hot doc_id is no hot key, as its texts differ. Rows equal in doc_id and text can't be
told apart by bits: such copies, if they exceed the limit together, are dealt out by number into parts. One row
of more than the limit is a shard of its own.

Rows: a null doc_id or text counts as empty in the hash; a null text has no bytes. Each row is returned. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import _store

BITS = 60


@dataclass(frozen=True)
class Params:
    limit: int = 1 << 20  #: bytes of text
    finer: int = 4  #: bits by which cells are finer than shards of even size


PARAMS = Params()


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, h (60 bits) and bytes of each row."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), h.alias("h"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("bytes"))


def _depths(cells: DataFrame, low: int, high: int, params: Params) -> DataFrame:
    """cell and depth: on how many of the levels low to high the prefix of a cell is split.

    cells: cell (a prefix of ``high`` bits), bytes, least and most (hashes)."""
    at = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("level")).withColumn("prefix", _shift(F.col("cell"), F.lit(high) - F.col("level")))
    split = at.groupBy("level", "prefix").agg(F.sum("bytes").alias("b"), F.min("least").alias("x"), F.max("most").alias("y")).where((F.col("b") > params.limit) & (F.col("x") < F.col("y")))
    return at.select("cell", "level", "prefix").join(split.select("level", "prefix"), ["level", "prefix"], "left_semi").groupBy("cell").agg(F.count("*").cast("int").alias("depth"))


def _shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftright", x, by.cast("int"))


def assigned(docs: DataFrame, params: Params = PARAMS) -> DataFrame:
    """doc_id, h, bytes, depth and shard (the prefix in binary digits, and a part's number for equal rows) of each row."""
    with _store.Scratch(docs.sparkSession, "shards") as scratch:
        return _store.staged(_assigned(docs, params, scratch), "shards")


def _assigned(docs: DataFrame, params: Params, scratch: _store.Scratch) -> DataFrame:
    rows = scratch.staged(hashed(docs))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    fine = min(BITS, params.finer + max(0, math.ceil(math.log2(max(1, total) / params.limit))))
    with_cell = rows.withColumn("cell", _shift(F.col("h"), F.lit(BITS - fine)))
    cells = with_cell.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.min("h").alias("least"), F.max("h").alias("most"))
    depths = _depths(scratch.staged(cells), 0, fine, params)
    first = with_cell.join(depths, "cell", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    first = scratch.staged(first.drop("cell"))
    # cells that split on all their bits go on, by their distinct hashes
    on = first.where(F.col("depth") > fine) if fine < BITS else first.where(F.lit(False))
    single = on.groupBy(F.col("h").alias("cell")).agg(F.sum("bytes").alias("bytes")).select("cell", "bytes", F.col("cell").alias("least"), F.col("cell").alias("most"))
    more = _depths(single, min(fine + 1, BITS), BITS, params).withColumnRenamed("depth", "more").withColumnRenamed("cell", "h")
    out = first.join(more, "h", "left").withColumn("depth", F.col("depth") + F.coalesce("more", F.lit(0))).drop("more")
    bits = F.when(F.col("depth") > 0, F.lpad(F.bin(F.col("h")), BITS, "0").substr(F.lit(1), F.col("depth"))).otherwise("")
    out = scratch.staged(out.withColumn("bits", bits))
    # equal rows that exceed the limit together
    copies = out.groupBy("bits").agg(F.sum("bytes").alias("b"), F.min("h").alias("x"), F.max("h").alias("y"), F.count("*").alias("n"))
    copies = copies.where((F.col("b") > params.limit) & (F.col("x") == F.col("y")) & (F.col("n") > 1)).select("bits")
    each = F.greatest(F.floor(F.lit(params.limit) / F.greatest("bytes", F.lit(1))), F.lit(1))
    numbered = _numbered(scratch.staged(out.withColumn("at", F.spark_partition_id()).join(copies, "bits", "left_semi")))
    parts = numbered.withColumn("shard", F.concat("bits", F.lit("."), F.floor(F.col("number") / each).cast("string")))
    rest = out.join(copies, "bits", "left_anti").withColumn("shard", F.col("bits"))
    columns = ["doc_id", "h", "bytes", "depth", "shard"]
    return rest.select(columns).union(parts.select(columns))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with a number from 0 among those of equal h, which may change places: first by the partition they came from (at), then in it."""
    counts = rows.groupBy("h", "at").agg(F.count("*").alias("n"))
    before = counts.select("h", "at", (F.sum("n").over(Window.partitionBy("h").orderBy("at")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("h", "at").orderBy("doc_id")) - 1
    return rows.withColumn("inside", inside).join(before, ["h", "at"]).withColumn("number", F.col("before") + F.col("inside"))


def directory(assigned_rows: DataFrame) -> DataFrame:
    """shard, depth, rows and bytes of each shard."""
    return assigned_rows.groupBy("shard").agg(F.first("depth").alias("depth"), F.count("*").alias("rows"), F.sum("bytes").alias("shard_bytes"))


def with_totals(docs: DataFrame, params: Params = PARAMS) -> DataFrame:
    """doc_id, n_bytes, depth, shard and shard_bytes of each row."""
    rows = assigned(docs, params)
    totals = directory(rows).select("shard", "shard_bytes")
    return rows.join(totals, "shard").select("doc_id", F.col("bytes").alias("n_bytes"), "depth", "shard", "shard_bytes")
