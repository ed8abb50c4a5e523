"""JSON lines with their numbers, however files are split among tasks.

A task reads a split of a file in order, so a line's number is its place in the split and how many lines the splits before
have. Both come from one count for each split; no line moves and no file is read by one task (compressed files aside, which
can't be split). Rows carry the split they are from; lines are counted again when the result is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources import files


def numbered(spark: SparkSession, path: str, across: bool = False) -> DataFrame:
    """file, line_no (from 1) and line of all lines, blank ones too. Spark's reader leaves out a file's byte order mark.

    across numbers the lines of all files as one, in the order of their names.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    splits = read.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("place").alias("base"))
    # a row for each split; those of one file, or of all, are summed up in order
    upto = (Window.orderBy("file", "start") if across else Window.partitionBy("file").orderBy("start")).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", "base", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    out = read.join(splits, ["file", "start"])
    return out.select("file", (F.col("before") + F.col("place") - F.col("base") + 1).alias("line_no"), F.col("value").alias("line"))


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    read = F.from_json("line", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return lines.withColumn("_row", read)


def line_problem(line: Column, row: Column) -> Column:
    """BLANK or MALFORMED, or null."""
    return F.when(F.trim(F.regexp_replace(line, r"\s", "")) == "", "BLANK").when(row.isNull() | row["_broken"].isNotNull(), "MALFORMED")


def manifest(spark: SparkSession, path: str, across: bool = False) -> DataFrame:
    """Filings with file, line_no and the first broken rule of each line: a blank or malformed line, or one of a filing's own."""
    rows = _parsed(numbered(spark, path, across), files.MANIFEST_SCHEMA)
    names = [c.split()[0] for c in files.MANIFEST_SCHEMA.split(", ")]
    flat = rows.select("file", "line_no", line_problem(F.col("line"), F.col("_row")).alias("_line"), *[F.col(f"_row.{n}").alias(n) for n in names])
    flat = flat.withColumn("rcept_dt", F.try_to_date("rcept_dt", "yyyyMMdd"))
    return flat.withColumn("problem", F.coalesce("_line", files.manifest_problem())).drop("_line")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """key, value, first_line and line_no of each line whose key an earlier line has (of one numbering)."""
    each = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])
    pairs = rows.select("line_no", F.explode(each).alias("x")).select("line_no", "x.*").where("value is not null")
    first = pairs.groupBy("key", "value").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n")).where("n > 1").drop("n")
    return pairs.join(first, ["key", "value"]).where("line_no > first_line").select("key", "value", "first_line", "line_no")
