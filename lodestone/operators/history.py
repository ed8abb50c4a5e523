"""Versions over time: values as of a date, latest versions, histories, and segments of a reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_as_of(versions: DataFrame, key: str, effective: str, tie: str, as_of: Column) -> DataFrame:
    """Each key's last version that is effective by as_of. An aggregation, so a key's history is never gathered."""
    rows = versions.where(F.col(effective) <= as_of)
    best = rows.groupBy(key).agg(F.max_by(F.struct(*versions.columns), F.struct(effective, tie)).alias("_row"))
    return best.select("_row.*")


def as_of_join(asked: DataFrame, versions: DataFrame, key: str, at: str, effective: str, tie: str, value: str) -> DataFrame:
    """For each row of asked the value that its key had at its moment; null before the first.

    Both sides go through one window over key and time, the asked rows behind versions of the same moment; so each
    side moves once, and no pairs are made.
    """
    v = versions.select(F.col(key), F.col(effective).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.col(value).alias("_v"), F.lit(None).cast(asked.select(F.struct("*")).schema[0].dataType).alias("_row"))
    q = asked.select(F.col(key), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(versions.schema[tie].dataType).alias("_tie"), F.lit(None).cast(versions.schema[value].dataType).alias("_v"), F.struct("*").alias("_row"))
    w = Window.partitionBy(key).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_side") == 0, F.struct("_v")), ignorenulls=True).over(w)
    return v.unionByName(q).withColumn("_last", last).where("_side = 1").select("_row.*", F.col("_last._v").alias("value_as_of"))


def full_history(versions: DataFrame, key: str, effective: str, tie: str, value: str) -> DataFrame:
    """Every version with its number, the previous value and the end of its validity."""
    w = Window.partitionBy(key).orderBy(effective, tie)
    return versions.select("*", F.row_number().over(w).alias("version"), F.lag(value).over(w).alias("previous"), F.lead(effective).over(w).alias("valid_to"))


def segments(rows: DataFrame, key: str, order: list[str], boundary: Column) -> DataFrame:
    """Numbers segments of each key's order: a new one at each boundary."""
    w = Window.partitionBy(key).orderBy(*order)
    flagged = rows.withColumn("_start", F.coalesce(boundary.cast("int"), F.lit(0)))
    return flagged.withColumn("segment", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def changed(column: str, key: str, order: list[str]) -> Column:
    """True on a key's first row and where the column differs from the row before."""
    w = Window.partitionBy(key).orderBy(*order)
    return ~F.col(column).eqNullSafe(F.lag(column).over(w)) | (F.row_number().over(w) == 1)


def renumbered(rows: DataFrame, key: str, order: list[str], name: str = "sequence_no") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
