"""Paths of sections in their trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import shared


def paths(nodes: DataFrame, glue: str = " > ") -> DataFrame:
    """id, path, level and error of a forest (id, parent, title), however deep.

    Blank titles are left out of paths. A node under a parent that isn't there is a MISSING_PARENT, one on or under a
    circle a CYCLE; neither has a path. Each round doubles the length of the pieces of path that nodes know, so there are
    as many rounds as the logarithm of the depth; a round that settles no further node leaves circles alone. ids are unique.
    Both sides of each join are as long as the forest, so neither is sent through the driver.
    """
    with shared.Scratch(nodes.sparkSession, "sections") as scratch:
        known = nodes.select(F.col("id").alias("up")).distinct()
        own = F.when(F.trim("title") != "", F.array("title")).otherwise(F.array().cast("array<string>"))
        rows = nodes.select("id", "parent", own.alias("parts"), F.lit(1).alias("level"))
        rows = rows.join(known.hint("merge"), rows["parent"] == known["up"], "left").withColumn("missing", F.col("parent").isNotNull() & F.col("up").isNull())
        rows, before = scratch.staged(rows.select("id", "up", "parts", "level", "missing")), None
        while (left := rows.where("up is not null").count()) and left != before:
            above = rows.select(F.col("id").alias("up"), F.struct(F.col("up").alias("next"), "parts", "level", "missing").alias("above"))
            joined = rows.join(above.hint("merge"), "up", "left")
            on = F.col("above").isNotNull()
            rows = scratch.staged(
                joined.select(
                    "id",
                    F.when(on, F.col("above.next")).alias("up"),
                    F.when(on, F.concat("above.parts", "parts")).otherwise(F.col("parts")).alias("parts"),
                    F.when(on, F.col("above.level") + F.col("level")).otherwise(F.col("level")).alias("level"),
                    F.when(on, F.col("above.missing") | F.col("missing")).otherwise(F.col("missing")).alias("missing"),
                )
            )
            before = left
        error = F.when(F.col("up").isNotNull(), "CYCLE").when(F.col("missing"), "MISSING_PARENT")
        out = rows.select("id", F.when(error.isNull(), F.array_join("parts", glue)).alias("path"), F.when(error.isNull(), F.col("level")).alias("level"), error.alias("error"))
        return shared.staged(out, "section-paths")
