"""Identity of paths: safe relative paths, names that differ only in their Unicode form, and what a manifest's path stands for.

A name may be composed or not (한 as one character or as three), by the system that made it. Paths are the same if their segments
are in canonical composition. Folders of one parent whose names are the same so are a collision: all of them are told, and no path
through them is resolved. All of it is joins and aggregations over the prefixes of paths, which are as many as a path is deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.files import nfc


def path_problem(path: Column) -> Column:
    """Why a path isn't safe and relative, or null: BLANK, ABSOLUTE, SEPARATOR (backslash or NUL), SEGMENT (blank, . or ..)."""
    text = F.trim(F.coalesce(path, F.lit("")))
    segments = F.split(text, "/", -1)
    return (
        F.when(text == "", "BLANK")
        .when(text.startswith("/") | text.startswith("\\") | text.rlike("^[A-Za-z]:"), "ABSOLUTE")
        .when((F.instr(text, "\\") > 0) | (F.instr(text, "\0") > 0), "SEPARATOR")
        .when(F.exists(segments, lambda s: (F.trim(s) == "") | s.isin(".", "..")), "SEGMENT")
    )


def _prefixes(path: Column) -> Column:
    """depth (from 1) and prefix of each folder on the way, and of the path itself."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("prefix")))


def folders(files: DataFrame) -> DataFrame:
    """folder, parent, name and same (the name composed) of each folder that the files' paths (safe ones) go through."""
    rows = files.where(path_problem(F.col("path")).isNull()).select(F.explode(_prefixes(F.trim("path"))).alias("p"), F.size(F.split(F.trim("path"), "/", -1)).alias("n"))
    found = rows.where("p.depth < n").select(F.col("p.prefix").alias("folder")).distinct()
    name = F.substring_index("folder", "/", -1)
    parent = F.when(F.instr("folder", "/") > 0, F.expr("substring(folder, 1, length(folder) - length(substring_index(folder, '/', -1)) - 1)")).otherwise("")
    return found.select("folder", parent.alias("parent"), name.alias("name"), nfc(name).alias("same"))


def collisions(files: DataFrame) -> DataFrame:
    """parent, same and folders (sorted) of names that are one name when composed."""
    groups = folders(files).groupBy("parent", "same").agg(F.sort_array(F.collect_set("folder")).alias("folders"))
    return groups.where(F.size("folders") > 1)


def resolved(asked: DataFrame, files: DataFrame) -> DataFrame:
    """asked (with path) and folder (the real one), problem and missing (the first segment that isn't there).

    problem is one of path_problem, MISSING, or AMBIGUOUS where a folder on the way has a collision.
    """
    names = [c for c in asked.columns]
    rows = asked.withColumn("problem", path_problem(F.col("path"))).withColumn("_same", nfc(F.trim(F.coalesce("path", F.lit("")))))
    known = folders(files).select("folder", nfc(F.col("folder")).alias("_prefix"))
    known = known.groupBy("_prefix").agg(F.min("folder").alias("folder"), F.count("*").alias("_n"))
    distinct = rows.where("problem is null").select("_same").distinct().select("_same", F.explode(_prefixes(F.col("_same"))).alias("p")).select("_same", "p.depth", F.col("p.prefix").alias("_prefix"))
    met = distinct.join(known, "_prefix", "left")
    per = met.groupBy("_same").agg(F.max("depth").alias("_depth"), F.min(F.when(F.col("folder").isNull(), F.col("depth"))).alias("_gap"), F.max("_n").alias("_n"), F.max_by("folder", "depth").alias("_folder"))
    out = rows.join(per, "_same", "left")
    problem = F.coalesce("problem", F.when(F.col("_gap").isNotNull(), "MISSING").when(F.col("_n") > 1, "AMBIGUOUS"))
    missing = F.when(F.col("problem").isNull() & F.col("_gap").isNotNull(), F.try_element_at(F.split("_same", "/", -1), F.col("_gap").cast("int")))
    return out.select(*names, F.when(problem.isNull(), F.col("_folder")).alias("folder"), problem.alias("problem"), missing.alias("missing"))
