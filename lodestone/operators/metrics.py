"""Counts of parsed filings: blocks, and tables with all that is inside them, rolled up over nesting paths; and their reconciliation.

A table's grid cells say it all: the path they are in, their row, whether they begin there, and their text. So tables, nested ones,
rows, cells and characters are sums over grids by path, and what a table holds is the sum over all paths that begin with its own.
Nothing is counted while parsing. A table without cells has no grid and counts as a table without rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import tables

#: What a path is made of.
STEP = r"rows\[\d+\]\.cells\[\d+\]\.nestedTables\[\d+\]\."
_SUMS = ("n_rows", "n_cells", "n_characters")


def grids(parsed: DataFrame) -> DataFrame:
    """Grid cells of the blocks (doc_id, sequence_no, block_type, table_json) that are tables, with doc_id and sequence_no as table_id."""
    rows = parsed.where("block_type = 'TABLE'").select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("sequence_no").cast("int").alias("sequence_no")).alias("key"), "table_json")
    made = tables.grid(rows.select(F.concat_ws(":", "key.doc_id", "key.sequence_no").alias("table_id"), "table_json"))
    at = F.split("table_id", ":")
    return made.withColumns({"doc_id": at[0].cast("long"), "sequence_no": at[1].cast("int")}).drop("table_id")


def by_path(cells: DataFrame) -> DataFrame:
    """doc_id, sequence_no, path, n_rows, n_cells, n_characters of each grid, without what is inside it."""
    own = F.col("is_origin")
    sums = [F.count_distinct("row_index").alias("n_rows"), F.count_if(own).alias("n_cells"), F.coalesce(F.sum(F.when(own, F.length("text"))), F.lit(0)).alias("n_characters")]
    return cells.where("error is null").groupBy("doc_id", "sequence_no", "path").agg(*sums)


def _steps(path: Column) -> Column:
    return F.regexp_extract_all(path, F.lit(STEP), F.lit(0))


def rolled_up(grid_sums: DataFrame) -> DataFrame:
    """doc_id, sequence_no, path, depth, n_tables and the sums of each grid with all grids inside it, however deep."""
    # a row for each grid around one and for itself: as many as it is deep, and one
    around = F.transform(F.sequence(F.lit(0), F.size(_steps(F.col("path")))), lambda k: F.array_join(F.slice(_steps(F.col("path")), 1, k), ""))
    rows = grid_sums.select("doc_id", "sequence_no", F.explode(around).alias("path"), *_SUMS)
    out = rows.groupBy("doc_id", "sequence_no", "path").agg(F.count("*").cast("int").alias("n_tables"), *[F.sum(c).alias(c) for c in _SUMS])
    return out.withColumn("depth", F.size(_steps(F.col("path"))))


def _inside(table_json: Column) -> Column:
    """How many tables a table holds, by its JSON: also those without cells."""
    return F.regexp_count(table_json, F.lit(r'"rows"\s*:')).cast("long")


def of_documents(parsed: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """One row a document: sections, max_section_level, blocks by type, tables, nested tables, rows, cells, images and characters.

    parsed are blocks (doc_id, sequence_no, block_type, text, table_json, status); sections, where the source has them, doc_id,
    level and title. Text in tables counts with the rest. A document without blocks has none of anything.
    """
    kinds = {"headings": "HEADING", "paragraphs": "PARAGRAPH", "page_breaks": "PAGE_BREAK", "images": "IMAGE"}
    count = [F.count_if(F.col("block_type") == k).alias(f"n_{name}") for name, k in kinds.items()]
    table = F.col("block_type") == "TABLE"
    found = _inside(F.col("table_json"))
    blocks = parsed.groupBy("doc_id").agg(F.count("block_type").alias("n_blocks"), *count, F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("_text"),
                                          F.coalesce(F.sum(F.when(table, found)), F.lit(0)).alias("n_tables"), F.coalesce(F.sum(F.when(table, found - 1)), F.lit(0)).alias("n_nested_tables"))
    inside = by_path(grids(parsed)).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in _SUMS])
    out = blocks.join(inside, "doc_id", "left")
    titles = F.lit(0)
    if sections is not None:
        own = sections.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.max("level").alias("max_section_level"), F.coalesce(F.sum(F.length("title")), F.lit(0)).alias("_titles"))
        out, titles = out.join(own, "doc_id", "left"), F.coalesce("_titles", F.lit(0))
    else:
        out = out.withColumns({"n_sections": F.lit(0).cast("long"), "max_section_level": F.lit(0)})
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_rows", "n_cells", "n_sections", "max_section_level")}
    return out.withColumns(zero | {"n_characters": F.coalesce("n_characters", F.lit(0)) + F.col("_text") + titles}).drop("_text", "_titles")


def reconciled(profile: DataFrame, counted: DataFrame) -> DataFrame:
    """doc_id, metric, profiled, parsed and agrees: the profile's tables, nested tables, rows and cells against the parse's.

    A document that only one of the two has is compared with nothing found.
    """
    tag = lambda *names: sum((F.coalesce(F.col("tags")[n], F.lit(0)) for n in names), F.lit(0))
    told = profile.select("doc_id", tag("table", "TABLE").alias("tables"), F.col("n_nested_tables").alias("nested_tables"), tag("tr", "TR").alias("rows"), tag("td", "th", "TD", "TH").alias("cells"))
    both = told.join(counted.select("doc_id", "n_tables", "n_nested_tables", "n_rows", "n_cells"), "doc_id", "full_outer")

    def pair(name: str) -> Column:
        return F.struct(F.lit(name).alias("metric"), *[F.coalesce(c, F.lit(0)).cast("long").alias(side) for side, c in (("profiled", name), ("parsed", f"n_{name}"))])

    each = both.select("doc_id", F.explode(F.array(*map(pair, ("tables", "nested_tables", "rows", "cells")))).alias("x")).select("doc_id", "x.*")
    return each.withColumn("agrees", F.col("profiled") == F.col("parsed"))


#: The title of the section that corrections stand in.
CORRECTION = "정정신고(보고)"


def body_problems(counted: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, problem: what a document lacks to be a filing. sections have doc_id, position, title and has_table (in the section itself)."""
    own = F.col("title").eqNullSafe(F.lit(CORRECTION))
    orders = sections.groupBy("doc_id").agg(F.max(F.when(own, F.col("position"))).alias("corrected"), F.min(F.when(~own, F.col("position"))).alias("body"), F.bool_or(~own & F.col("has_table")).alias("tabled"), F.count("*").alias("n"))
    both = counted.join(orders, "doc_id", "left")
    found = {
        "NO_SECTIONS": F.coalesce("n", F.lit(0)) == 0,
        "NO_TABLES": F.col("n_tables") == 0,
        "NO_CELLS": F.col("n_cells") == 0,
        "NO_TEXT": F.col("n_characters") == 0,
        "NO_BODY": F.col("corrected").isNotNull() & F.col("body").isNull(),
        "BODY_BEFORE_CORRECTION": F.col("body") <= F.col("corrected"),
        "NO_TABLE_IN_BODY": F.col("body").isNotNull() & ~F.coalesce("tabled", F.lit(False)),
    }
    names = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in found.items()]), lambda x: x.isNotNull())
    return both.select("doc_id", F.explode(names).alias("problem"))
