from __future__ import annotations

import json

from lodestone.operators import metrics
from lodestone.sources import markup

HTML = {
    1: "<h1>T</h1><table><tr><td>a<table><tr><td>bb<table><tr><th>c</th></tr></table></td><td>d</td></tr></table></td></tr><tr><td rowspan=2>e</td><td colspan=3>f</td></tr><tr><td>g</td></tr></table><p>ppp</p>",
    2: "<p>only text</p>",
    3: "<table></table>",
    4: "",
}


def parsed(spark):
    return markup.blocks(spark.createDataFrame(list(HTML.items()), "doc_id long, source string"), "html")


def test_counts_of_documents(spark):
    sections = spark.createDataFrame([(1, 1, "one"), (1, 3, None), (2, 2, "xy")], "doc_id long, level int, title string")
    rows = {r.doc_id: r.asDict() for r in metrics.of_documents(parsed(spark), sections).collect()}
    assert rows[1] == {
        "doc_id": 1, "n_blocks": 3, "n_headings": 1, "n_paragraphs": 1, "n_page_breaks": 0, "n_images": 0, "n_tables": 3, "n_nested_tables": 2,
        "n_rows": 5, "n_cells": 7, "n_sections": 2, "max_section_level": 3, "n_characters": 1 + 3 + len("abbcdefg") + 3,
    }
    assert (rows[2]["n_tables"], rows[2]["n_rows"], rows[2]["n_characters"], rows[2]["max_section_level"]) == (0, 0, 9 + 2, 2)
    assert (rows[3]["n_tables"], rows[3]["n_nested_tables"], rows[3]["n_rows"], rows[3]["n_cells"]) == (1, 0, 0, 0)
    assert metrics.of_documents(parsed(spark)).where("doc_id = 1").first().n_sections == 0


def test_sums_of_a_table_and_all_inside_it(spark):
    up = metrics.rolled_up(metrics.by_path(metrics.grids(parsed(spark))))
    got = {(r.doc_id, r.path): (r.depth, r.n_tables, r.n_rows, r.n_cells, r.n_characters) for r in up.collect()}
    one, two = "rows[0].cells[0].nestedTables[0].", "rows[0].cells[0].nestedTables[0].rows[0].cells[0].nestedTables[0]."
    assert got == {(1, ""): (0, 3, 5, 7, 8), (1, one): (1, 2, 2, 3, 4), (1, two): (2, 1, 1, 1, 1)}


def test_reconciled_counts(spark):
    docs = spark.createDataFrame(list(HTML.items()), "doc_id long, source string")
    counted = metrics.of_documents(parsed(spark)).where("doc_id <> 2")
    rows = metrics.reconciled(markup.structure_profile(docs, "html"), counted).collect()
    assert {r.doc_id for r in rows if not r.agrees} == set()
    assert {(r.metric, r.parsed) for r in rows if r.doc_id == 1} == {("tables", 3), ("nested_tables", 2), ("rows", 5), ("cells", 7)}
    short = counted.withColumn("n_cells", counted.n_cells - (counted.doc_id == 1).cast("int"))
    assert [(r.doc_id, r.metric, r.profiled, r.parsed) for r in metrics.reconciled(markup.structure_profile(docs, "html"), short).where("not agrees").collect()] == [(1, "cells", 7, 6)]


def test_what_a_filing_lacks(spark):
    sections = [(1, 0, metrics.CORRECTION, False), (1, 1, "body", True), (2, 0, metrics.CORRECTION, True), (3, 0, "body", False), (3, 1, metrics.CORRECTION, False), (4, 0, None, True)]
    made = spark.createDataFrame(sections, "doc_id long, position int, title string, has_table boolean")
    counted = spark.createDataFrame([(k, 1, 1, 1) for k in (1, 2, 3, 4)] + [(5, 0, 0, 0)], "doc_id long, n_tables int, n_cells int, n_characters int")
    got: dict[int, set] = {}
    for r in metrics.body_problems(counted, made).collect():
        got.setdefault(r.doc_id, set()).add(r.problem)
    assert got == {2: {"NO_BODY"}, 3: {"BODY_BEFORE_CORRECTION", "NO_TABLE_IN_BODY"}, 5: {"NO_SECTIONS", "NO_TABLES", "NO_CELLS", "NO_TEXT"}}


def test_text_that_looks_like_json(spark):
    table = {"rows": [{"cells": [{"type": "DATA", "text": 'say "rows": now', "nestedTables": []}]}]}
    rows = spark.createDataFrame([(1, 1, "TABLE", None, json.dumps(table))], "doc_id long, sequence_no int, block_type string, text string, table_json string")
    got = metrics.of_documents(rows).first()
    assert (got.n_tables, got.n_cells, got.n_characters) == (1, 1, 15)
