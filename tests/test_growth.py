"""What keeps jobs small: expressions of one length, rows in small parts, joins that send nothing through the driver."""

from __future__ import annotations

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import shared
from lodestone.operators import chunking, facts, sections, tables
from lodestone.sources import markup

TABLES = [
    {"rows": [{"cells": [{"text": "1. 투자구분", "colSpan": 2, "type": "HEADER"}, {"text": "신설"}]}, {"cells": [{"text": "투자금액(원)", "rowSpan": 2}, {"text": "자기자본"}, {"text": "7"}]}, {"cells": [{"text": " "}, {"text": "x"}]}]},
    {"rows": [{"cells": [{"text": "정정항목"}, {"text": "정정전"}, {"text": "정정후"}]}, {"cells": [{"text": "투자금액(원)"}, {"text": "1"}, {"text": "2", "nestedTables": [{"rows": [{"cells": [{"text": "in"}]}]}]}]}, {"cells": []}]},
    {"rows": [{"cells": [{"rowSpan": 0}]}]},
    {},
]


class Frame:
    """Stands for a frame; gives the function that a task would run."""

    def __getattr__(self, _):
        return lambda *a, **b: self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


@pytest.mark.parametrize("read", [tables.row_texts, tables.evidence, tables.corrections, tables.correction_starts, tables.table_chunks], ids=lambda f: f.__name__)
def test_rows_of_cells_read_as_cells_do(spark, read):
    made = spark.createDataFrame([(k, json.dumps(t)) for k, t in enumerate(TABLES)], "table_id long, table_json string")
    by_cell, by_row = (sorted(map(str, read(of(made)).collect())) for of in (tables.grid, tables.grid_rows))
    assert by_cell == by_row and by_row


def test_grids_come_in_small_parts():
    source = json.dumps({"rows": [{"cells": [{"text": "x"}] * 10}] * 100})
    batch = pa.record_batch({"table_id": pa.array(range(300), pa.int64()), "table_json": [source] * 300})
    frame = Frame()
    frame.schema = {"table_id": type("T", (), {"dataType": type("L", (), {"simpleString": lambda self: "bigint"})()})()}
    parts = list(tables.grid_rows(frame)([batch]))
    assert sum(p.num_rows for p in parts) == 30_000 and max(p.num_rows for p in parts) <= 2_100


def test_pages_come_in_small_parts(spark):
    source = "<h1>t</h1>" + "<p>some words</p>" * 20
    batch = pa.record_batch({"doc_id": pa.array(range(5_000), pa.int64()), "source": [source] * 5_000})
    parts = list(markup.blocks(Frame(), "html")([batch]))
    assert sum(p.num_rows for p in parts) == 5_000 * 21 and max(p.num_rows for p in parts) < 2_100


def test_chunks_come_in_small_parts(spark):
    batch = pa.record_batch({"doc_id": pa.array(range(500), pa.int64()), "sequence_no": [[1, 2]] * 500, "block_type": [["HEADING", "PARAGRAPH"]] * 500, "text": [["h", "words"]] * 500})
    parts = list(chunking.text_chunks(Frame())([batch]))
    assert sum(p.num_rows for p in parts) == 500 and max(p.num_rows for p in parts) <= 32
    assert parts[0].to_pylist()[0] == {"doc_id": 0, "sequence_no": 1, "headings": ["h"], "body": "words", "first_block": 2, "last_block": 2}


def test_reading_of_values_is_a_short_expression(spark):
    assert len(str(facts.normalized(F.col("k"), F.col("raw"), F.col("unit")))) < 20_000


def test_paths_send_nothing_through_the_driver(spark, monkeypatch):
    plans, staged = [], shared.Scratch.staged

    def seen(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(self, df)

    monkeypatch.setattr(shared.Scratch, "staged", seen)
    rows = spark.createDataFrame([(k, k // 2 if k else None, "t") for k in range(20)], "id long, parent long, title string")
    assert sections.paths(rows).where("error is null").count() == 20
    assert plans and not any("Broadcast" in p for p in plans)


def test_whole_grids_give_the_same_candidates(spark):
    made = spark.createDataFrame([(k, json.dumps(t)) for k, t in enumerate(TABLES)], "table_id long, table_json string")
    names = ["table_id", "path", "fact_key", "raw_value", "raw_unit", "row_index", "column_index"]
    by_cell, by_grid = (sorted(map(str, of.select(*names).collect())) for of in (facts.candidates(tables.grid(made)), facts.candidates_of(made)))
    assert by_cell == by_grid and len(by_cell) > 3


def test_verdicts_need_no_join_and_repeat_no_reading(spark):
    made = spark.createDataFrame([(k, json.dumps(t)) for k, t in enumerate(TABLES)], "table_id long, table_json string")
    found = facts.candidates_of(made)
    verdicts = facts.judged(found)
    plan = verdicts.where("verdict = 'VERIFIED'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("filter(rows") == 1
    told = {(r.table_id, r.fact_key): r for r in facts.gated(made, found).collect() if r.n_candidates}
    assert told == {(r.table_id, r.fact_key): r for r in verdicts.select(*next(iter(told.values())).asDict()).collect()}
