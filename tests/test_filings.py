from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from lodestone.functions import normalize
from lodestone.operators import calculation, facts, invariants, search, sections, tables
from lodestone.plans import question, tools
from lodestone.sources import files, markup


def grid_of(spark, *rows):
    made = {"rows": [{"cells": [{"type": "DATA", "text": t} for t in row]} for row in rows]}
    return spark.createDataFrame([(1, json.dumps(made, ensure_ascii=False))], "table_id long, table_json string")


def verdicts(spark, *rows):
    made = grid_of(spark, *rows)
    return facts.gated(made, facts.candidates(tables.grid(made)))


def test_each_definition_gets_one_verdict(spark):
    got = {r.fact_key: r.verdict for r in verdicts(spark, ("투자금액(원)", "100"), ("투자규모(원)", "100"), ("자기자본대비(%)", ""), ("자기자본대비(%)", "x"), ("투자목적", "확대"), ("자기자본", "5억원")).collect()}
    assert len(got) == len(facts.DEFINITIONS) == 16
    assert got["facility.amount"] == "AMBIGUOUS"  # two labels of one fact, though they agree
    assert got["facility.equity_ratio"] == "NOT_NORMALIZED"
    assert got["facility.purpose"] == "VERIFIED"
    assert got["facility.equity_amount"] == "NO_UNIT"  # the unit is asked for beside the value
    assert got["correction.end_date.after"] == "NO_CANDIDATE"


def test_labels_that_span_rows_count_where_they_begin(spark):
    cells = [[("투자금액(원)", 2), ("100", 1)], [("비고", 1), ("없음", 1)], [("투자목적", 1), ("확대", 3)], [("투자대상", 1)], [("자기자본(원)", 1), ("7", 1)]]
    made = {"rows": [{"cells": [{"type": "DATA", "text": t, "rowSpan": n} for t, n in row]} for row in cells]}
    table = spark.createDataFrame([(1, json.dumps(made, ensure_ascii=False))], "table_id long, table_json string")
    found = facts.candidates(tables.grid(table))
    assert {(r.fact_key, r.raw_value, r.row_index) for r in found.collect()} == {("facility.amount", "100", 0), ("facility.purpose", "확대", 2), ("facility.equity_amount", "7", 4)}
    got = {r.fact_key: (r.verdict, r.typed and r.typed.value) for r in facts.gated(table, found).collect()}
    assert got["facility.amount"] == ("VERIFIED", "100") and got["facility.target"] == ("NO_CANDIDATE", None)


def test_values_read_as_another_type_are_no_facts(spark):
    made = grid_of(spark, ("투자금액(원)", "100"), ("투자목적", "확대"))
    other = [(k, "TEXT" if k == "facility.amount" else kind, *rest) for k, kind, *rest in facts.DEFINITIONS]
    got = {r.fact_key: r.verdict for r in facts.gated(made, facts.candidates(tables.grid(made)), other).collect()}
    assert got["facility.amount"] == "OTHER_TYPE" and got["facility.purpose"] == "VERIFIED"


def test_facts_of_notes_and_corrections(spark):
    made = verdicts(spark, ("기타 투자판단과 관련한 중요사항", "- 투자금액 USD 1,118,534,000 (환율 1,263.1 KRW/USD)"), ("정정항목", "정정전", "정정후"), ("종료일", "2025-01-01", "2025년 6월 30일"))
    rows = {r.fact_key: r for r in facts.generated(made, spark.createDataFrame([(1, "20240102000001")], "table_id long, receipt_no string")).collect()}
    assert set(rows) == {"facility.amount.foreign_value", "facility.amount.currency_code", "facility.amount.disclosed_fx_rate", "correction.end_date.before", "correction.end_date.after"}
    assert rows["facility.amount.foreign_value"].raw_unit == rows["facility.amount.foreign_value"].unit == "USD"
    assert rows["facility.amount.currency_code"].text_value == "USD" and rows["facility.amount.currency_code"].currency is None
    assert rows["correction.end_date.after"].date_value == date(2025, 6, 30)
    again = {r.fact_key: r.fact_id for r in facts.generated(made, spark.createDataFrame([(1, "20240102000001")], "table_id long, receipt_no string")).collect()}
    assert again == {k: r.fact_id for k, r in rows.items()} and len(set(again.values())) == 5
    assert all(r.fact_id[14] == "3" and r.evidence_ids for r in rows.values())


def test_section_paths_of_deep_trees_circles_and_orphans(spark):
    rows = [(k, k - 1 if k else None, " " if k % 10 == 3 else f"t{k}") for k in range(150)]
    rows += [(200, 201, "a"), (201, 202, "b"), (202, 200, "c"), (203, 202, "d"), (300, 999, "e"), (301, 300, "f"), (400, 400, "g")]
    got = {r.id: (r.path, r.level, r.error) for r in sections.paths(spark.createDataFrame(rows, "id long, parent long, title string")).collect()}
    assert len(got) == len(rows)
    assert got[149] == (" > ".join(f"t{k}" for k in range(150) if k % 10 != 3), 150, None)
    assert {got[k] for k in (200, 201, 202, 203, 400)} == {(None, None, "CYCLE")}
    assert got[300] == got[301] == (None, None, "MISSING_PARENT")
    assert sections.paths(spark.createDataFrame([], "id long, parent long, title string")).count() == 0


def test_scope_errors(spark):
    documents = spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "document_id long, disclosure_id long")
    filings = spark.createDataFrame([(10, "CONTEST", 5), (20, "CONTEST", 5), (30, "OTHER", 5)], "disclosure_id long, provider string, company_id long")
    assert search.checked(search.ChunkScope(disclosure_ids=(10,), document_ids=(1, 2)), documents, filings)
    for scope, names in ((search.ChunkScope(disclosure_ids=(30, 10)), ["DISCLOSURE 30"]), (search.ChunkScope(disclosure_ids=(10,), document_ids=(3,)), ["DOCUMENT 3"]), (search.ChunkScope(document_ids=(3, 9)), ["DOCUMENT 9"])):
        with pytest.raises(search.ScopeError) as e:
            search.checked(scope, documents, filings)
        assert str(e.value) == "not found: " + ", ".join(names)
    chunks = spark.createDataFrame([(1, "red"), (3, "red"), (3, "blue")], "document_id long, text string")
    companies = spark.createDataFrame([(5, "five")], "company_id long, name string")
    c = search.ChunkColumns("text", "text", "text", "text")
    hits, summary = search.scoped_search(chunks, documents, filings, companies, c, search.ChunkCondition(keywords=("red",)), (F.col("document_id"),), search.ChunkScope(document_ids=(3,)))
    assert [(r.document_id, r.name) for r in hits.collect()] == [(3, "five")]
    assert tuple(summary.first()) == (1, 1, False)


def test_plan_tools_without_filings_find_nothing(spark):
    filings = spark.createDataFrame([(1, "a", "x")], "key long, title string, category string")
    chunks = spark.createDataFrame([(1, "a", "TEXT")], "key long, body string, kind string")
    given = {
        question.SEARCH: tools.search_filings(filings, search.FilingColumns("key", "title", "category"), (F.col("key"),)),
        question.EVIDENCE: tools.search_evidence(chunks, search.ChunkColumns("body", "body", "body", "body", "kind"), "key", (F.col("key"),)),
    }
    for category, n in (("x", 1), ("none", 0)):
        steps = (question.Step("a", question.SEARCH, {"categories": [category]}), question.Step("b", question.EVIDENCE, {"disclosureIdsFrom": "a", "keywords": ["a"], "blockTypes": ["PARAGRAPH", "IMAGE"]}), question.Step("c", question.CALCULATE))
        frames, warnings = question.compiled(question.Plan(steps), given)
        assert frames["b"].count() == n and warnings == ["c: CALCULATE isn't executed"]
    tables_only = tools.search_evidence(chunks, search.ChunkColumns("body", "body", "body", "body", "kind"), "key", (F.col("key"),))
    assert tables_only({"disclosureIdsFrom": "a", "keywords": ["a"], "blockTypes": ["TABLE_ROW"]}, {"a": spark.createDataFrame([(1,)], "filing long")}).count() == 0


def test_policies(spark):
    policies = [{"subtype": "a", "id": 1}, {"question": "q", "id": 2}, {"question": "q2", "id": 3}, {"question": "q2", "id": 4}]
    assert question.matched_policy(policies, "a", "q")["id"] == 1
    assert question.matched_policy(policies, "b", "q")["id"] == 2
    assert question.matched_policy(policies, None, "else") is None
    with pytest.raises(question.PlanError):
        question.matched_policy(policies, None, "q2")


def test_evidence_rules_and_order(spark):
    rows = [("METADATA", None, None, None, None), ("TABLE_CELL", 1, 0, None, "l"), ("PARAGRAPH", 1, 2, None, None), ("TABLE_ROW", 1, 1, None, None), ("TABLE", None, None, None, None)]
    made = spark.createDataFrame(rows, "block_type string, block_id int, row_index int, cell_index int, row_label string")
    broken = {k: [r.block_type for r in made.where(~test).collect()] for k, test in invariants.evidence_rules().items()}
    assert broken == {"block_given": ["TABLE"], "place_only_in_tables": ["PARAGRAPH"], "row_given": ["TABLE_ROW"], "cell_given": ["TABLE_CELL"]}
    numbered = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 2), (2, 1, 1)], "doc int, position int, n int")
    assert [tuple(r) for r in invariants.disordered(numbered, "doc", "n").collect()] == [(1, 3, 2)]


def test_duplicate_codes(spark):
    rows = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "b"), (None, None), (None, "c")], "corp_code string, stock_code string")
    assert {tuple(r) for r in files.duplicate_codes(rows, "corp_code", "stock_code").collect()} == {("corp_code", "1", 2), ("stock_code", "b", 2)}


def test_profiles(spark):
    html = "<html><body><table><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table><br><p>x</body></html>"
    made = spark.createDataFrame([(1, html), (2, None)], "doc_id long, source string")
    rows = {r.doc_id: r for r in markup.structure_profile(made, "html").collect()}
    assert rows[1].tags == {"html": 1, "body": 1, "table": 2, "tr": 2, "td": 2, "br": 1, "p": 1} and rows[1].n_nested_tables == 1 and rows[1].max_depth == 8
    assert rows[2].tags == {} and rows[2].status == "COMPLETED"
    xml = spark.createDataFrame([(1, "<A><SECTION-1><SECTION-2/><SECTION-2/></SECTION-1></A>"), (2, "<A>"), (3, "a < b")], "doc_id long, source string")
    profile = markup.structure_profile(xml, "xml")
    assert {(r.doc_id, r.level, r.n) for r in markup.section_levels(profile).collect()} == {(1, 1, 1), (1, 2, 2)}
    assert {r.doc_id: r.status for r in profile.collect()} == {1: "COMPLETED", 2: "FAILED", 3: "FAILED"}


@pytest.mark.parametrize(("line", "fixed", "n"), [
    ('<P A="v" B="w">x "y" z</P>', '<P A="v" B="w">x "y" z</P>', 0),
    ('<P A="say "k" now" B="2">t</P>', '<P A="say &quot;k&quot; now" B="2">t</P>', 2),
    ('<P A=""k">t</P><Q B="">', '<P A="k">t</P><Q B="">', 1),
    ('<P A="" B = "x"/>', '<P A="" B = "x"/>', 0),
    ('<P A = "a > b" C="x"">t', '<P A = "a > b" C="x&quot;">t', 1),
    ('<?xml version="1.0" encoding="utf-8"?>', '<?xml version="1.0" encoding="utf-8"?>', 0),
    ('<P A="""">t', '<P A="">t', 2),
    ('<P A="ends at the line', '<P A="ends at the line', 0),
    ("", "", 0),
])
def test_quotes_in_attributes(line, fixed, n):
    assert markup.repaired_quotes(line) == (fixed, n)


def test_repairs_of_quotes_are_counted(spark):
    rows = spark.createDataFrame([(1, '<DOCUMENT><P A="say "k" now">a & b</P></DOCUMENT>')], "doc_id long, source string")
    got = markup.structure_profile(rows, "xml").first()
    assert (got.n_repairs, got.status, got.tags) == (3, "COMPLETED", {"DOCUMENT": 1, "P": 1})


def test_mentions(spark):
    texts = ["1조 2,345억 6만 7원과 1,200 원, 3.5억원", "2024년 1월 5일, 2024.1.5, 2024/01/06, 2024년 12월, 12024-01-01x", "9.9%와 12 퍼센트", "숫자 없음", None, "0원"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", normalize.mentions(F.col("text")).alias("m")).collect()
    got = {r.k: r.m and [tuple(x) for x in r.m] for r in rows}
    assert got[0] == [("money", "1234500060007"), ("money", "1200"), ("money", "350000000")]
    assert got[1] == [("date", "2024-01-05"), ("date", "2024-01-05"), ("date", "2024-01-06"), ("month", "2024-12")]
    assert got[2] == [("ratio", "9.9"), ("ratio", "12")]
    assert got[3] == [] and got[4] is None and got[5] == [("money", "0")]


def test_same_period_and_decimals(spark):
    rows = spark.createDataFrame([(1, date(2024, 1, 1), None, date(2024, 1, 1), None, "9.90"), (2, date(2024, 1, 1), None, None, None, "12")], "k int, a_from date, a_to date, b_from date, b_to date, raw string")
    got = [tuple(r) for r in rows.orderBy("k").select(calculation.same_period("a", "b"), calculation.decimals(F.col("raw"))).collect()]
    assert got == [(True, 2), (False, 0)]
