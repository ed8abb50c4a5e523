from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.functions import normalize, text
from lodestone.operators import answers, calculation, chunking, history, quality, search, tables
from lodestone.plans import question
from lodestone.sources import files, markup

FACTS = "filing long, fact_key string, raw_value string, unit string, verified boolean, period_start date, period_end date"


def facts(spark, *rows):
    return spark.createDataFrame([(1, *r, *([None] * (6 - len(r)))) for r in rows], FACTS)


AMOUNT, EQUITY = ("a", "5296200000000", "KRW", True), ("e", "53503752397611", "KRW", True)


@pytest.mark.parametrize(
    ("rows", "verdict", "display"),
    [
        ([AMOUNT, EQUITY, ("r", "9.90", "PERCENT", True)], "MATCH", "9.90"),
        ([AMOUNT, EQUITY, ("r", "9.9", "PERCENT", True)], "MATCH", "9.9"),
        ([AMOUNT, EQUITY, ("r", "9.8", "PERCENT", True)], "MISMATCH", "9.9"),
        ([AMOUNT, EQUITY], "NOT_COMPARABLE", "9.9"),
        ([AMOUNT, EQUITY, ("r", "9.9", "PERCENT", True), ("r", "20.0", "PERCENT", True)], "NOT_COMPARABLE", "9.9"),
        ([AMOUNT, EQUITY, ("r", "9.9", "%", True)], "NOT_COMPARABLE", "9.9"),
        ([AMOUNT, ("e", "0", "KRW", True)], "NOT_CALCULABLE", None),
        ([AMOUNT, ("e", "-100", "KRW", True), ("r", "1", "PERCENT", True)], "NOT_COMPARABLE", "-5296200000000"),
        ([AMOUNT], "NOT_CALCULABLE", None),
        ([AMOUNT, AMOUNT, EQUITY], "NOT_CALCULABLE", None),
        ([AMOUNT, ("e", "1", "KRW", False)], "NOT_CALCULABLE", None),
        ([AMOUNT, ("e", "1", "USD", True)], "NOT_CALCULABLE", None),
        ([AMOUNT, ("e", "many", "KRW", True)], "NOT_CALCULABLE", None),
        ([AMOUNT, ("e", "1", "KRW", True, date(2024, 1, 1), date(2024, 12, 31))], "NOT_CALCULABLE", None),
    ],
)
def test_ratio(spark, rows, verdict, display):
    (got,) = calculation.ratio(facts(spark, *rows), "filing", "a", "e", "r").collect()
    assert (got.verdict, got.display) == (verdict, display)


def test_other_calculations(spark):
    days = [("s", "2024-01-01", "ISO_DATE", True), ("t", "2024-01-01", "ISO_DATE", True)]
    assert calculation.duration(facts(spark, *days), "filing", "s", "t").first().days == 1
    back = [("s", "2024-01-02", "ISO_DATE", True), ("t", "2024-01-01", "ISO_DATE", True)]
    assert calculation.duration(facts(spark, *back), "filing", "s", "t").first().verdict == "NOT_CALCULABLE"
    fx = [("f", "1000.50", "USD", True), ("x", "1300.10", "KRW_PER_USD", True)]
    assert calculation.product(facts(spark, *fx, ("k", "1300750", "KRW", True)), "filing", "f", "x", "k").first().verdict == "MATCH"
    assert calculation.product(facts(spark, *fx, ("k", "1300751", "KRW", True)), "filing", "f", "x", "k").first().verdict == "MISMATCH"
    money = [("b", "100", "KRW", True), ("c", "70", "KRW", True)]
    got = calculation.difference(facts(spark, *money), "filing", ("b", "c"), ("s", "t")).first()
    assert (got.amount_change, got.days_change) == (-30, None)
    got = calculation.difference(facts(spark, *back), "filing", ("b", "c"), ("s", "t")).first()
    assert (got.amount_change, got.days_change) == (None, -1)
    assert calculation.difference(facts(spark, *money, *days), "filing", ("b", "c"), ("s", "t")).first().reason == "both kinds"
    row = spark.range(1).select(calculation.change_rate(F.lit(50.0), F.lit(60.0)).alias("a"), calculation.change_rate(F.lit(0.0), F.lit(1.0)).alias("b"), calculation.dilution(F.lit(75.0), F.lit(25.0)).alias("c"), calculation.converted(F.lit(3), F.lit("억원"), F.lit("백만원")).alias("d"), calculation.converted(F.lit(3), F.lit("?"), F.lit("원")).alias("e")).first()
    assert tuple(row) == (20.0, None, 25.0, 300.0, None)


def test_titles_filter_only_without_structure(spark):
    rows = spark.createDataFrame([(1, "red", "x", date(2024, 1, 1)), (2, "red one", "x", date(2024, 2, 1)), (3, "blue", "y", date(2024, 3, 1))], "k int, t string, c string, d date")
    c = search.FilingColumns(key="k", title="t", category="c", filed_on="d")
    docs = spark.createDataFrame([(1,), (1,)], "k2 int")
    cond = search.MetadataCondition(title_terms=("red",), limit=1)
    got = search.metadata_search(rows, docs, "k2", c, cond, (F.desc("d"),)).collect()
    assert [(r.k, r.title_score, r.document_count) for r in got] == [(1, 3.0, 2)]
    assert search.candidate_summary(search.metadata_candidates(rows, c, cond), 1).first().truncated
    cond = search.MetadataCondition(title_terms=("green",), categories=("x",))
    assert [r.k for r in search.metadata_search(rows, docs, "k2", c, cond, (F.desc("d"),)).collect()] == [2, 1]
    cond = search.MetadataCondition(date_to=date(2025, 1, 1), as_of=date(2024, 1, 31))
    assert [r.k for r in search.metadata_candidates(rows, c, cond).collect()] == [1]


def test_conditions_are_checked():
    for bad in ({"limit": 0}, {"limit": 51}, {"correction": "?"}, {"date_from": date(2024, 2, 1), "date_to": date(2024, 1, 1)}, {"date_from": date(2024, 2, 1), "as_of": date(2024, 1, 1)}):
        with pytest.raises(ValueError):
            search.MetadataCondition(**bad)
    for bad in ({"top_k": 21}, {"neighbor_radius": 1}, {"chunk_types": ("IMAGE_CAPTION",)}):
        with pytest.raises(ValueError):
            search.ChunkCondition(**bad)


def test_chunk_search_without_signals_is_empty(spark):
    rows = spark.createDataFrame([("r", "s", "b", "b")], "r string, s string, b string, t string")
    assert search.chunk_search(rows, search.ChunkColumns("r", "s", "b", "t"), search.ChunkCondition(), ()).count() == 0


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "k int, x string, y int")
    new = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "d", 1)], "k int, x string, y int")
    got = {r.k: r.action for r in quality.upsert_actions(old, new, "k").collect()}
    assert got == {1: "unchanged", 2: "updated", 3: "missing", 4: "created"}
    assert {tuple(r) for r in quality.upserted(old, new, "k").collect()} == {(1, "a", None), (2, "b", None), (3, "c", 1), (4, "d", 1)}
    assert {tuple(r) for r in quality.replaced(old, new.where("k = 4"), "k").collect()} == {(1, "a", None), (2, "b", 1), (3, "c", 1), (4, "d", 1)}


def test_text_functions(spark):
    row = spark.range(1).select(
        text.paragraph(F.lit(" a \t b \r\n\r\n c　d ")).alias("p"), text.heading(F.lit(" a \n b ")).alias("h"), text.heading(F.lit(" \n ")).alias("none"),
        text.joined_paragraphs(F.array(F.lit("a"), F.lit(" "), F.lit("b"))).alias("j"),
        text.search_text(F.lit("path"), F.array(F.lit("h1"), F.lit(""), F.lit("h2")), F.lit("body")).alias("s"), text.search_text(F.lit(" "), F.array().cast("array<string>"), F.lit("body")).alias("s2"),
        text.row_text(F.array(F.lit("a"), F.lit("x\ny"), F.lit(""), F.lit(None), F.lit(""))).alias("r"), text.label(F.lit("ㆍ 2. 투자 금액(백만원) ")).alias("l"),
        text.label_unit(F.array(F.lit("투자금액(원)"), F.lit("비율(퍼센트)"))).alias("u"), text.display_name(F.lit("  "), F.lit("f.xml")).alias("d"),
        text.deterministic_id(F.lit("a"), F.lit("b")).alias("id"), text.suspicious(F.lit("\n".join("abcdefghijklmnopqrstuvwxyz"))).alias("bad"), text.suspicious(F.lit("a\nb")).alias("good"),
    ).first()
    assert (row.p, row.h, row.none, row.j) == ("a b\nc d", "a b", None, "a\n\nb")
    assert (row.s, row.s2, row.r) == ("[path]\n소제목: h1 > h2\nbody", "body", "a | x / y")
    assert (row.l, row.u, row.d) == ("투자금액", "%", "f.xml")
    assert row.id[14] == "3" and row.id[19] in "89ab" and len(row.id) == 36
    assert row.bad and not row.good


def test_money_and_items(spark):
    row = spark.range(1).select(normalize.korean_money(F.lit("5조 2,962억 원")).alias("a"), normalize.korean_money(F.lit("1만 5 원")).alias("b"), normalize.korean_money(F.lit("없음")).alias("c"), normalize.correction_item(F.lit("2. 투자내역 - 투자금액(원)")).alias("d"), normalize.correction_item(F.lit("투자금액 및 종료일")).alias("e"), normalize.plain_text(F.lit(" a  b ")).alias("t")).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (5_296_200_000_000, 10_005, None, "amount", None)
    assert (row.t.status, row.t.value) == ("MAPPED", "a b")


def test_text_chunks():
    sizes = chunking.Sizes(10, 20, 40, 60)
    blocks = [(1, "HEADING", "One"), (2, "HEADING", "Two"), (3, "PARAGRAPH", "a" * 15), (4, "PAGE_BREAK", None), (5, "PARAGRAPH", "b" * 5), (6, "TABLE", None), (7, "PARAGRAPH", "Some words here. And then some more words there. End."), (8, "HEADING", "Three"), (9, "PARAGRAPH", "..."), (10, "HEADING", "only")]
    got = chunking.text_chunks_of(blocks, sizes)
    assert [c["body"] for c in got] == ["a" * 15, "b" * 5, "Some words here.", "And then some more words there. End."]
    assert [c["headings"] for c in got] == [["One", "Two"], ["One", "Two"], [], []]
    assert [c["sequence_no"] for c in got] == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        chunking.Sizes(5, 4, 6, 7)


def test_sentences_break_at_soft_marks():
    assert chunking.sentences("One two. Three!  Four", 100) == ["One two.", "Three!", "Four"]
    parts = chunking.sentences("word, " * 30, 20)
    assert all(len(p) <= 20 for p in parts) and "".join(parts).replace(" ", "") == "word," * 30
    assert chunking.sentences("x" * 45, 20) == ["x" * 20, "x" * 20, "x" * 5]


def test_table_chunks_repeat_headers():
    sizes = chunking.Sizes(5, 10, 30, 60)
    rows = [(0, True, "head"), (1, False, "a" * 12), (2, False, "b" * 12), (3, False, "c" * 12)]
    assert tables.table_chunks_of(rows, sizes) == [("head\n" + "a" * 12 + "\n" + "b" * 12, 1, 2), ("head\n" + "c" * 12, 3, 3)]
    assert tables.table_chunks_of([(0, True, "h")], sizes) == [("h", 0, 0)]
    assert tables.nested_context("a" * 400, "b" * 10) == ("a" * 340, "b" * 10)


def test_grid_errors_become_rows(spark):
    bad = json.dumps({"rows": [{"cells": [{"text": "x", "rowSpan": 0}]}]})
    rows = spark.createDataFrame([(1, bad), (2, "no json"), (3, None)], "table_id long, table_json string")
    got = {r.table_id: r.error for r in tables.grid(rows).collect()}
    assert set(got) == {1, 2} and all(got.values())


def test_html_blocks():
    page = "<html><head><style>x</style></head><body><h1>T <b>b</b></h1><p>One<br>two</p><div style='display: none'>gone</div><table><tr><th rowspan=2>h</th><td>1<table><tr><td>in</td></tr></table></td></tr></table>tail <a href='/x'>go</a></body></html>"
    got = markup.parsed_html(page)
    assert [(k, t) for k, t, _ in got.blocks] == [("HEADING", "T b"), ("PARAGRAPH", "One\ntwo"), ("TABLE", None), ("PARAGRAPH", "tail go")]
    cells = json.loads(got.blocks[2][2])["rows"][0]["cells"]
    assert cells[0]["rowSpan"] == 2 and cells[1]["nestedTables"][0]["rows"][0]["cells"][0]["text"] == "in"
    assert got.links == [("/x", "go")]
    with pytest.raises(ValueError):
        markup.parsed_html("<table><tr><td rowspan='x'>a</td></tr></table>")


def test_xml_blocks(spark):
    source = "<DOCUMENT><DOCUMENT-NAME>N</DOCUMENT-NAME><SECTION-1><TITLE>A</TITLE><P>x & y < 3 <STS></P><SECTION-2><TITLE>B</TITLE><TITLE>extra</TITLE><PGBRK/><PGBRK/><TABLE><TR><TD>1</TD></TR></TABLE></SECTION-2></SECTION-1></DOCUMENT>"
    rows = spark.createDataFrame([(1, source), (2, "<DOCUMENT><P>"), (3, None)], "doc_id long, source string")
    got = [(r.doc_id, r.block_type, r.text, r.section_level, r.section_path) for r in markup.blocks(rows, "xml").where("status = 'COMPLETED'").collect()]
    assert got == [(1, "PARAGRAPH", "x & y < 3 <STS>", 1, "A"), (1, "HEADING", "extra", 2, "A > B"), (1, "PAGE_BREAK", None, 2, "A > B"), (1, "TABLE", None, 2, "A > B")]
    failed, ok = files.quarantined(markup.blocks(rows, "xml"))[::-1]
    assert {r.doc_id for r in failed.collect()} == {2, 3} and ok.count() == 4
    routed = markup.routed_blocks(spark.createDataFrame([(1, "HTML", "<p>a</p>"), (2, "PDF", "x"), (3, "DART_XML", "<DOCUMENT><P>b</P></DOCUMENT>")], "doc_id long, format string, source string"))
    assert {(r.doc_id, r.text, r.status) for r in routed.collect()} == {(1, "a", "COMPLETED"), (2, None, "FAILED"), (3, "b", "COMPLETED")}


def test_links(spark):
    urls = ["http://dart.fss.or.kr/x?rcpNo=20240101000001", "https://kind.krx.co.kr/a?acptNo=20240101000002&x=1", "http://dart.fss.or.kr/x?rcpNo=12", "http://dart.fss.or.kr/x?rcpNo=20240101000001&rcpNo=20240101000002", "http://other/x?rcpNo=20240101000001", "no url"]
    got = [r.t and (r.t.system, r.t.number) for r in spark.createDataFrame([(u,) for u in urls], "u string").select(markup.link_target(F.col("u")).alias("t")).collect()]
    assert got == [("DART", "20240101000001"), ("KRX", "20240101000002"), None, None, None, None]


def test_sources(spark, tmp_path):
    head = [c.split()[0] for c in files.COMPANY_SCHEMA.split(", ")]
    row = ["00126380", "005930", "Name", "Name", "Eng", "KOSPI", "ind", "3", "sec", "1975-06-11", "12월", "4000000", "1", "2", "3", "4", ""]
    (tmp_path / "c.csv").write_text("﻿" + ",".join(head) + "\n" + ",".join(row) + "\n" + ",".join(["1", *row[1:]]) + "\n", encoding="utf-8")
    got = files.companies(spark, str(tmp_path / "c.csv")).collect()
    assert [(r.fiscal_month, r.market_cap, r.problem) for r in got] == [(12, 4_000_000, None), (12, 4_000_000, "corp_code")]
    with pytest.raises(ValueError):
        (tmp_path / "d.csv").write_text("a,b\n1,2\n")
        files.companies(spark, str(tmp_path / "d.csv"))
    good = {"doc_id": "major_20240101000001", "doc_group": "major", "rcept_no": "20240101000001", "rcept_dt": "20240101", "file_path": "a/b.xml", "n_files": 1}
    rows = [good, good | {"file_path": "../b"}, good | {"base_year": 2024}, good | {"rcept_dt": "2024"}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert [r.problem for r in files.manifest(spark, str(tmp_path / "m.jsonl")).collect()] == [None, "file_path", "base_period", "rcept_dt"]
    (tmp_path / "f").mkdir()
    for name, raw in (("20240101000001.xml", "﻿<?xml version='1.0'?>\n<DOCUMENT/>".encode()), ("20240101000001_viewer.html", b"<!-- x --><HTML>"), ("20240101000001_a.xml", b"%PDF-1"), ("z.html", "<html>가".encode("cp949"))):
        (tmp_path / "f" / name).write_bytes(raw)
    found = files.raw_files(spark, str(tmp_path / "f"))
    assert {r.file_name: (r.role, r.content_format) for r in found.collect()} == {"20240101000001.xml": ("MAIN", "DART_XML"), "20240101000001_viewer.html": ("VIEWER", "HTML"), "20240101000001_a.xml": ("ATTACHMENT", "PDF"), "z.html": ("UNKNOWN", "HTML")}
    texts = {r.path.rsplit("/", 1)[1]: r.source for r in files.decoded(found).collect()}
    assert texts["z.html"] == "<html>가" and texts["20240101000001.xml"].startswith("<?xml")
    assert spark.range(1).select(files.nfc(F.lit("é")).alias("x")).first().x == "é"
    files.write_replacing(spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), str(tmp_path / "out"), "k")
    files.write_replacing(spark.createDataFrame([(2, "c")], "k int, x string"), str(tmp_path / "out"), "k")
    assert {(r.k, r.x) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "a"), (2, "c")}
    files.write_report(spark.createDataFrame([(1, ["a"])], "k int, x array<string>"), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).columns == ["k", "x"]


def test_pages(spark):
    rows = spark.createDataFrame([(1, 1, " a \n\n b"), (1, 2, "�"), (1, 3, "x" * 600_000)], "doc_id int, page_no int, text string")
    assert [(r.text[:3], r.suspicious, r.status) for r in files.pages_as_sections(rows).collect()] == [("a\nb", False, "COMPLETED"), ("�", True, "COMPLETED"), ("xxx", False, "FAILED")]


def test_history(spark):
    v = spark.createDataFrame([("a", 1, 1, 10.0), ("a", 3, 2, 30.0), ("a", 3, 3, 31.0)], "k string, t int, i int, v double")
    asked = spark.createDataFrame([("a", 0), ("a", 2), ("a", 3), ("b", 9)], "k string, at int")
    got = {(r.k, r.at): r.value_as_of for r in history.as_of_join(asked, v, "k", "at", "t", "i", "v").collect()}
    assert got == {("a", 0): None, ("a", 2): 10.0, ("a", 3): 31.0, ("b", 9): None}
    assert [r.i for r in history.latest_as_of(v, "k", "t", "i", F.lit(2)).collect()] == [1]


def test_plans():
    s1 = question.Step("s1", question.SEARCH, {"limit": 5})
    s2 = question.Step("s2", question.LOOKUP, {"disclosureIdsFrom": "s1", "factKeys": ["x"]})
    plan = question.validated(question.Plan((s1, s2)))
    assert plan.steps[1].depends_on == ("s1",)
    assert question.with_required_facts(plan, ("y", "x")).steps[1].input["factKeys"] == ["x", "y"]
    bad = [(s1, s1), (s2,), (s1, question.Step("s2", question.EVIDENCE, {"factsFrom": "s1"})), (s1, question.Step("s3", question.SEARCH, {"limit": 5})), (question.Step("s", "?"),), (question.Step("s", question.SEARCH, {"limit": 99}),), (question.Step("s", question.LOOKUP, {}, ("s",)),), tuple(question.Step(f"s{k}", question.SEARCH, {"limit": k}) for k in (1, 2, 3))]
    for steps in bad:
        with pytest.raises(question.PlanError):
            question.validated(question.Plan(steps))
    for times in ({"receipt_from": "2024-02-30"}, {"receipt_from": "2024-02-02", "receipt_to": "2024-01-01"}):
        with pytest.raises(question.PlanError):
            question.validated(question.Plan((), **times))
    frames, warnings = question.compiled(question.Plan((s1, question.Step("h", question.HISTORY))), {question.SEARCH: lambda i, b: "frame"})
    assert frames == {"s1": "frame"} and len(warnings) == 1
    words, hints, sections, warned = question.resolved_terms(["?"], ["facility.amount"])
    assert words == ("투자금액", "투자 금액", "투자규모") and hints == set(words) and sections and warned == ["unknown concept ?"]
    assert question.resolved_terms([], ["?"])[:3] == ((), frozenset(), ())


def test_answer_checks(spark):
    rows = facts(spark, ("a", "1", "KRW", True), ("b", "2", "KRW", False))
    assert answers.outcomes(rows, "filing", ("a", "b")).first().outcome == "PARTIAL"
    assert answers.outcomes(rows, "filing", ("a",)).first().outcome == "COMPLETED"
    assert answers.outcomes(rows, "filing", ("b",)).first().outcome == "UNANSWERABLE"
    verdicts = spark.createDataFrame([(1, "NOT_CALCULABLE", None)], "filing long, verdict string, display string")
    assert answers.outcomes(rows, "filing", ("a",), verdicts).first().outcome == "PARTIAL"
    assert answers.claims(rows, "filing", verdicts).count() == 1


def test_stream_of_events(spark, tmp_path):
    from lodestone.streaming import events

    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 7, "view", 1.0), (1, "2024-01-01 00:10:00", 7, "view", 1.0), (2, "2024-01-01 00:20:00", 7, "click", 2.0)], "event_id long, ts string, user_id long, event_type string, value double")
    rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    out = []
    events.drained(events.deduplicated(events.source(spark, str(tmp_path / "in"), schema), "event_id"), str(tmp_path / "cp"), lambda df, _: out.extend(r.event_id for r in df.collect()))
    assert sorted(out) == [1, 2]
    events.drained(events.deduplicated(events.source(spark, str(tmp_path / "in"), schema), "event_id"), str(tmp_path / "cp"), lambda df, _: out.extend(r.event_id for r in df.collect()))
    assert sorted(out) == [1, 2]
    counts = []
    events.drained(events.windowed(events.source(spark, str(tmp_path / "in"), schema)), str(tmp_path / "cp2"), lambda df, _: counts.extend((r.event_type, r.n) for r in df.collect()), "update")
    assert sorted(counts) == [("click", 1), ("view", 2)]


def test_stream_of_a_folder_of_files_out_of_order(spark, tmp_path):
    made = ["id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(CAST((id * 7) % 20 AS INT)) AS ts", "7L AS user_id", "'view' AS event_type", "1.0D AS value"]
    for k in (13, 2, 19, 0, 7, 16, 5, 11, 1, 18, 9, 4, 15, 3, 12, 8, 17, 6, 14, 10):  # a file each, over 20 days
        spark.range(k, k + 1, 1, 1).selectExpr(*made).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = [r.event_id for r in catalog.queries()["q60_stream_without_duplicates"](spark, str(tmp_path)).collect()]
    assert sorted(got) == list(range(20))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_queries_against_oracles(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    rows = catalog.queries()[name](spark, d).toPandas()
    if name not in catalog.oracle_sql():
        assert len(rows)
        return
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(rows.columns)
    assert columns == sorted(want.columns)
    plain = [sorted(map(tuple, x[columns].astype(object).where(x[columns].notna(), None).values.tolist()), key=str) for x in (rows, want)]
    assert plain[0] == plain[1]


def test_shared_folder_is_the_sessions_or_one_of_our_own(monkeypatch):
    from types import SimpleNamespace

    from lodestone.shared import shared_folder

    def session(folder, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master, applicationId="test"))

    assert shared_folder(session("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    own = shared_folder(session(None, "local[4]"))
    assert own.startswith("file://") and own == shared_folder(session("", "local"))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(RuntimeError):
            shared_folder(session(None, master))
