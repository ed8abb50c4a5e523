from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone import shared
from lodestone.operators import assembly, chunking, tables
from lodestone.operators.chunking import Sizes

SECTIONS = "doc_id long, section_id string, sequence_no int, section_path string"
BLOCKS = "doc_id long, sequence_no int, section_id string, block_type string, text string, table_id long, table_json string"
TEXT, TABLE = Sizes(20, 40, 60, 90), Sizes(20, 30, 50, 80)


def cell(text, kind="DATA", nested=(), **spans):
    return {"type": kind, "text": text, "nestedTables": list(nested), **spans}


def grid(*rows, **more):
    return {"rows": [{"cells": [c if isinstance(c, dict) else cell(c) for c in row]} for row in rows], **more}


def frames(spark, sections, blocks):
    return spark.createDataFrame(sections, SECTIONS).repartition(3), spark.createDataFrame(blocks, BLOCKS).repartition(3)


def fits(length, added, sizes):
    return length + added <= sizes.target or length < sizes.least and length + added <= sizes.most


def packed_table(table, sizes, path=()):
    """(path, body, first, last) of a table and those inside it, row by row; no spans."""
    rows = []
    for k, row in enumerate(table["rows"]):
        texts = [" / ".join(" ".join(x.split()) for x in c["text"].split("\n") if x.strip()) for c in row["cells"]]
        kinds = {c["type"] for c, t in zip(row["cells"], texts, strict=True) if t}
        text = re.sub(r"( \| *)+$", "", " | ".join(texts))
        if text:
            rows.append((k, kinds == {"HEADER"}, text))
    lead = 0
    while lead < len(rows) and rows[lead][1]:
        lead += 1
    head = "\n".join(t for _, _, t in rows[:lead])
    if lead == len(rows) or len(head) + 1 >= sizes.absolute:
        head, lead = "", 0
    room, out, now = len(head) + 1 if head else 0, [], []

    def flush():
        if now:
            out.append((path, "\n".join([*([head] if head else []), *(t for _, t in now)]), now[0][0], now[-1][0]))
            now.clear()

    for k, _, text in rows[lead:]:
        if now and not (room + len(text) <= sizes.absolute and fits(room + len("\n".join(t for _, t in now)), 1 + len(text), sizes)):
            flush()
        if room + len(text) > sizes.absolute:
            left = sizes.absolute - room
            for piece in chunking.split_text(text, min(max(1, sizes.most - room), left), left):
                out.append((path, (head + "\n" if head else "") + piece, k, k))
        else:
            now.append((k, text))
    flush()
    for k, row in enumerate(table["rows"]):
        for j, c in enumerate(row["cells"]):
            for i, inner in enumerate(c["nestedTables"]):
                out += packed_table(inner, sizes, (*path, k, j, i))
    return out


def brute(sections, blocks):
    """Chunks of one filing, block by block."""
    events = sorted([(s[2], "START", s) for s in sections] + [(b[1], b[3], b) for b in blocks], key=lambda x: x[0])
    paths = {s[1]: s[3] for s in sections}
    drafts, heads, used, now, section, fresh = [], [], False, [], object(), True

    def flush():
        if now:
            body = "\n\n".join(t for _, _, t in now)
            drafts.append((now[0][0], now[0][1], 0, "TEXT", section, list(heads), body, None, now[0][0], now[-1][0]))
            now.clear()

    for seq, kind, what in events:
        if kind == "START":
            flush()
            fresh = True
            continue
        if fresh or what[2] != section:
            flush()
            heads, used, section, fresh = [], False, what[2], False
        text = " ".join((what[4] or "").split()) if kind == "HEADING" else "\n".join(t for x in re.split(r"\r\n|\r|\n", what[4] or "") if (t := " ".join(x.split())))
        if kind == "HEADING":
            flush()
            if used:
                heads, used = [], False
            heads = heads + ([text] if text else [])
        elif kind == "PARAGRAPH" and text:
            for part, piece in enumerate(chunking.split_text(text, TEXT.most, TEXT.absolute) if len(text) > TEXT.most else [text]):
                length = len("\n\n".join(t for _, _, t in now))
                if now and not fits(length, 2 + len(piece), TEXT):
                    flush()
                now.append((seq, part, piece))
            used = True
        elif kind == "PAGE_BREAK":
            if len("\n\n".join(t for _, _, t in now)) >= TEXT.least:
                flush()
        elif kind in ("TABLE", "IMAGE"):
            flush()
            used = True
            if kind == "TABLE":
                for part, (path, body, first, last) in enumerate(packed_table(json.loads(what[6]), TABLE)):
                    drafts.append((seq, part, 1, "TABLE", section, list(heads), body, path, first, last))
    flush()
    drafts = sorted((d for d in drafts if any(c.isalnum() for c in d[6])), key=lambda d: d[:3])
    return [(k, d[3], assembly.PREAMBLE if d[4] is None else paths[d[4]], d[5], d[6], d[0], d[7], d[8], d[9]) for k, d in enumerate(drafts, 1)]


def made(r, doc):
    """A filing of random sections and blocks."""
    words = ["alpha", "beta", "gamma.", "delta!", "다.", "가나", "é", "12", "-", "\n", "so,"]
    text = lambda n: " ".join(r.choice(words) for _ in range(r.randint(0, n)))

    def table(depth=0):
        rows = []
        for k in range(r.randint(1, 5)):
            kind = "HEADER" if k == 0 and r.random() < 0.5 else "DATA"
            rows.append([cell(text(r.choice((2, 6, 40))), kind, [table(depth + 1)] if depth < 2 and r.random() < 0.2 else []) for _ in range(r.randint(1, 3))])
        return grid(*rows)

    sections, blocks, seq = [], [], 0
    for _ in range(r.randint(0, 25)):
        seq += r.randint(1, 3)
        if r.random() < 0.15:
            sections.append((doc, f"s{doc}-{len(sections)}", seq, f"path {len(sections)}"))
            continue
        kind = r.choice(("HEADING", "PARAGRAPH", "PARAGRAPH", "PARAGRAPH", "TABLE", "PAGE_BREAK", "IMAGE"))
        own = r.choice([None, *(s[1] for s in sections)][-2:])
        blocks.append((doc, seq, own, kind, text(r.choice((0, 3, 8, 40))) if kind in ("HEADING", "PARAGRAPH") else None, doc * 1000 + seq if kind == "TABLE" else None, json.dumps(table(), ensure_ascii=False) if kind == "TABLE" else None))
    return sections, blocks


def path_numbers(path):
    return None if path is None else tuple(int(x) for x in re.findall(r"\[(\d+)\]", path))


def test_against_one_block_at_a_time(spark):
    r = random.Random(5)
    filings = {doc: made(r, doc) for doc in range(120)}
    sections, blocks = ([x for f in filings.values() for x in f[k]] for k in (0, 1))
    got = {doc: [] for doc in filings}
    for x in assembly.chunks(*frames(spark, sections, blocks), TEXT, TABLE).orderBy("doc_id", "sequence_no").collect():
        got[x.doc_id].append((x.sequence_no, x.chunk_type, x.section_path, x.headings, x.body, x.anchor, path_numbers(x.path), x.first, x.last))
    assert sum(map(len, got.values())) > 600
    for doc, (s, b) in filings.items():
        assert got[doc] == brute(s, b), doc


def test_context_of_nested_tables(spark):
    inner = grid(["in"])
    told = grid(["told"], parentContext={"precedingText": "First one. Near before.", "followingText": None})
    deep = grid(["mid", cell("around the deep one", nested=[inner])])
    table = grid([cell("left"), cell("a cell\nof two lines", nested=[deep, told])], [cell("", nested=[inner])])
    long = grid([cell("Sentence of words. " * 60, nested=[grid([cell("word " * 100, nested=[inner])])])])
    made = [(1, json.dumps(table)), (2, json.dumps(long)), (3, None), (4, "no json")]
    rows = assembly.contexts(tables.grid(spark.createDataFrame(made, "table_id long, table_json string")))
    got = {(r.table_id, path_numbers(r.path)): r.context for r in rows.collect()}
    assert got[1, (0, 1, 0)] == "a cell of two lines"
    assert got[1, (0, 1, 0, 0, 1, 0)] == "a cell of two lines > around the deep one"
    assert got[1, (0, 1, 1)] == "First one. Near before."
    assert got[1, (1, 0, 0)] == ""
    assert got[2, (0, 0, 0)].endswith("…") and len(got[2, (0, 0, 0)]) <= 350
    assert len(got[2, (0, 0, 0, 0, 0, 0)]) <= 500 and got[2, (0, 0, 0, 0, 0, 0)].endswith("word…") and " > word" in got[2, (0, 0, 0, 0, 0, 0)]
    assert set(got) == {(1, (0, 1, 0)), (1, (0, 1, 0, 0, 1, 0)), (1, (0, 1, 1)), (1, (1, 0, 0)), (2, (0, 0, 0)), (2, (0, 0, 0, 0, 0, 0))}


def test_budget_of_both_sides():
    before, after = "Far away. " * 50 + "Close by.", "Right here. " + "Much later. " * 50
    both = assembly.direct_context(before, after, "unused")
    assert "Close by." in both and "Right here." in both and len(both) <= 350
    assert both.startswith("Far away.") and len(both) > 300
    # what one side leaves goes to the other, which fits in whole
    assert assembly.direct_context("x. " * 110, "short", None) == "x. " * 110 + "short"
    assert assembly.direct_context("short", "x. " * 110, None) == "short " + ("x. " * 110).strip()
    assert assembly.direct_context("", "", "unused") == "" and assembly.direct_context(None, None, None) == ""
    assert assembly.with_ancestors(["a" * 400, "b" * 300]) == "…" + "a" * 8 + " > " + "b" * 300  # the last of the pieces that fit
    assert assembly.with_ancestors(["far. " * 60 + "near.", "b" * 470]) == "…near. > " + "b" * 470
    assert assembly.with_ancestors(["up", "", "own"]) == "up > own" and assembly.with_ancestors([]) == ""


def test_search_text_of_a_nested_chunk(spark):
    table = json.dumps(grid([cell("k", "HEADER"), cell("v", "HEADER")], ["1", cell("inside", nested=[grid(["x", "y"])])]))
    sections = [(1, "s", 2, "One > Two")]
    blocks = [(1, 1, None, "PARAGRAPH", "before", None, None), (1, 3, "s", "HEADING", " A\n heading ", None, None), (1, 4, "s", "TABLE", None, 9, table), (1, 5, "s", "PARAGRAPH", "...", None, None)]
    got = [(r.sequence_no, r.search_text) for r in assembly.chunks(*frames(spark, sections, blocks)).orderBy("sequence_no").collect()]
    assert got == [(1, "[문서 서두]\nbefore"), (2, "[One > Two]\n소제목: A heading\nk | v\n1 | inside"), (3, "[One > Two]\n소제목: A heading\n상위 셀 문맥: inside\nx | y")]


def test_problems_keep_a_filing_out(spark):
    sections = [(1, "a", 1, "p"), (2, "b", 5, "p"), (3, "c", 0, "p")]
    blocks = [(1, 2, "a", "PARAGRAPH", "fine", None, None), (2, 5, "b", "PARAGRAPH", "x", None, None), (3, 1, "c", "PARAGRAPH", "x", None, None), (4, 1, "a", "PARAGRAPH", "x", None, None), (5, None, None, "PARAGRAPH", "x", None, None), (6, 1, None, "IMAGE", None, None, None)]
    given = frames(spark, sections, blocks)
    assert {tuple(r) for r in assembly.problems(*given).collect()} == {(2, 5, "SHARED_SEQUENCE"), (3, 0, "BAD_SEQUENCE"), (4, 1, "UNKNOWN_SECTION"), (5, None, "BAD_SEQUENCE")}
    assert [(r.doc_id, r.body) for r in assembly.chunks(*given).collect()] == [(1, "fine")]
    assert assembly.chunks(*frames(spark, [], [])).count() == 0


@pytest.mark.parametrize(("text", "units"), [
    ("매출은 3.5억원이다. 다음 해에도 늘었다! 그렇다?왜", ["매출은 3.5억원이다.", "다음 해에도 늘었다!", "그렇다?", "왜"]),
    ("Sales of 3.5 m. rose. (In all.) \"Yes.\" no", ["Sales of 3.5 m. rose.", "(In all.)", "\"Yes.\" no"]),
    ("句。句！ end", ["句。", "句！", "end"]),
    ("", []),
])
def test_sentences(text, units):
    assert chunking.sentence_units(text) == units


def test_pieces_keep_whole_characters():
    text = "🙂" * 30
    assert chunking.split_text(text, 7, 10) == ["🙂" * 7] * 4 + ["🙂" * 2]
    assert chunking.broken("word, word word", 8) == ["word,", "word", "word"]
    assert chunking.split_text("One. Two. Three.", 10, 20) == ["One. Two.", "Three."]


def test_reading_order_numbers(spark):
    sections = [(1, "a", 1, "p"), (1, "b", 6, "q")]
    kinds = ["HEADING", "PARAGRAPH", "HEADING", "HEADING", "IMAGE", "HEADING", "PARAGRAPH"]
    blocks = [(1, k, "a" if k < 6 else "b", kind, "text", None, None) for k, kind in zip((2, 3, 4, 5, 7, 8, 9), kinds, strict=True)]
    rows = assembly.reading_order(*frames(spark, sections, blocks)).orderBy("sequence_no").select("sequence_no", F.dense_rank().over(assembly.Window.orderBy("segment")).alias("s"), "epoch", "run").collect()
    assert [tuple(r) for r in rows] == [(2, 1, 1, 1), (3, 1, 1, 1), (4, 1, 2, 2), (5, 1, 2, 3), (7, 2, 0, 1), (8, 2, 1, 2), (9, 2, 1, 2)]


def test_drafts_of_tables_move_nothing(spark):
    """A table is expanded once, where it is, and its context is that of the cells; keys are of any type."""
    inner = grid(["in"])
    table = grid([cell("k", "HEADER"), cell("v", "HEADER")], ["1", cell("a cell\nof two lines", nested=[grid([cell("mid", nested=[inner])]), grid([])])], [cell(""), cell("x" * 200, nested=[inner])])
    rows = [(k, json.dumps(table) if k % 3 else (None, "no json")[k % 2]) for k in range(40)]
    made = spark.createDataFrame(rows, "k long, table_json string").repartition(3)
    drafts = assembly.table_drafts(made.select(F.struct("k", F.lit("a").alias("b")).alias("table_id"), "table_json"), TABLE)
    assert "Exchange hashpartitioning" not in drafts._jdf.queryExecution().executedPlan().toString()
    told = {(r.table_id, r.path): r.context for r in assembly.contexts(tables.grid(made.withColumnRenamed("k", "table_id"))).collect()}
    got: dict[int, list] = {}
    for r in drafts.collect():
        assert r.table_id.b == "a" and r.context == told.get((r.table_id.k, r.path))
        got.setdefault(r.table_id.k, []).append((r.part, path_numbers(r.path), r.body, r.first_row, r.last_row))
    want = [(k, path, body, first, last) for k, (path, body, first, last) in enumerate(packed_table(table, TABLE))]
    assert set(got) == {k for k in range(40) if k % 3} and all(sorted(x) == want for x in got.values())


def test_blocks_are_put_in_order_once(spark, monkeypatch):
    staged, names = shared.staged, []
    monkeypatch.setattr(shared, "staged", lambda df, name: names.append(name) or staged(df, name))
    s, b = made(random.Random(2), 1)
    plan = assembly.chunks(*frames(spark, s, b), TEXT, TABLE)._jdf.queryExecution().executedPlan().toString()
    assert names == ["filing-problems", "filing-order"] and "starts" not in plan
