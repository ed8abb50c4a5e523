"""Chunks of whole filings in reading order: text and tables, nested tables with what stands around them.

Two streams meet here, starts of sections and blocks. Windows over their common order give segments (between two starts, or
where the section changes), epochs (headings that stand for what follows them) and runs (paragraphs that may share a chunk).
What windows can't say, as it depends on what was packed before, is a fold over rows in order: the rows are dealt by run or
table and sorted, and a task keeps one length, so no filing is gathered anywhere. What is gathered is one chunk's parts.

Lengths are in code points. Sizes: a chunk takes the next part if it stays within ``target``, or if it is shorter than ``least``
and stays within ``most``; a paragraph longer than ``most`` and a table row longer than ``absolute`` are cut by sentences.

Filings with a problem (``problems``) have no chunks. A null or blank text is no paragraph and no heading; a null table is an
empty one; one that can't be expanded is a problem. Chunks without a letter or digit are left out before chunks are numbered.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import shared
from lodestone.functions import text as T
from lodestone.operators import tables
from lodestone.operators.chunking import TABLE_SIZES, TEXT_SIZES, Sizes, split_text

# The path of what stands before the first section, and what leads the context of a nested table.
PREAMBLE = "문서 서두"
CONTEXT_PREFIX = "상위 셀 문맥: "
#: Characters of the context from all tables around one, and the mark of what was cut.
MOST_CONTEXT, CUT = 500, "…"

_BLOCK = ["doc_id", "sequence_no"]
#: One step of a nested grid's path: a row and a cell of the grid around it.
_STEP = re.compile(r"rows\[(\d+)\]\.cells\[(\d+)\]\.nestedTables\[\d+\]\.")


def problems(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, sequence_no, problem: numbers that are missing or not positive, that two things share, and sections that aren't there."""
    events = sections.select("doc_id", "sequence_no").unionByName(blocks.select("doc_id", "sequence_no"))
    counted = events.groupBy("doc_id", "sequence_no").agg(F.count("*").alias("n"))
    bad = F.when(F.col("sequence_no").isNull() | (F.col("sequence_no") < 1), "BAD_SEQUENCE").when(F.col("n") > 1, "SHARED_SEQUENCE")
    numbered = counted.select("doc_id", "sequence_no", bad.alias("problem")).where("problem is not null")
    known = sections.select("doc_id", "section_id").distinct()
    lost = blocks.where("section_id is not null").join(known, ["doc_id", "section_id"], "left_anti")
    return numbered.unionByName(lost.select("doc_id", "sequence_no", F.lit("UNKNOWN_SECTION").alias("problem")))


def _shown(kind: Column, text: Column) -> Column:
    """The text of a paragraph or heading as it is used; null if nothing is left."""
    return F.when(kind == "HEADING", T.heading(text)).when(kind == "PARAGRAPH", F.nullif(T.paragraph(text), F.lit("")))


def reading_order(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, sequence_no, section_id, block_type, text) with shown, segment, epoch and run.

    A segment ends at a section's start and where the section changes. An epoch begins at a heading behind anything that used
    the one before: a paragraph, a table, an image. A run begins at each heading, table and image. All are numbered from 0.
    """
    starts = sections.select("doc_id", "sequence_no", F.lit(True).alias("starts"))
    events = blocks.withColumn("starts", F.lit(False)).unionByName(starts, allowMissingColumns=True)
    by_doc = Window.partitionBy("doc_id").orderBy("sequence_no")
    before = F.lag(F.struct("starts", "section_id")).over(by_doc)
    edge = ~F.col("starts") & (before["starts"] | ~before["section_id"].eqNullSafe(F.col("section_id")))
    upto = by_doc.rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumn("edge", F.coalesce(edge, F.lit(False)).cast("int")).withColumn("segment", F.sum("edge").over(upto)).where(~F.col("starts")).drop("edge", "starts")

    inside = Window.partitionBy("doc_id", "segment").orderBy("sequence_no")
    earlier, own = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("shown", _shown(F.col("block_type"), F.col("text")))
    heading, solid = F.col("block_type") == "HEADING", F.col("block_type").isin("TABLE", "IMAGE")
    used = F.max(F.when((F.col("block_type") == "PARAGRAPH") & F.col("shown").isNotNull() | solid, F.col("sequence_no"))).over(earlier)
    last = F.max(F.when(heading, F.col("sequence_no"))).over(earlier)
    out = out.withColumn("opens", (heading & F.coalesce(used > last, last.isNull())).cast("int"))
    return out.withColumns({"epoch": F.sum("opens").over(own), "run": F.sum((heading | solid).cast("int")).over(own)}).drop("opens")


def _headings(ordered: DataFrame) -> DataFrame:
    """doc_id, segment, epoch, headings: those of an epoch, which all stand before what uses them."""
    rows = ordered.where("block_type = 'HEADING' and shown is not null")
    gathered = F.sort_array(F.collect_list(F.struct("sequence_no", "shown")))
    return rows.groupBy("doc_id", "segment", "epoch").agg(F.transform(gathered, lambda x: x["shown"]).alias("headings"))


def _folded(rows: DataFrame, keys: list[str], order: list[str], add, extra: str) -> DataFrame:
    """rows with the columns of extra: add, made anew for each key, gets the rows of the key in order and gives their values.

    add(row) may give several: then the row is repeated.
    """
    fields = [f for f in rows.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + extra
    names = [f.name for f in fields] + [c.split()[0] for c in extra.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, step = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != last:
                    last, step = key, add()
                out += [(*row, *more) for more in step(row)]
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _taken(length: int, added: int, sizes: Sizes) -> bool:
    """Whether a chunk of that length takes what makes it so much longer."""
    return length + added <= sizes.target or length < sizes.least and length + added <= sizes.most


def _pieces(rows: DataFrame, sizes: Sizes) -> DataFrame:
    """Paragraphs in parts; only those longer than most go through Python."""
    long = F.length("shown") > sizes.most

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, sizes.most, sizes.absolute))

    whole = rows.where(~long).select("*", F.lit(0).alias("part"), F.col("shown").alias("piece"))
    return whole.union(rows.where(long).select("*", F.posexplode(cut("shown")).alias("part", "piece")))


def text_drafts(ordered: DataFrame, sizes: Sizes = TEXT_SIZES) -> DataFrame:
    """doc_id, segment, epoch, section_id, anchor, part, body, first_block, last_block of the text chunks."""
    kept = ["doc_id", "segment", "run", "epoch", "section_id", "sequence_no"]
    parts = _pieces(ordered.where("block_type = 'PARAGRAPH' and shown is not null").select(*kept, "shown"), sizes).select(*kept, "part", "piece")
    breaks = ordered.where("block_type = 'PAGE_BREAK'").select(*kept, F.lit(0).alias("part"), F.lit(None).cast("string").alias("piece"))

    def packing():
        length, chunk = 0, 0

        def add(row):
            nonlocal length, chunk
            if row.piece is None:  # a page's end
                if length >= sizes.least:
                    length, chunk = 0, chunk + 1
                return []
            if length and not _taken(length, 2 + len(row.piece), sizes):
                length, chunk = 0, chunk + 1
            length += len(row.piece) + 2 * (length > 0)
            return [(chunk,)]

        return add

    packed = _folded(parts.union(breaks), ["doc_id", "segment", "run"], ["sequence_no", "part"], packing, "chunk int")
    pieces = F.sort_array(F.collect_list(F.struct("sequence_no", "part", "piece")))
    out = packed.groupBy("doc_id", "segment", "run", "chunk").agg(F.first("epoch").alias("epoch"), F.first("section_id").alias("section_id"), pieces.alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["piece"]), "\n\n")
    first = F.col("p")[0]
    return out.select("doc_id", "segment", "epoch", "section_id", first["sequence_no"].alias("anchor"), first["part"].alias("part"), body.alias("body"),
                      first["sequence_no"].alias("first_block"), F.element_at("p", -1)["sequence_no"].alias("last_block"))


def grid_chunks(rows: list[tuple[int, bool, str]], sizes: Sizes = TABLE_SIZES) -> list[tuple[str, int, int]]:
    """(body, first row, last row) of a grid's chunks, from its rows that aren't blank: (row, of headers alone, text).

    Rows of headers alone at a grid's start are repeated in each chunk, unless the grid has no others or they leave no room.
    """
    lead = next((k for k, (_, header_only, _) in enumerate(rows) if not header_only), 0)
    room = sum(len(text) + 1 for _, _, text in rows[:lead])
    if room >= sizes.absolute:
        lead = room = 0
    header = [text for _, _, text in rows[:lead]]
    out: list[tuple[list[str], int, int]] = []
    length, joins = 0, False  # of the last chunk without its header, and whether it may take more
    for row, _, text in rows[lead:]:
        size = len(text)
        if room + size > sizes.absolute:
            left = sizes.absolute - room
            out += [([piece], row, row) for piece in split_text(text, min(max(1, sizes.most - room), left), left)]
            length, joins = 0, False
        elif joins and _taken(room + length, 1 + size, sizes):
            out[-1] = ([*out[-1][0], text], out[-1][1], row)
            length += size + 1
        else:
            out.append(([text], row, row))
            length, joins = size, True
    return [("\n".join([*header, *texts]), first, last) for texts, first, last in out]


def nearest(text: str, most: int) -> str:
    """The end of a text, by sentences, behind a mark if something is left out."""
    if len(text) <= most:
        return text
    if most <= 1:
        return CUT[:most]
    return CUT + split_text(text, most - 1, most - 1)[-1]


def direct_context(before: str | None, after: str | None, cell: str | None) -> str:
    """What stands around a nested table in its cell: near sentences on both sides, or the cell's start where the source doesn't tell sides."""
    flat = lambda x: " ".join((x or "").split())
    most = tables.MAX_CONTEXT
    if before is None and after is None:
        text = flat(cell)
        if len(text) <= most:
            return text
        edge = text.rfind(" ", 0, most)
        return text[: edge if edge >= (most - 1) // 2 else most - 1].rstrip() + CUT
    sides = [flat(before), flat(after)]
    if all(sides):
        room = [len(x) for x in tables.nested_context(*sides, most - 1)]
    else:
        room = [most, most]
    parts = [split_text(x, n, n)[end] for x, n, end in zip(sides, room, (-1, 0), strict=True) if x]
    return " ".join(parts)


def with_ancestors(contexts: list[str]) -> str:
    """Contexts from the outermost table to the own, the nearest in full and the others as far as there is room."""
    out = ""
    for own in contexts:
        if not out or not own:
            out = own or nearest(out, MOST_CONTEXT)
            continue
        room = MOST_CONTEXT - 3 - len(own)
        above = nearest(out, room) if room >= 1 else ""
        out = f"{above} > {own}" if above else nearest(own, MOST_CONTEXT)
    return out


def contexts(cells: DataFrame) -> DataFrame:
    """table_id, path, context of each nested grid: what stands around it in the cells of all grids that hold it."""
    nested = cells.where("error is null and path <> '' and row_index = 0 and column_index = 0")
    up, at = r"^(.*?)rows\[\d+\]\.cells\[\d+\]\.nestedTables\[\d+\]\.$", r"rows\[(\d+)\]\.cells\[(\d+)\]\.nestedTables\[\d+\]\.$"
    nested = nested.select("table_id", F.col("path").alias("inner"), F.regexp_extract("path", up, 1).alias("path"), *[F.regexp_extract("path", at, k).cast("int").alias(c) for k, c in ((1, "row_index"), (2, "cell_index"))], "before", "after")
    around = cells.where("is_origin").select("table_id", "path", "row_index", "cell_index", F.col("text").alias("cell"))
    own = nested.join(around, ["table_id", "path", "row_index", "cell_index"], "left").select("table_id", "inner", "before", "after", "cell")
    # a grid and all that hold it: the paths that its own begins with, as many as it is deep
    steps = F.regexp_extract_all("inner", F.lit(r"rows\[\d+\]\.cells\[\d+\]\.nestedTables\[\d+\]\."), F.lit(0))
    chain = nested.select("table_id", F.col("inner").alias("path"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), ""))).alias("depth", "inner"))
    gathered = F.sort_array(F.collect_list(F.struct("depth", "before", "after", "cell")))
    rows = chain.join(own, ["table_id", "inner"], "left").groupBy("table_id", "path").agg(gathered.alias("c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [with_ancestors([direct_context(x["before"], x["after"], x["cell"]) for x in c]) for c in batch.c]
            yield pd.DataFrame({"table_id": batch.table_id, "path": batch.path, "context": text})

    return rows.mapInPandas(run, "table_id long, path string, context string")


def contexts_of(rows: list[tuple]) -> dict[str, str]:
    """What ``contexts`` tells of the nested grids of one table, from its expanded rows."""
    sides = {path: (before, after) for path, row, _, before, after in rows if row == 0}
    cells = {(path, row): own for path, row, own, _, _ in rows}
    out = {}
    for path in sides:
        chain, outer = [], ""
        for step in _STEP.finditer(path):
            inner, cell = path[: step.end()], int(step[2])
            chain.append(direct_context(*sides.get(inner, (None, None)), next((c[0] for c in cells.get((outer, int(step[1])), ()) if c[4] == cell), None)))
            outer = inner
        if chain:
            out[path] = with_ancestors(chain)
    return out


def _with_context(keys: pa.Array, rows: list[tuple], more: list[tuple]) -> pa.RecordBatch:
    """rows as in ``tables``, with the number of their table and the context of their grid."""
    made, (number, context) = tables.row_batch(keys, rows), zip(*more, strict=True)
    columns = [made.column("table_id"), pa.array(number, pa.int64()), *(made.column(c) for c in ("path", "row_index", "cells")), pa.array(context, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["table_id", "number", "path", "row_index", "cells", "context"])


_DRAFT = (("path", pa.string()), ("part", pa.int32()), ("body", pa.string()), ("context", pa.string()), ("first_row", pa.int32()), ("last_row", pa.int32()))


def _draft_batch(drafts: list[tuple]) -> pa.RecordBatch:
    keys, *columns = zip(*drafts, strict=True)
    return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), *(pa.array(x, kind) for x, (_, kind) in zip(columns, _DRAFT, strict=True))], names=["table_id", *(name for name, _ in _DRAFT)])


def table_drafts(blocks: DataFrame, sizes: Sizes = TABLE_SIZES) -> DataFrame:
    """table_id, path, part (from 0, in the order of the table's grids), body, context, first_row, last_row from (table_id, table_json).

    table_id is of any type, a struct too. A table's rows stay in the task that expands it, in their order, so nothing is dealt or
    sorted; a task holds one grid. A table that can't be expanded has no drafts.
    """
    kind = blocks.schema["table_id"].dataType.simpleString()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            rows, more, held = [], [], 0
            for at, source in enumerate(batch.column(1).to_pylist()):
                try:
                    own = tables.expanded_rows(json.loads(source or "{}"))
                except (ValueError, TypeError, AttributeError):
                    continue
                around, number = contexts_of(own), number + 1
                rows += [(at, *row, None) for row in own]
                more += [(number, around.get(row[0])) for row in own]
                held += sum(len(row[2]) for row in own)
                if held >= tables.CELLS:
                    yield _with_context(batch.column(0), rows, more)
                    rows, more, held = [], [], 0
            if rows:
                yield _with_context(batch.column(0), rows, more)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_rows():
            for batch in batches:
                keys, names = batch.column(0), [c.to_pylist() for c in batch.columns[1:]]
                for k, row in enumerate(zip(*names, strict=True)):
                    yield keys, k, row

        out, table, part = [], None, 0
        for (number, path, context), rows in itertools.groupby(all_rows(), lambda x: x[2][:3]):
            if number != table:
                table, part = number, 0
            keys, at, row = next(rows)
            key, own = keys.slice(at, 1), [row[3:], *(row[3:] for _, _, row in rows)]
            for body, start, end in grid_chunks(own, sizes):
                out.append((key, path, part, body, context, start, end))
                part += 1
            if len(out) >= 500:
                yield _draft_batch(out)
                out = []
        if out:
            yield _draft_batch(out)

    schema = f"table_id {kind}, number long, path string, row_index int, cells array<struct<text: string, is_origin: boolean, is_header: boolean, continues: boolean, cell_index: int>>, context string"
    rows = blocks.select("table_id", "table_json").mapInArrow(expand, schema)
    cells = F.transform("cells", lambda x: F.struct(T.paragraph(x["text"]).alias("text"), (x["is_origin"] | x["continues"]).alias("shown"), x["is_header"].alias("header")))
    rows = rows.withColumn("cells", cells)
    text = T.row_text(F.transform("cells", lambda x: F.when(x["shown"], x["text"]).otherwise("")))
    rows = rows.select("table_id", "number", "path", "context", "row_index", F.forall("cells", lambda x: x["header"] | (x["text"] == "")).alias("header_only"), text.alias("text"))
    return rows.where("text <> ''").mapInArrow(pack, f"table_id {kind}, path string, part int, body string, context string, first_row int, last_row int")


def chunks(sections: DataFrame, blocks: DataFrame, text_sizes: Sizes = TEXT_SIZES, table_sizes: Sizes = TABLE_SIZES) -> DataFrame:
    """doc_id, sequence_no, chunk_type, section_path, headings, body, search_text, anchor, path, first, last of whole filings.

    sections have doc_id, section_id, sequence_no and section_path; blocks doc_id, sequence_no, section_id, block_type, text and
    table_id with table_json for tables. first and last are block numbers of text, and rows of the grid of a table.
    """
    bad = shared.staged(problems(sections, blocks).select("doc_id").distinct(), "filing-problems")
    sections, blocks = (x.join(bad, "doc_id", "left_anti") for x in (sections, blocks))
    # five things are made of the blocks in order, so they are written once
    blocks = blocks.withColumn("table_json", F.when(F.col("block_type") == "TABLE", F.col("table_json")))
    ordered = shared.staged(reading_order(sections, blocks).drop("text"), "filing-order")
    text = text_drafts(ordered, text_sizes).withColumns({"chunk_type": F.lit("TEXT"), "path": F.lit(None).cast("string"), "context": F.lit(None).cast("string")})
    text = text.withColumnsRenamed({"first_block": "first", "last_block": "last"})
    place = F.struct("doc_id", "segment", "epoch", "section_id", F.col("sequence_no").alias("anchor"))
    drafts = table_drafts(ordered.where("block_type = 'TABLE' and table_id is not null").select(place.alias("table_id"), "table_json"), table_sizes)
    table = drafts.select("table_id.*", *drafts.columns[1:]).withColumn("chunk_type", F.lit("TABLE")).withColumnsRenamed({"first_row": "first", "last_row": "last"})

    out = text.unionByName(table).where(F.col("body").rlike(r"[\p{L}\p{N}]"))
    out = out.join(_headings(ordered), ["doc_id", "segment", "epoch"], "left")
    out = out.join(sections.select("doc_id", "section_id", "section_path"), ["doc_id", "section_id"], "left")
    out = out.withColumn("section_path", F.when(F.col("section_id").isNull(), F.lit(PREAMBLE)).otherwise(F.col("section_path")))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("anchor", "part", F.when(F.col("chunk_type") == "TEXT", 0).otherwise(1)))
    headings = F.coalesce("headings", F.array().cast("array<string>"))
    led = F.when(F.length("context") > 0, F.concat(F.lit(CONTEXT_PREFIX), "context", F.lit("\n"), "body")).otherwise(F.col("body"))
    return out.select("doc_id", number.alias("sequence_no"), "chunk_type", "section_path", headings.alias("headings"), "body", T.search_text(F.col("section_path"), headings, led).alias("search_text"), "anchor", "path", "first", "last")
