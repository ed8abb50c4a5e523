"""Filings in HTML and XML, as rows: blocks in reading order, tables as JSON, links and profiles.

Documents are the unit of work: each is parsed in Python, in Arrow batches, and a document that can't be parsed gives one
row with its error instead of failing the job.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.sax import ContentHandler, SAXException, make_parser
from xml.sax.handler import feature_external_ges

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SKIPPED = {"script", "style", "noscript"}
_BLOCKS = {"p", "div", "li", "ul", "ol", "section", "article", "header", "footer", "nav", "main", "body", "form"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


def _tidy(text: str) -> str:
    lines = (" ".join(line.replace(" ", " ").split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


class _HtmlBlocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str | None, str | None]] = []
        self.links: list[tuple[str, str]] = []
        self.tags: Counter[str] = Counter()
        self.text: list[str] = []
        self.kind = "PARAGRAPH"
        self.hidden: list[str] = []
        self.tables: list[dict] = []
        self.depth = self.deepest = self.nested = 0
        self.href: str | None = None
        self.label: list[str] = []

    def flush(self) -> None:
        text = _tidy("".join(self.text))
        if text:
            self.blocks.append((self.kind, text, None))
        self.text, self.kind = [], "PARAGRAPH"

    def handle_starttag(self, tag: str, attrs) -> None:
        self.tags[tag] += 1
        given = dict(attrs)
        if tag not in _VOID:
            self.depth += 1
            self.deepest = max(self.deepest, self.depth)
            style = (given.get("style") or "").replace(" ", "").lower()
            if self.hidden or tag in _SKIPPED or "display:none" in style or "noprint" in (given.get("class") or "").split():
                self.hidden.append(tag)
                return
        if self.hidden:
            return
        if tag == "br":
            self._write("\n")
        elif tag == "table":
            if not self.tables:
                self.flush()
            self.nested += bool(self.tables)
            self.tables.append({"rows": []})
        elif self.tables and tag == "tr":
            self.tables[-1]["rows"].append({"cells": []})
        elif self.tables and tag in ("td", "th") and self.tables[-1]["rows"]:
            self.tables[-1]["rows"][-1]["cells"].append({"type": "HEADER" if tag == "th" else "DATA", "rowSpan": _span(given.get("rowspan")), "colSpan": _span(given.get("colspan")), "text": "", "nestedTables": []})
        elif not self.tables and (tag in _BLOCKS or tag in _HEADINGS):
            self.flush()
            self.kind = "HEADING" if tag in _HEADINGS else "PARAGRAPH"
        if tag == "img" and not self.tables:
            self.flush()
            self.blocks.append(("IMAGE", given.get("alt"), None))
        if tag == "a":
            self.href, self.label = given.get("href"), []

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _VOID:
            return
        self.depth = max(0, self.depth - 1)
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            return
        if tag == "table" and self.tables:
            table = self.tables.pop()
            for row in table["rows"]:
                for cell in row["cells"]:
                    cell["text"] = _tidy(cell["text"])
            if not self.tables:
                self.blocks.append(("TABLE", None, json.dumps(table, ensure_ascii=False)))
            elif self.tables[-1]["rows"] and self.tables[-1]["rows"][-1]["cells"]:
                self.tables[-1]["rows"][-1]["cells"][-1]["nestedTables"].append(table)
        elif not self.tables and (tag in _BLOCKS or tag in _HEADINGS):
            self.flush()
        if tag == "a" and self.href is not None:
            self.links.append((self.href, _tidy("".join(self.label))))
            self.href = None

    def _write(self, data: str) -> None:
        if self.tables:
            rows = self.tables[-1]["rows"]
            if rows and rows[-1]["cells"]:
                rows[-1]["cells"][-1]["text"] += data
        else:
            self.text.append(data)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self._write(re.sub(r"\s+", " ", data))
            if self.href is not None:
                self.label.append(data)


def _span(value: str | None) -> int:
    if value is None:
        return 1
    if not value.strip().isdigit() or int(value) < 1:
        raise ValueError(f"span {value!r}")
    return int(value)


def parsed_html(source: str) -> _HtmlBlocks:
    parser = _HtmlBlocks()
    parser.feed(source)
    parser.close()
    parser.flush()
    return parser


# Names in angle brackets that filings use as plain text.
PSEUDO_TAGS = ("STS", "CG", "BGMI", "DREAM", "MANIFESTO", "DATABADA", "GRANDATA", "SIT", "IIT", "SHEESH")
_BARE_AMPERSAND = re.compile(r"&(?!(?:#\d+|#x[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);)")
_BARE_ANGLE = re.compile(rf"<(?![/!?A-Za-z])|<(?=/?(?:{'|'.join(PSEUDO_TAGS)})\b)")


_MARKS = re.compile('[<>"]')
_OPENS = re.compile(r"=\s*$")
#: What stands behind a quote that ends a value: the line's or the tag's end, or another attribute.
_CLOSES = re.compile(r"\s*(?:$|[/?]?>|[^\W\d][\w:.\-]*\s*=|:[\w:.\-]*\s*=)")


def repaired_quotes(line: str) -> tuple[str, int]:
    """A line with quotes inside attribute values escaped, or left out where the value has nothing before them; and how many there were.

    Outside a tag, in a tag, in a value: only marks change the state, and angle brackets in a value are none.
    """
    out, done, repairs = [], 0, 0
    tag, value = False, -1  # where the value begins
    for mark in _MARKS.finditer(line):
        at, sign = mark.start(), mark[0]
        if not tag:
            tag = sign == "<"
        elif value < 0:
            if sign == ">":
                tag = False
            elif sign == '"' and _OPENS.search(line, 0, at):
                value = at + 1
        elif sign == '"':
            if _CLOSES.match(line, at + 1):
                value = -1
                continue
            repairs += 1
            empty = at == value
            out += [line[done:at], "" if empty else "&quot;"]
            done = at + 1
            value = at + 1 if empty else value
    return "".join([*out, line[done:]]), repairs


def repaired_xml(source: str) -> tuple[str, int]:
    """The source with bare ampersands, angle brackets and quotes in attributes escaped, and how many there were."""
    source, a = _BARE_AMPERSAND.subn("&amp;", source)
    source, b = _BARE_ANGLE.subn("&lt;", source)
    lines = [repaired_quotes(x) if x.count('"') > 2 else (x, 0) for x in source.split("\n")]
    return "\n".join(x for x, _ in lines), a + b + sum(n for _, n in lines)


class _XmlBlocks(ContentHandler):
    def __init__(self) -> None:
        super().__init__()
        self.blocks: list[tuple[str, str | None, str | None, int, str]] = []  # kind, text, table, level, section title
        self.levels: list[int] = []
        self.titles: list[str | None] = []
        self.tables: list[dict] = []
        self.text: list[str] = []
        self.tags: Counter[str] = Counter()
        self.name = ""

    def _path(self) -> str:
        return " > ".join(t for t in self.titles if t)

    def _add(self, kind: str, text: str | None, table: str | None = None) -> None:
        if kind == "PAGE_BREAK" and self.blocks and self.blocks[-1][0] == "PAGE_BREAK":
            return
        self.blocks.append((kind, text, table, self.levels[-1] if self.levels else 0, self._path()))

    def startElement(self, name: str, attrs) -> None:  # noqa: N802
        self.tags[name] += 1
        if m := re.fullmatch(r"SECTION-(\d)", name):
            self.levels.append(int(m[1]))
            self.titles.append(None)
        elif name == "TABLE":
            self.tables.append({"rows": []})
        elif name == "TR" and self.tables:
            self.tables[-1]["rows"].append({"cells": []})
        elif name in ("TD", "TH", "TU", "TE") and self.tables and self.tables[-1]["rows"]:
            self.tables[-1]["rows"][-1]["cells"].append({"type": "HEADER" if name == "TH" else "DATA", "rowSpan": _span(attrs.get("ROWSPAN")), "colSpan": _span(attrs.get("COLSPAN")), "text": "", "nestedTables": []})
        elif name == "PGBRK":
            self._add("PAGE_BREAK", None)
        if name in ("P", "TITLE", "DOCUMENT-NAME", "IMG-CAPTION") and not self.tables:
            self.text = []

    def endElement(self, name: str) -> None:  # noqa: N802
        if name == "TABLE" and self.tables:
            table = self.tables.pop()
            for row in table["rows"]:
                for cell in row["cells"]:
                    cell["text"] = _tidy(cell["text"])
            if not self.tables:
                self._add("TABLE", None, json.dumps(table, ensure_ascii=False))
            elif self.tables[-1]["rows"] and self.tables[-1]["rows"][-1]["cells"]:
                self.tables[-1]["rows"][-1]["cells"][-1]["nestedTables"].append(table)
            return
        if self.tables:
            if name == "P":
                self.characters("\n")
            return
        text = _tidy("".join(self.text))
        if name == "DOCUMENT-NAME":
            self.name = text
        elif name == "TITLE":
            if self.titles and self.titles[-1] is None:
                self.titles[-1] = text
            elif text:
                self._add("HEADING", text)
        elif name == "P" and text:
            self._add("PARAGRAPH", text)
        elif name == "IMG-CAPTION":
            self._add("IMAGE", text or None)
        elif re.fullmatch(r"SECTION-\d", name):
            self.levels.pop()
            self.titles.pop()
        if name in ("P", "TITLE", "DOCUMENT-NAME", "IMG-CAPTION"):
            self.text = []

    def characters(self, content: str) -> None:
        if self.tables:
            rows = self.tables[-1]["rows"]
            if rows and rows[-1]["cells"]:
                rows[-1]["cells"][-1]["text"] += content
        else:
            self.text.append(content)


def parsed_xml(source: str) -> tuple[_XmlBlocks, int]:
    fixed, repairs = repaired_xml(source)
    handler, parser = _XmlBlocks(), make_parser()
    parser.setFeature(feature_external_ges, False)
    parser.setContentHandler(handler)
    parser.feed(fixed)
    parser.close()
    return handler, repairs


_BLOCK_SCHEMA = "doc_id long, sequence_no int, block_type string, text string, table_json string, section_level int, section_path string, status string, error string"

#: Documents that are read at once, and blocks and characters that are given at once: what a task holds beside the batch it was given.
_READ, _ROWS, _CHARS = 32, 2_000, 1 << 20
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _in_parts(schema: str, read: Callable[[int, str], list[tuple]], pages: DataFrame) -> DataFrame:
    """Rows that read makes of (doc_id, source), given in small parts, so a task's memory doesn't follow the size of its batches."""
    fields = [c.split() for c in schema.split(", ")]
    kinds = pa.schema([(name, _ARROW[kind]) for name, kind in fields])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for start in range(0, batch.num_rows, _READ):
                part = batch.slice(start, _READ)
                for doc, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    rows += read(doc, source or "")
                    held += len(source or "")
                    if len(rows) >= _ROWS or rows and held >= _CHARS:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return pages.select(F.col("doc_id").cast("long").alias("doc_id"), "source").mapInArrow(run, schema)


def blocks(documents: DataFrame, kind: str) -> DataFrame:
    """The blocks of documents (doc_id, source) of kind html or xml; a failed one has a row of status FAILED."""

    def read(doc: int, source: str) -> list[tuple]:
        try:
            found = [(k, t, j, 1, "") for k, t, j in parsed_html(source).blocks] if kind == "html" else parsed_xml(source)[0].blocks
            return [(doc, n, *b, "COMPLETED", None) for n, b in enumerate(found, 1)]
        except (ValueError, SAXException) as e:
            return [(doc, 0, None, None, None, 0, None, "FAILED", str(e)[:2000])]

    return _in_parts(_BLOCK_SCHEMA, read, documents)


def routed_blocks(documents: DataFrame) -> DataFrame:
    """Blocks of documents (doc_id, format, source), each by its format's parser; other formats are FAILED rows."""
    others = documents.where(~F.col("format").isin("HTML", "DART_XML"))
    failed = others.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("sequence_no"), *[F.lit(None).cast(t).alias(n) for n, t in (("block_type", "string"), ("text", "string"), ("table_json", "string"))], F.lit(0).alias("section_level"), F.lit(None).cast("string").alias("section_path"), F.lit("FAILED").alias("status"), F.concat(F.lit("no parser for "), "format").alias("error"))
    return blocks(documents.where("format = 'HTML'"), "html").unionByName(blocks(documents.where("format = 'DART_XML'"), "xml")).unionByName(failed)


def html_profile(documents: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """doc_id and how often each tag opens, by expression counts alone."""
    counts = [F.regexp_count(F.lower("source"), F.lit(rf"<{t}[\s>/]")).cast("long").alias(f"n_{t}") for t in tags]
    return documents.select("doc_id", *counts)


class _XmlProfile(ContentHandler):
    """Counts of what an XML filing is made of, without its tree."""

    def __init__(self) -> None:
        super().__init__()
        self.tags: Counter[str] = Counter()
        self.depth = self.deepest = self.inside = self.nested = 0

    def startElement(self, name: str, attrs) -> None:  # noqa: N802
        self.tags[name] += 1
        self.depth += 1
        self.deepest = max(self.deepest, self.depth)
        if name == "TABLE":
            self.nested += self.inside > 0
            self.inside += 1

    def endElement(self, name: str) -> None:  # noqa: N802
        self.depth -= 1
        self.inside -= name == "TABLE"


_PROFILE_SCHEMA = "doc_id long, tags map<string, long>, max_depth int, n_nested_tables int, n_repairs int, status string, error string"


def structure_profile(documents: DataFrame, kind: str) -> DataFrame:
    """doc_id, how often each tag opens, the depth, nested tables and repairs of documents (doc_id, source) of kind html or xml."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, source in zip(batch.doc_id, batch.source, strict=True):
                try:
                    if kind == "html":
                        found = parsed_html(source or "")
                        rows.append((doc, dict(found.tags), found.deepest, found.nested, 0, "COMPLETED", None))
                    else:
                        fixed, repairs = repaired_xml(source or "")
                        handler, parser = _XmlProfile(), make_parser()
                        parser.setFeature(feature_external_ges, False)
                        parser.setContentHandler(handler)
                        parser.feed(fixed)
                        parser.close()
                        rows.append((doc, dict(handler.tags), handler.deepest, handler.nested, repairs, "COMPLETED", None))
                except (ValueError, SAXException) as e:
                    rows.append((doc, {}, 0, 0, 0, "FAILED", str(e)[:2000]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PROFILE_SCHEMA.replace("<string, long>", "").split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source").mapInPandas(run, _PROFILE_SCHEMA)


def section_levels(profile: DataFrame) -> DataFrame:
    """doc_id, level and n: how many sections of each level a profiled XML filing has."""
    each = profile.select("doc_id", F.explode("tags").alias("tag", "n")).where(F.col("tag").rlike(r"^SECTION-\d$"))
    return each.select("doc_id", F.substring("tag", 9, 1).cast("int").alias("level"), "n")


def reconciled(profile: DataFrame, parsed: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """doc_id, metric, profiled, parsed and agrees for each check: a count of the profile against one of the parse's metrics."""
    both = profile.join(tree_metrics(parsed).drop("status"), "doc_id", "left")
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.coalesce(a, F.lit(0)).cast("long").alias("profiled"), F.coalesce(b, F.lit(0)).cast("long").alias("parsed")) for k, (a, b) in checks.items()])
    return both.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.*", (F.col("x.profiled") == F.col("x.parsed")).alias("agrees"))


def html_links(documents: DataFrame) -> DataFrame:
    """doc_id, position and href of the anchors, in order."""
    hrefs = F.regexp_extract_all("source", F.lit(r"<a\s[^>]*href=\"([^\"]*)\""), F.lit(1))
    return documents.select("doc_id", F.posexplode(hrefs).alias("position", "href"))


def tree_metrics(parsed: DataFrame) -> DataFrame:
    """Counts of each document's blocks by type, and its characters."""
    kinds = ("HEADING", "PARAGRAPH", "TABLE", "IMAGE", "PAGE_BREAK")
    return parsed.groupBy("doc_id").agg(*[F.count_if(F.col("block_type") == k).alias(f"n_{k.lower()}") for k in kinds], F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_characters"), F.max("status").alias("status"))


def link_target(url: Column) -> Column:
    """The filing that a link names: system and 14-digit number, or null."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))

    def number(*keys: str) -> Column:
        found = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(url, F.lit(rf"(?i)[?&]{k}=([^&#]*)"), F.lit(1)) for k in keys])))
        return F.when((F.size(found) == 1) & F.get(found, F.lit(0)).rlike(r"^\d{14}$"), F.get(found, F.lit(0)))

    target = F.when(host == "dart.fss.or.kr", F.struct(F.lit("DART").alias("system"), number("rcpNo").alias("number"))).when(host == "kind.krx.co.kr", F.struct(F.lit("KRX").alias("system"), number("acptNo", "rcpNo").alias("number")))
    return F.when(target["number"].isNotNull(), target)
