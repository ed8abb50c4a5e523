"""Elements of HTML filings as rows, and headings decided over their order.

The walk through a page only says what stands where: each element outside tables with its parent, tag, class, style and text. What is
a heading is decided in Spark: by tag or class, by its words, or by its style and what comes next, a bold centred span directly before
a table. Hidden elements and scripts are no rows, so they don't stand between two others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.markup import _BLOCKS, _SKIPPED, _VOID

# The class of filings' pages and of their titles, and the title of corrections.
FORM, TITLE, CORRECTION = "xforms", "xforms_title", "정정신고(보고)"
#: Characters of a span that can be a heading by its style.
MOST_TITLE = 120

_SCHEMA = "doc_id long, position int, parent int, tag string, classes string, style string, text string, in_form boolean, holds_table boolean"


def _tidy(text: str) -> str | None:
    lines = (" ".join(x.split()) for x in text.replace("\xa0", " ").split("\n"))
    return "\n".join(x for x in lines if x) or None


class _Walk(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[dict] = []  # of elements that can hold others
        self.hidden: list[str] = []
        self.tables = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        given = dict(attrs)
        style, classes = given.get("style") or "", given.get("class") or ""
        if self.hidden or tag in _SKIPPED or "display:none" in style.replace(" ", "").lower() or "noprint" in classes.split():
            if tag not in _VOID:
                self.hidden.append(tag)
            return
        if self.tables:
            self.tables += tag == "table"
            return
        if tag in _BLOCKS and any(x["tag"] == "p" for x in self.open):
            self._close("p")
        if tag == "br":
            self._write("\n")
        row = {"position": len(self.rows), "parent": self.open[-1]["position"] if self.open else -1, "tag": tag, "classes": classes, "style": style, "text": [], "in_form": FORM in classes.split() or any(x["in_form"] for x in self.open), "holds_table": False}
        self.rows.append(row)
        if tag == "table":
            self.tables = 1
            for x in self.open:
                x["holds_table"] = True
        elif tag not in _VOID:
            self.open.append(row)

    def _close(self, tag: str) -> None:
        if any(x["tag"] == tag for x in self.open):
            while self.open.pop()["tag"] != tag:
                pass

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
        elif self.tables:
            self.tables -= tag == "table"
        else:
            self._close(tag)

    def _write(self, data: str) -> None:
        for x in self.open:
            if x["tag"] == "span" or TITLE in x["classes"].split() or re.fullmatch("h[1-6]", x["tag"]):
                x["text"].append(data)

    def handle_data(self, data: str) -> None:
        if not self.hidden and not self.tables:
            self._write(re.sub(r"\s+", " ", data))


def elements(documents: DataFrame) -> DataFrame:
    """The elements outside tables of documents (doc_id, source), in order; text only of those that may be headings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        for batch in batches:
            out = []
            for doc, source in zip(batch.doc_id, batch.source, strict=True):
                walk = _Walk()
                walk.feed(source or "")
                walk.close()
                out += [{"doc_id": doc} | x | {"text": _tidy("".join(x["text"]))} for x in walk.rows]
            yield pd.DataFrame(out, columns=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source").mapInPandas(run, _SCHEMA)


def declared(style: Column, name: str) -> Column:
    """The value that a style declares last for a property, in small letters; empty if none."""
    values = F.regexp_extract_all(F.lower(style), F.lit(rf"(?:^|;)\s*{name}\s*:\s*([^;]*)"), F.lit(1))
    return F.coalesce(F.trim(F.try_element_at(values, F.lit(-1))), F.lit(""))


def headings(rows: DataFrame) -> DataFrame:
    """doc_id, position, title and kind (CLASS, TAG, CORRECTION, STYLE) of the headings among elements.

    A heading inside another is left out.
    """
    next_tag = F.lead("tag").over(Window.partitionBy("doc_id", "parent").orderBy("position"))
    flat = F.regexp_replace("text", r"\s+", "")
    weight = declared(F.col("style"), "font-weight")
    styled = (
        (F.col("tag") == "span") & ~F.col("holds_table") & (F.length("text") <= MOST_TITLE) & (F.instr("text", "\n") == 0)
        & ((weight == "bold") | weight.rlike("^[7-9]00$")) & (declared(F.col("style"), "text-align") == "center") & (F.col("next_tag") == "table")
    )
    kind = (
        F.when(F.array_contains(F.split("classes", r"\s+"), TITLE), "CLASS")
        .when(F.col("tag").rlike("^h[1-6]$"), "TAG")
        .when((F.col("tag") == "span") & ~F.col("holds_table") & (flat == CORRECTION), "CORRECTION")
        .when(styled, "STYLE")
    )
    found = rows.withColumn("next_tag", next_tag).where("in_form and text is not null").withColumn("kind", kind).where("kind is not null")
    own = found.select("doc_id", F.col("position").alias("parent"))
    top = found.join(own, ["doc_id", "parent"], "left_anti")
    return top.select("doc_id", "position", F.when(F.regexp_replace("text", r"\s+", "") == CORRECTION, CORRECTION).otherwise(F.col("text")).alias("title"), "kind")


def sections(rows: DataFrame) -> DataFrame:
    """doc_id, position, title, n_tables: the headings in order, each with the tables up to the next; position -1 is what is before the first."""
    marks = rows.join(headings(rows).select("doc_id", "position", "title"), ["doc_id", "position"], "left")
    upto = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    under = F.coalesce(F.max(F.when(F.col("title").isNotNull(), F.col("position"))).over(upto), F.lit(-1))
    out = marks.withColumn("under", under).groupBy("doc_id", F.col("under").alias("position")).agg(F.max("title").alias("title"), F.count_if(F.col("tag") == "table").alias("n_tables"))
    return out.where("title is not null or n_tables > 0")


def problems(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id and problem of documents that are no filings: NO_FORM without an element of the form's class."""
    formed = rows.where("in_form").select("doc_id").distinct()
    return documents.select(F.col("doc_id").cast("long").alias("doc_id")).join(formed, "doc_id", "left_anti").select("doc_id", F.lit("NO_FORM").alias("problem"))
