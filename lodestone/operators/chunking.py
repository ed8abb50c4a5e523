"""Search chunks from ordered content blocks, and their packing to size.

Packing depends on what has been packed so far, which windows can't say, so a document's blocks are folded in Python, one
document at a time in Arrow batches. Everything around it stays in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sizes:
    """Characters: least, wanted, usual most, never more."""

    least: int
    target: int
    most: int
    absolute: int

    def __post_init__(self) -> None:
        if not self.least <= self.target <= self.most <= self.absolute:
            raise ValueError("sizes must ascend")


TEXT_SIZES, TABLE_SIZES = Sizes(700, 1000, 1400, 2000), Sizes(1000, 1500, 2000, 3000)

_SENTENCE = re.compile(r"(?<=[.!?。？！])\s+")
_SOFT = re.compile(r"[\s,;:)\]，；]")


def sentences(text: str, most: int) -> list[str]:
    """Sentences; one longer than ``most`` is broken at the last soft mark in its second half, or else at ``most``."""
    out = []
    for sentence in _SENTENCE.split(text.strip()):
        rest = sentence
        while len(rest) > most:
            marks = [m.end() for m in _SOFT.finditer(rest, most // 2, most - 1)]
            cut = marks[-1] if marks else most
            out.append(rest[:cut].strip())
            rest = rest[cut:].strip()
        if rest:
            out.append(rest)
    return out


def packed(parts: list[str], most: int, glue: str = " ") -> list[str]:
    """Parts in order, joined greedily while they fit."""
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(glue) + len(part) <= most:
            out[-1] += glue + part
        else:
            out.append(part)
    return out


def split_long(text: str, sizes: Sizes) -> list[str]:
    return [text] if len(text) <= sizes.most else packed(sentences(text, sizes.absolute), sizes.most)


# What ends a sentence at once, what ends it before a blank that no small letter follows, and what may close and open around it.
_ENDS = re.compile(r"""[!?。！？][!?。！？.．)\]}」』”’"']*\s*|[.．][!?。！？.．)\]}」』”’"']*\s+(?=[(\[{「『“‘"'\s]*[^a-zà-öø-ÿ(\[{「『“‘"'\s])""")
_MARKS = ",;:)]，；"


def sentence_units(text: str) -> list[str]:
    """Sentences by the marks of Korean and Latin prose; a point before a small letter or inside a number ends none."""
    out, at = [], 0
    for end in [m.end() for m in _ENDS.finditer(text)] + [len(text)]:
        if piece := text[at:end].strip():
            out.append(piece)
        at = end
    return out


def broken(text: str, most: int) -> list[str]:
    """A text longer than ``most`` in pieces: cut before the last blank or behind the last soft mark of the second half, or else at most."""
    out, rest = [], text.strip()
    while len(rest) > most:
        places = range(min(most - 1, len(rest) - 1), max(1, most // 2) - 1, -1)
        cut = next((k if rest[k].isspace() else k + 1 for k in places if rest[k].isspace() or rest[k] in _MARKS), most)
        out.append(rest[:cut].strip())
        rest = rest[cut:].lstrip()
    return [p for p in [*out, rest] if p]


def split_text(text: str, preferred: int, absolute: int) -> list[str]:
    """Sentences packed up to ``preferred``; one longer than ``absolute`` is broken."""
    text = text.strip()
    if len(text) <= preferred:
        return [text] if text else []
    units = [p for s in sentence_units(text) for p in ([s] if len(s) <= absolute else broken(s, preferred))]
    return packed(units, preferred)


@dataclass
class _Draft:
    headings: list[str]
    first: int
    parts: list[str] = field(default_factory=list)
    last: int = 0

    def length(self) -> int:
        return sum(map(len, self.parts)) + 2 * max(0, len(self.parts) - 1)


def text_chunks_of(blocks: list[tuple[int, str, str | None]], sizes: Sizes = TEXT_SIZES) -> list[dict]:
    """Chunks of one document's blocks (sequence, type, text), in order.

    Headings gather until a paragraph uses them; the next heading then starts anew. A table or image ends a chunk and
    the headings. A page break ends a chunk only if that has the least size.
    """
    out: list[dict] = []
    headings: list[str] = []
    used = False
    draft: _Draft | None = None

    def flush() -> None:
        nonlocal draft
        if draft and any(c.isalnum() for p in draft.parts for c in p):
            out.append({"sequence_no": len(out) + 1, "headings": list(draft.headings), "body": "\n\n".join(draft.parts), "first_block": draft.first, "last_block": draft.last})
        draft = None

    for seq, kind, text in blocks:
        text = (text or "").strip()
        if kind == "HEADING":
            flush()
            if used:
                headings, used = [], False
            if text:
                headings.append(text)
        elif kind in ("TABLE", "IMAGE"):
            flush()
            headings, used = [], False
        elif kind == "PAGE_BREAK":
            if draft and draft.length() >= sizes.least:
                flush()
        elif text:
            for part in split_long(text, sizes):
                if draft and draft.length() + 2 + len(part) > sizes.most:
                    flush()
                if draft is None:
                    draft = _Draft(list(headings), seq)
                draft.parts.append(part)
                draft.last = seq
                used = True
    flush()
    return out


#: Documents whose chunks are made at once.
_READ = 32


def text_chunks(blocks: DataFrame, sizes: Sizes = TEXT_SIZES) -> DataFrame:
    """doc_id, sequence_no, headings, body, first_block, last_block from blocks (doc_id, sequence_no, block_type, text)."""

    schema = pa.schema([("doc_id", pa.int64()), ("sequence_no", pa.int32()), ("headings", pa.list_(pa.string())), ("body", pa.string()), ("first_block", pa.int64()), ("last_block", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _READ):  # what a task holds beside the batch it was given
                part = [c.to_pylist() for c in batch.slice(start, _READ).columns]
                rows = [{"doc_id": doc} | c for doc, *blocks in zip(*part, strict=True) for c in text_chunks_of(list(zip(*blocks, strict=True)), sizes)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # a document's blocks are at most one file's
    gathered = blocks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("sequence_no", "block_type", "text"))).alias("parts"))
    gathered = gathered.select("doc_id", "parts.sequence_no", "parts.block_type", "parts.text")
    return gathered.mapInArrow(run, "doc_id long, sequence_no int, headings array<string>, body string, first_block long, last_block long")


def chunking_target() -> Column:
    """Documents (content_format, parse_status, parser_name, chunk_status, source_group) that are parsed, in a format that is chunked, and not chunked yet."""
    form, group = F.col("content_format"), F.col("source_group")
    partial = (form == "PDF") & (F.col("parse_status") == "PARTIAL") & F.coalesce(F.col("parser_name") == "PdfTextDisclosureParser", F.lit(False))
    fits = (form == "DART_XML") | (form == "PDF") & (group == "PERIODIC") | (form == "HTML") & (group == "EXCHANGE")
    return ((F.col("parse_status") == "COMPLETED") | partial) & (F.col("chunk_status") == "PENDING") & fits


def sentence_chunks(documents: DataFrame, sizes: Sizes = TEXT_SIZES) -> DataFrame:
    """doc_id, sequence_no, body: whole texts cut by sentences and packed to size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, k, body) for doc, text in zip(batch.doc_id, batch.text, strict=True) for k, body in enumerate(packed(sentences(text or "", sizes.absolute), sizes.most), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "sequence_no", "body"])

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, sequence_no int, body string")
