"""Secrets in texts, by one automaton for all rules.

The rules' expressions are compiled by subset construction and minimised into one transition array. A batch of texts is
read once, a byte at a time in all of its segments together. Segments end at row borders and at bytes that lead
the automaton to its start from every state (line breaks, commas and such), so no match crosses their borders.
The exact expressions then run on those segments alone whose rules have ended, for the spans: leftmost,
not overlapping, and without matches that fail the rule's length. A segment of more than ``LONG`` bytes, of a text
without such bytes, is read by the same automaton on its own, as it would hold up the others.

Kinds: assign, access and hex, as the op6 contract has them, then private_key, jwt and slack, which the method adds.
Spans are in code points, end exclusive.

Rows: a null text is empty. Each row gives one result. Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import _bytes
from lodestone.llm.automaton import Automaton


@dataclass(frozen=True)
class Rule:
    kind: str
    scanned: str  #: for the automaton: ends in each text that has a match to be kept; shorter counts keep it small
    exact: str
    group: int = 0  #: whose length counts
    least: int = 0


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_SET = r"""["']?\x20*[:=]\x20*["']?"""

RULES = (
    Rule("assign", rf"({_KEYS}){_SET}[A-Za-z0-9+/_.=\-]{{2,}}", rf"({_KEYS}){_SET}([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{4,}", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{14,}", "[0-9a-f]+", 0, 24),
    Rule("private_key", r"-----BEGIN\x20([A-Z]+\x20)?PRIVATE\x20KEY-----", r"-----BEGIN\x20(?:[A-Z]+\x20)?PRIVATE\x20KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z\-]", r"xox[abprs]-[0-9A-Za-z-]+", 0, 20),
)
#: How many of the rules, from the first, are the contract's.
N_BASE = 3

LONG = 1 << 16
#: Bytes of a segment, about.
SEGMENT = 1024


def compiled(rules: tuple[Rule, ...] = RULES) -> Automaton:
    return Automaton([r.scanned for r in rules])


class Scanner:
    def __init__(self, automaton: Automaton, rules: tuple[Rule, ...] = RULES) -> None:
        self.automaton, self.rules = automaton, rules
        self.exact = [re.compile(r.exact) for r in rules]

    def segments(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Starts of segments, all row borders among them."""
        breaks = np.flatnonzero(self.automaton.resets[data] & ((data & 0xC0) != 0x80))  # not inside a character
        if not len(breaks):
            return np.unique(at[:-1])
        wanted = np.searchsorted(breaks, np.arange(SEGMENT, len(data), SEGMENT))
        return np.unique(np.concatenate([at[:-1], breaks[wanted[wanted < len(breaks)]]]))

    def spans(self, data: np.ndarray, at: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """By row: (start, rule, end) in code points, sorted."""
        if not len(data):
            return {}
        start = self.segments(data, at)
        start = start[start < len(data)]
        end = np.append(start[1:], len(data))
        long = end - start > LONG
        hit = np.zeros(len(start), np.uint16)
        hit[~long] = self.automaton.scan(data, start[~long], end[~long])
        for k in np.flatnonzero(long):
            hit[k] = self.automaton.scan_one(data[start[k] : end[k]])
        where = np.flatnonzero(hit)
        if not len(where):
            return {}
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        rows = np.searchsorted(at, start[where], "right") - 1
        out: dict[int, list[tuple[int, int, int]]] = {}
        for k, row in zip(where.tolist(), rows.tolist(), strict=True):
            text = data[start[k] : end[k]].tobytes().decode("utf-8", "replace")
            shift = int(points[start[k]] - points[at[row]])
            for r, rule in enumerate(self.rules):
                if hit[k] >> r & 1:
                    own = [(m.start() + shift, r, m.end() + shift) for m in self.exact[r].finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
                    if own:
                        out.setdefault(row, []).extend(own)
        return {row: sorted(found) for row, found in out.items()}


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES, n_base: int = N_BASE) -> DataFrame:
    """doc_id and spans (kind, start, end) of each row."""
    # a few thousand states at most, as the rules have; no data in it
    shared = docs.sparkSession.sparkContext.broadcast(compiled(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, rules)
        for batch in batches:
            for low, high, data, at in _bytes.slices(batch.column(1), 2 << 20):
                found = scanner.spans(data, at)
                spans = [[{"kind": rules[r].kind, "start": s, "end": e} for s, r, e in found.get(k, ())] for k in range(high - low)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(spans, span_type)], ["doc_id", "spans"])

    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_bytes.frugal(run), "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES, n_base: int = N_BASE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row."""
    base = [r.kind for r in rules[:n_base]]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    out = scanned(docs, rules, n_base)
    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter("spans", lambda x: x["kind"].isin(base))
    return out.select("doc_id", *map(count, base), F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
