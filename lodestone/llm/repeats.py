"""Repeated strings of a corpus by prefix-free parsing.

Every byte is found that a string of ``length`` bytes covers which also starts anywhere else, in the same text or
another. Texts are parsed into phrases at triggers of a rolling hash, and repeats are decided on the dictionary
of distinct phrases and their counts in the parse, not on the text; a copy of a phrase costs one row.

Triggers: a window (a string of ``length`` bytes) is read as its grams of ``gram`` bytes, and its trigger is the
gram of least hash, the first of those. It depends on the window's bytes alone, so equal windows have equal triggers
at equal offsets, and every window has one. Windows in a row with the same trigger are a phrase: the bytes from
the first window's start to the last one's end. Phrases overlap by length - 1 bytes, so each window lies in just
one phrase, and no phrase holds a window twice.

1. Count the parse by trigger. A trigger that occurs once has windows that occur once. Where all phrases of a
   trigger are equal and there are several, all their windows repeat.
2. Where a trigger has different phrases, phrases that occur several times repeat as a whole. For the others, the
   dictionary's distinct phrases of the trigger are laid end to end, and a suffix array puts their windows in
   order, cut off at ``length`` bytes, as longer agreement isn't asked for. Equal windows have their trigger at the
   same place, so the order is made place by place where there are many. Equal neighbours repeat. With the
   counts of the parse that is what the corpus order of all suffixes would say, without a sort of the corpus.
3. A trigger with more than ``GROUP`` different phrases is split before anything is ordered. A window's place is where its
   trigger stands in it. Phrases are cut into the windows of a quarter of the places; all windows of a quarter share the
   bytes around the trigger that each of them holds, so equal ones have equal such bytes, and those are the key of a
   smaller group. Cut phrases that are equal as a whole are counted as in step 2, and one of them goes on. Groups that
   are still too large are cut again, down to single windows, whose key is all of the window. So no task holds more than
   ``GROUP`` different phrases of a group, copies of a passage cost a few rows each, and there is but one form of phrase.

Windows are compared byte by byte; grams, phrases and the keys of groups by 61-bit hashes, phrases only among equal
keys, so by 122 bits.

Corpus order: phrases overlap by a window less a byte, so two suffixes that agree on ``length`` bytes do so inside
their phrases, and the order of the parse, which would tell apart suffixes that agree beyond a phrase's end, is never
asked. So no suffix array of the parse is made; it comes in by its counts.

Rows: a null text is empty; texts shorter than ``length`` lose nothing. Repeated rows are copies like any
others, and each is returned. Texts are known by 88 bits of two hashes of theirs and worked on once, however many
rows have them and whatever their doc_ids; the rows meet the result at the end. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import _bytes, _store


@dataclass(frozen=True)
class Params:
    length: int = 200
    gram: int = 64


PARAMS = Params()

#: Different phrases of one group that a task orders at once, and phrases of several groups.
GROUP, TOGETHER = 512, 2_048
#: Ranges of places into which the windows of too large a group are dealt.
RANGES = 4
#: Windows whose bytes are ordered at once, about.
AT_ONCE = 1 << 15
#: Bytes of a text that are parsed at once; longer texts in sections, whose phrases are cut at the borders.
SECTION = 8 << 20

_U = np.uint64
_LOW = _U(0xFFFFFF)


def phrases(data: np.ndarray, at: np.ndarray, params: Params) -> tuple[np.ndarray, ...]:
    """First window, number of windows, hash of the trigger and hash of the phrase, for all phrases of the rows."""
    none = np.zeros(0, np.int64)
    parts = [(none, none, none.astype(_U), none.astype(_U))]
    if len(data) <= SECTION:
        parts.append(_parse(data, at, params))
    else:
        for row in range(len(at) - 1):
            for low in range(int(at[row]), int(at[row + 1]), SECTION):
                high = min(low + SECTION + params.length - 1, int(at[row + 1]))
                first, *rest = _parse(data[low:high], np.array([0, high - low]), params)
                parts.append((first + low, *rest))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _parse(data: np.ndarray, at: np.ndarray, params: Params) -> tuple[np.ndarray, ...]:
    length, gram = params.length, params.gram
    n, rows = len(data) - length + 1, np.flatnonzero(np.diff(at) >= length)
    if n <= 0 or not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
    prefix = _bytes.prefix_hash(data)
    key = _bytes.gram_hash(data, gram)
    least = (key & ~_LOW) | np.arange(len(key), dtype=_U)  # the hash, then the place, so the first of equal ones
    span, size = length - gram + 1, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: n], least[span - size :])
    trigger = (least & _LOW).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)  # windows that don't leave their row
    inside[at[rows]] += 1
    np.subtract.at(inside, at[rows + 1] - length + 1, 1)
    inside = np.cumsum(inside[:n]) > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (trigger[1:] != trigger[:-1])
    new[at[rows]] = True
    last = inside.copy()
    last[:-1] &= new[1:] | ~inside[1:]
    first, final = np.flatnonzero(new), np.flatnonzero(last)
    return first, final - first + 1, key[trigger[first]], _bytes.span_hash(prefix, first, final + length)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, doc and tag (64 and 24 bits of the text's hashes), which name the text, and text."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return out.select("doc_id", F.xxhash64("text").alias("doc"), F.xxhash64(F.lit("tag"), "text").bitwiseAND(F.lit(0xFFFFFF)).alias("tag"), "text")


def parse(docs: DataFrame, params: Params = PARAMS) -> DataFrame:
    """doc, span (first window, number of windows and tag, in one number), trigger, phrase: a row for each phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for low, _, data, at in _bytes.slices(batch.column(2)):
                first, n, trigger, phrase = phrases(data, at, params)
                row = np.searchsorted(at, first, "right") - 1
                span = (first - at[row]) << 32 | n << 24 | tag[low + row]
                yield pa.RecordBatch.from_arrays([pa.array(doc[low + row]), pa.array(span), pa.array(trigger.view(np.int64)), pa.array(phrase.view(np.int64))], ["doc", "span", "trigger", "phrase"])

    return _rows(docs).select("doc", "tag", "text").mapInArrow(_bytes.frugal(run), "doc long, span long, trigger long, phrase long")


def _first(span):
    return F.shiftright(span, 32)


def _count(span):
    return F.shiftright(span, 24).bitwiseAND(F.lit(0xFF))


def _tag(span):
    return F.col(span).bitwiseAND(F.lit(0xFFFFFF))


def _packed(docs: DataFrame) -> DataFrame:
    """doc, tag and the compressed text of each distinct text; copies fold before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, at = _bytes.text_buffers(batch.column(2))
            raw = memoryview(np.ascontiguousarray(data))
            packed = pa.array([press.compress(raw[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], packed], ["doc", "tag", "packed"])

    packed = _rows(docs).select("doc", "tag", "text").mapInArrow(_bytes.frugal(run), "doc long, tag long, packed binary")
    return packed.groupBy("doc", "tag").agg(F.first("packed").alias("packed"))


_MARKED = "doc long, tag long, n_bytes long, sha string, packed binary, runs array<struct<low: long, high: long>>, tests array<struct<trigger: long, single: boolean, big: boolean, first: long, n: int, bytes: binary>>"


def _mark(joined: DataFrame, length: int) -> DataFrame:
    """Joins end here: rows without marks are done; the others keep their text, and bring the phrases to be ordered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for low in range(0, len(batch), 256):
                out: list[dict] = []
                for doc, tag, packed, marks in zip(*(c.to_pylist() for c in batch.slice(low, 256).columns), strict=True):
                    text = press.decompress(packed)
                    row = {"doc": doc, "tag": tag, "n_bytes": len(text), "sha": None, "packed": None, "runs": [], "tests": []}
                    if marks:
                        whole = sorted((m["first"], m["first"] + m["n"] - 1 + length) for m in marks if m["whole"])
                        row["runs"] = [{"low": a, "high": b} for a, b in _merged(whole)]
                        row["tests"] = [{k: m[k] for k in ("trigger", "single", "big", "first", "n")} | {"bytes": text[m["first"] : m["first"] + m["n"] - 1 + length]} for m in marks if m["trigger"] is not None]
                        row["packed"] = packed
                    else:
                        row["sha"] = hashlib.sha256(text).hexdigest()
                    out.append(row)
                yield pa.RecordBatch.from_pylist(out, schema)

    run_type = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
    test_type = pa.list_(pa.struct([("trigger", pa.int64()), ("single", pa.bool_()), ("big", pa.bool_()), ("first", pa.int64()), ("n", pa.int32()), ("bytes", pa.binary())]))
    schema = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string()), ("packed", pa.binary()), ("runs", run_type), ("tests", test_type)])
    return joined.select("doc", "tag", "packed", "marks").mapInArrow(_bytes.frugal(run), _MARKED)


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted [low, high) runs, with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for low, high in runs:
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _starts(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The phrases (columns n and bytes) end to end, and row and place of each window."""
    data, at = _bytes.text_buffers(batch.column("bytes"))
    n = batch.column("n").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    return data, row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + at[row]


def _places(data: np.ndarray, at: np.ndarray, params: Params) -> np.ndarray:
    """Where each phrase's trigger stands: the gram of least hash of its first window, the first of those."""
    key, span, out = _bytes.gram_hash(data, params.gram), np.arange(params.length - params.gram + 1), []
    for k in range(0, len(at) - 1, 1024):
        start = at[k : min(k + 1024, len(at) - 1), None] + span
        out.append(np.argmin(key[start] & ~_LOW, axis=1))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _ordered(tests: DataFrame, params: Params) -> DataFrame:
    """doc, tag, first, n: windows of single phrases that occur again, in runs; from phrases dealt by trigger and sorted."""

    length = params.length

    def order(rows: pa.Table) -> pa.RecordBatch:
        data, row, start = _starts(rows)
        single = rows.column("single").to_numpy(zero_copy_only=False)[row]
        _, begin = _bytes.text_buffers(rows.column("bytes"))
        place = (_places(data, begin, params) + begin[:-1])[row] - start  # of the trigger in each window
        parts = -(-len(row) // AT_ONCE)
        part = place * parts // (length - params.gram + 1)
        windows = np.lib.stride_tricks.sliding_window_view(data, length)
        twice = np.zeros(len(row), bool)
        for k in range(parts):
            own = np.flatnonzero(part == k) if parts > 1 else np.arange(len(row))
            # the suffix array of these windows, by bytes
            suffix = np.ascontiguousarray(windows[start[own]]).view(f"S{length}").ravel()
            at = np.argsort(suffix)
            suffix = suffix[at]
            same = np.zeros(len(at) + 1, bool)
            same[1:-1] = suffix[1:] == suffix[:-1]
            twice[own[at]] = same[1:] | same[:-1]
        twice &= single
        edge = twice.copy()
        edge[1:] &= ~twice[:-1] | (row[1:] != row[:-1])
        last = twice.copy()
        last[:-1] &= ~twice[1:] | (row[1:] != row[:-1])
        low, high = np.flatnonzero(edge), np.flatnonzero(last)
        n = rows.column("n").to_numpy().astype(np.int64)
        first = rows.column("first").to_numpy()[row[low]] + low - (np.cumsum(n) - n)[row[low]]
        return pa.RecordBatch.from_arrays([pa.array(rows.column(c).to_numpy()[row[low]]) for c in ("doc", "tag")] + [pa.array(first), pa.array(high - low + 1)], ["doc", "tag", "first", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            trigger = held.column("trigger").to_numpy()
            whole = int(np.searchsorted(trigger, trigger[-1])) if len(trigger) else 0  # the last trigger may go on
            for part in _runs(trigger[:whole]):
                yield order(held.slice(*part).combine_chunks())
            held = held.slice(whole)
        if held is not None and len(held):
            yield order(held.combine_chunks())

    return tests.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(_bytes.frugal(run), "doc long, tag long, first long, n long")


def _runs(trigger: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, number) of rows that are ordered together: whole triggers."""
    low = 0
    while low < len(trigger):
        high = min(low + TOGETHER, len(trigger))
        if high < len(trigger):
            back = int(np.searchsorted(trigger, trigger[high]))
            high = back if back > low else int(np.searchsorted(trigger, trigger[high], "right"))
        yield low, high - low
        low = high


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... of count[k] numbers, for all k one after the other."""
    upto = np.cumsum(count)
    return np.repeat(first - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)


_PARTS = "doc long, tag long, trigger long, single boolean, first long, n int, bytes binary, low int, full long"


def _split(tests: DataFrame, width: int, params: Params) -> DataFrame:
    """Phrases cut at places: the windows whose places lie between low and low + width (of the row) go to RANGES smaller ranges.

    trigger becomes the hash of the bytes that all windows of the range hold; full is the hash of the bytes of all of them.
    """
    length, step = params.length, -(-width // RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_row in range(0, len(batch), 1024):
                part = batch.slice(at_row, 1024)
                data, at = _bytes.text_buffers(part.column("bytes"))
                n, first, low = (part.column(c).to_numpy().astype(np.int64) for c in ("n", "first", "low"))
                place = _places(data, at, params)
                row = np.repeat(np.arange(len(n)), RANGES)
                own = low[row] + np.tile(np.arange(RANGES) * step, len(n))
                end = np.minimum(own + step, low[row] + width)
                # the k-th window of a phrase has the place of the first less k
                begin, last = np.maximum(0, place[row] - end + 1), np.minimum(n[row] - 1, place[row] - own)
                kept = (own < end) & (begin <= last)
                row, own, end, begin, last = (x[kept] for x in (row, own, end, begin, last))
                start, stop, trigger = at[row] + begin, at[row] + last + length, at[row] + place[row]
                prefix = _bytes.prefix_hash(data)
                key = _bytes.mix(_bytes.span_hash(prefix, trigger - own, trigger - end + 1 + length) + own.astype(_U))
                ends = np.append(0, np.cumsum(stop - start)).astype(np.int32)
                cut = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(data[_spread(start, stop - start)])])
                columns = [part.column(c).take(pa.array(row)) for c in ("doc", "tag")] + [pa.array(key.view(np.int64)), part.column("single").take(pa.array(row))]
                columns += [pa.array(first[row] + begin), pa.array(last - begin + 1, pa.int32()), cut, pa.array(own, pa.int32()), pa.array(_bytes.span_hash(prefix, start, stop).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PARTS.split(", ")])

    return tests.select("doc", "tag", "single", "first", "n", "bytes", "low").mapInArrow(_bytes.frugal(run), _PARTS)


def _groups(counted: DataFrame, scratch: _store.Scratch) -> DataFrame:
    """trigger and how many different phrases it has, of those where a phrase that occurs once may hold windows of another.

    counted has trigger and times, a row for each different phrase. Written, so that both sides of a join with it are plain
    exchanges, whose hot partitions Spark can split.
    """
    groups = counted.groupBy("trigger").agg(F.count("*").alias("different"), F.min("times").alias("least"))
    return scratch.staged(groups.where("different > 1 and least = 1").select("trigger", "different"))


def _refined(tests: DataFrame, params: Params, scratch: _store.Scratch) -> tuple[DataFrame, DataFrame]:
    """Phrases in groups that a task can order, and those (of big groups) whose windows all occur again: doc, tag, first, n."""
    names = ["doc", "tag", "trigger", "single", "first", "n", "bytes"]
    ready = tests.where("not big").select(*names)
    whole = ready.select("doc", "tag", "first", "n").where("false")
    width, large = params.length - params.gram + 1, tests.where("big").withColumn("low", F.lit(0))
    while width > 1 and not large.isEmpty():
        parts = scratch.staged(_split(large, width, params))
        times = F.sum(F.when(F.col("single"), 1).otherwise(2))
        counted = scratch.staged(parts.groupBy("trigger", "full").agg(times.alias("times"), F.min(F.struct("doc", "tag", "first", "n", "low", "bytes")).alias("one")))
        again = counted.where("times > 1").select("trigger", "full")
        whole = whole.union(parts.where("single").join(again, ["trigger", "full"], "left_semi").select("doc", "tag", "first", "n"))
        left = counted.join(_groups(counted, scratch), "trigger").select("one.*", "trigger", (F.col("times") == 1).alias("single"), (F.col("different") > GROUP).alias("big"))
        left = scratch.staged(left)
        ready = ready.union(left.where("not big").select(*names))
        large, width = left.where("big"), -(-width // RANGES)
    return ready, whole


def removals(docs: DataFrame, params: Params = PARAMS) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes; null where nothing goes), sha (of the remaining bytes) and runs (removed)."""
    length = params.length
    if length > 255 or params.gram >= length:
        raise ValueError("length is at most 255 bytes, and longer than a gram")
    with _store.Scratch(docs.sparkSession, "repeats") as scratch:
        # the parse is made anew for the count and for the join: it costs less than to keep it
        triggers = parse(docs, params).groupBy("trigger").agg(F.count("*").alias("n"), F.min("phrase").alias("low"), F.max("phrase").alias("high"))
        # written, so that both sides of the join are plain exchanges, whose hot partitions Spark can split
        triggers = scratch.staged(triggers.where("n > 1").select("trigger", (F.col("low") == F.col("high")).alias("alike")))
        found = scratch.staged(parse(docs, params).join(triggers, "trigger"))
        alike, mixed = found.where("alike").select("doc", "span"), found.where("not alike").select("doc", "span", "trigger", "phrase")

        counted = mixed.groupBy("trigger", "phrase").agg(F.count("*").alias("times"), F.min(F.struct("doc", "span")).alias("one"))
        counted = scratch.staged(counted)
        whole = alike.union(mixed.join(counted.where("times > 1").select("trigger", "phrase"), ["trigger", "phrase"], "left_semi").select("doc", "span"))
        tests = counted.join(_groups(counted, scratch), "trigger").select("one.doc", "one.span", "trigger", (F.col("times") == 1).alias("single"), (F.col("different") > GROUP).alias("big"))

        null = {"trigger": F.lit(None).cast("long"), "single": F.lit(None).cast("boolean"), "big": F.lit(None).cast("boolean")}
        marks = whole.select("doc", "span", F.lit(True).alias("whole"), *[c.alias(k) for k, c in null.items()])
        marks = marks.union(tests.select("doc", "span", F.lit(False), "trigger", "single", "big"))
        # at most two marks for each phrase of a text, however many rows have it: its copies' marks are equal
        marks = marks.groupBy("doc", _tag("span").alias("tag")).agg(F.collect_set(F.struct(_first("span").alias("first"), _count("span").cast("int").alias("n"), "whole", "trigger", "single", "big")).alias("marks"))
        marked = _store.staged(_mark(_packed(docs).join(marks, ["doc", "tag"], "left"), length), "repeats-marked")
        tests = marked.where("size(tests) > 0").select("doc", "tag", F.explode("tests").alias("t")).select("doc", "tag", "t.*")
        ready, more = _refined(tests, params, scratch)
        again = _store.staged(_ordered(ready, params).union(more), "repeats-again")

    # no more runs than the text has windows that begin one
    again = again.groupBy("doc", "tag").agg(F.collect_list(F.struct(F.col("first").alias("low"), (F.col("first") + F.col("n") - 1 + length).alias("high"))).alias("more"))
    flagged = marked.where("packed is not null").select("doc", "tag", "n_bytes", "packed", "runs").join(again, ["doc", "tag"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for low in range(0, len(batch), 256):
                out = []
                for doc, tag, n_bytes, packed, runs, more in zip(*(c.to_pylist() for c in batch.slice(low, 256).columns), strict=True):
                    merged = _merged(sorted((r["low"], r["high"]) for r in [*runs, *(more or [])]))
                    text, parts, at = press.decompress(packed), [], 0
                    for a, b in merged:
                        parts.append(text[at:a])
                        at = b
                    kept = b"".join([*parts, text[at:]])
                    out.append({"doc": doc, "tag": tag, "n_bytes": n_bytes, "kept": kept, "sha": hashlib.sha256(kept).hexdigest(), "runs": [{"low": a, "high": b} for a, b in merged]})
                yield pa.RecordBatch.from_pylist(out, schema)

    run_type = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
    schema = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("sha", pa.string()), ("runs", run_type)])
    done = flagged.select("doc", "tag", "n_bytes", "packed", "runs", "more").mapInArrow(_bytes.frugal(cut), "doc long, tag long, n_bytes long, kept binary, sha string, runs array<struct<low: long, high: long>>")
    texts = done.union(marked.where("packed is null").select("doc", "tag", "n_bytes", F.lit(None).cast("binary"), "sha", "runs"))
    return _rows(docs).select("doc_id", "doc", "tag").join(texts, ["doc", "tag"]).select("doc_id", "n_bytes", "kept", "sha", "runs")


def digests(docs: DataFrame, params: Params = PARAMS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    out = removals(docs, params)
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["high"] - r["low"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))
