"""Benchmark passages in documents, found by templates rather than by words.

A text becomes a sequence of template tokens: words without the punctuation at their edges, A-Z folded, where
numbers become one placeholder, units behind a number another, and runs of capitalised words inside a sentence a
third. Windows of eight tokens are joined with the benchmark's by hash; a window needs five plain words, so that
placeholders alone match nothing. Hits line up along diagonals (item, shift). Of each run of tokens that hits cover on
a diagonal, the longest piece with consistent slots counts, if it holds a window: each value of the benchmark stands for
one value of the document and the other way round, so a question with other numbers or names is found and a chance
meeting of templates isn't. Slots that are equal word for word are consistent. A document is contaminated if such a
piece has 13 tokens in a row, or half of an item's tokens are matched.
Items of five to seven tokens are one window each, of plain words or more than half of them; shorter ones
can't be told from chance and match nothing.

Beside its template a text is read as its plain words, A-Z folded and without the punctuation at their edges, numbers and
names too, in windows of eight of any words. So a copy is found whatever its letter case, however it is punctuated
and however dense in numbers it is. Such hits need no consistency, and count for the same run and share.

Items whose templates are equal word for word, with slots that repeat alike, are one class, as consistency can't tell
them apart: however many items a template has, a text meets it once. Words match those of any item of the class.

The join: the benchmark's windows are a table, distinct by class. The documents' windows pass a sieve first, a bit array
of the benchmark's window hashes of at most 2 bytes for each of ``block`` windows, and those left are joined with the
table by hash; Spark broadcasts it only where its written size is below the session's threshold. Hits are then grouped by
text, class and diagonal, a group being no longer than an item. Equal texts fold into one on the way. Texts go by their
md5, and only verdicts of texts with hits are joined back.

Every row gives one result, whatever its doc_id. Null texts, in either table, are empty and match nothing; null or
repeated item_ids don't matter, as items count by their class. Extra columns don't matter. With an empty benchmark nothing
is contaminated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import _bytes, _store


@dataclass(frozen=True)
class Params:
    window: int = 8
    least: int = 5  #: tokens of the shortest item that is looked for
    plain: float = 0.6  #: share of a window that placeholders don't fill
    run: int = 13  #: tokens in a row that contaminate
    share: float = 0.5  #: of an item's tokens that contaminates


PARAMS = Params()

#: Windows of the benchmark up to which the sieve grows; with more of them it lets more through, at no loss.
BLOCK = 8_000_000

# Names of units, as they stand behind a number.
UNITS = """% percent kg g mg lb lbs oz ton tons tonnes km m cm mm mi mile miles ft feet foot in inch inches yd yards
l ml liter liters litre litres gal gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours
day days week weeks month months year years km/h mph m/s kmh hz khz mhz ghz w kw mw v kv a ma j kj cal kcal n pa
kpa c f k usd eur gbp dollars dollar cents euros euro pounds pound yen won""".split()

_U = np.uint64
_NUMBER, _NAME, _UNIT = _U(0x1B873593CC9E2D51), _U(0x38B34AE5A1E38B93), _U(0x52DCE729DA3AC9FB)

_ALNUM = np.ones(256, bool)
_ALNUM[:128] = [chr(c).isalnum() for c in range(128)]
_DIGIT, _CAPITAL, _STOP = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = _CAPITAL[65:91] = True
_STOP[list(b".!?:")] = True


def _unit_hashes() -> np.ndarray:
    units = [u for u in UNITS if u[0].isalnum()]
    data, at = _bytes.text_buffers(pa.array(units))
    return np.sort(_bytes.span_hash(_bytes.prefix_hash(data, _bytes.FOLDED), at[:-1], at[1:]))


_UNIT_HASHES = _unit_hashes()


@dataclass(frozen=True)
class Tokens:
    token: np.ndarray
    slot: np.ndarray  #: the value of each slot, 0 for plain words
    first: np.ndarray  #: each row's first token, one entry more than rows
    word: np.ndarray  #: each token's first word, one entry more than tokens


def read(data: np.ndarray, at: np.ndarray) -> tuple[Tokens, Tokens]:
    """Template tokens of all rows, and their words."""
    start, end, first = _bytes.word_spans(data, at)
    solid = _ALNUM[data] & ~_bytes.SPACE[data]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid, out=before[1:])
    where = np.flatnonzero(solid)
    has = before[end] > before[start]
    stops = _STOP[data[end - 1]] if len(end) else np.zeros(0, bool)
    opens = np.zeros(len(start) + 1, bool)  # words that begin a sentence
    opens[1:] = np.append(stops, False)[: len(start)] if len(start) else opens[1:]
    opens[first[:-1]] = True
    opens = opens[: len(start)]
    for _ in range(2):  # marks alone, such as a dash, leave the sentence's beginning to the next word
        later = np.flatnonzero(opens & ~has) + 1
        opens[later[later < len(opens)]] = True
    rows = np.repeat(np.arange(len(at) - 1), np.diff(first))[has]
    core, last = where[before[start[has]]], where[before[end[has]] - 1] + 1
    opens, value = opens[has], _bytes.span_hash(_bytes.prefix_hash(data, _bytes.FOLDED), core, last)
    number = _DIGIT[data[core]]
    name = _CAPITAL[data[core]] & ~opens
    behind = np.zeros(len(core), bool)
    behind[1:] = number[:-1] & (rows[1:] == rows[:-1])
    unit = behind & np.isin(value, _UNIT_HASHES) if behind.any() else behind
    name &= ~unit
    token = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    slot = np.where(number | unit | name, value, _U(0))
    literal = Tokens(value, np.zeros(len(value), _U), np.searchsorted(rows, np.arange(len(at))), np.arange(len(value) + 1))
    word = literal.word
    # a run of names is one slot
    inner = np.zeros(len(core), bool)
    inner[1:] = name[1:] & name[:-1] & (rows[1:] == rows[:-1])
    if inner.any():
        heads = np.flatnonzero(~inner)
        place = np.arange(len(core)) - np.repeat(heads, np.diff(np.append(heads, len(core))))
        slot = np.add.reduceat(np.where(slot != 0, _bytes.mix(slot + place.astype(_U)), _U(0)), heads)
        token, rows, word = token[heads], rows[heads], np.append(heads, len(core))
    return Tokens(token, slot, np.searchsorted(rows, np.arange(len(at))), word), literal


def windows(text: Tokens, size: int, plain: float) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window, and where it begins; those with too few plain words or across rows are left out."""
    token, slot, first = text.token, text.slot, text.first
    n = len(token) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    total = _bytes.prefix_of_values(token)
    words = np.zeros(len(token) + 1, np.int64)
    np.cumsum(slot == 0, out=words[1:])
    good = words[size:] - words[:-size] >= plain * size
    for k in first[1:-1]:  # the starts whose window would pass the end of a row
        good[max(0, k - size + 1) : k] = False
    begin = np.flatnonzero(good)
    return _bytes.span_hash(total, begin, begin + size), begin


def consistent(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Where the longest piece begins and ends in which each value of a stands for one of b, and the other way round."""
    where = np.flatnonzero(a)
    best, begin = (0, 0), 0
    by_a: dict[int, tuple[int, int]] = {}  # the last place of a value, and what stood for it there
    by_b: dict[int, tuple[int, int]] = {}
    for k, x, y in zip(where.tolist(), a[where].tolist(), b[where].tolist(), strict=True):
        (i, other), (j, one) = by_a.get(x, (-1, y)), by_b.get(y, (-1, x))
        clash = max(i if other != y else -1, j if one != x else -1)
        if clash >= begin:
            best = max(best, (begin, k), key=lambda p: p[1] - p[0])
            begin = clash + 1
        by_a[x], by_b[y] = (k, y), (k, x)
    return max(best, (begin, len(a)), key=lambda p: p[1] - p[0])


def _classes(text: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The number of each slot's value in its row, by first occurrence (0 for plain words), and a hash of each row's class."""
    number = np.zeros(len(text.token), np.int64)
    for a, b in zip(text.first[:-1].tolist(), text.first[1:].tolist(), strict=True):
        known: dict[int, int] = {0: 0}
        number[a:b] = [known.setdefault(x, len(known)) for x in text.slot[a:b].tolist()]
    part = _bytes.mix(_bytes.mix(text.token + number.astype(_U)) + np.diff(text.word).astype(_U))
    return number, _bytes.span_hash(_bytes.prefix_of_values(part), text.first[:-1], text.first[1:])


def _keys(text: Tokens, kind: int, size: int, plain: float) -> tuple[np.ndarray, np.ndarray]:
    """Join keys and starts of the windows of a kind (0 templates, 1 words) and size."""
    key, start = windows(text, size, plain)
    return _bytes.mix(key ^ _U(kind << 8 | size)), start


def _pieces(values: np.ndarray, start: np.ndarray, size: int) -> pa.Array:
    """The bytes of values[start : start + size] for each start."""
    rows = values[start[:, None] + np.arange(size)] if len(start) else np.zeros((0, size), values.dtype)
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def item_windows(benchmark: DataFrame, params: Params = PARAMS) -> DataFrame:
    """The benchmark's windows, distinct by class: klass, kind, size, key, place, n_tokens, n_words, numbers and words (of templates)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in _bytes.slices(batch.column(0)):
                kinds = read(data, at)
                number, klass = _classes(kinds[0])
                lengths = [np.diff(k.first) for k in kinds]
                for kind, text in enumerate(kinds):
                    for size in range(params.least, params.window + 1):
                        own = lengths[kind] >= size if size == params.window else lengths[kind] == size
                        key, start = _keys(text, kind, size, params.plain)
                        item = np.searchsorted(text.first, start, "right") - 1
                        key, start, item = (x[own[item]] for x in (key, start, item))
                        place, same = start - text.first[item], np.ones(len(item), np.int32)
                        none = pa.array([b""] * len(item), pa.binary())
                        words = (text.word[start[:, None] + np.arange(size + 1)] - text.word[text.first[item]][:, None]).astype(np.int64)
                        columns = [klass[item].view(np.int64), kind * same, size * same, key.view(np.int64), place, *(n[item] for n in lengths)]
                        columns = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4), strict=True)]
                        columns += [none, none] if kind else [_pieces(number, start, size), pa.array([w.tobytes() for w in words], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["klass", "kind", "size", "key", "place", "n_tokens", "n_words", "numbers", "words"])

    texts = benchmark.select(F.col("text").cast("string").alias("text"))
    schema = "klass long, kind int, size int, key long, place long, n_tokens long, n_words long, numbers binary, words binary"
    return texts.mapInArrow(_bytes.frugal(run), schema).dropDuplicates(["klass", "kind", "size", "key", "place"])


def _sieve(items: DataFrame, bits: int) -> bytes:
    """A bit for each of the keys' first ``bits`` bits that some key has; as many bits whatever the benchmark's size."""
    place = F.shiftrightunsigned("key", 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = items.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("word")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["at"].to_numpy(np.int64)] = words["word"].to_numpy(np.int64)
    return out.tobytes()


def _found(docs: DataFrame, items: DataFrame, params: Params, block: int) -> DataFrame:
    """doc (md5 of the text), kind, size, key, begin and slots of the documents' windows that the sieve lets through."""
    # at most as many rows as kinds and sizes of windows
    shapes = sorted((r["kind"], r["size"], r["n"]) for r in items.groupBy("kind", "size").agg(F.count("*").alias("n")).collect())
    bits = min(max(1, sum(n for _, _, n in shapes)), block).bit_length() + 4
    shared = docs.sparkSession.sparkContext.broadcast(_sieve(items, max(10, bits)))
    down = _U(64 - max(10, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for low, _, data, at in _bytes.slices(batch.column(1)):
                kinds = read(data, at)
                for kind, size, _ in shapes:
                    text = kinds[kind]
                    key, begin = _keys(text, kind, size, params.plain)
                    place = key >> down
                    maybe = np.flatnonzero(sieve[place >> _U(3)] >> (place & _U(7)).astype(np.uint8) & 1)
                    if not len(maybe):
                        continue
                    key, begin = key[maybe], begin[maybe]
                    row = np.searchsorted(text.first, begin, "right") - 1
                    slots = pa.array([b""] * len(row), pa.binary()) if kind else _pieces(text.slot, begin, size)
                    columns = [batch.column(0).take(pa.array(low + row)), pa.array(np.full(len(row), kind), pa.int32()), pa.array(np.full(len(row), size), pa.int32())]
                    columns += [pa.array(key.view(np.int64)), pa.array(begin - text.first[row]), slots]
                    yield pa.RecordBatch.from_arrays(columns, ["doc", "kind", "size", "key", "begin", "slots"])

    texts = docs.select(_digest(F.col("text")).alias("doc"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_bytes.frugal(run), "doc string, kind int, size int, key long, begin long, slots binary")


def _digest(text: Column) -> Column:
    return F.md5(text.cast("string").cast("binary"))


def _consistent_pieces(diagonals: DataFrame, params: Params) -> DataFrame:
    """doc, klass, unit (0 template tokens, 1 words), low, high, total and run: what counts of each diagonal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 1024):
                out: list[tuple] = []
                for doc, klass, kind, n_tokens, n_words, hits in zip(*(c.to_pylist() for c in batch.slice(first, 1024).columns), strict=True):
                    base = min(h["place"] for h in hits)
                    n = max(h["place"] + h["size"] for h in hits) - base
                    covered, ours, theirs, words = np.zeros(n + 1, bool), np.zeros(n, np.int64), np.zeros(n, _U), np.zeros(n + 1, np.int64)
                    for h in hits:
                        at, size = h["place"] - base, h["size"]
                        covered[at : at + size] = True
                        if kind == 0:
                            ours[at : at + size] = np.frombuffer(h["numbers"], np.int64)
                            theirs[at : at + size] = np.frombuffer(h["slots"], _U)
                            words[at : at + size + 1] = np.frombuffer(h["words"], np.int64)
                    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0)).tolist()
                    for low, high in zip(edges[::2], edges[1::2], strict=True):
                        a, b = consistent(ours[low:high], theirs[low:high]) if kind == 0 else (0, high - low)
                        if b - a < min(params.window, n_words if kind else n_tokens):
                            continue
                        if kind == 0:
                            out.append((doc, klass, 0, base + low + a, base + low + b, n_tokens, b - a))
                            out.append((doc, klass, 1, int(words[low + a]), int(words[low + b]), n_words, b - a))
                        else:
                            out.append((doc, klass, 1, base + low, base + high, n_words, b - a))
                types = (pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["doc", "klass", "unit", "low", "high", "total", "run"])

    narrow = diagonals.select("doc", "klass", "kind", "n_tokens", "n_words", "hits")
    return narrow.mapInArrow(_bytes.frugal(run), "doc string, klass long, unit int, low long, high long, total long, run long")


def _union_length(ranges: str) -> Column:
    """How many places sorted [low, high) ranges cover."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(done: Column, x: Column) -> Column:
        new = F.greatest(F.lit(0), x["high"] - F.greatest(x["low"], done["end"]))
        return F.struct(F.greatest(done["end"], x["high"]).cast("long").alias("end"), (done["n"] + new).cast("long").alias("n"))

    return F.aggregate(ranges, start, add)["n"]


_FOUND = T.StructType([T.StructField("n_items", T.LongType()), T.StructField("longest_run", T.LongType()), T.StructField("item_share", T.DoubleType())])


def matches(docs: DataFrame, benchmark: DataFrame, params: Params = PARAMS, block: int = BLOCK) -> DataFrame:
    """doc (md5 of the text), n_items (classes), longest_run and item_share of the distinct texts in which something counts."""
    with _store.Scratch(docs.sparkSession, "leaks") as scratch:
        # written, so that Spark knows its size when it chooses the join
        items = scratch.staged(item_windows(benchmark, params))
        hits = _found(docs, items, params, block).join(items, ["key", "kind", "size"])
        # on a diagonal an item's place has one window of the text, so a set is no longer than an item; copies of a text fold
        window = F.struct("place", "size", "slots", "numbers", "words")
        by = ["doc", "klass", "kind", (F.col("begin") - F.col("place")).alias("shift"), "n_tokens", "n_words"]
        pieces = _consistent_pieces(hits.groupBy(*by).agg(F.collect_set(window).alias("hits")), params)
        covered = pieces.groupBy("doc", "klass", "unit", "total").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("ranges"), F.max("run").alias("run"))
        covered = covered.select("doc", "klass", "run", (_union_length("ranges") / F.col("total")).alias("share"))
        by_class = covered.groupBy("doc", "klass").agg(F.max("run").alias("run"), F.max("share").alias("share"))
        by_text = by_class.groupBy("doc").agg(F.count("*").alias("n_items"), F.max("run").alias("longest_run"), F.max("share").alias("item_share"))
        return _store.staged(by_text, "leaks-found")


def _free_name(docs: DataFrame) -> str:
    name, taken = "_doc", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def contaminated(params: Params = PARAMS) -> Column:
    return (F.col("longest_run") >= params.run) | (F.col("item_share") >= params.share)


def judged(docs: DataFrame, benchmark: DataFrame, params: Params = PARAMS, block: int = BLOCK) -> DataFrame:
    """docs with n_items, longest_run, item_share and contaminated; columns of docs named like those are left out."""
    docs = docs.drop(*[f.name for f in _FOUND], "contaminated")
    name = _free_name(docs)
    found = matches(docs, benchmark, params, block).withColumnRenamed("doc", name)
    out = docs.withColumn(name, _digest(F.col("text"))).join(found, name, "left").drop(name)
    out = out.select(*docs.columns, *[F.coalesce(f.name, F.lit(0).cast(f.dataType)).alias(f.name) for f in _FOUND])
    return out.withColumn("contaminated", contaminated(params))


def kept(docs: DataFrame, benchmark: DataFrame, params: Params = PARAMS) -> DataFrame:
    """The rows of docs without benchmark passages, with the columns of docs."""
    name = _free_name(docs)
    gone = matches(docs, benchmark, params).where(contaminated(params)).select(F.col("doc").alias(name))
    return docs.withColumn(name, _digest(F.col("text"))).join(gone, name, "left_anti").select(*docs.columns)
