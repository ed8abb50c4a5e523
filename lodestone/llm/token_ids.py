"""Token ids as files: ids ranked by frequency, byte-aligned variable-length coding, separate control bytes.

A file (Parquet, so that it lies on any store that Spark writes to) holds blocks. A block has the ids of
consecutive documents in ascending doc_id order:

* ``doc_ids`` and ``counts``: the documents and how many ids each has,
* ``control``: two bits a value, four values a byte from the low bits up: the value's length less one,
* ``data``: the values' 1 to 4 bytes, low byte first.

A value is the rank of an id by how often the whole corpus has it, so that frequent ids take one byte. The
ranks are a table beside the blocks. A reader looks the control bytes up in a 256-row table of lengths and
gathers all values of a block at once with numpy.

Encoding: where the tokenizer's own file says that it splits texts by the one pattern whose cuts ``_piece_starts`` knows,
texts are cut there and a worker sends each distinct piece through the library once. Pieces are looked up by a hash and then
compared byte by byte; one that isn't the piece its hash is known for goes through the library itself. Any other tokenizer
gets whole texts. Ids are 16 bits wide between the steps, or 32 where the vocabulary needs them.

Rows: a null text is empty; every row is written, so a repeated doc_id gives as many entries, in the order
of their first ids, then of a hash of all. A null doc_id comes last. Extra columns are ignored. An empty table gives empty files.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import _bytes, _store

#: Ends each document in the op10 contract.
END_ID = 2

#: Ids of one block, about.
BLOCK_IDS = 1 << 20

#: Bytes of ids in a task of the sorted exchange, about; smaller tables keep the session's number of partitions.
PART_BYTES = 32 << 20

#: Distinct pieces that a worker remembers before it starts anew.
REMEMBERED = 3 << 19

_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP[list(b"!#$%&*,.:;?")] = True

_LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    length = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = length - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    keep = np.arange(4, dtype=np.uint8)[None, :] < length[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values that encode_values was given."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    start = np.cumsum(length) - length
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = np.zeros(n, np.uint32)
    for k in range(4):
        has = length > k if k else slice(None)
        out[has] |= raw[start[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def id_type(path: str, end_id: int) -> str:
    """The numpy type that holds all ids of the tokenizer."""
    return "<u2" if max(_tokenizer(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


@lru_cache(maxsize=2)
def splits_as_known(path: str) -> bool:
    """Whether the tokenizer's file has no step by which a cut of ``_piece_starts`` could change ids."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    own = made.get("pre_tokenizer") or {}
    plain = own.get("type") == "ByteLevel" and own.get("use_regex", True) and not own.get("add_prefix_space", True)
    model = made.get("model") or {}
    plain = plain and model.get("type") == "BPE" and not model.get("dropout") and not any(made.get(k) for k in ("normalizer", "truncation", "padding", "post_processor"))
    for token in made.get("added_tokens") or ():
        raw = np.frombuffer(token["content"].encode(), np.uint8)
        plain = plain and not (token["lstrip"] or token["rstrip"] or token["single_word"] or token["normalized"])
        plain = plain and len(_piece_starts(raw, np.array([0, len(raw)]))) == 1
    return bool(plain)


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)  # a worker's later tasks know the pieces of its earlier ones


def _piece_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where a text can be cut without a change of its ids.

    The tokenizer splits by a pattern whose tokens never hold white space behind anything else, and whose only
    look-ahead lies in a run of white space. So a cut before an ASCII white-space byte that follows a character
    which is not white space changes nothing. A previous character of three or two bytes that could be white
    space outside ASCII (lead C2, or a middle byte 80, 81 or 9A) gives no cut. Nor does a letter's token hold
    the punctuation behind it, other than an apostrophe.
    """
    space = _bytes.SPACE[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = space[1:] & ~space[:-1]
    if len(data) > 2:
        before, previous = data[:-2], data[1:-1]
        cut[2:] &= ~((previous >= 0x80) & ((before == 0xC2) | (before == 0x80) | (before == 0x81) | (before == 0x9A)))
    cut[1:] |= _STOP[data[1:]] & _LETTER[data[:-1]]
    cut[at[:-1][at[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... of count[k] numbers, for all k one after the other."""
    upto = np.cumsum(count)
    return np.repeat(first - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)


class Encoder:
    """Encodes many texts with the tokenizers library; each distinct piece goes through the library once, where texts can be cut."""

    def __init__(self, path: str) -> None:
        self.path, self.type, self.cuts = path, id_type(path, 0), splits_as_known(path)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.rows = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, self.type)
        self.own_starts = np.zeros(1, np.int64)
        self.own = np.zeros(0, np.uint8)  # the pieces' bytes

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> None:
        flat, counts = self._through_library(data, start, end, 1 << 14)
        rows = np.arange(len(keys)) + len(self.starts) - 1
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, flat])
        self.own_starts = np.concatenate([self.own_starts, self.own_starts[-1] + np.cumsum(end - start)])
        self.own = np.concatenate([self.own, data[_spread(start, end - start)]])
        keys, rows = np.concatenate([self.keys, keys]), np.concatenate([self.rows, rows])
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], rows[order]

    def _through_library(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, at_once: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings data[start:end] one after the other, and how many each has."""
        raw, tokenizer = data.tobytes(), _tokenizer(self.path)
        flat, counts = [np.zeros(0, self.type)], [np.zeros(0, np.int64)]
        for k in range(0, len(start), at_once):
            texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(start[k : k + at_once].tolist(), end[k : k + at_once].tolist(), strict=True)]
            found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            flat.append(np.fromiter((i for x in found for i in x), np.uint32, int(counts[-1].sum())).astype(self.type))
        return np.concatenate(flat), np.concatenate(counts)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and for each text the index of its first id (one entry more than texts)."""
        if not len(data):
            return np.zeros(0, self.type), np.zeros(len(at), np.int64)
        if not self.cuts:
            ids, counts = self._through_library(data, at[:-1], at[1:], 64)
            return ids, np.append(0, np.cumsum(counts))
        start = _piece_starts(data, at)
        end = np.append(start[1:], len(data))
        keys = _bytes.span_hash(_bytes.prefix_hash(data), start, end)
        distinct, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self._forget()
        place = np.searchsorted(self.keys, distinct)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == distinct[known]
        if not known.all():
            new = where[~known]
            self._learn(data, start[new], end[new], distinct[~known])
            place = np.searchsorted(self.keys, distinct)
        row = self.rows[place][inverse]
        first, count, ids = self.starts[row], self.starts[row + 1] - self.starts[row], self.ids
        other = self._others(data, start, end, row)
        if len(other):  # rare: their ids stand behind the known ones
            flat, counts = self._through_library(data, start[other], end[other], 1 << 14)
            first[other], count[other], ids = len(ids) + np.cumsum(counts) - counts, counts, np.concatenate([ids, flat])
        pieces = np.searchsorted(start, at)
        return ids[_spread(first, count)], np.append(0, np.cumsum(count))[pieces]

    def _others(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Which pieces data[start:end], that lie end to end, aren't byte by byte what is remembered in their rows."""
        first, size = self.own_starts[row], self.own_starts[row + 1] - self.own_starts[row]
        differs = size != end - start
        if differs.any():
            size = np.where(differs, 0, size)
        unlike = np.zeros(int(size.sum()) + 1, np.int32)
        np.cumsum(self.own[_spread(first, size)] != (data[_spread(start, size)] if differs.any() else data), out=unlike[1:])
        upto = np.cumsum(size)
        return np.flatnonzero(differs | (unlike[upto] != unlike[upto - size]))


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, ids (little-endian, of the type that ``id_type`` gives, with the end id) and their number."""
    kind = id_type(tokenizer_path, end_id)
    end = np.array([end_id], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            for low, high, data, at in _bytes.slices(batch.column(1), 4 << 20):
                ids, first = encoder.encode(data, at)
                rows = [ids[a:b].astype(kind).tobytes() + end for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(rows, pa.binary()), pa.array(np.diff(first) + 1, pa.int64())], ["doc_id", "ids", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_bytes.frugal(run), "doc_id long, ids binary, n long")


def id_counts(ids: DataFrame, kind: str, most: int) -> DataFrame:
    """id, n: how often the corpus has each id below ``most``. Each task adds up before anything moves; no more rows than ids result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(most, np.int64)
        for batch in batches:
            data, _ = _bytes.text_buffers(batch.column(0))
            total += np.bincount(data.view(kind), minlength=most)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return ids.select("ids").mapInArrow(_bytes.frugal(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Encodes every text and writes ``path``/blocks and ``path``/ranks in the format above."""
    with _store.Scratch(docs.sparkSession, "token-ids") as scratch:
        most = max(_tokenizer(tokenizer_path).get_vocab_size(), end_id + 1)
        _write(scratch.staged(encoded(docs, tokenizer_path, end_id)), path, id_type(tokenizer_path, end_id), most)


def _write(ids: DataFrame, path: str, kind: str, most: int) -> None:
    spark = ids.sparkSession
    # no more rows than the vocabulary has: the driver and every task can hold them
    ranks = sorted(((n, -i) for i, n in id_counts(ids, kind, most).collect()), reverse=True)
    order = [-i for _, i in ranks]
    spark.createDataFrame([(r, i) for r, i in enumerate(order)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(most, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids: list[int | None] = []
        counts: list[int] = []
        parts: list[bytes] = []
        held, part, seq = 0, None, 0

        def block() -> pa.RecordBatch:
            values = shared.value[np.frombuffer(b"".join(parts), kind)]
            control, data = encode_values(values)
            row = {"part": [part], "seq": [seq], "n_ids": [len(values)], "doc_ids": [list(doc_ids)], "counts": [list(counts)], "control": [control], "data": [data]}
            doc_ids.clear(), counts.clear(), parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for low in range(0, len(batch), 64):
                piece = batch.slice(low, 64)
                for doc, ids_, n, p in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    part = p
                    doc_ids.append(doc), counts.append(n), parts.append(ids_)
                    held += n
                    if held >= BLOCK_IDS:
                        yield block()
                        held, seq = 0, seq + 1
        if doc_ids:
            yield block()

    arrow = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
    # a range exchange, so that blocks are in order; rows that share a doc_id or have none are split by their ids, and equal
    # rows, which may change places, by their number
    order = [F.col("doc_id").asc_nulls_last(), F.col("first"), F.col("hash"), F.col("row")]
    keyed = ids.withColumns({"first": F.substring("ids", 1, 16), "hash": F.xxhash64("ids"), "row": F.monotonically_increasing_id()})
    parts = -(-sum(n for n, _ in ranks) * np.dtype(kind).itemsize // PART_BYTES)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_range = (keyed.repartitionByRange(parts, *order) if parts > usual else keyed.repartitionByRange(*order)).sortWithinPartitions(*order)
    (by_range.withColumn("part", F.spark_partition_id()).select("doc_id", "ids", "n", "part")
     .mapInArrow(_bytes.frugal(run), "part int, seq int, n_ids long, doc_ids array<bigint>, counts array<bigint>, control binary, data binary")
     .write.option("compression", "none").parquet(f"{path}/blocks"))
    shared.unpersist()


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files alone."""
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # no more rows than the vocabulary has
    id_of = spark.sparkContext.broadcast(np.array([r["id"] for r in ranks] or [0], "<u4"))
    # one row a partition, then one row a block of a partition: no window sees a document
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("total"))
    parts = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inside = blocks.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("within"))
    starts = inside.join(parts, "part").select("part", "seq", (F.col("before") + F.col("within")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                first, n, docs, counts, control, data = (batch.column(c)[k] for c in range(6))
                ids = id_of.value[decode_values(control.as_py(), data.as_py(), n.as_py())]
                counts = counts.values.to_numpy(zero_copy_only=False)
                upto = np.cumsum(counts)
                crc = [zlib.crc32(ids[b - c : b].tobytes()) for b, c in zip(upto.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(upto - counts + first.as_py(), pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return (blocks.join(starts, ["part", "seq"]).select("first", "n_ids", "doc_ids", "counts", "control", "data")
            .mapInArrow(_bytes.frugal(run), "doc_id long, start long, n_tokens long, ids_crc32 long"))


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    path = _store.new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer_path, end_id)
    return read(docs.sparkSession, path)
