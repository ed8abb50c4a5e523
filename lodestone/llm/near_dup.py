"""Near-duplicate documents by min-max hashing, banding and a check on full sets.

A text's set holds its distinct word shingles (five words by default; A-Z folded; a text of fewer words gives
one shingle of all of them; a text without words an empty set, which links with nothing). Each permutation of
the hashes gives two signature values, the minimum and the maximum, so 64 permutations give 128 values; both
agree between two sets with probability equal to their Jaccard similarity. 32 bands of four values each, mins
and maxes apart, miss a pair of similarity 0.8 with probability (1 - 0.8**4)**32, about 5e-8.

1. Equal sets become one class, kept by the smallest doc_id; only classes are banded.
2. In each bucket every class is compared with the smallest one (the star). Links that hold on full sets give
   components.
3. In small buckets that still hold several components, every class outside the largest is compared with all of other
   components there. In large ones it is compared with a few classes drawn from the largest; copies that drifted from
   the smallest class mostly link here.
4. Where a large bucket holds several components even then, every class outside the largest is compared with all of
   other components there, blocks of either side at once. Pairs inside a component can't change the result. So no link
   between components is lost, whatever the size of a bucket.

What grows how: copies, equal or linked with a group's core, cost rows in proportion. Only classes that lie in one
bucket with many others and yet outside its largest component, near misses at similarities of about 0.6 to 0.8, cost
more: with m of those in a bucket of n classes, step 4 moves m * n / (BLOCK / 2) rows and compares m * n pairs, as none
may be missed.

Pairs whose signatures agree in fewer than 60% of the values (similarity 0.8 is more than five standard
deviations above) or whose set sizes exclude the threshold are not read in full; all others are compared on whole sets.
Shingles are compared by 64-bit hashes.

Rows: a null text is empty. A row without a doc_id is linked with nothing and kept. Rows that share a doc_id
count as one document that links wherever one of its texts does; ``clusters`` returns each row, ``kept`` one row of
each document that stays. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import _bytes, _store
from lodestone.llm.graph import components
from lodestone.llm.sieve import may_hold


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    percent: int = 80  #: of the union's size that the intersection has at least
    permutations: int = 64
    band_rows: int = 4

    @property
    def values(self) -> int:
        return 2 * self.permutations


PARAMS = Params()
#: Members of a large bucket's largest component that all others there are compared with.
HUBS = 8
#: Members up to which a bucket is small, so that its pairs are rows, and members of a block of larger buckets.
FEW, BLOCK = 12, 1024
#: A bucket is dealt into parts of about PART rows, or of the HOT_BUCKETS-th of all rows where that is more, so that no
#: more than HOT_BUCKETS buckets have several parts. PART is FEW at least: buckets of few members have one part.
PART, HOT_BUCKETS = 512, 10_000

_U = np.uint64
_SINGLE = _U(0x5851F42D4C957F2D)
_STEP = _U(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its shingles."""
    h, first = _bytes.words(data, at, fold=True)
    grown, usable = h, len(h)
    for k in range(1, size):
        usable = max(0, len(h) - k)
        grown = _bytes.mix(grown[:usable] * _STEP + h[k : k + usable])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(grown[a : b - size + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            x = np.array([int(_SINGLE) + b - a], _U)
            for v in h[a:b]:
                x = _bytes.mix(x * _STEP + v)
            out.append(x)
        else:
            out.append(np.zeros(0, _U))
    return out


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(4)
    return r.integers(0, 1 << 31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, n).astype(np.uint32)


def _signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each permutation."""
    x = (s >> _U(32)).astype(np.uint32)
    low, high = np.full(len(a), 0xFFFFFFFF, np.uint32), np.zeros(len(a), np.uint32)
    for k in range(0, len(x), 2048):
        y = np.multiply.outer(x[k : k + 2048], a)
        y += b
        np.minimum(low, y.min(axis=0), out=low)
        np.maximum(high, y.max(axis=0), out=high)
    return np.concatenate([low, high])


def _sieve_bytes(values: np.ndarray) -> np.ndarray:
    """A byte of each value, mixed first, as minima of large sets share their high bits: unequal values agree once in 256."""
    return (_bytes.mix(values.astype(_U)) >> _U(32)).astype(np.uint8)


def signatures(docs: DataFrame, params: Params = PARAMS) -> DataFrame:
    """doc_id, n (set size), f1 and f2 (128 bits of the set), bands (a key each), sig (a byte of each value, mixed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(params.permutations)
        weights = np.random.default_rng(5).integers(1, 1 << 63, params.values, dtype=np.int64).astype(_U) | _U(1)
        for batch in batches:
            for low, high, data, at in _bytes.slices(batch.column(1)):
                sets = shingle_sets(data, at, params.shingle)
                values = np.stack([_signature(s, a, b) for s in sets])
                keys = _bytes.mix((values.astype(_U) * weights).reshape(len(sets), -1, params.band_rows).sum(axis=2, dtype=_U))
                f1 = np.array([_bytes.mix(s).sum(dtype=_U) for s in sets], _U)
                f2 = np.array([_bytes.mix(s ^ _SINGLE).sum(dtype=_U) for s in sets], _U)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel().view(np.int64)))
                sig = pa.array([v.tobytes() for v in _sieve_bytes(values)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists, sig], ["doc_id", "n", "f1", "f2", "bands", "sig"])

    return _ids_and_texts(docs).mapInArrow(_bytes.frugal(run), "doc_id long, n long, f1 long, f2 long, bands array<bigint>, sig binary")


def _ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _packed(texts: DataFrame) -> DataFrame:
    """doc_id and the compressed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, at = _bytes.text_buffers(batch.column(1))
            raw = memoryview(np.ascontiguousarray(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress(raw[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], ["doc_id", "packed"])

    return texts.mapInArrow(_bytes.frugal(run), "doc_id long, packed binary")


def _plausible(pairs: DataFrame, classes: DataFrame, params: Params) -> DataFrame:
    """Pairs (u, v) whose sizes and signatures allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(_bytes.text_buffers(batch.column(k))[0], np.uint8).reshape(len(batch), -1) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) * 5 >= params.values * 3))

    u, v = (classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}")) for c in "uv")
    sized = pairs.join(u, "u").join(v, "v").where(100 * F.least("n_u", "n_v") >= params.percent * F.greatest("n_u", "n_v"))
    return sized.select("u", "v", "sig_u", "sig_v").mapInArrow(_bytes.frugal(run), "u long, v long").distinct()


def _linked(pairs: DataFrame, packed: DataFrame, params: Params) -> DataFrame:
    """Those pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, last, held = zstandard.ZstdDecompressor(), None, np.zeros(0, _U)

        def whole(packed: bytes) -> np.ndarray:
            data = np.frombuffer(press.decompress(packed), np.uint8)
            return shingle_sets(data, np.array([0, len(data)]), params.shingle)[0]

        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for k in range(len(batch)):
                own = batch.column(2)[k].as_py()
                if own != last:
                    last, held = own, whole(own)
                s = whole(batch.column(3)[k].as_py())
                both = np.sort(np.concatenate([held, s]))
                shared = int((both[1:] == both[:-1]).sum())
                keep[k] = shared > 0 and 100 * shared >= params.percent * (len(held) + len(s) - shared)
            yield batch.select([0, 1]).filter(pa.array(keep))

    u, v = (packed.select(F.col("doc_id").alias(c), F.col("packed").alias(f"packed_{c}")) for c in "uv")
    return pairs.join(v, "v").join(u, "u").select("u", "v", "packed_u", "packed_v").sortWithinPartitions("u").mapInArrow(_bytes.frugal(run), "u long, v long")


def _parted(buckets: DataFrame) -> DataFrame:
    """A table of one row for each bucket, once for each of the bucket's parts. Joins with members name the part too."""
    return buckets.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def _members(rows: DataFrame, buckets: DataFrame, scratch: _store.Scratch) -> DataFrame:
    """The rows (rep, band, key) that lie in buckets (band, key, hub, n), with hub, parts, the part each is dealt to, and whether the bucket is large."""
    total = buckets.agg(F.sum("n")).first()[0] or 0
    buckets = buckets.withColumn("parts", F.ceil(F.col("n") / max(PART, -(-total // HOT_BUCKETS))).cast("int")).withColumn("large", F.col("n") > FEW).drop("n")
    # at most HOT_BUCKETS rows, so every task may hold them
    hot = F.broadcast(scratch.staged(buckets.where("parts > 1").select("band", "key", F.col("parts").alias("several"))))
    part = F.pmod(F.xxhash64(F.lit(6), "rep"), F.coalesce("several", F.lit(1))).cast("int")
    dealt = rows.join(hot, ["band", "key"], "left").select("rep", "band", "key", part.alias("part"))
    return dealt.join(_parted(buckets), ["band", "key", "part"])


def _open(placed: DataFrame, scratch: _store.Scratch) -> tuple[DataFrame, DataFrame]:
    """The members of buckets with several components; and those outside the largest, as a, with some hubs from inside it."""
    several = placed.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.first("parts").alias("parts")).where("low < high").select("band", "key", "parts")
    several = scratch.staged(several)
    opened = scratch.staged(placed.join(_parted(several), ["band", "key", "part"], "left_semi"))
    drawn = [F.min_by("rep", F.xxhash64("rep", F.lit(k))).alias(f"h{k}") for k in range(HUBS)]
    sizes = opened.groupBy("band", "key", "component").agg(F.count("*").alias("n"), F.first("parts").alias("parts"), *drawn)
    hubs = F.struct("component", F.array(*[f"h{k}" for k in range(HUBS)]).alias("hubs"))
    largest = sizes.groupBy("band", "key").agg(F.max_by(hubs, F.struct("n", "component")).alias("largest"), F.sum("n").alias("total"), F.max("n").alias("most"), F.first("parts").alias("parts"))
    largest = scratch.staged(largest)
    outside = opened.drop("parts").join(_parted(largest), ["band", "key", "part"]).where("component <> largest.component")
    return opened, outside.select("band", "key", "parts", F.col("rep").alias("a"), F.col("component").alias("component_a"), "largest.hubs", "total", (F.col("total") - F.col("most")).alias("n_outside"))


def _block_links(opened: DataFrame, outside: DataFrame, packed: DataFrame, params: Params) -> DataFrame:
    """Links of what is outside the largest components of large buckets with all other components there.

    Either side of a bucket is dealt into blocks, and each pair of blocks is compared by one product of two matrices over
    the shingles that both hold. No pair becomes a row: of the links between two components one is returned.
    """

    def blocks(n):
        return F.ceil(n / BLOCK).cast("int")

    def numbers(n):
        return F.explode(F.sequence(F.lit(0), blocks(n) - 1))

    sizes = outside.groupBy("band", "key").agg(F.first("total").alias("total"), F.first("n_outside").alias("n_outside"), F.first("parts").alias("parts"))
    place = F.xxhash64(F.lit(3), "rep")
    left = outside.select("band", "key", F.col("a").alias("rep"), F.col("component_a").alias("component"), "total", "n_outside")
    left = left.select("band", "key", F.pmod(place, blocks(F.col("n_outside"))).cast("int").alias("x"), numbers(F.col("total")).alias("y"), F.lit(0).alias("side"), "rep", "component")
    right = opened.drop("parts").join(_parted(sizes), ["band", "key", "part"]).withColumn("y", F.pmod(place, blocks(F.col("total"))).cast("int"))
    right = right.select("band", "key", numbers(F.col("n_outside")).alias("x"), "y", F.lit(1).alias("side"), "rep", "component")
    rows = left.union(right).join(packed.withColumnRenamed("doc_id", "rep"), "rep").select("band", "key", "x", "y", "side", "rep", "component", "packed")

    def links(rows: pa.Table) -> pa.RecordBatch:
        press = zstandard.ZstdDecompressor()
        texts = pa.array([press.decompress(p) for p in rows.column("packed").to_pylist()], pa.binary())
        sets = shingle_sets(*_bytes.text_buffers(texts), params.shingle)
        side, rep, component = (rows.column(c).to_numpy() for c in ("side", "rep", "component"))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        shared = _intersections([sets[k] for k in a], [sets[k] for k in b])
        n = np.array([len(s) for s in sets])
        found = (100 * shared >= params.percent * (n[a][:, None] + n[b][None, :] - shared)) & (component[a][:, None] != component[b][None, :])
        i, j = np.nonzero(found)
        _, one = np.unique(np.stack([component[a[i]], component[b[j]]]), axis=1, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(rep[a[i[one]]]), pa.array(rep[b[j[one]]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            key = np.stack([held.column(c).to_numpy() for c in ("band", "key", "x", "y")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
            for low, high in zip(cuts, cuts[1:], strict=False):
                yield links(held.slice(low, high - low).combine_chunks())
            held = held.slice(cuts[-1])  # its blocks may go on
        if held is not None and len(held):
            yield links(held.combine_chunks())

    return rows.repartition("band", "key", "x", "y").sortWithinPartitions("band", "key", "x", "y").mapInArrow(_bytes.frugal(run), "u long, v long").distinct()


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of a with every set of b; sets are sorted."""
    out = np.zeros((len(a), len(b)), np.float32)
    if not out.size:  # a block to which the hash dealt nothing
        return out.astype(np.int64)
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    sides = []
    for sets in (a, b):
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        own = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        sides.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[own], at[own]))
    for low in range(0, len(both), 4096):
        dense = []
        for (row, at), n in zip(sides, (len(a), len(b)), strict=True):
            m = np.zeros((n, min(4096, len(both) - low)), np.float32)
            here = (at >= low) & (at < low + 4096)
            m[row[here], at[here] - low] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return np.rint(out).astype(np.int64)


def clusters(docs: DataFrame, params: Params = PARAMS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept, one row a document."""
    with _store.Scratch(docs.sparkSession, "near-dup") as scratch:
        return _store.staged(_clusters(docs, params, scratch), "near-dup-clusters")


def _clusters(docs: DataFrame, params: Params, scratch: _store.Scratch) -> DataFrame:
    sigs = scratch.staged(signatures(docs, params))
    nodes = sigs.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # partial aggregation folds a large class of copies before anything moves
    least = nodes.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "bands", "sig")).alias("r"))
    classes = scratch.staged(least.select("f1", "f2", "n", F.col("r.doc_id").alias("rep"), F.col("r.bands").alias("bands"), F.col("r.sig").alias("sig")))

    rows = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = rows.groupBy("band", "key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top"), F.count("*").alias("n")).where("hub < top").drop("top")
    members = scratch.staged(_members(rows, scratch.staged(buckets), scratch))
    wanted = scratch.staged(members.select(F.col("rep").alias("doc_id")).distinct())
    # texts of other documents don't move, and those that do are compressed before
    near = _ids_and_texts(docs).where(may_hold(wanted, "doc_id")(F.col("doc_id")))
    packed = scratch.staged(_packed(near).join(wanted, "doc_id", "left_semi"))

    star = members.where("rep <> hub").select(F.col("hub").alias("u"), F.col("rep").alias("v")).distinct()
    links = scratch.staged(_linked(_plausible(star, classes, params), packed, params))

    def placed(rows: DataFrame, found: DataFrame) -> DataFrame:
        own = rows.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
        return scratch.staged(own.withColumn("component", F.coalesce("component", "rep")))

    found = components(links, scratch)
    opened, outside = _open(placed(members, found), scratch)
    few = outside.where(F.col("total") <= FEW).select("band", "key", "a", "component_a")
    few = few.join(opened.where("parts = 1"), ["band", "key"]).where("component_a <> component and a <> hub and rep <> hub").select("a", "rep")
    pairs = few.union(outside.where(F.col("total") > FEW).select("a", F.explode(F.array_distinct("hubs"))))
    pairs = pairs.select(F.least("a", "rep").alias("u"), F.greatest("a", "rep").alias("v")).distinct()
    known = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    links = scratch.staged(known.union(_linked(_plausible(pairs, classes, params), packed, params)))
    large = members.where("large")
    if not large.isEmpty():
        opened, outside = _open(placed(large, components(links, scratch)), scratch)
        links = scratch.staged(links.union(_block_links(opened, outside, packed, params)))
    # rows of one doc_id with different texts
    several = nodes.groupBy("doc_id").agg(F.min(F.struct("f1", "f2", "n")).alias("low"), F.max(F.struct("f1", "f2", "n")).alias("high")).where("low <> high").select("doc_id")
    several = scratch.staged(several)
    if not several.isEmpty():
        own = nodes.join(several, "doc_id").join(classes.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"]).select("doc_id", "rep").distinct()
        own = scratch.staged(own)
        links = links.union(own.join(own.groupBy("doc_id").agg(F.min("rep").alias("least")), "doc_id").select(F.col("rep").alias("u"), F.col("least").alias("v")))
    found = components(links, scratch)

    by_class = classes.select("f1", "f2", "n", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    by_class = by_class.select("f1", "f2", "n", F.coalesce("component", "rep").alias("component"))
    out = sigs.select("doc_id", "n", "f1", "f2").join(by_class, ["f1", "f2", "n"], "left")
    component: Column = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept(docs: DataFrame, params: Params = PARAMS) -> DataFrame:
    """The rows of docs that stay: one document of each component, and rows without a doc_id."""
    found = clusters(docs, params)
    name = "_gone"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    own = F.col("doc_id").cast("long")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    gone = _store.staged(gone, "near-dup-gone")
    # only rows that may go are joined
    maybe, rows = may_hold(gone, name), docs.withColumn(name, own)
    stay = rows.where(~maybe(F.col(name))).unionByName(rows.where(maybe(F.col(name))).join(gone, name, "left_anti"))
    # of rows that share a surviving doc_id the one of least hash stays; where there are none, docs move once
    with _store.Scratch(docs.sparkSession, "near-dup-repeated") as scratch:
        often = scratch.staged(found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(name)).count().where("count > 1").select(name))
        if often.isEmpty():
            return stay.select(*docs.columns)
        often = _store.staged(often, "near-dup-repeated")
    one = stay.join(often, name, "left_semi").groupBy(name).agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("_row"))
    return stay.join(often, name, "left_anti").select(*docs.columns).union(one.select("_row.*"))
