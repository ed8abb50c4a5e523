"""Mixing sources to target weights: packed blocks, multinomial shards, permuted indices.

The words of a source's documents are one stream, in a pseudorandom but fixed order of the documents, cut into
blocks of a fixed number of words (the last may be shorter). The mix is a sequence of slots, grouped in output
shards. For each shard the numbers of slots by source are one multinomial draw with the sources' quotas as
weights. The k-th slot of a source, over all shards, is block ``p(k mod n)`` of its n blocks, where p is a
keyed permutation of its own for each pass k // n; so no block is taken a further time before all have been.
Blocks and documents then meet in a join by (source, block).

Independent draws miss a source's quota by about its root. Slots drawn beyond a quota go to the sources that
were drawn too seldom, in order, so shards keep their size and quotas hold exactly: whole passes, and then as
many blocks as the rest of the target needs. So a source's words are within about a block of its target, and
no document is taken more often than ``cap`` times.

Targets: sources in code-point order, null last, weigh 5, 2, 1 and so on, and share 150% of all words; no
target is above twice its source's words, and what that leaves over is shared again by weight.

Rows: a null text has no words. Repeated rows are documents of their own. A document without words takes
nothing. Extra columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import _bytes, _store


@dataclass(frozen=True)
class Params:
    weights: tuple[int, ...] = (5, 2, 1)
    volume: float = 1.5  #: words of the mix, by all words
    cap: int = 2  #: of a source's words that its target may be
    block: int = 128  #: words
    shard: int = 8192  #: slots
    seed: int = 20240501
    max_sources: int = 1_000_000  #: whose quotas a task holds; more is an error, not a cut


PARAMS = Params()
#: Parts into which each source is dealt, so that no window holds a whole source.
PARTS = 1024
#: Shards whose draws are summed in one window.
BLOCK_OF = 4096


def sized(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, source, size (words) and mark (a hash of the text) of each row, written to the shared folder. Without text."""
    return _store.staged(_narrow(_with_id(docs)), "mix-sizes")


def _with_id(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row_id", F.monotonically_increasing_id())


def _narrow(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(_WORD)).cast("long")
    return docs.select("row_id", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("mark"))


_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, params: Params = PARAMS) -> DataFrame:
    """source, src (its number in code-point order), source_size, weight, target; one row a source.

    The level up to which sources are filled: sources in ascending order of cap by weight reach their cap until
    what is left, shared by weight, reaches the next cap no more.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    cycle = F.array(*[F.lit(float(w)) for w in params.weights])
    out = by_source.withColumn("src", F.row_number().over(order) - 1).withColumn("weight", F.get(cycle, F.col("src") % len(params.weights)))
    out = out.withColumn("most", params.cap * F.col("source_size").cast("double"))
    out = out.withColumn("ratio", F.col("most") / F.col("weight"))
    upto = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0)).orderBy("src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = params.volume * F.sum("source_size").over(whole) - F.sum("most").over(upto) + F.col("most")
    out = out.withColumn("level", left / (F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight")))
    out = out.withColumn("full", F.min(F.col("ratio") <= F.col("level")).over(upto))
    first_open = F.min(F.when(~F.col("full"), F.struct("ratio", "src", "level"))).over(whole)
    out = out.withColumn("level", first_open["level"])
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("level") * F.col("weight"))
    return out.select("source", "src", "source_size", "weight", target.alias("target"))


def _quotas(found: DataFrame, params: Params) -> DataFrame:
    """With blocks (of the source) and quota (slots): whole passes, then the blocks that the rest needs."""
    size = F.greatest(F.col("source_size"), F.lit(1))
    passes = F.least(F.floor(F.col("target") / size), F.lit(params.cap))
    blocks = F.ceil(F.col("source_size") / params.block)
    rest = F.greatest(F.col("target") - passes * size, F.lit(0.0))
    part = F.when(passes < params.cap, F.round(rest * blocks / size)).otherwise(0)
    return found.withColumn("blocks", blocks.cast("long")).withColumn("quota", F.when(F.col("source_size") > 0, passes * blocks + part).otherwise(0).cast("long"))


def plan(quotas: DataFrame, params: Params = PARAMS) -> DataFrame:
    """shard, src, slot (the source's), block, pass: one row for each slot of the mix."""
    spark = quotas.sparkSession
    rows = quotas.where("quota > 0").select("src", "blocks", "quota").orderBy("src").limit(params.max_sources + 1).collect()
    if len(rows) > params.max_sources:
        raise ValueError(f"more than {params.max_sources} sources")
    src, blocks, quota = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    total = int(quota.sum())
    shared = spark.sparkContext.broadcast((src, quota / max(1, total)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, weights = shared.value
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n = min(params.shard, total - shard * params.shard)
                drawn = np.random.default_rng([params.seed, shard]).multinomial(n, weights)
                own = np.flatnonzero(drawn)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard)), pa.array(numbers[own]), pa.array(drawn[own])], ["shard", "src", "n"])

    drawn = spark.range(0, -(-total // params.shard)).mapInArrow(_bytes.frugal(draw), "shard long, src long, n long")
    with _store.Scratch(spark, "mix-drawn") as scratch:
        drawn = _store.staged(_running(scratch.staged(drawn), ["src"], "shard", "n", "first"), "mix-draws")
    limits = quotas.select("src", "quota", "blocks")
    held = drawn.join(limits, "src").withColumn("fit", F.least("n", F.greatest(F.col("quota") - F.col("first"), F.lit(0))))
    # slots beyond quotas, about the root of all, take the places that other quotas still have
    over = held.where("fit < n").select("shard", "src", (F.col("n") - F.col("fit")).alias("extra"))
    by_shard = _running(over.groupBy("shard").agg(F.sum("extra").alias("extra")), [], "shard", "extra", "before").drop("extra")
    within = F.sum("extra").over(Window.partitionBy("shard").orderBy("src")) - F.col("extra")
    over = over.withColumn("within", within).join(by_shard, "shard")
    over = over.select("shard", F.explode(F.sequence(F.col("before") + F.col("within"), F.col("before") + F.col("within") + F.col("extra") - 1)).alias("rank"))
    got = drawn.groupBy("src").agg(F.sum("n").alias("got"))
    short = limits.join(got, "src", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < quota")
    # one row a source
    short = short.withColumn("before", F.sum(F.col("quota") - F.col("got")).over(Window.orderBy("src")) - (F.col("quota") - F.col("got")))
    short = short.select("src", "blocks", "before", "got", F.explode(F.sequence(F.col("got"), F.col("quota") - 1)).alias("first"))
    short = short.select("src", "blocks", "first", (F.col("before") + F.col("first") - F.col("got")).alias("rank"))
    runs = held.where("fit > 0").select("shard", "src", "first", F.col("fit").alias("n"), "blocks")
    runs = runs.union(over.join(short, "rank").select("shard", "src", "first", F.lit(1).cast("long"), "blocks"))

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, own, first, n, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slot = np.arange(first, first + n)
                block = np.concatenate([permuted(slot[slot // of == p] % of, of, [params.seed, own, int(p)]) for p in np.unique(slot // of)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.full(n, own)), pa.array(slot), pa.array(block), pa.array(slot // of)], ["shard", "src", "slot", "block", "pass"])

    return runs.select("shard", F.col("src").cast("long").alias("src"), "first", "n", "blocks").mapInArrow(_bytes.frugal(permute), "shard long, src long, slot long, block long, pass long")


def _running(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """rows with the sum of value over the rows before them in order (a number from 0), by keys.

    In two steps, so that no window holds more than BLOCK_OF rows of order, or the sums of as many.
    """
    rows = rows.withColumn("_b", F.floor(F.col(order) / BLOCK_OF))
    sums = rows.groupBy(*keys, "_b").agg(F.sum(value).alias("_s"))
    sums = sums.select(*keys, "_b", (F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_s")).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(*keys, "_b").orderBy(order)) - F.col(value)
    return rows.withColumn("_inside", inside).join(sums, [*keys, "_b"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_b", "_before", "_inside")


def permuted(index: np.ndarray, n: int, key: list[int]) -> np.ndarray:
    """A pseudorandom permutation of range(n) at the given indices: a Feistel network, walked until it stays below n."""
    if n < 2:
        return index.copy()
    half = max(1, -(-(n - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    rounds = np.random.default_rng(key).integers(0, 1 << 63, 4, dtype=np.int64).astype(np.uint64)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in rounds:
            left, right = right, left ^ (_bytes.mix(right ^ r) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def placed(sizes: DataFrame, found: DataFrame, params: Params) -> DataFrame:
    """Rows with words, with src, first (of the row's words in its source's stream) and each block they lie in."""
    # the order hangs on the rows' contents; row_id only tells equal rows apart
    rows = sizes.where("size > 0").withColumn("part", F.pmod(F.xxhash64(F.lit(params.seed), "doc_id", "mark"), F.lit(PARTS)))
    rows = rows.join(found.select("source", "src"), rows["source"].eqNullSafe(found["source"])).select("row_id", "doc_id", "mark", "src", "part", "size")
    inside = rows.withColumn("within", F.sum("size").over(Window.partitionBy("src", "part").orderBy("doc_id", "mark", "row_id")) - F.col("size"))
    parts = rows.groupBy("src", "part").agg(F.sum("size").alias("of_part"))
    parts = parts.select("src", "part", (F.sum("of_part").over(Window.partitionBy("src").orderBy("part")) - F.col("of_part")).alias("before"))
    out = inside.join(parts, ["src", "part"]).select("row_id", "src", "size", (F.col("before") + F.col("within")).alias("first"))
    last = (F.col("first") + F.col("size") - 1) / params.block
    return out.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / params.block), F.floor(last))))


def taken(docs_sizes: DataFrame, params: Params = PARAMS) -> tuple[DataFrame, DataFrame]:
    """The sources' table, and row_id, src, pass, low, high: the words low to high of a row that a pass takes."""
    found = _store.staged(_quotas(targets(docs_sizes, params), params), "mix-sources")
    slots = plan(found, params).select("src", "block", "pass")
    pieces = placed(docs_sizes, found, params).join(slots, ["src", "block"])
    low = F.greatest(F.col("block") * params.block - F.col("first"), F.lit(0))
    high = F.least((F.col("block") + 1) * params.block - F.col("first"), F.col("size"))
    return found, pieces.select("row_id", "src", "pass", low.alias("low"), high.alias("high"))


def amounts(docs: DataFrame, params: Params = PARAMS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row."""
    sizes = sized(docs)
    found, pieces = taken(sizes, params)
    words = pieces.groupBy("row_id").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    by_source = found.select(F.col("source").alias("_source"), "source_size", "target")
    out = sizes.join(words, "row_id", "left").join(by_source, F.col("source").eqNullSafe(F.col("_source")))
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, params: Params = PARAMS) -> DataFrame:
    """The mix with the columns of docs: for each row and pass the text of the words taken, whole where all are.

    n_chars, if docs have it, is the new text's length. A row whose words no slot takes is left out.
    """
    # the row in one column, so that no name of docs meets one of ours
    kept = _store.staged(docs.select(F.struct(*docs.columns).alias("_doc")).withColumn("row_id", F.monotonically_increasing_id()), "mix-documents")
    sizes = _store.staged(_narrow(kept.select("row_id", "_doc.doc_id", "_doc.source", "_doc.text")), "mix-sizes")
    _, pieces = taken(sizes, params)
    spans = pieces.groupBy("row_id", "pass").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("_spans"))
    joined = kept.join(spans, "row_id")
    names = list(docs.columns)
    text, length = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _bytes.text_buffers(batch.column(text))
            start, end, first = _bytes.word_spans(data, at)
            texts = []
            for k, spans in enumerate(batch.column(len(names)).to_pylist()):
                a, b = int(first[k]), int(first[k + 1])
                runs: list[list[int]] = []
                for s in spans:
                    if runs and runs[-1][1] == s["low"]:
                        runs[-1][1] = s["high"]
                    else:
                        runs.append([s["low"], s["high"]])
                cuts = [(at[k] if low == 0 else start[a + low], at[k + 1] if a + high == b else end[a + high - 1]) for low, high in runs]
                texts.append("\n".join(data[x:y].tobytes().decode("utf-8", "replace") for x, y in cuts))
            columns = list(batch.columns[: len(names)])
            columns[text] = pa.array(texts, batch.schema.field(text).type)
            if length is not None:
                columns[length] = pa.array([len(t) for t in texts], batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.select("_doc.*", "_spans").mapInArrow(_bytes.frugal(cut), docs.schema)
