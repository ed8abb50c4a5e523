"""Quality scores of documents: gradient-boosted trees over statistics of whole texts.

``text_statistics`` makes the features, ``gradient_trees`` the model. Both kinds of label are sampled apart, ``max_low`` and
``max_high`` labelled rows of least hash at most, and weigh as much as all labelled rows of their kind, so scores stay
probabilities. With that bound the fit is the work of one task whatever the table's size; the statistics of its rows are made
in parallel, where the texts are, and only those move. The model, some 20 kB, goes to every task. Scoring reads every whole text.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0. Where a doc_id has several labels the largest
counts; null labels and null doc_ids teach nothing. A doc_id that stands in many rows counts for each, within the bound. Every
row is scored, a null text as an empty one. Without rows of both kinds to learn from all scores are the share of good ones (0
without any). Extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import _bytes
from lodestone.llm.gradient_trees import Forest, Growth, grown
from lodestone.llm.text_statistics import NAMES, statistics
from lodestone.shared import Scratch


@dataclass(frozen=True)
class Params:
    max_low: int = 8_000
    max_high: int = 12_000
    threshold: float = 0.3
    growth: Growth = field(default_factory=Growth)


PARAMS = Params()
#: Features are made of so many bytes of text at once.
SLICE = 1 << 19


def _held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64()))


def examples(docs: DataFrame, labels: DataFrame, scratch: Scratch, label: str = "quality", params: Params = PARAMS) -> tuple[DataFrame, dict[bool, int]]:
    """good, turn and stats of the rows to learn from, and how many labelled doc_ids there are of either kind."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label).cast("int") > 0).alias("good")).where("doc_id is not null and good is not null")
    known = known.where(~_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("good").alias("good")).withColumn("turn", F.xxhash64(F.lit("quality"), "doc_id"))
    counts = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}

    def bounded(rows: DataFrame, *order: str | Column) -> DataFrame:
        low, high = (rows.where(test).orderBy(*order).limit(most) for test, most in (("not good", params.max_low), ("good", params.max_high)))
        return low.union(high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, at in _bytes.slices(batch.column(2), SLICE):
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns[:2]), _lists(statistics(data, at))], ["good", "turn", "stats"])

    # max_low + max_high rows of three small columns: every task may hold them, and no text moves
    taught = F.broadcast(bounded(known, "turn", "doc_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(taught, "doc_id")
    made = rows.select("good", "turn", "text").mapInArrow(_bytes.frugal(run), "good boolean, turn long, stats array<double>")
    # a doc_id may stand in many rows: bounded again
    return bounded(scratch.staged(made), "turn", "stats"), counts


def trained(docs: DataFrame, labels: DataFrame, params: Params = PARAMS, label: str = "quality") -> Forest:
    with Scratch(docs.sparkSession, "quality-classifier") as scratch:
        return _fitted(*examples(docs, labels, scratch, label, params), params)


def _fitted(rows: DataFrame, counts: dict[bool, int], params: Params) -> Forest:
    """The forest, grown in one task from rows whose number is bounded."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, stats = [], []
        for batch in batches:
            good.append(batch.column(0).to_numpy(zero_copy_only=False))
            stats.append(batch.column(2).flatten().to_numpy().reshape(-1, len(NAMES)))
        if not good:
            return
        y, x = np.concatenate(good).astype(bool), np.concatenate(stats)
        own = {kind: max(1, int((y == kind).sum())) for kind in (False, True)}
        # each kind weighs as in the labels, and all rows together as many as they are
        part = {kind: counts.get(kind, 0) / sum(counts.values()) * len(y) / own[kind] for kind in own}
        made = grown(x, y, np.where(y, part[True], part[False]), params.growth)
        columns = {"feature": [made.feature.ravel().tolist()], "edge": [made.edge.ravel().tolist()], "leaf": [made.leaf.ravel().tolist()], "start": [made.start]}
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns["feature"], pa.list_(pa.int32())), *(pa.array(columns[k], pa.list_(pa.float64())) for k in ("edge", "leaf")), pa.array(columns["start"], pa.float64())], list(columns)
        )

    fitted = rows.repartition(1).sortWithinPartitions("turn", "stats", "good").mapInArrow(_bytes.frugal(learn), "feature array<int>, edge array<double>, leaf array<double>, start double").collect()
    inner = (1 << params.growth.depth) - 1
    if not fitted:  # Spark runs no task where there are no rows
        return Forest(np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, inner + 1)), -35.0)
    one = fitted[0]
    return Forest(np.array(one["feature"], np.int32).reshape(-1, inner), np.array(one["edge"], float).reshape(-1, inner), np.array(one["leaf"], float).reshape(-1, inner + 1), one["start"])


def scored(docs: DataFrame, model: Forest, params: Params = PARAMS) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, at in _bytes.slices(batch.column(1), SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(shared.value.scores(statistics(data, at)), pa.float64())], ["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = narrow.mapInArrow(_bytes.frugal(run), "doc_id long, score double")
    held = F.coalesce(_held_out(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= params.threshold).cast("int").alias("predicted"))
