"""Toxicity scores: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of pairs of neighbours and of pairs with one word
between (A-Z folded, edges without punctuation), in 2**22 places. Each coordinate has a rate of its own, which
falls with the gradients it has seen, and the L1 term keeps most weights at zero, so the model is a short list of
places and weights that every task can hold; the list's length is bounded by the places and, in practice, by
the sample.

Training takes the labelled rows of least hash, at most ``max_toxic`` and ``max_clean`` rows of either kind (a doc_id
that stands in many rows counts for each) and ``max_features`` features, a bound that makes the fit a single task's work whatever the table's size; each pass
reads them in the same order, so reruns agree. Both kinds weigh alike. Scoring reads every whole text.

Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1. Where a doc_id has several labels
the largest counts; null labels and null doc_ids teach nothing. Every row is scored, a null text as an empty one.
Without positive or negative rows to learn from, all scores are the share of positive ones (0 without any).
Extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import _bytes, _store


@dataclass(frozen=True)
class Params:
    bits: int = 22
    max_toxic: int = 6_000
    max_clean: int = 8_000
    max_features: int = 40_000_000
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    passes: int = 15
    threshold: float = 0.7


PARAMS = Params()
_U = np.uint64
_SALTS = (_U(0x8CB92BA72F3D8DD7), _U(0xABA2C4DD1A8E7B25), _U(0xD1B54A32D192ED03))


def features(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every n-gram and skip-gram, repeated ones too."""
    h, first = _bytes.core_words(data, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    places, rows = [_bytes.mix(h ^ _SALTS[0])], [row]
    for gap in (1, 2):
        if len(h) > gap:
            together = row[gap:] == row[:-gap]
            places.append(_bytes.mix(h[:-gap] * _SALTS[gap] + h[gap:])[together])
            rows.append(row[gap:][together])
    return np.concatenate(rows), (np.concatenate(places) >> _U(64 - bits)).astype(np.int32)


def _distinct(row: np.ndarray, place: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    """Sorted distinct places of each of n rows."""
    key = np.unique(row.astype(np.int64) << bits | place)
    return np.split((key & (1 << bits) - 1).astype(np.int32), np.searchsorted(key >> bits, np.arange(1, n)))


class Model:
    """Places and weights that aren't zero, and the bias."""

    def __init__(self, place: np.ndarray, weight: np.ndarray, bias: float, bits: int) -> None:
        self.place, self.weight, self.bias, self.bits = place, weight, bias, bits
        self.dense: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"dense": None}

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.dense is None:
            self.dense = np.zeros(1 << self.bits, np.float32)
            self.dense[self.place] = self.weight
        row, place = features(data, at, self.bits)
        heavy = self.dense[place] != 0
        key = np.unique(row[heavy].astype(np.int64) << self.bits | place[heavy])
        total = np.bincount(key >> self.bits, self.dense[key & (1 << self.bits) - 1], len(at) - 1)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35)))


def fit(rows: list[np.ndarray], labels: np.ndarray, params: Params) -> Model:
    """FTRL-proximal, one row at a time; rows hold distinct places."""
    y = labels.astype(np.float64)
    share = float(y.mean()) if len(y) else 0.0
    none = np.zeros(0, np.int32)
    if not 0 < share < 1:
        return Model(none, none.astype(np.float32), 35.0 if share else -35.0, params.bits)
    z, n = np.zeros(1 << params.bits), np.zeros(1 << params.bits)
    bias = bias_n = 0.0
    heft = np.where(y > 0, min(10.0, 0.5 / share), min(1.0, 0.5 / (1 - share)))
    for _ in range(params.passes):
        for part, target, by in zip(rows, y, heft, strict=True):
            zs, ns = z[part], n[part]
            root = np.sqrt(ns)
            w = np.where(np.abs(zs) <= params.l1, 0.0, (np.sign(zs) * params.l1 - zs) / ((params.beta + root) / params.alpha + params.l2))
            g = by * (1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - target)
            grown = np.sqrt(ns + g * g)
            z[part] = zs + g - (grown - root) / params.alpha * w
            n[part] = ns + g * g
            bias_n += g * g
            bias -= params.alpha / (params.beta + bias_n**0.5) * g
    w = np.where(np.abs(z) <= params.l1, 0.0, (np.sign(z) * params.l1 - z) / ((params.beta + np.sqrt(n)) / params.alpha + params.l2))
    kept = np.flatnonzero(w)
    return Model(kept.astype(np.int32), w[kept].astype(np.float32), float(bias), params.bits)


def teachers(docs: DataFrame, labels: DataFrame, label: str, params: Params, scratch: _store.Scratch | None = None) -> DataFrame:
    """turn, toxic and text of the labelled rows to learn from: those of least hash, up to the bound."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    turn = F.xxhash64(F.lit("turn"), "doc_id")
    known = known.withColumn("turn", turn)
    toxic, clean = (known.where(test).orderBy("turn", "doc_id").limit(most) for test, most in (("toxic > 0", params.max_toxic), ("toxic <= 0", params.max_clean)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(toxic.union(clean), "doc_id")
    # written, as both kinds are read from it; bounded again, as a doc_id may stand in many rows
    rows = scratch.staged(rows) if scratch else _store.staged(rows, "toxicity-teachers")
    order = ["turn", "doc_id", F.xxhash64("text")]
    toxic, clean = (rows.where(test).orderBy(*order).limit(most) for test, most in (("toxic > 0", params.max_toxic), ("toxic <= 0", params.max_clean)))
    return toxic.union(clean).select("turn", "toxic", "text")


def trained(docs: DataFrame, labels: DataFrame, params: Params = PARAMS, label: str = "toxic") -> Model:
    """The model; its features are made in parallel, its weights in one task."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, at in _bytes.slices(batch.column(2)):
                places = _distinct(*features(data, at, params.bits), high - low, params.bits)
                ends = np.append(0, np.cumsum([len(p) for p in places]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(places), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns[:2]), lists], ["turn", "toxic", "places"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, held = [], [], 0
        for batch in batches:
            for toxic, places in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = places.values.to_numpy(zero_copy_only=False)
                if held + max(1, len(own)) <= params.max_features:
                    rows.append(own.copy())
                    labels.append(toxic > 0)
                    held += max(1, len(own))
        model = fit(rows, np.array(labels, bool), params)
        yield pa.RecordBatch.from_arrays([pa.array([*model.place.tolist(), -1], pa.int32()), pa.array([*model.weight.tolist(), model.bias], pa.float64())], ["place", "weight"])

    with _store.Scratch(docs.sparkSession, "toxicity") as scratch:
        made = teachers(docs, labels, label, params, scratch).mapInArrow(_bytes.frugal(make), "turn long, toxic int, places array<int>")
        rows = made.repartition(1).sortWithinPartitions("turn", "places").mapInArrow(_bytes.frugal(learn), "place int, weight double").toPandas()
    own = rows[rows.place >= 0]
    bias = rows.weight[rows.place < 0]  # Spark runs no task where there are no rows
    return Model(own.place.to_numpy(np.int32), own.weight.to_numpy(np.float32), float(bias.iloc[0]) if len(bias) else -35.0, params.bits)


def scored(docs: DataFrame, model: Model, params: Params = PARAMS) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, at in _bytes.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(shared.value.scores(data, at), pa.float64())], ["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = narrow.mapInArrow(_bytes.frugal(run), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= params.threshold).cast("int").alias("predicted"))
