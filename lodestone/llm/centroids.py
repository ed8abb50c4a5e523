"""Clusters of vectors by Lloyd's rounds with Drake's adaptive bounds, in exact integers.

Vectors become integers (floor of ``scale`` times each component), so sums, means and squared distances are exact, and a
plain scan of all centroids gives the same result. Bounds spare most of those scans. Each vector keeps

* ``upper``: no less than its distance to its own centroid,
* ``near`` and ``lower``: some of the next centroids in order of distance, with a lower bound each,
* ``rest``: one lower bound for all the others.

When centroids move, upper grows by the own centroid's way, each lower falls by its centroid's and rest by the longest. If
upper is below all lower bounds then the vector stays. Otherwise its own distance is taken exactly; if that isn't below the
first bounds either but below a later one, only the centroids before that one can be nearer, and they are measured and ordered
again; if it isn't below rest, all are. Bounds are widened by more than what floats lose, and a tie is never certified, so
the smaller number always wins. The number of bounds falls to the most that any vector needed in the round before.

Each round is one pass over a table of vectors with their bounds, written with the round's sums: a row for each batch and
centroid, which only a task that ends leaves behind, so lost executors count nothing twice. Spark adds these rows up. The
driver sees k centroids. The table of the round before goes once it is read.

Rows: vectors with another number of components, or with one that is null or not finite, are left out, and null vectors too.
Repeated rows count each. A row without a vec_id is clustered like others, but is the last to be a first centroid; of rows
with one hash those whose packed components come first go first. Components saturate at 2**27, beyond which distances would not
fit a long. With fewer vectors than k there are fewer centroids. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import _bytes
from lodestone.shared import new_path, remove

#: Components' largest size: 64 squares of twice this are below 2**63.
LARGEST = 1 << 27
#: Squared distances up to which doubles add up exactly.
_EXACT = 1 << 53
#: By how much bounds are widened: more than a distance's rounding and that of the sums it goes through.
_SLACK = 1e-9


@dataclass(frozen=True)
class Params:
    k: int = 8
    rounds: int = 10
    dimensions: int = 64
    scale: int = 1024
    seed: int = 3
    bounds: int = 3  #: lower bounds of a vector at first, besides the one for the rest

    def __post_init__(self) -> None:
        if not 1 <= self.dimensions <= 64 or self.k < 1 or self.bounds < 1 or self.rounds < 0:
            raise ValueError("k, bounds and dimensions are 1 at least, dimensions 64 at most, rounds not negative")


PARAMS = Params()


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c."""
    far = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * far * far * x.shape[1] < _EXACT:  # every sum on the way is a whole number that a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for k, own in enumerate(c):
        step = x - own
        out[:, k] = (step * step).sum(axis=1)
    return out


def _measured(x: np.ndarray, c: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to the centroids that its row of which names."""
    out = np.empty(which.shape, np.int64)
    for j in range(which.shape[1]):
        step = x - c[which[:, j]]
        out[:, j] = (step * step).sum(axis=1)
    return out


def _above(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + _SLACK) + _SLACK


def _below(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 - _SLACK) - _SLACK


@dataclass
class Bounds:
    """What is known of each vector: see the module."""

    own: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    rest: np.ndarray

    def cut(self, keep: int) -> None:
        """Keeps so many bounds; what the others said goes into rest."""
        if keep < self.lower.shape[1]:
            self.rest = np.minimum(self.rest, self.lower[:, keep:].min(axis=1))
            self.near, self.lower = self.near[:, :keep], self.lower[:, :keep]


def scanned(x: np.ndarray, c: np.ndarray, bounds: int) -> Bounds:
    """Bounds of vectors that are measured against all centroids."""
    d = squared(x, c)
    order = np.argsort(d, axis=1, kind="stable")  # ties: the smaller number
    sorted_ = np.take_along_axis(d, order, axis=1)
    keep = min(bounds, len(c) - 1)
    rest = _below(sorted_[:, keep + 1]) if keep + 1 < len(c) else np.full(len(x), np.inf)
    return Bounds(order[:, 0], _above(sorted_[:, 0]), order[:, 1 : keep + 1], _below(sorted_[:, 1 : keep + 1]), rest)


def moved(x: np.ndarray, c: np.ndarray, way: np.ndarray, b: Bounds) -> tuple[int, int]:
    """Assigns vectors anew after the centroids moved to c, by way each; changes b.

    Returns the most bounds that a vector needed, and how many distances were measured.
    """
    n, kept = b.lower.shape
    b.upper = b.upper * (1 + _SLACK) + way[b.own]
    b.lower = b.lower - way[b.near] - _SLACK
    b.rest = b.rest - way.max(initial=0.0) - _SLACK
    # from the back, so that a bound also holds for all behind it
    least = np.minimum.accumulate(np.concatenate([b.lower, b.rest[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
    open_ = np.flatnonzero(b.upper >= least[:, 0])
    if not len(open_):
        return 0, 0
    exact = _measured(x[open_], c, b.own[open_][:, None])[:, 0]
    b.upper[open_] = _above(exact)
    depth = (b.upper[open_][:, None] >= least[open_]).sum(axis=1)
    measured, deepest = len(open_), 0
    for j in range(1, kept + 1):
        part = depth == j
        if not part.any():
            continue
        rows = open_[part]
        which = np.concatenate([b.own[rows][:, None], b.near[rows, :j]], axis=1)
        d = np.concatenate([exact[part][:, None], _measured(x[rows], c, which[:, 1:])], axis=1)
        order = np.lexsort((which, d), axis=1)
        which, d = np.take_along_axis(which, order, axis=1), np.take_along_axis(d, order, axis=1)
        b.own[rows], b.upper[rows] = which[:, 0], _above(d[:, 0])
        b.near[rows, :j], b.lower[rows, :j] = which[:, 1:], _below(d[:, 1:])
        measured, deepest = measured + len(rows) * j, j
    rows = open_[depth == kept + 1]
    if len(rows):
        new = scanned(x[rows], c, kept)
        b.own[rows], b.upper[rows], b.near[rows], b.lower[rows], b.rest[rows] = new.own, new.upper, new.near, new.lower, new.rest
        measured, deepest = measured + len(rows) * len(c), kept
    return deepest, measured


def _floats(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


_SUMS = "sums array<struct<slot: int, n: long>>"
_STATE = f"vec_id long, x binary, own int, upper double, near array<int>, lower array<double>, rest double, distance long, {_SUMS}"


def _sums(x: np.ndarray, own: np.ndarray, k: int, deepest: int, distance: np.ndarray | None) -> list[dict]:
    """A batch's share of what the round adds up: components by centroid, then counts, inertia, and the most bounds needed."""
    d = x.shape[1]
    order = np.argsort(own, kind="stable")
    present, first = np.unique(own[order], return_index=True)
    total = np.add.reduceat(x[order], first, axis=0) if len(x) else np.zeros((0, d), np.int64)
    out = [{"slot": int(c) * d + j, "n": int(v)} for c, row in zip(present, total, strict=True) for j, v in enumerate(row)]
    out += [{"slot": k * d + int(c), "n": int(n)} for c, n in zip(present, np.bincount(own, minlength=k)[present], strict=True)]
    if distance is not None:
        out += [{"slot": k * (d + 1) + int(c), "n": int(distance[own == c].sum())} for c in present]
    return [*out, {"slot": -1 - deepest, "n": 1}]


def _rows(vec_id: pa.Array, x: np.ndarray, b: Bounds, k: int, deepest: int, distance: np.ndarray | None) -> pa.RecordBatch:
    """A batch of the state; its first row carries the batch's sums."""
    n, kept = b.lower.shape
    ends = pa.array(np.arange(n + 1) * kept, pa.int32())
    sums = [_sums(x, b.own, k, deepest, distance), *[None] * (n - 1)] if n else []
    raw = np.ascontiguousarray(x, "<i4")
    packed = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * 4 * x.shape[1]), pa.py_buffer(raw)])
    return pa.RecordBatch.from_arrays(
        [
            vec_id,
            packed,
            pa.array(b.own, pa.int32()),
            pa.array(b.upper),
            pa.ListArray.from_arrays(ends, pa.array(b.near.ravel(), pa.int32())),
            pa.ListArray.from_arrays(ends, pa.array(b.lower.ravel(), pa.float64())),
            pa.array(b.rest),
            pa.array(distance, pa.int64()) if distance is not None else pa.nulls(n, pa.int64()),
            pa.array(sums, pa.list_(pa.struct([("slot", pa.int32()), ("n", pa.int64())]))),
        ],
        ["vec_id", "x", "own", "upper", "near", "lower", "rest", "distance", "sums"],
    )


def vectors(table: DataFrame, params: Params = PARAMS) -> DataFrame:
    """vec_id and x (the integers, four bytes each) of the vectors that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(_floats(batch.column(1)).astype(np.float64).reshape(-1, params.dimensions) * params.scale)
            x = np.clip(x, -LARGEST, LARGEST).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "x"])

    embedding = F.col("embedding").cast("array<double>")
    narrow = table.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return narrow.where((F.size("embedding") == params.dimensions) & finite).mapInArrow(_bytes.frugal(run), "vec_id long, x binary")


def first_centroids(kept: DataFrame, params: Params = PARAMS) -> np.ndarray:
    """The k vectors of least hash."""
    digest = F.sha2(F.concat(F.lit(f"{params.seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(digest.alias("digest"), "x").orderBy(F.col("digest").asc_nulls_last(), "x").limit(params.k).collect()
    return np.array([np.frombuffer(r["x"], "<i4") for r in rows], np.int64).reshape(len(rows), params.dimensions)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(_bytes.text_buffers(column)[0], "<i4").reshape(-1, dimensions).astype(np.int64)


def _pass(df: DataFrame, centroids: np.ndarray, way: np.ndarray | None, bounds: int, last: bool, params: Params) -> DataFrame:
    """The state after an assignment to the centroids; way is None at first."""
    shared = df.sparkSession.sparkContext.broadcast((centroids, way))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, way = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1), params.dimensions)
            if way is None:
                b, deepest = scanned(x, c, bounds), bounds
            else:
                own, upper, rest = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 6))
                near, lower = (_floats(batch.column(k)).reshape(len(x), -1) for k in (4, 5))
                b = Bounds(own.astype(np.int64), upper, near.astype(np.int64), lower, rest)
                b.cut(bounds)
                deepest, _ = moved(x, c, way, b)
            distance = _measured(x, c, b.own[:, None])[:, 0] if last else None
            yield _rows(batch.column(0), x, b, len(c), deepest, distance)

    return df.mapInArrow(_bytes.frugal(run), _STATE)


def _totals(state: DataFrame) -> dict[int, int]:
    """The rounds' sums by slot: k * (dimensions + 2) rows at most, and one for each number of bounds."""
    each = state.where("sums is not null").select(F.explode("sums").alias("s")).select("s.slot", F.col("s.n").cast("decimal(38,0)").alias("n"))
    return {r["slot"]: int(r["n"]) for r in each.groupBy("slot").agg(F.sum("n").alias("n")).collect()}


def _means(centroids: np.ndarray, totals: dict[int, int]) -> np.ndarray:
    k, d = centroids.shape
    out = centroids.copy()
    for c in range(k):
        if n := totals.get(k * d + c):
            out[c] = [totals[c * d + j] // n for j in range(d)]  # whole numbers of any size, rounded down
    return out


def clustered(table: DataFrame, params: Params = PARAMS) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector that is kept."""
    spark = table.sparkSession
    path = new_path(spark, "centroids")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    state = stored(vectors(table, params), "vectors")
    centroids = first_centroids(state, params)
    bounds = min(params.bounds, max(1, len(centroids) - 1)) if len(centroids) > 1 else 0
    name, way = "vectors", None
    for turn in range(params.rounds + 1 if len(centroids) else 0):
        last = turn == params.rounds
        before, name = name, f"round-{turn}"
        state = stored(_pass(state, centroids, way, bounds, last, params), name)
        remove(spark, f"{path}/{before}")
        totals = _totals(state)
        if not last:
            new = _means(centroids, totals)
            # a centroid's way, widened as the bounds are
            way, centroids = _above(np.array([((a - b) ** 2).sum() for a, b in zip(new, centroids, strict=True)])), new
            needed = max((-1 - slot for slot in totals if slot < 0), default=bounds)
            bounds = min(bounds, max(1, needed)) if turn else bounds
    return _described(spark, state, centroids, totals if len(centroids) else {})


def _described(spark: SparkSession, state: DataFrame, centroids: np.ndarray, totals: dict[int, int]) -> DataFrame:
    """The last state with what holds for whole clusters: a row for each of k."""
    k, d = centroids.shape
    inertia = [totals.get(k * (d + 1) + c, 0) for c in range(k)]
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(c, inertia[c], sum(inertia), digests[c]) for c in range(k)]
    of_clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    if not rows:
        state = state.select("vec_id", F.lit(0).alias("own"), F.lit(0).cast("long").alias("distance"))
    own = state.select("vec_id", F.col("own").alias("cluster"), "distance")
    return own.join(F.broadcast(of_clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
