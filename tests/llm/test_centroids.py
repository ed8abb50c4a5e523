from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from lodestone.llm import centroids, queries, sql

SCHEMA = "vec_id long, embedding array<float>, cluster string, x int"
WIDE = "vec_id long, embedding array<double>, cluster string, x int"


def brute(rows, params):
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha) by plain Lloyd rounds in Python's whole numbers."""
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == params.dimensions and all(v is not None and math.isfinite(v) for v in e):
            kept.append((vec_id, [max(-centroids.LARGEST, min(centroids.LARGEST, math.floor(params.scale * v))) for v in e]))

    def turn(row):
        return "g" if row[0] is None else hashlib.sha256(f"{params.seed}:{row[0]}".encode()).hexdigest()

    c = [x for _, x in sorted(kept, key=lambda r: (turn(r), np.array(r[1], "<i4").tobytes()))[: params.k]]
    for k in range(params.rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c)) for _, x in kept]
        if k < params.rounds:
            for j in range(len(c)):
                if mine := [x for (_, x), (_, o) in zip(kept, own, strict=True) if o == j]:
                    c[j] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    of = [sum(d for d, o in own if o == j) for j in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    return [(i, o, d, of[o], sum(of), sha[o]) for (i, _), (d, o) in zip(kept, own, strict=True)]


def check(spark, rows, params, schema=SCHEMA):
    df = spark.createDataFrame([(i, e, "clash", 1) for i, e in rows], schema).repartition(3)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(map(tuple, centroids.clustered(df, params).collect()), key=str)
    assert got == sorted(brute(rows, params), key=str)
    return got


def blobs(seed, n, d, groups=6):
    r = np.random.default_rng(seed)
    middle = r.normal(0, 1, (groups, d))
    return [(k, (middle[r.integers(groups)] + r.normal(0, 0.4, d)).astype(np.float32).tolist()) for k in range(n)]


@pytest.mark.parametrize(("k", "bounds", "rounds"), [(8, 3, 10), (20, 2, 6), (5, 9, 4), (2, 1, 3), (1, 1, 2), (8, 1, 0)])
def test_against_plain_rounds(spark, k, bounds, rounds):
    check(spark, blobs(k, 300, 5), centroids.Params(k=k, bounds=bounds, rounds=rounds, dimensions=5))


def test_ties_and_empty_clusters(spark):
    grid = [(k, [float(k % 3), float(k // 3 % 3)]) for k in range(200)]  # nine places, many at equal distances
    got = check(spark, grid, centroids.Params(k=12, dimensions=2, scale=1, rounds=5))
    assert len({r[1] for r in got}) < 12


def test_rows_that_are_left_out_and_repeated(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (1, [-0.0004, 9.0]), (None, [3.0, 3.0]), (None, None), (2, None), (3, []), (4, [1.0]), (5, [1.0, 2.0, 3.0]), (6, [nan, 1.0]), (7, [1.0, -inf]), (8, [None, 1.0]), (9, [2.0, 2.0]), (10, [0.1, 0.1])]
    assert len(check(spark, rows, centroids.Params(k=3, dimensions=2))) == 6


def test_fewer_vectors_than_centroids(spark):
    check(spark, [(1, [1.0, 1.0]), (2, [2.0, 0.0])], centroids.Params(dimensions=2))


def test_large_components_are_exact(spark):
    r = np.random.default_rng(4)
    rows = [(k, (r.normal(0, 1, 3) * 10.0 ** r.integers(-3, 39)).tolist()) for k in range(120)]
    check(spark, rows, centroids.Params(k=6, dimensions=3), WIDE)


@pytest.mark.parametrize("schema", [SCHEMA, WIDE])
def test_empty_table(spark, schema):
    out = centroids.clustered(spark.createDataFrame([], schema))
    assert out.count() == 0
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.clustered(spark.createDataFrame([(1, None, "", 1)], schema)).count() == 0


def test_bounds_hold_and_spare_distances():
    r = np.random.default_rng(9)
    middle = r.normal(0, 400, (12, 16))
    x = np.floor(middle[r.integers(12, size=3000)] + r.normal(0, 60, (3000, 16))).astype(np.int64)
    c = x[:20].copy()
    b = centroids.scanned(x, c, 4)
    spared = []
    for turn in range(12):
        new = np.array([x[b.own == k].sum(axis=0) // max(1, (b.own == k).sum()) if (b.own == k).any() else c[k] for k in range(20)])
        way = centroids._above(((new - c) ** 2).sum(axis=1))
        c = new
        deepest, measured = centroids.moved(x, c, way, b)
        d = centroids.squared(x, c)
        root = np.sqrt(d)
        assert (b.own == d.argmin(axis=1)).all()
        assert (b.upper >= root.min(axis=1)).all()
        assert (b.lower <= np.take_along_axis(root, b.near, axis=1)).all()
        others = root.copy()
        np.put_along_axis(others, np.concatenate([b.own[:, None], b.near], axis=1), np.inf, axis=1)
        assert (b.rest <= others.min(axis=1)).all()
        spared.append(1 - measured / d.size)
        b.cut(max(1, deepest) if turn else 4)
    assert min(spared[3:]) > 0.5 and spared[-1] > 0.9


def test_rounds_leave_one_table(spark):
    from lodestone.shared import shared_folder

    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/lodestone")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def tables():
        if not store.exists(folder):
            return {}
        made = {str(f.getPath()): store.listStatus(f.getPath()) for f in store.listStatus(folder) if f.getPath().getName().startswith("centroids-")}
        return {name: [f.getPath().getName() for f in files] for name, files in made.items()}

    before = tables()
    centroids.clustered(spark.createDataFrame([(i, e, "", 1) for i, e in blobs(1, 50, 4)], SCHEMA), centroids.Params(dimensions=4, rounds=3)).count()
    new = {k: v for k, v in tables().items() if k not in before}
    assert list(new.values()) == [["round-3"]]


def test_query_against_sql_and_brute_force(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(map(tuple, queries.op13_centroids(spark, d).collect()))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    assert got == sorted(duck.execute(sql.clusters()).fetchall())
    assert got == sorted(brute([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()], centroids.PARAMS))
