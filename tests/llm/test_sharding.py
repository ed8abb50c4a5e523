from __future__ import annotations

import random
from collections import defaultdict

import duckdb
import pytest

from lodestone.llm import sharding, sql

SCHEMA = "doc_id long, text string, shard string, depth int"


def rows(n=300, seed=1):
    r = random.Random(seed)
    out = [(k, "x" * r.randint(0, 400)) for k in range(n)]
    out += [(5, "same text " * 20)] * 40 + [(None, f"hot {k} " * 12) for k in range(100)] + [(900, "y" * 9000), (901, None), (901, None), (902, "")]
    return out


def made(spark, data, params):
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in data], SCHEMA).repartition(3)
    return sharding.with_totals(df, params).collect()


@pytest.mark.parametrize("limit", [500, 3000, 10**9])
def test_every_shard_fits(spark, limit):
    data, params = rows(), sharding.Params(limit=limit)
    got = made(spark, data, params)
    assert len(got) == len(data)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    for own in shards.values():
        assert sum(r.n_bytes for r in own) == own[0].shard_bytes
        assert own[0].shard_bytes <= limit or len(own) == 1
    # a shard that was split no further than need be: its parent doesn't fit
    prefixes = {s.split(".")[0] for s in shards}
    assert not any(a != b and b.startswith(a) for a in prefixes for b in prefixes)
    for p in prefixes:
        if p:
            assert sum(r.n_bytes for r in got if r.shard.startswith(p[:-1])) > limit


@pytest.mark.parametrize("limit", [500, 3000])
def test_against_sql(spark, limit):
    import pandas as pd

    data = rows(seed=4)
    documents = pd.DataFrame(data, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(sql.sharding(sharding.Params(limit=limit))).fetchall()
    got = [(r.doc_id, r.n_bytes, r.depth, r.shard, r.shard_bytes) for r in made(spark, data, sharding.Params(limit=limit))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert made(spark, [], sharding.PARAMS) == []


def test_a_very_long_text_and_a_very_long_word(spark):
    rows = [(1, "word " * 4_000_000), (2, "x" * 3_000_000), (3, None), (4, "a")]
    got = {r.doc_id: (r.n_bytes, r.shard) for r in sharding.with_totals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: n for k, (n, _) in got.items()} == {1: 20_000_000, 2: 3_000_000, 3: 0, 4: 1}
    assert got[1][1] != got[2][1]
