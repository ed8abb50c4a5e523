from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from lodestone.llm import _store, near_dup, queries
from lodestone.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, n int, component_id string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(d, t, None, 1, "clash") for d, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


def check(spark, texts, size=2):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.clusters(frame(spark, texts).repartition(3), near_dup.Params(shingle=size)).collect()}
    want = {d: (n, c, c == d) for d, (n, c) in brute.near_dup(list(enumerate(texts)), size).items()}
    assert got == want


def families(seed, n=260):
    """Copies that drift from copies, so that groups hold links, near misses and chains."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    out = [" ".join(r.choice(words) for _ in range(r.randint(1, 90))) for _ in range(20)]
    for _ in range(n):
        w = r.choice(out[:30] if r.random() < 0.7 else out).split()
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    return [*out, "", None, " \t\n ", "one", "ONE", "one", "a b", "b a", "A  B", "x " * 30_000, "x x"]


@pytest.mark.parametrize(("few", "block", "hubs"), [(12, 1024, 8), (2, 3, 1), (2, 40, 2)])
def test_against_all_pairs(spark, monkeypatch, few, block, hubs):
    monkeypatch.setattr(near_dup, "FEW", few)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "HUBS", hubs)
    check(spark, families(few + block))


@pytest.mark.parametrize("letters", ["ab", "xQ"])
def test_words_made_to_collide(spark, letters):
    a, b = brute.colliding_words(letters)
    check(spark, [f"{a} {a}", f"{b} {b}", f"{a} {b} {a}", f"{b} {a} {b}", f"{a} {a}", a, b])


def test_buckets_of_several_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "FEW", 2)
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "PART", 3)
    check(spark, families(11))


def test_five_words_are_the_default(spark):
    assert near_dup.PARAMS.shingle == 5
    check(spark, families(5), 5)


def test_rows_of_one_doc_id_join_what_either_is_linked_with(spark):
    a, b = "the first of two quite different texts under one number", "nothing that stands here is in the other one of them"
    df = frame(spark, [a, a, b, b, b], [1, 5, 5, 9, 9])
    assert {(r.doc_id, r.component_id) for r in near_dup.clusters(df).collect()} == {(1, 1), (5, 1), (9, 1)}
    assert [r.doc_id for r in near_dup.kept(df).collect()] == [1]
    twice = frame(spark, [a, a, b, None, None], [5, 5, 5, None, None])
    assert sorted((r.doc_id for r in near_dup.kept(twice).collect()), key=str) == [5, None, None]


def test_sieve_tells_large_sets_apart():
    r = np.random.default_rng(7)
    a, b = near_dup._permutations(64)
    for n in (50, 1000, 5000):
        x, y = (near_dup._sieve_bytes(near_dup._signature(np.sort(r.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2)), a, b)) for _ in range(2))
        assert (x == y).mean() < 0.1


def test_rows_without_id_and_repeated_ids(spark):
    text = "a text of some words that stands here twice or more"
    df = frame(spark, [text, text, text + " x", None, "else where at all"], [None, 4, 4, 4, None])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.clusters(df).collect()), key=str)
    assert got == sorted([(None, None, True), (4, 4, True), (4, 4, True), (4, 4, True), (None, None, True)], key=str)
    kept = near_dup.kept(frame(spark, [text, text, "", None], [5, 9, 7, None]))
    assert kept.columns == ["doc_id", "text", "lang", "n", "component_id"]
    assert {r.doc_id for r in kept.collect()} == {5, 7, None}


def test_empty_table(spark):
    assert near_dup.clusters(frame(spark, [])).count() == 0


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    a, b = near_dup._permutations(64)
    errors = []
    for _ in range(40):
        x = np.unique(r.integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[: r.integers(50, 300)], r.integers(0, 1 << 63, 60, dtype=np.int64).astype(np.uint64)]))
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        errors.append((near_dup._signature(x, a, b) == near_dup._signature(y, a, b)).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_intersections():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 9000, n)).astype(np.uint64) for n in (0, 1, 50, 6000, 8000)]
    got = near_dup._intersections(sets[:3], sets)
    assert (got == [[len(np.intersect1d(x, y)) for y in sets] for x in sets[:3]]).all()


def test_components_of_paths(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 100)]
    with _store.Scratch(spark, "test") as scratch:
        got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long"), scratch).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102, 200), 100)}


def test_query_on_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_near_dup(spark, d).collect()}
    assert got == brute.near_dup(rows)
