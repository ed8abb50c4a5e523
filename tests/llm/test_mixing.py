from __future__ import annotations

import random
from collections import Counter

import brute
import numpy as np
import pytest

from lodestone.llm import mixing
from lodestone.tables import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 1, "clash") for d, t, s in rows], SCHEMA)


def made(seed=1):
    r = random.Random(seed)
    names = ["b", "a", "Z", None, "é", "tiny"]
    rows = [(k, " \n".join(f"w{k}_{j}" for j in range(r.randint(0, 900))) + " ", r.choice(names[:5])) for k in range(120)]
    return [*rows, (500, "just three words", "tiny"), (501, None, "none"), (None, "word " * 40, "a"), (7, rows[7][1], rows[7][2]), (600, "w " * 30_000, "b")]


def sizes_of(rows):
    total = Counter()
    for _, t, s in rows:
        total[s] += len(brute.WORD.findall(t or ""))
    return total


@pytest.mark.parametrize("block", [16, 128])
def test_targets_and_amounts(spark, block):
    rows, params = made(), mixing.Params(block=block, shard=50)
    got = mixing.amounts(frame(spark, rows).repartition(3), params).collect()
    assert len(got) == len(rows)
    sizes = sizes_of(rows)
    want = brute.targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * block
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.05)


def test_reruns_agree(spark):
    df = frame(spark, made())
    a, b = ([tuple(r) for r in mixing.amounts(x).collect()] for x in (df.coalesce(1), df.repartition(5, "text")))
    assert sorted(a, key=str) == sorted(b, key=str)


def test_mixed_texts_hold_the_words_taken(spark):
    rows, params = made(3), mixing.Params(block=16, shard=64)
    df = frame(spark, rows).coalesce(1)
    out = mixing.mixed(df, params)
    assert out.schema == df.schema
    words, whole = Counter(), {}
    for r in out.collect():
        own = brute.WORD.findall(r.text)
        assert r.n_chars == len(r.text)
        words[r.source] += len(own)
        whole.setdefault(r.doc_id, []).append(r.text)
    for s, t in brute.targets(sizes_of(rows)).items():
        assert abs(words[s] - t) <= 32
    texts = {d: t for d, t, _ in rows}
    assert all(len(x) <= 2 * (2 if d == 7 else 1) for d, x in whole.items())
    assert whole[500] == [texts[500]] * 2  # a source at its cap comes whole, twice, and unchanged
    assert 501 not in whole


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    for key in ([1, 2, 0], [1, 2, 1]):
        assert sorted(mixing.permuted(np.arange(n), n, key)) == list(range(n))


def test_empty_and_wordless_tables(spark):
    assert mixing.amounts(frame(spark, [])).count() == 0
    assert mixing.mixed(frame(spark, [])).count() == 0
    got = mixing.amounts(frame(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 7, 8)], "doc_id long, text string, source string, row_id int, size int")
    assert [tuple(r) for r in mixing.mixed(df).collect()][:1] == [(1, "a b c", "s", 7, 8)]
    assert mixing.amounts(df).first()["size"] == 3


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = mixing.amounts(docs).collect()
    want = brute.targets(sizes_of([(r.doc_id, r.text, r.source) for r in docs.collect()]))
    taken = Counter()
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 0.03 * t for s, t in want.items())


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_OF", 3)
    rows = [(s, k, (k * 7 + s) % 5) for s in range(3) for k in range(20) if (k + s) % 4]
    for keys in (["src"], []):
        made = rows if keys else [(0, k, v) for k, v in {k: v for _, k, v in rows}.items()]
        got = {(r.src, r.shard): r.first for r in mixing._running(spark.createDataFrame(made, "src int, shard long, n long"), keys, "shard", "n", "first").collect()}
        assert got == {(s, k): sum(v for s2, k2, v in made if s2 == s and k2 < k) for s, k, _ in made}


def test_taken_against_the_plan(spark):
    """Each document's words are those of the slots whose blocks it lies in, slot by slot."""
    docs = spark.createDataFrame([(k, "w " * (k % 37), "abc"[k % 3]) for k in range(120)], "doc_id long, text string, source string")
    params = mixing.Params(block=16, shard=8)
    sizes = mixing.sized(docs)
    found = mixing._quotas(mixing.targets(sizes, params), params)
    slots = [(r.src, r.block, r["pass"]) for r in mixing.plan(found, params).collect()]
    assert len(slots) == len(set(slots)) == sum(r.quota for r in found.collect())
    want: dict[int, int] = {}
    own = {r.row_id: r for r in sizes.collect()}
    first: dict[int, tuple[int, int]] = {r.row_id: (r.src, r.first) for r in mixing.placed(sizes, found, params).collect()}
    for src, block, _ in slots:
        for row, (s, low) in first.items():
            if s == src:
                want[row] = want.get(row, 0) + max(0, min(low + own[row].size, (block + 1) * 16) - max(low, block * 16))
    got = sorted((r.doc_id, r.taken) for r in mixing.amounts(docs, params).collect())
    assert got == sorted((r.doc_id, want.get(k, 0)) for k, r in own.items())
