from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from lodestone.llm import queries, repeats

SCHEMA = "doc_id long, text string, runs string"


def check(spark, texts, params, ids=None):
    ids = ids or list(range(len(texts)))
    df = spark.createDataFrame([(d, t, "clash") for d, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digests(df, params).collect()), key=str)
    want = sorted(((d, *x) for d, x in zip(ids, brute.repeats(texts, params.length), strict=True)), key=str)
    assert got == want


def planted(r: random.Random) -> list[str]:
    base = ["".join(r.choice("abcdefgh é") for _ in range(r.randint(0, 400))) for _ in range(40)]
    for _ in range(60):
        a, b = r.choice(base), r.randrange(len(base))
        k = r.randint(0, len(a))
        at = r.randint(0, len(base[b]))
        base[b] = base[b][:at] + a[k : k + r.randint(5, 120)] + base[b][at:]
    near = list(r.choice(base))
    for k in range(0, len(near), 37):
        near[k] = "#"
    return [*base, "".join(near), base[3], base[3], "a" * 300, "ab" * 90, "", None, "xyz " * 100]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, seed):
    check(spark, planted(random.Random(seed)), repeats.Params(length=20, gram=6))


def test_sections_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SECTION", 150)
    monkeypatch.setattr(repeats, "GROUP", 2)
    check(spark, planted(random.Random(7)), repeats.Params(length=20, gram=6))


@pytest.mark.parametrize("group", [1, 3, 40])
def test_groups_of_any_size_are_split_alike(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    r = random.Random(group)
    line = "".join(r.choice("abcdefgh ") for _ in range(31))
    around = lambda n: "".join(r.choice("pq") for _ in range(n))
    # one line in many contexts, too short for a window, just long enough, and longer
    texts = [around(r.randint(0, 30)) + line[: r.choice((12, 17, 19, 20, 21, 31))] + around(r.randint(0, 30)) for _ in range(150)]
    check(spark, [*texts, *planted(r)[:20]], repeats.Params(length=20, gram=6))


@pytest.mark.parametrize("group", [512, 4_000])
def test_a_passage_in_many_contexts_costs_a_few_rows_for_each(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    made = []
    own = repeats._store.Scratch.staged
    monkeypatch.setattr(repeats._store.Scratch, "staged", lambda self, df: made.append(out := own(self, df)) or made.__setitem__(-1, out.count()) or out)
    r = np.random.default_rng(3)
    text = lambda n: r.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    line, n = text(90), 40_000
    texts = [text(60) + line + text(60) for _ in range(n)]
    seen = {}
    for k, t in enumerate(texts):
        for at in range(len(t) - 80 + 1):
            h = hash(t[at : at + 80])
            seen[h] = -1 if h in seen else k
    want = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for at in range(len(t) - 80 + 1):
            if seen[hash(t[at : at + 80])] < 0:
                gone[at : at + 80] = True
        want.append((len(t), int(gone.sum())))
    rows = repeats.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), repeats.Params(length=80, gram=24)).collect()
    assert [(x.n_bytes, x.n_removed) for x in sorted(rows, key=lambda x: x.doc_id)] == want
    assert len(made) > 6 and max(made) < 6 * n


def test_windows_ordered_place_by_place(spark, monkeypatch):
    monkeypatch.setattr(repeats, "AT_ONCE", 40)
    check(spark, planted(random.Random(11)), repeats.Params(length=20, gram=6))


def test_rows_that_share_a_doc_id_or_have_none(spark):
    line = "one and the same passage of more than twenty bytes"
    texts = [line + " x", line + " yy", None, "short", line, line, "other text that no row repeats at all"]
    check(spark, texts, repeats.Params(length=20, gram=6), [1, 1, None, None, None, None, 5])


def test_many_texts_under_one_doc_id(spark):
    r = random.Random(4)
    check(spark, [*planted(r), *planted(r)], repeats.Params(length=20, gram=6), [7] * 96)
    check(spark, planted(r), repeats.Params(length=20, gram=6), [None] * 48)


def test_many_equal_rows(spark):
    text = "".join(random.Random(6).choice("abcdefgh ") for _ in range(3000))
    other = text[:1000] + "#" + text[1000:1100]
    df = spark.createDataFrame([(k % 3, text if k else other) for k in range(20_000)], "doc_id long, text string").repartition(7)
    rows = repeats.digests(df).groupBy("n_bytes", "n_removed", "n_spans").count().collect()
    assert sorted(map(tuple, rows)) == [(1101, 1000, 1, 1), (3000, 3000, 1, 19_999)]


def test_very_long_text(spark):
    r = np.random.default_rng(9)
    text = r.integers(97, 123, 20_000_000, dtype=np.uint8).tobytes().decode()
    texts = [text, "#" + text[9_000_000:9_000_300] + "#", "#" + text[:150]]
    rows = repeats.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans) for x in rows) == [(0, 20_000_000, 300, 1), (1, 302, 300, 1), (2, 151, 0, 0)]


def test_phrases_made_to_collide(spark):
    a, b = brute.colliding_words()
    check(spark, [a, b, a + "#" + b, b + "." + a], repeats.Params(length=250, gram=40))
    check(spark, [f"{'-' * 300}{x}{'-' * 300}" for x in (a, b)], repeats.Params(length=200, gram=64))


def test_empty_table(spark):
    assert repeats.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op7_repeats(spark, d).collect())
    assert got == sorted((d, *x) for (d, _), x in zip(rows, brute.repeats([t for _, t in rows], 200), strict=True))
