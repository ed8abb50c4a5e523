from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import _bytes, queries, quality_classifier
from lodestone.llm.gradient_trees import Growth, binned, edges, grown
from lodestone.llm.text_statistics import NAMES, statistics
from lodestone.shared import Scratch
from lodestone.tables import table

SCHEMA = "doc_id long, text string, lang string, quality int, stats string"
LABELS = "doc_id long, quality int, text string"
GROUPS = ["a-z", "A-Z", "0-9", " ", "\n", "\t\r\x0b\x0c", ".", ",;:", "!?", "#*$%&|<>", "()[]{}\"'", "/\\\\_=+@-"]


def plain(text):
    """The statistics by names, one text at a time."""
    text = text or ""
    n = max(1, len(text))
    counts = [len(re.findall(f"[{g if k in (0, 1, 2, 11) else re.escape(g)}]", text)) for k, g in enumerate(GROUPS)]
    lead = sum(ord(c) > 127 for c in text)
    counts += [lead, len(text) - lead - sum(counts)]
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    w = max(1, len(words))
    fold = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words]
    size = [len(x) for x in words]
    letters = [sum(c.isascii() and c.isalpha() or ord(c) > 127 for c in x) for x in words]
    uppers = [len(re.findall("[A-Z]", x)) for x in words]
    pairs, triples = Counter(zip(fold, fold[1:])), Counter(zip(fold, fold[1:], fold[2:]))
    covered = {k + s for k, x in enumerate(zip(fold, fold[1:], fold[2:])) if triples[x] > 1 for s in range(3)}
    lines = text.split("\n") if text else []
    solid = [x for x in lines if x]
    count = Counter(fold)
    mean = sum(size) / w
    p = [c / n for c in counts]
    run = [len(m[0]) for m in re.finditer(rb"(.)\1*", text.encode(), re.DOTALL)]
    return [
        *p, math.log1p(len(text)), math.log1p(len(words)), math.log1p(len(lines)), mean, math.sqrt(max(0, sum(s * s for s in size) / w - mean**2)), math.log1p(max(size, default=0)),
        sum(s <= 3 for s in size) / w, sum(s > 14 for s in size) / w, sum(bool(re.match("[A-Z]", x)) for x in words) / w,
        sum(u > 1 and u == c for u, c in zip(uppers, letters)) / w, sum(bool(re.search("[0-9]", x)) for x in words) / w, sum(not c for c in letters) / w,
        sum(x[-1] in "#*$%&|<>!?" for x in words) / w, len(count) / w, max(count.values(), default=0) / w, sum(a == b for a, b in zip(fold, fold[1:])) / w,
        sum(c for c in pairs.values() if c > 1) / max(1, len(words) - 1), len(covered) / w, math.log1p(len(text) / max(1, len(lines))),
        (len(solid) - len(set(solid))) / max(1, len(solid)), sum(x[-1] in ".!?:;\"'" for x in solid) / max(1, len(lines)),
        sum(not any(c.isascii() and c.isalpha() or ord(c) > 127 for c in x) for x in solid) / max(1, len(lines)), -sum(x * math.log2(x) for x in p if x), math.log1p(max(run, default=0)),
    ]


def made_texts(seed, n=300):
    r = random.Random(seed)
    alphabet = [" ", " ", "\n", "\t", "a", "bc", "Z", "ABC", "é", "中文", "🙂", "1", "...", "#", "!", "- ", "/", "(", "'", "\x00", "word ", "Word ", "word word word\n", "=="]
    return ["", None, "\n", "\n\n", " ", "x", "x\n", "\nx", *("".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(n)), "the same line\n" * 30_000, "y" * 1_000_000, ""]


@pytest.mark.parametrize("most", [60, 1 << 20])
def test_statistics_against_one_text_at_a_time(most):
    texts = made_texts(1)
    got = np.concatenate([statistics(data, at) for _, _, data, at in _bytes.slices(pa.array(texts), most)])
    assert got.shape == (len(texts), len(NAMES)) and np.isfinite(got).all()
    want = np.array([plain(t) for t in texts])
    assert np.allclose(got, want, atol=1e-9), [(NAMES[j], texts[i]) for i, j in np.argwhere(~np.isclose(got, want, atol=1e-9))[:5]]


def slow_trees(x, y, weight, how):
    """The forest as nested tuples, by a plain search over rows."""
    share = (weight * y).sum() / weight.sum()
    margin = np.full(len(x), math.log(share / (1 - share)))
    cuts = edges(x, how.bins)
    trees = []

    def grow(rows, g, h, depth):
        if depth == how.depth or not len(rows):
            return -how.rate * g[rows].sum() / (h[rows].sum() + how.l2)
        best = (how.least_gain, None, None)
        for f in range(x.shape[1]):
            for e in cuts[f]:
                left, right = rows[x[rows, f] <= e], rows[x[rows, f] > e]
                if min(h[left].sum(), h[right].sum()) < how.least_curvature:
                    continue
                gain = sum(s * g[p].sum() ** 2 / (h[p].sum() + how.l2) for s, p in ((1, left), (1, right), (-1, rows)))
                if gain > best[0] + 1e-12:
                    best = (gain, f, e)
        if best[1] is None:
            return grow(rows, g, h, how.depth)
        _, f, e = best
        return f, e, grow(rows[x[rows, f] <= e], g, h, depth + 1), grow(rows[x[rows, f] > e], g, h, depth + 1)

    def down(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(how.trees):
        p = 1 / (1 + np.exp(-margin))
        trees.append(grow(np.arange(len(x)), weight * (p - y), weight * p * (1 - p), 0))
        margin = margin + np.array([down(trees[-1], row) for row in x])
    return margin


@pytest.mark.parametrize("bins", [5, 200])
def test_trees_against_a_plain_search(bins):
    r = np.random.default_rng(bins)
    x = np.round(r.normal(0, 1, (150, 4)), 1)
    y = (x[:, 0] * x[:, 1] > 0) ^ (r.random(150) < 0.05)
    weight = np.where(y, 0.7, 1.6)
    how = Growth(trees=6, depth=3, bins=bins, rate=0.5, l2=1.0, least_curvature=0.5)
    forest = grown(x, y, weight, how)
    assert np.allclose(forest.margins(x), slow_trees(x, y, weight, how), atol=1e-8)
    assert (binned(x, edges(x, bins)).max(axis=0) < bins + 1).all()


@pytest.mark.parametrize(("y", "score"), [([True] * 4, 1.0), ([False] * 4, 0.0)])
def test_labels_of_one_kind_give_no_tree(y, score):
    x = np.arange(8.0).reshape(4, 2)
    forest = grown(x, np.array(y), np.ones(4), Growth())
    assert np.allclose(forest.scores(x), score) and not len(forest.feature)


def corpus(n=500):
    r = random.Random(4)
    good = [f"{a}{b}" for a in ("ar", "ben", "cor", "dim", "el") for b in ("o", "una", "it", "as")]
    rows, labels = [], []
    for k in range(n):
        low = k % 4 == 0
        words = [r.choice(good) for _ in range(r.randint(20, 90))]
        rows.append((k, " ".join(f"{w}!!" for w in words) if low else " ".join(words) + ".", None, 1, "clash"))
        labels.append((k, None if k % 60 == 59 else int(not low), "x"))
    return rows, labels


def test_learns_and_reruns_agree(spark):
    rows, labels = corpus()
    extra = [(None, "one two", None, None, ""), (1000, None, "en", 1, ""), (1001, "", "en", 1, ""), (1001, "", "en", 1, ""), (1002, "word " * 100_000, "en", 1, ""), (1003, "q" * 300_000, "", 0, "")]
    docs = spark.createDataFrame([*rows, *extra], SCHEMA).repartition(3)
    known = spark.createDataFrame([*labels, (None, 1, "x"), (0, 0, "x"), (9000, 1, "x")], LABELS)
    model = quality_classifier.trained(docs, known)
    got = sorted(map(tuple, quality_classifier.scored(docs, model).collect()), key=str)
    assert got == sorted(map(tuple, quality_classifier.scored(docs, quality_classifier.trained(docs.repartition(2), known)).collect()), key=str)
    assert len(got) == len(rows) + len(extra)
    by_id = {d: (h, s, p) for d, h, s, p in got}
    assert not by_id[None][0]
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, (h, _, _) in by_id.items() if d is not None)
    assert all(0 <= s <= 1 and p == (s >= 0.3) for _, s, p in by_id.values())
    held = [(d, p) for d, (h, _, p) in by_id.items() if d is not None and h and d < 500]
    assert len(held) > 60 and all(p == (d % 4 != 0) for d, p in held)


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows, labels = corpus()
    turned = [(d, 1 - q if q is not None and zlib.crc32(str(d).encode()) % 5 == 0 else q, x) for d, q, x in labels]
    docs = spark.createDataFrame(rows, SCHEMA)
    a, b = (quality_classifier.trained(docs, spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert len(a.feature) and (a.edge == b.edge).all() and (a.leaf == b.leaf).all()


def test_the_sample_is_bounded_and_weighed(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, *([(1, "many rows of one number", "", 1, "")] * 200)], SCHEMA)
    params = quality_classifier.Params(max_low=9, max_high=30)
    with Scratch(spark, "test") as scratch:
        taught, counts = quality_classifier.examples(docs, spark.createDataFrame(labels, LABELS), scratch, params=params)
        n = Counter(r.good for r in taught.collect())
    assert n == {False: 9, True: 30}
    want = Counter(bool(q) for d, q, _ in labels if q is not None and zlib.crc32(str(d).encode()) % 5 != 0)
    assert counts == want


@pytest.mark.parametrize(("value", "score"), [(0, 0.0), (1, 1.0), (None, 0.0)])
def test_labels_of_one_kind(spark, value, score):
    docs = spark.createDataFrame([(k, "text", "en", 1, "") for k in range(9)], SCHEMA)
    known = spark.createDataFrame([(k, value, "") for k in range(9)], LABELS)
    assert np.allclose([r.score for r in quality_classifier.scored(docs, quality_classifier.trained(docs, known)).collect()], score)


def test_empty_tables(spark):
    docs, known = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert quality_classifier.scored(docs, quality_classifier.trained(docs, known)).count() == 0


def test_held_out_accuracy_on_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in table(spark, d, "labels").collect()}
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in queries.op11_quality_classifier(spark, d).collect() if r.held_out and r.doc_id in labels]
    good, bad = ([p for _, p, q in held if q == k] for k in (1, 0))
    assert len(bad) > 100 and sum(good) >= 0.995 * len(good) and sum(bad) <= 0.1 * len(bad)
    a, b = (np.array([s for s, _, q in held if q == k]) for k in (1, 0))
    assert (a[:, None] > b[None, :]).mean() > 0.98
