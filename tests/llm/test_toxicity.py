from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from lodestone.llm import queries, toxicity
from lodestone.tables import table

SCHEMA = "doc_id long, text string, lang string, toxic int, score int"


def made(n=400):
    r = random.Random(2)
    plain = [f"w{k}" for k in range(60)]
    rows, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        words = [r.choice(plain) for _ in range(r.randint(5, 60))]
        if toxic:
            words.insert(r.randint(0, len(words)), r.choice(["Vile,", "rotten!", "foul"]))
        rows.append((k, " ".join(words), "en", None, 7))
        labels.append((k, None if k % 50 == 49 else int(toxic), "x"))
    return rows, labels


def test_learns_and_reruns_agree(spark):
    rows, labels = made()
    extra = [(None, "foul", None, None, 1), (1000, None, "en", None, 1), (1001, "", "en", None, 1), (1001, "", "en", None, 1), (1002, "word " * 60_000, "en", None, 1)]
    docs = spark.createDataFrame([*rows, *extra], SCHEMA).repartition(3)
    known = spark.createDataFrame([*labels, (None, 1, "x"), (0, 0, "x"), (5000, 1, "x")], "doc_id long, toxic int, text string")
    model = toxicity.trained(docs, known)
    got = sorted(map(tuple, toxicity.scored(docs, model).collect()), key=str)
    again = sorted(map(tuple, toxicity.scored(docs, toxicity.trained(docs.repartition(2), known)).collect()), key=str)
    assert got == again
    assert len(got) == len(rows) + len(extra)
    by_id = {d: (h, s, p) for d, h, s, p in got}
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, (h, _, _) in by_id.items() if d is not None)
    assert all(0 <= s <= 1 and p == (s >= 0.7) for _, s, p in by_id.values())
    held = [(d, p) for d, (h, _, p) in by_id.items() if d is not None and h and d < 400]
    assert len(held) > 90
    assert sum(p == (d % 4 == 0) for d, p in held) >= 0.95 * len(held)
    assert not by_id[1000][2] and not by_id[1001][2] and not by_id[1002][2]
    assert len(model.place) < 400


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows, labels = made()
    turned = [(d, 1 - t if t is not None and zlib.crc32(str(d).encode()) % 3 == 1 else t, x) for d, t, x in labels]
    docs = spark.createDataFrame(rows, SCHEMA)
    a, b = (toxicity.trained(docs, spark.createDataFrame(x, "doc_id long, toxic int, text string")) for x in (labels, turned))
    assert a.bias == b.bias and (a.place == b.place).all() and (a.weight == b.weight).all()


@pytest.mark.parametrize(("value", "score"), [(0, 0.0), (1, 1.0), (None, 0.0)])
def test_labels_of_one_kind(spark, value, score):
    docs = spark.createDataFrame([(k, "text", "en", 1, 1) for k in range(6)], SCHEMA)
    known = spark.createDataFrame([(k, value) for k in range(6)], "doc_id long, toxic int")
    got = [r.score for r in toxicity.scored(docs, toxicity.trained(docs, known)).collect()]
    assert np.allclose(got, score)


def test_empty_tables(spark):
    docs, known = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored(docs, toxicity.trained(docs, known)).count() == 0


def test_held_out_accuracy_on_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in table(spark, d, "labels").collect()}
    rows = queries.op1_toxicity(spark, d).collect()
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    toxic = [p for _, p, t in held if t]
    clean = [p for _, p, t in held if not t]
    assert sum(toxic) >= 0.55 * len(toxic)
    assert sum(clean) <= 0.005 * len(clean)
    a, b = (np.array([s for s, _, t in held if t == k]) for k in (1, 0))
    assert (a[:, None] > b[None, :]).mean() > 0.93


def test_fit_against_the_plain_algorithm():
    r = random.Random(3)
    params = toxicity.Params(bits=10, l1=0.4, passes=3)
    rows = [np.array(sorted(r.sample(range(40), r.randint(0, 8))), np.int32) for _ in range(60)]
    labels = np.array([bool(len(x) and x[0] < 9) for x in rows])
    model = toxicity.fit(rows, labels, params)

    z, n, bias, bias_n = {}, {}, 0.0, 0.0
    share = labels.mean()

    def weight(i):
        if abs(z.get(i, 0.0)) <= params.l1:
            return 0.0
        return (np.sign(z[i]) * params.l1 - z[i]) / ((params.beta + n[i] ** 0.5) / params.alpha + params.l2)

    for _ in range(params.passes):
        for x, y in zip(rows, labels, strict=True):
            w = {int(i): weight(int(i)) for i in x}
            g = (min(10.0, 0.5 / share) if y else min(1.0, 0.5 / (1 - share))) * (1 / (1 + np.exp(-(sum(w.values()) + bias))) - y)
            for i in w:
                grown = n.get(i, 0.0) + g * g
                z[i] = z.get(i, 0.0) + g - (grown**0.5 - n.get(i, 0.0) ** 0.5) / params.alpha * w[i]
                n[i] = grown
            bias_n += g * g
            bias -= params.alpha / (params.beta + bias_n**0.5) * g
    want = {i: weight(i) for i in z if weight(i)}
    assert 5 < len(want) < len(z)
    assert model.place.tolist() == sorted(want) and np.allclose(model.weight, [want[i] for i in sorted(want)], atol=1e-6) and np.isclose(model.bias, bias)


def test_a_doc_id_of_many_rows_stays_within_the_bound(spark):
    docs = spark.createDataFrame([(k % 4, f"text {k}") for k in range(400)], "doc_id long, text string")
    known = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, toxic int")
    taught = toxicity.teachers(docs, known, "toxic", toxicity.Params(max_toxic=7, max_clean=5))
    assert taught.where("toxic > 0").count() <= 7 and taught.where("toxic <= 0").count() <= 5
