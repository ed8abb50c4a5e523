from __future__ import annotations

import random
import re

import brute
import numpy as np

from lodestone.llm import decontamination, queries

DOCS = "doc_id long, text string, item_id int"
ITEMS = "item_id int, text string, doc_id string"
QUESTION = "A train from Paris covers 300 km in 4 hours. How far will the same train from Paris go in 10 hours at that steady speed?"
OTHER = "The baker sold twelve loaves of dark bread on every morning of that long and windy week by the sea."


def flags(spark, docs, items, **kw):
    d = spark.createDataFrame([(k, t, 9) for k, t in enumerate(docs)], DOCS)
    b = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)], ITEMS)
    rows = decontamination.judged(d, b, **kw).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(docs)))
    return {r.doc_id for r in rows if r.contaminated}


def test_copies_and_other_numbers_are_caught(spark):
    changed = QUESTION.replace("Paris", "Rome").replace("300", "450").replace("10 hours", "7 hours")
    crossed = QUESTION.replace("Paris", "Rome", 1).replace("300 km", "450 km")  # one name stands for two
    docs = ["some words before " + QUESTION + " and after", "x " + changed, "", None, "Nothing of the kind stands here, or so we hope.", OTHER.upper(), "word " * 5000]
    assert flags(spark, docs, [QUESTION, OTHER, None, "", OTHER]) >= {0, 1}
    assert not flags(spark, docs, [QUESTION, OTHER]) & {2, 3, 4, 6}
    params = decontamination.Params(share=0.99, run=99)
    assert flags(spark, [changed, crossed], [QUESTION], params=params) == {0}


def test_one_altered_place_does_not_hide_the_rest(spark):
    crossed = QUESTION.replace("Paris", "Rome", 1).replace("300 km", "450 km")
    equal = QUESTION.replace("300 km", "7 km").replace("10 hours", "7 hours")  # two numbers came out equal
    mixed = "A train from Rome covers 450 km in 9 hours."  # not a window with more than a chance meeting
    assert flags(spark, [crossed, equal, mixed], [QUESTION]) == {0, 1}
    assert decontamination.consistent(np.array([5, 0, 5, 0, 0, 6]), np.array([7, 0, 8, 0, 0, 9])) == (1, 6)
    assert decontamination.consistent(np.array([5, 0, 0, 6, 0]), np.array([7, 0, 0, 7, 0])) == (1, 5)


def test_exact_copies_in_other_case_without_punctuation_or_dense_in_numbers(spark):
    names = "Later Ann Lee met Bob Ray in Rome. Kim Day saw Lou Fox there: Tom Orr went with Jim Poe to Bonn, and Sue May came by."
    numbers = "12 + 7 = 19, 30 - 4 = 26, 8 * 9 = 72, 45 / 5 = 9, 61 + 20 = 81, 3 * 33 = 99"
    items = [QUESTION, names, numbers]
    docs = [f"here {c(t)} there" for t in items for c in (str.upper, str.lower, str.title, lambda t: re.sub("[.,:?]", "", t), str)]
    others = ["here 12 + 8 = 20, 31 - 4 = 27, 8 * 7 = 56, 45 / 9 = 5, 60 + 20 = 80", "LATER ANN MET NOBODY IN ROME AND WENT AWAY"]
    assert flags(spark, docs + others, items) == set(range(len(docs)))
    d = spark.createDataFrame([(1, QUESTION)], "doc_id long, text string")
    b = spark.createDataFrame([(1, QUESTION)], "item_id int, text string")
    assert decontamination.judged(d, b).first().item_share == 1.0


def test_placeholders_alone_match_nothing(spark):
    assert not flags(spark, ["12 34 56 78 90 12 34 56 78 " * 20, "x John Smith Ann Lee Bob Ray " * 9], ["1 2 3 4 5 6 7 8 9 10", "so Kim Day 5 km Lou Fox 6 km"])


def test_words_made_to_collide(spark):
    a, b = brute.colliding_words()
    assert flags(spark, [f"so {a} and {b} {a} or {a} {b} but {b} {b} too", f"so {b} and {a} {b} or {b} {a} but {a} {a} too"], [f"{a} and {b} {a} or {a} {b} but {b} {b}"]) == {0}
    # whole items of 1,024 words, that are one class only if their templates are equal
    long, other = (" ".join({"a": "one", "b": "two"}[c] for c in x) for x in (a, b))
    items = spark.createDataFrame([(1, long), (2, other)], "item_id int, text string")
    assert decontamination.item_windows(items).select("klass").distinct().count() == 2


def test_short_items_and_blocks(spark):
    docs = ["well the quick brown fox jumps here", "a quick brown", OTHER, QUESTION]
    assert flags(spark, docs, ["the quick brown fox jumps", "a quick brown", OTHER, QUESTION], block=10) == {0, 2, 3}


def test_empty_tables_and_clashing_columns(spark):
    assert flags(spark, [], [QUESTION]) == set()
    assert flags(spark, [QUESTION], []) == set()
    d = spark.createDataFrame([(1, QUESTION, 5, True)], "doc_id long, text string, n_items int, contaminated boolean")
    b = spark.createDataFrame([(1, QUESTION)], "item_id int, text string")
    (got,) = decontamination.judged(d, b).collect()
    assert got.contaminated and got.n_items == 1 and got.doc_id == 1
    assert decontamination.kept(d, b).columns == d.columns
    assert decontamination.kept(d, b).count() == 0


def test_query_on_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    rows = queries.op9_decontamination(spark, d).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert {r.doc_id for r in rows if r.contaminated} == {k for k, t in docs.items() if brute.has_run(t, items)}


def test_against_all_diagonals(spark):
    r = random.Random(8)
    words = [*"the baker sold some bread to that old man and his dog".split(), "Ann", "Rome", "Bob", "12", "7", "40", "km", "hours", "-", "(Rome)", "man.", "dog?", "é"]
    items = [" ".join(r.choice(words) for _ in range(r.randint(3, 30))) for _ in range(12)]
    docs: list[str | None] = [None, ""]
    for _ in range(60):
        w = [r.choice(words) for _ in range(r.randint(0, 10))]
        for _ in range(r.randint(1, 2)):
            own = r.choice(items).split()
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = r.choice(words)
            w += [*own, r.choice(words)]
        docs.append(" ".join(w))
    d = spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(1, t) for t in items], "item_id int, text string")
    got = {x.doc_id: (x.longest_run, round(x.item_share, 9)) for x in decontamination.judged(d, b).collect()}
    want = {k: brute.decontaminate(t, items, set(decontamination.UNITS)) for k, t in enumerate(docs)}
    assert got == {k: (run, round(share, 9)) for k, (run, share) in want.items()}
    assert sum(run >= 13 for run, _ in got.values()) > 5


def test_many_items_of_one_template_are_one_class(spark):
    names = [a + b for a in "BCDFGHJKLM" for b in ("ann", "ella", "ono", "ara", "ix")]
    items = [f"A train from {names[k % 50]} covers {k} km in {k % 7 + 2} hours. How far will the same train from {names[k % 50]} go in {k + 9} hours?" for k in range(10_000)]
    docs = [items[5000], "so " + items[3].replace("covers 3 km", "covers 7777 km"), "A train from Bann covers 1 km in 3 hours. How far will the same train from Cann go in 10 hours?"] * 40
    d = spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id int, text string")
    table = decontamination.item_windows(b)
    assert table.select("klass").distinct().count() <= 3  # some have equal numbers
    assert table.where("kind = 0").count() <= 3 * 40
    rows = decontamination.judged(d, b).collect()
    assert all(x.n_items <= 3 for x in rows) and [x.contaminated for x in rows if x.doc_id % 3 < 2] == [True] * 80


def test_rows_without_id_repeated_rows_and_long_texts(spark):
    long = "word " * 400_000 + QUESTION
    rows = [(None, QUESTION), (None, QUESTION), (3, QUESTION), (3, "none of it"), (4, None), (5, long), (6, "go " * 20_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(None, QUESTION), (None, QUESTION), (1, None), (1, "go " * 40)], "item_id int, text string")
    got = sorted(((x.doc_id, x.contaminated) for x in decontamination.judged(d, b).collect()), key=str)
    assert got == sorted([(None, True), (None, True), (3, True), (3, False), (4, False), (5, True), (6, True)], key=str)
    assert sorted(x.doc_id for x in decontamination.kept(d, b).collect()) == [3, 4]


def test_one_plan_whatever_the_size_of_the_benchmark(spark):
    d = spark.createDataFrame([(1, OTHER)], "doc_id long, text string")
    plans = []
    for n in (1, 60):
        b = spark.createDataFrame([(k, OTHER + f" w{k} and more") for k in range(n)], "item_id int, text string")
        out = decontamination.judged(d, b, block=100)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
    assert plans == [0, 0]  # verdicts are a written table
