from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestone.shared import new_path
from lodestone.sources import files, lines, versions

ROWS = "doc int, part int, text string"


@pytest.fixture
def folder(spark):
    return new_path(spark, "test-versions")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_documents_are_replaced_as_a_whole(spark, folder):
    assert versions.current(spark, folder) is None
    first = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], ROWS)
    versions.replaced_documents(spark, folder, first, "doc")
    again = spark.createDataFrame([(1, 1, "new"), (3, 1, "d")], ROWS)
    want = [(1, 1, "new"), (2, 1, "c"), (3, 1, "d")]
    for _ in range(2):
        assert rows_of(versions.replaced_documents(spark, folder, again, "doc")) == want
    assert rows_of(versions.current(spark, folder)) == want
    assert [n for n, _ in versions.pointers(spark, folder)] == [1, 2, 3]
    assert versions.cleaned(spark, folder) == 2
    assert rows_of(versions.current(spark, folder)) == want and [n for n, _ in versions.pointers(spark, folder)] == [3]


def test_a_run_that_dies_before_its_pointer_leaves_the_old_version(spark, folder, monkeypatch):
    old = spark.createDataFrame([(1, 1, "old")], ROWS)
    versions.replaced_documents(spark, folder, old, "doc")
    new = spark.createDataFrame([(1, 1, "new")], ROWS)

    def dies(*_):
        raise OSError("gone")

    own = versions._point
    monkeypatch.setattr(versions, "_point", dies)
    with pytest.raises(OSError):
        versions.replaced_documents(spark, folder, new, "doc")
    assert rows_of(versions.current(spark, folder)) == [(1, 1, "old")]
    monkeypatch.setattr(versions, "_point", own)
    assert rows_of(versions.replaced_documents(spark, folder, new, "doc")) == [(1, 1, "new")]
    assert versions.cleaned(spark, folder) == 2  # what the dead run wrote goes too


def test_a_write_that_dies_leaves_the_old_version(spark, folder):
    versions.replaced_documents(spark, folder, spark.createDataFrame([(1, 1, "old")], ROWS), "doc")
    broken = spark.createDataFrame([(1, 1, "x")], ROWS).withColumn("text", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        versions.replaced_documents(spark, folder, broken, "doc")
    assert rows_of(versions.current(spark, folder)) == [(1, 1, "old")]


def test_of_two_runs_from_one_state_one_fails(spark, folder):
    versions.replaced_documents(spark, folder, spark.createDataFrame([(1, 1, "old")], ROWS), "doc")

    def other_first(old):
        versions.replaced_documents(spark, folder, spark.createDataFrame([(2, 1, "other")], ROWS), "doc")
        return old.withColumn("text", F.lit("late"))

    with pytest.raises(versions.Conflict):
        versions.published(spark, folder, other_first)
    assert rows_of(versions.current(spark, folder)) == [(1, 1, "old"), (2, 1, "other")]


def test_failures_have_a_table_of_their_own(spark, folder):
    rows = spark.createDataFrame([(1, None), (2, "x" * 3000), (3, "bad")], "k int, error string")
    for _ in range(2):
        fine = versions.noted_failures(rows, folder, "b1", F.col("k"), F.col("error"), "parse")
        assert [r.k for r in fine.collect()] == [1]
    versions.noted_failures(rows.where("k = 3"), folder, "b2", F.col("k"), F.col("error"), "chunk")
    got = sorted((r.batch, r.step, r.key, len(r.error)) for r in versions.failures(spark, folder).collect())
    assert got == [("b1", "parse", "2", 2000), ("b1", "parse", "3", 3), ("b2", "chunk", "3", 3)]


def filing(k, **more):
    return json.dumps({"doc_id": f"major_{k:014d}", "doc_group": "major", "rcept_no": f"{k:014d}", "rcept_dt": "20240102", "file_path": "a/b.xml", "n_files": 1} | more)


@pytest.mark.parametrize("split", [60, 1000, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_numbers_are_the_same_whatever_the_splits(spark, tmp_path, split, end):
    made = {}
    for name, n in (("a.jsonl", 90), ("b.jsonl", 0), ("c.jsonl", 40)):
        own = ["" if k % 17 == 3 else "{broken" if k % 19 == 5 else filing(k, file_path="가" * (k % 50)) for k in range(n)]
        made[name] = own
        (tmp_path / name).write_bytes(("﻿" + end.join(own) + (end if n % 20 else "")).encode())
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 10)
        got = sorted((r.file.rsplit("/", 1)[1], r.line_no, r.line) for r in lines.numbered(spark, str(tmp_path)).collect())
        across = sorted((r.line_no, r.line) for r in lines.numbered(spark, str(tmp_path), across=True).collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    want = [(name, k, line) for name in ("a.jsonl", "b.jsonl", "c.jsonl") for k, line in enumerate(made[name], 1)]
    assert got == want
    assert across == [(k, line) for k, (_, _, line) in enumerate(want, 1)]


def test_problems_and_repeats_are_named_by_line(spark, tmp_path):
    own = [filing(1), "  \t", filing(2, rcept_no="x"), "{no json", filing(1), "[]", filing(3), filing(1, doc_id="other")]
    (tmp_path / "m.jsonl").write_text("\n".join(own), encoding="utf-8")
    rows = lines.manifest(spark, str(tmp_path))
    assert {r.line_no: r.problem for r in rows.collect()} == {1: None, 2: "BLANK", 3: "doc_id", 4: "MALFORMED", 5: None, 6: "MALFORMED", 7: None, 8: "doc_id"}
    got = {tuple(r) for r in lines.repeated(rows, "doc_id", "rcept_no").collect()}
    one = f"{1:014d}"
    assert got == {("doc_id", f"major_{one}", 1, 5), ("rcept_no", one, 1, 5), ("rcept_no", one, 1, 8)}
    assert rows.select(*[c.split()[0] for c in files.MANIFEST_SCHEMA.split(", ")]).where("line_no = 1").count() == 1
