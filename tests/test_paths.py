from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from lodestone.sources import paths

ONE, THREE = "한글", unicodedata.normalize("NFD", "한글")


def frame(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, path string").repartition(2)


def test_unsafe_paths(spark):
    given = {"a/b.xml": None, " a ": None, "": "BLANK", None: "BLANK", "/a": "ABSOLUTE", "C:x": "ABSOLUTE", "\\a": "ABSOLUTE", "a\\b": "SEPARATOR", "a\0b": "SEPARATOR", "a//b": "SEGMENT", "a/../b": "SEGMENT", "./a": "SEGMENT", "a/": "SEGMENT", "a/ /b": "SEGMENT", "..a/b..": None}
    rows = frame(spark, list(given)).select("path", paths.path_problem(F.col("path")).alias("p")).collect()
    assert {r.path: r.p for r in rows} == given


def test_folders_that_are_one_when_composed(spark):
    files = frame(spark, [f"a/{ONE}/x", f"a/{THREE}/y", f"b/{ONE}/x", f"c/{THREE}/d/x", f"a/{ONE}/z", "../a/x", f"e/{ONE}", f"e/{THREE}"])
    got = [(r.parent, r.same, r.folders) for r in paths.collisions(files).collect()]
    assert got == [("a", ONE, sorted([f"a/{ONE}", f"a/{THREE}"]))]  # files of one name are no folders


def test_paths_of_a_manifest(spark):
    files = frame(spark, [f"a/{THREE}/x", f"b/{ONE}/x", f"b/{THREE}/x", "c/d/e/x", "top"])
    asked = frame(spark, [f"a/{ONE}", f"a/{THREE}", "a", f"b/{ONE}", "c/d/no/e", "c/d", "../c", None, "c/d"])
    rows = {r.k: (r.folder, r.problem, r.missing) for r in paths.resolved(asked, files).collect()}
    assert rows == {
        0: (f"a/{THREE}", None, None), 1: (f"a/{THREE}", None, None), 2: ("a", None, None), 3: (None, "AMBIGUOUS", None), 4: (None, "MISSING", "no"),
        5: ("c/d", None, None), 6: (None, "SEGMENT", None), 7: (None, "BLANK", None), 8: ("c/d", None, None),
    }
    assert paths.resolved(asked, files.where("false")).where("problem is null").count() == 0
    assert paths.collisions(files.where("false")).count() == 0
