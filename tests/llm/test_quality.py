from __future__ import annotations

import random
import re

import brute
import pytest

from lodestone.llm import quality

SCHEMA = "doc_id long, text string, lang string, n_words int, classes string"


def base(text):
    text = text or ""
    w = brute.WORD.findall(text)
    lines = [x for x in text.split("\n") if brute.WORD.search(x)]
    where = {}
    for k in range(len(w) - 2):
        where.setdefault(tuple(w[k : k + 3]), []).append(k)
    covered = {k + j for at in where.values() if len(at) > 1 for k in at for j in range(3)}
    n = len(w)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def texts():
    r = random.Random(4)
    common = ["the", "of", "and", "to", "in", "is"]
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(400)]
    clean = [" ".join(r.choice(common) if r.random() < 0.35 else r.choice(words) for _ in range(r.randint(120, 300))) + "." for _ in range(60)]
    junk = [" ".join(r.choice(words).upper() + "!!" for _ in range(150)), " ".join(r.choice(words) + "%%% $$$" for _ in range(150)), " ".join(f"{k} 77" for k in range(200))]
    odd = ["", None, " \n\t\x0b\x0c\r ", "a b c " * 40, "é🙂 ß x " * 60, "line\nline\n \nline\r\nline", "x y z", "one two three one two three", "w " * 40_000, "\n".join(["same line of text"] * 30)]
    return clean, junk, odd


def test_measures_and_verdicts(spark):
    clean, junk, odd = texts()
    every = [*clean, *junk, *odd, clean[0]]
    df = spark.createDataFrame([(k, t, "en" if k % 7 else None) for k, t in enumerate(every)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    assert len(got) == len(every)
    for k, t in enumerate(every):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), repr(t)[:80]
        assert not (r.kept and r.base_failed)
    assert all(got[k].kept for k in range(len(clean)))
    assert not any(got[len(clean) + k].kept for k in range(len(junk)))


@pytest.mark.parametrize("lang", [None, "xx"])
def test_without_references_the_base_rules_decide(spark, lang):
    _, junk, odd = texts()
    df = spark.createDataFrame([(k, t, lang) for k, t in enumerate([*junk, *odd])], "doc_id long, text string, lang string")
    assert all(r.kept == (not r.base_failed) for r in quality.judged(df).collect())


def test_kept_has_the_columns_of_documents(spark):
    clean, junk, odd = texts()
    df = spark.createDataFrame([(None, t, "en", 3, "clash") for t in [*clean, *clean[:2], *junk, *odd]], SCHEMA)
    out = quality.kept(df)
    assert out.schema == df.schema
    assert out.where("n_words <> 3 or classes <> 'clash'").count() == 0
    assert out.count() >= len(clean) + 2
    assert quality.kept(spark.createDataFrame([], SCHEMA)).count() == 0
    assert quality.judged(df).where("n_words = 3").count() == 1  # the operator's column, of the text "x y z"


def test_other_languages_are_judged_by_characters_alone(spark):
    clean, junk, _ = texts()
    strange = " ".join(f"zq{k % 97}xj vvow{k % 89} oolm{k % 83}y" for k in range(100)).translate(str.maketrans("0123456789", "abcdefghij")) + "."
    rows = [(k, t, "en") for k, t in enumerate(clean)] + [(100, strange, "en"), (101, strange, "fi"), (102, junk[0], "fi")]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (got[100], got[101], got[102]) == (False, True, False)


def test_distance_is_zero_for_the_reference(spark):
    df = spark.createDataFrame([([0.25, 0.75, 0.0],), ([0.0, 0.0, 1.0],)], "p array<double>")
    got = [r.d for r in df.select(quality._distance("p", [0.25, 0.75, 0.0]).alias("d")).collect()]
    assert got[0] == pytest.approx(0) and got[1] == pytest.approx(1)
