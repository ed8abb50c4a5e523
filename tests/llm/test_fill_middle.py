from __future__ import annotations

import hashlib
import random
import re
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import _bytes, fill_middle, queries, sql

SCHEMA = "doc_id long, text string, n int, form string, output string, hashes string"
FORMS = fill_middle.FORMS


def units(text, unit):
    if unit == "chars":
        return list(text)
    if unit == "lines":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    return re.findall(r"^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)


def brute(doc_id, text, params=fill_middle.PARAMS):
    """form, prefix, middle, output, by one text at a time."""
    text = text or ""
    h = hashlib.sha256(f"{params.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    own = units(text, params.unit)
    assert "".join(own) == text
    n = len(own)
    if not text or any(m in text for m in params.sentinels) or h3 % 100 >= 100 - params.plain_percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(own[:a]), "".join(own[a:b]), "".join(own[b:])
    p, s, m = params.sentinels
    if h4 % 100 < params.spm_percent:
        return n, "spm", a, b - a, s + suffix + p + prefix + m + middle
    return n, "psm", a, b - a, p + prefix + s + suffix + m + middle


def texts(seed, n=300):
    r = random.Random(seed)
    alphabet = [" ", "\n", "\t", "a", "Z", "é", "中", "🙂", "é", "<", "P>", "<P", ">", "<S>", "word", " ", "\r\n", "\x0b", "\x00"]
    return ["", None, "<P>", "x", "\n", " \t", "🙂" * 40, *("".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)), "long text " * 300_000, "é" * 900_000]


@pytest.mark.parametrize("unit", fill_middle.UNITS)
def test_against_one_text_at_a_time(spark, unit):
    params = fill_middle.Params(unit=unit, seed=7)
    rows = [(k - 3, t, 1, "x", "y", "z") for k, t in enumerate(texts(3))] + [(None, "no number here", 1, None, None, None), (5, "said twice", 1, "", "", ""), (5, "said twice", 1, "", "", "")]
    made = fill_middle.transformed(spark.createDataFrame(rows, SCHEMA).repartition(3), params)
    made = made.withColumn("restored", fill_middle.restored(made.output, made.form, params))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output, r.restored) for r in made.collect()), key=str)
    want = sorted(((d, *brute(d, t, params), t or "") for d, t, *_ in rows), key=str)
    assert got == want
    assert {r[2] for r in got} == set(FORMS)


def test_slices_change_nothing():
    own = [t or "" for t in texts(8)[:-2]]
    r = np.random.default_rng(2)
    hashes = r.integers(0, 1 << 32, (len(own), 4))
    column = pa.array(own)
    whole = [fill_middle.arranged(data, at, hashes[a:b]) for a, b, data, at in _bytes.slices(column)]
    cut = [fill_middle.arranged(data, at, hashes[a:b]) for a, b, data, at in _bytes.slices(column, 50)]
    assert len(whole) == 1 and len(cut) > 100
    assert np.concatenate([c["output"] for c in cut]).tobytes() == whole[0]["output"].tobytes()
    assert sum(len(c["n"]) for c in cut) == len(own)


def test_decomposed_characters_are_units_of_their_own():
    text = unicodedata.normalize("NFD", "é")
    data, at = _bytes.text_buffers(pa.array([text]))
    assert fill_middle.unit_sums(data, at, "chars")[-1] == 2


@pytest.mark.parametrize("marks", [("", "b", "c"), ("<a>", "<a>", "c"), ("aba", "c", "d"), ("ab", "bc", "d"), ("xaby", "ab", "c")])
def test_sentinels_that_cannot_be_told_apart(marks):
    with pytest.raises(ValueError):
        fill_middle.Params(prefix=marks[0], suffix=marks[1], middle=marks[2])


def test_empty_table(spark):
    assert fill_middle.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_sql_and_brute_force(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(map(tuple, queries.op12_fill_middle(spark, d).collect()))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert got == sorted(duck.execute(sql.fill_middle_digests()).fetchall())
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted((d, *brute(d, t)[:4], sha(brute(d, t)[4]), sha(t or "")) for d, t in rows)
