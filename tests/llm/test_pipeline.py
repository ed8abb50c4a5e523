from __future__ import annotations

from collections import Counter

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import _store, mixing, quality
from lodestone.tables import table

D = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark):
    docs = table(spark, D, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-duplicates", "benchmark passages", "mixing", "token ids"]
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(_store.staged(stage(spark, frames[-1], D), "test-stage"))
    assert all(f.columns == docs.columns for f in frames[1:-1])
    rows = [{r.doc_id: r for r in f.collect()} for f in frames[:4]]

    verdicts = {r.doc_id: r.kept for r in quality.judged(docs.select("doc_id", "text", "lang")).collect()}
    assert set(rows[1]) == {d for d, ok in verdicts.items() if ok}
    groups = brute.near_dup([(d, r.text) for d, r in rows[1].items()], size=5)
    assert set(rows[2]) == {d for d, (_, c) in groups.items() if c == d}
    items = [r.text for r in table(spark, D, "benchmark").collect()]
    assert set(rows[3]) == {d for d, r in rows[2].items() if not brute.has_run(r.text, items)}
    assert all(a[d] == r for a, b in zip(rows, rows[1:], strict=False) for d, r in b.items())

    sizes, taken = Counter(), Counter()
    for r in rows[3].values():
        sizes[r.source] += len(brute.WORD.findall(r.text))
    for r in frames[4].collect():
        taken[r.source] += len(brute.WORD.findall(r.text))
        assert r.doc_id in rows[3]
    want = brute.targets(sizes)
    assert all(abs(taken[s] - t) <= 2 * mixing.PARAMS.block for s, t in want.items())

    assert frames[5].count() == frames[4].count()
    last = frames[5].agg(F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens")).first()
    assert last[0] == last[1]


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, D)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def folder(spark, tmp_path, rows, schema, items):
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_empty_tables(spark, tmp_path):
    d = folder(spark, tmp_path, [], table(spark, D, "documents").schema, [])
    assert corpus_pipeline.run(spark, d).count() == 0


def test_nulls_repeated_rows_long_texts_and_clashing_columns(spark, tmp_path):
    docs = [r for r in table(spark, D, "documents").where("lang = 'en'").orderBy("doc_id").limit(40).collect() if len(brute.WORD.findall(r.text)) > 60]
    extra = {"n_items": "int", "size": "int", "row_id": "string", "_doc": "string", "_gone": "long", "kept": "string", "target": "double", "ids": "string"}
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{k}` {t}" for k, t in extra.items())
    tail = (1, 2, "r", "d", 3, "k", 0.5, "i")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, *tail) for r in docs]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None, None, *tail), (None, None, None, None, None, *[None] * 8), (9_000_001, "", "en", "web", 0, *tail)]
    rows += [(9_000_002, " ".join(x[1] for x in rows[2:9]) * 3, "xx", None, None, *tail), (9_000_003, None, "en", "web", None, *tail)]
    d = folder(spark, tmp_path, rows, schema, [(1, docs[2].text), (None, None), (None, "")])
    frames = [table(spark, d, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(_store.staged(stage(spark, frames[-1], d), "test-edges"))
    assert all(f.columns == frames[0].columns for f in frames[1:-1])
    ids = [Counter(r.doc_id for r in f.collect()) for f in frames[:-1]]
    assert not {9_000_001, 9_000_003} & set(ids[1]) and ids[1][docs[0].doc_id] == 3
    assert all(n == 1 for k, n in ids[2].items() if k is not None) and ids[2][None] == 1
    assert docs[2].doc_id not in ids[3] and set(ids[3]) == set(ids[2]) - {docs[2].doc_id, 9_000_002}
    assert set(ids[4]) <= set(ids[3]) and frames[5].count() == frames[4].count()
