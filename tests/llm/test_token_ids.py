from __future__ import annotations

import random
import zlib

import brute as brute_words
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import _bytes, queries, token_ids

SCHEMA = "doc_id long, text string, n_tokens int"


def brute(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    made = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, *_ in rows]
    made.sort(key=lambda x: (x[0] is None, x[0] or 0, np.array(x[1], "<u2").tobytes()))
    out, start = [], 0
    for d, ids in made:
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def test_pieces_give_the_ids_of_whole_texts():
    r = random.Random(5)
    alphabet = [" ", "  ", "\n", "\t", " ", "　", " ", "\u0085", "a", "B", "é", "1", "'s", "!", ",", ".", "ß", "\x1c", "中", "🙂", "<|endoftext|>", "don't", "|"]
    texts = ["", " ", "it's  'll <|endoftext|> ok", "x" * 5000, *("".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(2000))]
    encoder, tokenizer = token_ids.Encoder(queries.tokenizer_path()), token_ids._tokenizer(queries.tokenizer_path())
    for low, high, data, at in _bytes.slices(pa.array(texts), 3000):
        ids, first = encoder.encode(data, at)
        for k, text in enumerate(texts[low:high]):
            assert ids[first[k] : first[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def same_as_library(texts):
    encoder, tokenizer = token_ids.Encoder(queries.tokenizer_path()), token_ids._tokenizer(queries.tokenizer_path())
    for low, high, data, at in _bytes.slices(pa.array(texts), 3000):
        ids, first = encoder.encode(data, at)
        for k, text in enumerate(texts[low:high]):
            assert ids[first[k] : first[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_made_to_collide():
    a, b = brute_words.colliding_words()
    assert a != b
    same_as_library([f"x {a} y {b}", f"{b} {a}", "", b, a * 3, f"{b} and {a}{b}"])


@pytest.mark.parametrize("different", [1, 3])
def test_pieces_that_share_a_hash_are_told_apart(monkeypatch, different):
    own = _bytes.span_hash
    monkeypatch.setattr(_bytes, "span_hash", lambda *x: own(*x) % np.uint64(different))
    r = random.Random(6)
    same_as_library(["", *(" ".join(r.choice(["one", "two", "owt", "three", "a,", "é", "中"]) for _ in range(r.randint(0, 30))) for _ in range(400))])


def test_only_a_known_split_is_cut(tmp_path):
    import json

    path = queries.tokenizer_path()
    assert token_ids.splits_as_known(path)
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    changes = [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"added_tokens": [made["added_tokens"][0] | {"id": 50257, "content": "two words"}, *made["added_tokens"]]}]
    texts = ["Two  words, TWO words two words", "", " x"]
    for k, change in enumerate(changes):
        other = str(tmp_path / f"{k}.json")
        with open(other, "w", encoding="utf-8") as f:
            json.dump(made | change, f)
        assert not token_ids.splits_as_known(other)
        encoder, tokenizer = token_ids.Encoder(other), token_ids._tokenizer(other)
        for _, _, data, at in _bytes.slices(pa.array(texts)):
            ids, first = encoder.encode(data, at)
            assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_wide_ids(spark, monkeypatch):
    monkeypatch.setattr(token_ids, "id_type", lambda path, end_id: "<u4")
    rows = [(k, f"text number {k} of these") for k in range(20)]
    got = token_ids.write_and_read(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer_path())
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_very_long_text_and_many_rows_of_one_doc_id(spark, monkeypatch):
    monkeypatch.setattr(token_ids, "PART_BYTES", 4000)
    rows = [(5, "a word or two " * 200_000), *((9, f"text {k % 7}") for k in range(900)), (2, "x" * 100_000)]
    got = sorted(map(tuple, token_ids.write_and_read(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), queries.tokenizer_path()).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(d for d, _ in rows)
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in brute(rows))


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 4099])
def test_coding_round_trip(n):
    r = np.random.default_rng(n)
    values = (r.integers(0, 1 << 32, n) >> r.integers(0, 32, n)).astype(np.uint32)
    control, data = token_ids.encode_values(values)
    assert len(control) == -(-n // 4)
    assert (token_ids.decode_values(control, data, n) == values).all()


def test_files_give_back_the_ids(spark, monkeypatch):
    monkeypatch.setattr(token_ids, "BLOCK_IDS", 40)
    rows = [(7, "seven of them", 1), (3, None, 1), (3, "again", 2), (3, "again", 2), (None, "no number", 1), (1, "", 1), (-4, "word " * 300, 1), (20, "a b\n c", None)]
    got = token_ids.write_and_read(spark.createDataFrame(rows, SCHEMA).repartition(3), queries.tokenizer_path())
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_empty_table(spark):
    assert token_ids.write_and_read(spark.createDataFrame([], SCHEMA), queries.tokenizer_path()).count() == 0


def test_query_on_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op10_token_ids(spark, d).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy(F.col("doc_id"))
    assert list(map(tuple, got.collect())) == brute(rows)


def test_columns_with_the_names_of_its_own_and_a_very_long_word(spark):
    schema = "doc_id long, text string, ids string, n string, part int, start long, hash string, row int"
    rows = [(2, "one two", "x", "y", 1, 9, "h", 3), (1, "z" * 400_000, "x", "y", 1, 9, "h", 3), (3, None, None, None, None, None, None, None)]
    got = token_ids.write_and_read(spark.createDataFrame(rows, schema), queries.tokenizer_path())
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))
