from __future__ import annotations

import brute
import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import _bytes


def slow(values):
    out = 0
    for k, v in enumerate(values):
        out = (out + v * pow(_bytes._PLACE, k, _bytes.PRIME)) % _bytes.PRIME
    return _bytes.mix(np.array([out], np.uint64))[0]


@pytest.mark.parametrize(("start", "end"), [(0, 3), (5, 5), (40_000, 40_700), (32_760, 32_775), (69_000, 70_000), (0, 70_000)])
def test_hashes_against_whole_numbers(start, end):
    r = np.random.default_rng(start)
    data = r.integers(0, 256, 70_000).astype(np.uint8)
    at = np.array([start]), np.array([end])
    assert _bytes.span_hash(_bytes.prefix_hash(data), *at)[0] == slow([x + 1 for x in data[start:end].tolist()])
    values = r.integers(0, 1 << 63, 70_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert _bytes.span_hash(_bytes.prefix_of_values(values), *at)[0] == slow(values[start:end].tolist())


def test_products_at_the_edges():
    p = _bytes.PRIME
    edge = np.array([0, 1, p - 1, p, p + 7, (1 << 31) - 1, 1 << 31, 1 << 60], np.uint64)
    for a in edge.tolist():
        got = _bytes.times(np.full(len(edge), a, np.uint64), edge)
        assert got.tolist() == [a * b % p for b in edge.tolist()]


def test_equal_strings_have_equal_hashes_and_made_ones_differ():
    a, b = brute.colliding_words()
    h, first = _bytes.words(*_bytes.text_buffers(pa.array([f"{a} {b} {a}", f"zz {b}", f"{a}a {a}"])))
    assert first.tolist() == [0, 3, 5, 7]
    assert h[0] == h[2] == h[6] and h[1] == h[4] and len({*h.tolist()}) == 4
    g = _bytes.gram_hash(np.frombuffer(b"abcdefg-abcdefg", np.uint8), 7)
    assert len(g) == 9 and g[0] == g[8] and len({*g.tolist()}) == 8
    assert len(_bytes.gram_hash(np.zeros(3, np.uint8), 7)) == 0
