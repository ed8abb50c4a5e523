"""Statistics of whole texts as rows of numbers, for all texts of a slice at once.

Bytes are counted by class and by text with one ``bincount``; words and lines are known by hashes, so repeats are found by
sorting. Every number is defined for an empty text (0) and is finite. None depends on the language of the text by a word list.
"""

from __future__ import annotations

import numpy as np

from lodestone.llm import _bytes

_GROUPS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" ",
    "break": b"\n",
    "other_space": b"\t\r\x0b\x0c",
    "stop": b".",
    "comma": b",;:",
    "shout": b"!?",
    "symbol": b"#*$%&|<>",
    "bracket": b"()[]{}\"'",
    "path": b"/\\_-=+@",
}
_CLASSES = [*_GROUPS, "inner", "lead", "other"]
_CLASS = np.full(256, _CLASSES.index("other"), np.int64)
for _name, _members in _GROUPS.items():
    _CLASS[list(_members)] = _CLASSES.index(_name)
_CLASS[0x80:0xC0] = _CLASSES.index("inner")
_CLASS[0xC0:] = _CLASSES.index("lead")

NAMES = (
    *(f"{c}_share" for c in _CLASSES if c != "inner"),
    "log_chars", "log_words", "log_lines", "word_mean", "word_deviation", "log_longest_word", "short_words", "long_words",
    "capital_words", "upper_words", "words_with_digits", "words_without_letters", "words_ending_marked", "distinct_words",
    "top_word", "words_like_last", "repeated_pairs", "words_in_repeated_triples", "line_mean", "repeated_lines", "lines_ending_marked",
    "lines_without_letters", "class_entropy", "longest_run",
)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _counted(row: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: distinct keys, the most frequent one's count, and how many entries have a key that occurs twice or more."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    if not len(r):
        zero = np.zeros(n, np.int64)
        return zero, zero, zero
    begin = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])))
    size = np.diff(np.append(begin, len(r)))
    of = r[begin]
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, size)
    return np.bincount(of, minlength=n), most, np.bincount(of[size > 1], size[size > 1], n).astype(np.int64)


def _sums(marks: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many marks lie in each data[start:end]."""
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return total[end] - total[start]


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text."""
    n = len(at) - 1
    row_of = np.repeat(np.arange(n), np.diff(at))
    kind = _CLASS[data]
    counts = np.bincount(row_of * len(_CLASSES) + kind, minlength=n * len(_CLASSES)).reshape(n, -1)
    inner = _CLASSES.index("inner")
    chars = counts.sum(axis=1) - counts[:, inner]
    shares = np.delete(counts, inner, axis=1) / np.maximum(chars, 1)[:, None]

    start, end, first = _bytes.word_spans(data, at)
    row = np.repeat(np.arange(n), np.diff(first))
    words = np.diff(first)
    letter = (kind == _CLASSES.index("lower")) | (kind == _CLASSES.index("upper")) | (kind == _CLASSES.index("lead"))
    size = _sums(kind != inner, start, end)
    letters = _sums(letter, start, end)
    uppers = _sums(kind == _CLASSES.index("upper"), start, end)
    digits = _sums(kind == _CLASSES.index("digit"), start, end)
    marked = np.isin(kind, [_CLASSES.index(c) for c in ("symbol", "shout")])

    def share(test: np.ndarray) -> np.ndarray:
        return _ratio(np.bincount(row[test], minlength=n), words)

    mean = _ratio(np.bincount(row, size, n), words)
    spread = np.sqrt(np.maximum(0, _ratio(np.bincount(row, size.astype(np.float64) ** 2, n), words) - mean**2))
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, size)
    final = end - 1
    h = _bytes.span_hash(_bytes.prefix_hash(data, _bytes.FOLDED), start, end)
    distinct, most, _ = _counted(row, h, n)
    like_last = np.zeros(len(h), bool)
    like_last[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    pair = _bytes.mix(h[:-1] * np.uint64(3) + h[1:])[row[1:] == row[:-1]] if len(h) else h
    pair_row = row[1:][row[1:] == row[:-1]] if len(h) else row
    _, _, again = _counted(pair_row, pair, n)
    covered = _repeated_triples(h, row)

    line_start, line_end, line_row = _lines(data, at)
    lines = np.bincount(line_row, minlength=n)
    line_size = line_end - line_start
    line_hash = _bytes.span_hash(_bytes.prefix_hash(data), line_start, line_end)
    solid = _sums(letter, line_start, line_end)
    full = line_size > 0
    distinct_lines, _, _ = _counted(line_row[full], line_hash[full], n)
    whole_lines = np.bincount(line_row[full], minlength=n)
    ends = np.zeros(len(line_row), bool)
    ends[full] = np.isin(data[line_end[full] - 1], np.frombuffer(b".!?:;\"'", np.uint8))

    p = shares.clip(0, 1)
    entropy = -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(axis=1)
    return np.column_stack([
        shares, np.log1p(chars), np.log1p(words), np.log1p(lines), mean, spread, np.log1p(longest),
        share(size <= 3), share(size > 14), share(_capital(data, start, kind)), share((uppers > 1) & (uppers == letters)), share(digits > 0), share(letters == 0), share(marked[final]),
        _ratio(distinct, words), _ratio(most, words), share(like_last), _ratio(again, np.maximum(words - 1, 0)), share(covered), np.log1p(_ratio(chars, lines)),
        _ratio(whole_lines - distinct_lines, whole_lines), _ratio(np.bincount(line_row[ends], minlength=n), lines), _ratio(np.bincount(line_row[full & (solid == 0)], minlength=n), lines),
        entropy, np.log1p(_longest_run(data, at, row_of)),
    ])


def _capital(data: np.ndarray, start: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return kind[start] == _CLASSES.index("upper")


def _repeated_triples(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether each word lies in three words that stand twice or more in its text."""
    covered = np.zeros(len(h), bool)
    if len(h) < 3:
        return covered
    here = np.flatnonzero(row[2:] == row[:-2])
    key = _bytes.mix(_bytes.mix(h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:])[here]
    order = np.lexsort((key, row[here]))
    k, r = key[order], row[here][order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    found = here[order[twice]]
    for step in range(3):
        covered[found + step] = True
    return covered


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of all lines; an empty text has none."""
    full = np.flatnonzero(at[:-1] < at[1:])
    breaks = np.flatnonzero(data == 10)
    row = np.concatenate([full, np.searchsorted(at, breaks, "right") - 1])
    start, end = np.concatenate([at[:-1][full], breaks + 1]), np.concatenate([at[1:][full], breaks])
    # both in the order of texts, then of places: the k-th line starts and ends there
    by_start = np.lexsort((start, row))
    return start[by_start], end[np.lexsort((end, row))], row[by_start]


def _longest_run(data: np.ndarray, at: np.ndarray, row_of: np.ndarray) -> np.ndarray:
    """The longest run of one byte in each text."""
    out = np.zeros(len(at) - 1, np.int64)
    if len(data):
        begin = np.flatnonzero(np.append(True, (data[1:] != data[:-1]) | (row_of[1:] != row_of[:-1])))
        np.maximum.at(out, row_of[begin], np.diff(np.append(begin, len(data))))
    return out
