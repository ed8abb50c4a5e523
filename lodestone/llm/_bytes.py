"""Texts of Arrow batches as byte arrays, and hashes of their words, without a Python loop over words.

Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r; in UTF-8 no byte of a longer
character is among those, so bytes and code points give the same words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is taken alone.
SLICE = 1 << 20

_U = np.uint64
#: Hashes are polynomials modulo this prime, at one place. (Modulo 2**64 some strings collide whatever the place is, such as
#: Thue-Morse words of 1,024 letters.)
PRIME = (1 << 61) - 1
_P, _LOW30, _LOW31 = _U(PRIME), _U((1 << 30) - 1), _U((1 << 31) - 1)
_PLACE = 0x1E3779B97F4A7C15 % PRIME
_PLACES = (_PLACE, pow(_PLACE, -1, PRIME))

#: Bytes that are summed up at once, so that what is at hand stays in the processor's cache.
_STEP = 1 << 15

_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _codes(fold: bool) -> np.ndarray:
    codes = np.arange(1, 257, dtype=_U)  # no byte is 0, so strings of different lengths differ
    if fold:
        codes[65:91] = codes[97:123]
    return codes


CODES, FOLDED = _codes(False), _codes(True)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, or up to 7 more."""
    return (x & _P) + (x >> _U(61))


def _least(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME; x is below twice that."""
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of what is at most 7 above it."""
    high_a, low_a, high_b, low_b = a >> _U(31), a & _LOW31, b >> _U(31), b & _LOW31
    middle = high_a * low_b + low_a * high_b
    return _least(_reduced(_U(2) * high_a * high_b + (middle >> _U(30)) + ((middle & _LOW30) << _U(31)) + low_a * low_b))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The place's powers, and their inverses, for exponents up to n."""
    if len(_powers[0]) <= n:
        size = 1 << max(16, n.bit_length())
        for k, base in enumerate(_PLACES):
            out = np.ones(size, _U)
            have = len(_powers[k])
            out[:have] = _powers[k]
            while have < size:
                out[have : 2 * have] = times(out[:have], np.full(1, pow(base, have, PRIME), _U))
                have *= 2
            _powers[k] = out
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits; one to one."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def _summed(n: int, parts: Callable[[int, int], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sums of n terms modulo PRIME from the first on, one value more than terms. parts gives terms[low:high] as
    high * 2**31 + low, both below 2**48."""
    out, carry = np.zeros(n + 1, _U), _U(0)
    for low in range(0, n, _STEP):
        high = min(low + _STEP, n)
        upper, lower = (np.cumsum(x) for x in parts(low, high))
        out[low + 1 : high + 1] = _reduced(((upper & _LOW30) << _U(31)) + (upper >> _U(30)) + lower + carry)
        carry = out[high]
    return out


def prefix_hash(data: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    """One value more than bytes; see span_hash."""
    up = powers(len(data))[0]

    def parts(low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        own, power = codes[data[low:high]], up[low:high]
        return own * (power >> _U(31)), own * (power & _LOW31)

    return _summed(len(data), parts)


def prefix_of_values(values: np.ndarray) -> np.ndarray:
    """As prefix_hash, for 64-bit values in place of bytes."""
    up = powers(len(values))[0]

    def parts(low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        terms = times(_reduced(values[low:high]), up[low:high])
        return terms >> _U(31), terms & _LOW31

    return _summed(len(values), parts)


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand; 61 bits, spread over 64."""
    return mix(times(_reduced(prefix[end] + _U(2 * PRIME) - prefix[start]), powers(len(prefix))[1][start]))


def gram_hash(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each data[k : k + size], by doubling: for short grams, where two that share one only cost time."""
    n, width = max(0, len(data) - size + 1), 1
    out = mix(CODES[data])
    while 2 * width <= size:
        out = out[:-width] * _U(0x9E3779B97F4A7C15) + out[width:]
        out ^= out >> _U(29)
        width *= 2
    if width < size:
        out = out[:n] * _U(0xC2B2AE3D27D4EB4F) + out[size - width : size - width + n]
    return mix(out)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run for mapInArrow; when a task ends its worker gives freed memory back, as it stays for later tasks beside the JVM."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
            trim(0)

    return wrapped


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of about ``most`` bytes."""
    data, at = text_buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one entry more than rows)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    starts_here = inside[1:-1] & ~inside[:-2]
    ends_here = inside[1:-1] & ~inside[2:]
    edge = at[:-1][at[:-1] < at[1:]]  # rows that aren't empty
    starts_here[edge] |= inside[1:-1][edge]
    last = edge[edge > 0] - 1
    ends_here[last] |= inside[1:-1][last]
    starts = np.flatnonzero(starts_here)
    return starts, np.flatnonzero(ends_here) + 1, np.searchsorted(starts, at)


def words(data: np.ndarray, at: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (fold: as if A-Z were a-z), and for each row the index of its first word."""
    starts, ends, first = word_spans(data, at)
    return span_hash(prefix_hash(data, FOLDED if fold else CODES), starts, ends), first


ALNUM = np.ones(256, bool)  # bytes of other scripts count as letters
ALNUM[:128] = [chr(c).isalnum() for c in range(128)]


def core_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without the punctuation at their edges, A-Z folded, and each row's first one.

    Words of punctuation alone are left out.
    """
    start, end, first = word_spans(data, at)
    solid = ALNUM[data]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid, out=before[1:])
    has = before[end] > before[start]
    where = np.flatnonzero(solid)
    low, high = where[before[start[has]]], where[before[end[has]] - 1] + 1
    kept = np.append(0, np.cumsum(has))
    return span_hash(prefix_hash(data, FOLDED), low, high), kept[first]
