"""Fill-in-the-middle: texts cut in three and put in another order, with sentinels, by one numpy kernel a batch.

A text is cut into units: code points, words (each with the white space behind it; what stands before the first word is a
unit of its own) or lines. One rule finds where units begin, for all texts of a batch at once:

1. a table gives the class of each byte,
2. a second table says of two adjacent classes whether a unit begins between them; a text's first byte always begins one,
3. the sum of those marks up to each byte, less the sum where the text starts, is the unit the byte lies in,
4. ``searchsorted`` in these sums gives the byte of every text's two cuts together.

Output: ``plain`` is the text; ``psm`` is prefix, suffix, middle and ``spm`` suffix, prefix, middle, each part behind its
sentinel. A text that is empty or holds a sentinel stays plain, so ``restored`` always gives back the text. Where a text is
cut and which form it takes follow from a hash of its doc_id alone, so reruns agree, however the table is split.

Rows: a null text is empty; a null doc_id is hashed as an empty string; repeated rows give repeated rows; extra columns are
ignored; an empty table gives an empty result. A text of any length is handled whole; one longer than a slice is a slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import _bytes

UNITS = ("chars", "words", "lines")
FORMS = ("plain", "psm", "spm")


@dataclass(frozen=True)
class Params:
    """Of 100 texts ``plain_percent`` stay plain and ``spm_percent`` of the others take the form spm."""

    unit: str = "chars"
    seed: int = 1
    plain_percent: int = 10
    spm_percent: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        if self.unit not in UNITS:
            raise ValueError(f"unit must be one of {', '.join(UNITS)}")
        marks = [m.encode() for m in self.sentinels]
        for a, b in product(range(3), repeat=2):
            # else a text's edge and a sentinel could make another sentinel, and the text could not be told apart
            if not marks[a] or a != b and marks[a] in marks[b] or any(marks[a][-k:] == marks[b][:k] for k in range(1, len(marks[a]))):
                raise ValueError("sentinels must not be empty, hold one another or overlap")

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


PARAMS = Params()

_INNER, _SPACE, _BREAK, _OTHER = range(4)
#: Class of each byte: inside a character, white space, line feed, and all else.
CLASS = np.full(256, _OTHER, np.uint8)
CLASS[0x80:0xC0] = _INNER
CLASS[_bytes.SPACE] = _SPACE
CLASS[ord("\n")] = _BREAK


def _begins(unit: str) -> np.ndarray:
    """For the classes of a byte and the one before it (4 * before + own): whether a unit begins at the byte."""
    before, own = np.repeat(np.arange(4), 4), np.tile(np.arange(4), 4)
    if unit == "chars":
        return own != _INNER
    if unit == "lines":
        return before == _BREAK
    white = [_SPACE, _BREAK]
    return np.isin(before, white) & ~np.isin(own, white)


BEGINS = {unit: _begins(unit) for unit in UNITS}


def unit_sums(data: np.ndarray, at: np.ndarray, unit: str) -> np.ndarray:
    """How many units begin in data[:i], for each i; every text that isn't empty begins one."""
    kind = CLASS[data]
    mark = np.zeros(len(data), bool)
    mark[1:] = BEGINS[unit][kind[:-1] * np.uint8(4) + kind[1:]]
    mark[at[:-1][at[:-1] < at[1:]]] = True
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mark, out=sums[1:])
    return sums


def cut_places(sums: np.ndarray, at: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The byte behind the first units[k] units of text k; units[k] is at most the text's number of units."""
    place = np.searchsorted(sums, sums[at[:-1]] + units + 1) - 1
    return np.minimum(place, at[1:])


def _holding(data: np.ndarray, at: np.ndarray, mark: bytes) -> np.ndarray:
    """Whether each text holds the mark."""
    usable = max(0, len(data) - len(mark) + 1)
    hit = np.ones(usable, bool)
    for k, byte in enumerate(mark):
        hit &= data[k : k + usable] == byte
    where = np.flatnonzero(hit)
    row = np.searchsorted(at, where, "right") - 1
    out = np.zeros(len(at) - 1, bool)
    out[row[where + len(mark) <= at[row + 1]]] = True
    return out


def arranged(data: np.ndarray, at: np.ndarray, hashes: np.ndarray, params: Params = PARAMS) -> dict[str, np.ndarray]:
    """n, form (its number in FORMS), prefix and middle (units), output bytes and their offsets, of all texts together.

    hashes has four columns of unsigned 32-bit values, one row a text.
    """
    sums = unit_sums(data, at, params.unit)
    n = sums[at[1:]] - sums[at[:-1]]
    points = np.sort(hashes[:, :2] % (n + 1)[:, None], axis=1)
    plain = (n == 0) | (hashes[:, 2] % 100 >= 100 - params.plain_percent)
    marks = [m.encode() for m in params.sentinels]
    for mark in marks:
        plain |= _holding(data, at, mark)
    spm = hashes[:, 3] % 100 < params.spm_percent
    form = np.where(plain, 0, np.where(spm, 2, 1))

    low, high = (cut_places(sums, at, points[:, k]) for k in (0, 1))
    start, end = at[:-1], at[1:]
    own = np.cumsum([len(data), *map(len, marks)])  # the sentinels stand behind the texts in one array
    whole = np.concatenate([data, np.frombuffer(b"".join(marks), np.uint8)])
    parts = np.zeros((len(n), 6, 2), np.int64)  # six pieces of a text, by start and end
    parts[:, 0::2] = np.stack([own[:3], own[1:]], axis=1)
    parts[:, 1], parts[:, 3], parts[:, 5] = (np.stack(x, axis=1) for x in ((start, low), (high, end), (low, high)))
    turned = form == 2
    parts[turned, :4] = parts[turned][:, [2, 3, 0, 1]]
    parts[plain] = 0
    parts[plain, 1] = np.stack([start, end], axis=1)[plain]

    first, size = parts[:, :, 0].ravel(), (parts[:, :, 1] - parts[:, :, 0]).ravel()
    upto = np.cumsum(size)
    total = int(upto[-1]) if len(upto) else 0
    out = whole[np.repeat(first - (upto - size), size) + np.arange(total)]
    return {"n": n, "form": form, "prefix": points[:, 0], "middle": points[:, 1] - points[:, 0], "output": out, "offsets": np.append(0, upto[5::6])}


def _hashes(seed: int) -> Column:
    """Four unsigned 32-bit numbers of the doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def transformed(docs: DataFrame, params: Params = PARAMS) -> DataFrame:
    """doc_id, n (units), form, prefix_units and middle_units (null if plain) and output of each row."""
    names = pa.array(FORMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(2).flatten().to_numpy().reshape(-1, 4)
            for low, high, data, at in _bytes.slices(batch.column(1)):
                made = arranged(data, at, hashes[low:high], params)
                output = pa.LargeStringArray.from_buffers(high - low, pa.py_buffer(made["offsets"]), pa.py_buffer(made["output"])).cast(pa.string())
                plain = made["form"] == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(made["n"]), names.take(pa.array(made["form"])), *(pa.array(made[k], mask=plain) for k in ("prefix", "middle")), output],
                    ["doc_id", "n", "form", "prefix_units", "middle_units", "output"],
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.withColumn("hashes", _hashes(params.seed)).mapInArrow(_bytes.frugal(run), "doc_id long, n long, form string, prefix_units long, middle_units long, output string")


def restored(output: Column, form: Column, params: Params = PARAMS) -> Column:
    """The text, from output and form alone."""
    prefix, suffix, middle = (F.lit(len(m)) for m in params.sentinels)
    at_prefix, at_suffix, at_middle = (F.instr(output, m) for m in params.sentinels)  # from 1
    psm = F.concat(
        F.substring(output, at_prefix + prefix, at_suffix - at_prefix - prefix),
        F.substring(output, at_middle + middle, F.length(output)),
        F.substring(output, at_suffix + suffix, at_middle - at_suffix - suffix),
    )
    spm = F.concat(
        F.substring(output, at_prefix + prefix, at_middle - at_prefix - prefix),
        F.substring(output, at_middle + middle, F.length(output)),
        F.substring(output, at_suffix + suffix, at_prefix - at_suffix - suffix),
    )
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, params: Params = PARAMS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the hashes of the output and of the text rebuilt from it."""
    made = transformed(docs, params)
    return made.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form"), params), 256).alias("restored_sha256"),
    )
