"""A bit array over ids, so that rows that can't meet any of them don't move to a join.

The array has a bit for each of the ids' first hash bits and at most 2**BITS of them, 16 MB, whatever the number of ids; with very
many ids it lets more rows through, at no loss, as the join behind it is exact.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 27


def may_hold(ids: DataFrame, column: str) -> Callable[[Column], Column]:
    """Of a column of ids, which may be among ids.column: true for all that are, and for one in some 16 others; null is not."""
    bits = min(BITS, max(10, ids.count().bit_length() + 4))
    place = F.shiftrightunsigned(F.xxhash64(F.col(column).cast("long")), 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = ids.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("word")).toPandas()  # 2**(BITS - 6) rows at most
    array = np.zeros(1 << (bits - 6), np.int64)
    array[words["at"].to_numpy(np.int64)] = words["word"].to_numpy(np.int64)
    shared, down = ids.sparkSession.sparkContext.broadcast(array.tobytes()), np.uint64(64 - bits)

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        at = keys.to_numpy(np.int64).view(np.uint64) >> down
        held = np.frombuffer(shared.value, np.uint8)
        return pd.Series(held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0)

    return lambda own: own.isNotNull() & test(F.xxhash64(own.cast("long")))
