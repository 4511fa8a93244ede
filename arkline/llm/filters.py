"""A filter of names that tasks ask before they let a row move."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class BitFilter:
    """Of the 16 bits a name has room for one is set, up to 8 MB together; more names only let
    more others through. No name of ``names`` (a binary column) is ever missed."""

    MOST = 26

    def __init__(self, names: DataFrame, column: str):
        self.size = 1 << min(self.MOST, max(16, (16 * names.count()).bit_length()))
        bit = F.pmod(F.xxhash64(column), F.lit(self.size))
        words = names.select((bit / 64).cast("int").alias("w"), (bit % 64).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).toArrow()
        self.table = np.zeros(self.size // 64, np.int64)
        self.table[words["w"].to_numpy()] = words["bits"].to_numpy()

    def __contains__(self, name: bytes) -> bool:
        at = xxhash.xxh64_intdigest(name, seed=42) % self.size  # Spark's xxhash64 of a binary value
        return bool(int(self.table[at >> 6]) >> (at & 63) & 1)
