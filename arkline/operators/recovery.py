"""Parity of contents and repair from it."""

from __future__ import annotations

import pandas as pd
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import kernels, sizes


def protect(contents: DataFrame, percent: int, content_col: str = "content") -> DataFrame:
    """contents with its recovery geometry and parity shards. A row is a task's unit: parity of
    one content needs all of it, contents don't need each other."""
    size = F.octet_length(content_col).cast("long")
    shaped = contents.withColumns(sizes.recovery_geometry(size, F.lit(percent).cast("long")))
    return shaped.withColumn("parity", kernels.parity_column(F.col(content_col), F.col("d").cast("int"), F.col("nr").cast("int")))


@pandas_udf(T.BinaryType())
def repaired(content: pd.Series, damaged: pd.Series, parity: pd.Series, shards: pd.Series) -> pd.Series:
    """Each content with its damaged shards (their numbers) recovered; null where too many are."""

    def one(data, bad, rest, d):
        width = -(-len(data) // d)
        width += width % 2
        padded = bytes(data).ljust(d * width, b"\0")
        lost = set(bad)
        try:
            whole = kernels.recover([None if k in lost else padded[k * width : (k + 1) * width] for k in range(d)], [None if p is None else bytes(p) for p in rest])
        except ValueError:
            return None
        return b"".join(whole)[: len(data)]

    return pd.Series([one(*row) for row in zip(content, damaged, parity, shards, strict=True)])


def damaged_shards(content: Column, sums: Column, shards: Column) -> Column:
    """Numbers of shards whose CRC-32 isn't the noted one."""
    width = sizes.ceil_div(F.octet_length(content).cast("long"), shards)
    width = width + width % 2
    part = lambda k: F.rpad(F.hex(F.substring(content, (k * width + 1).cast("int"), width.cast("int"))), (2 * width).cast("int"), F.lit("0"))
    numbers = F.sequence(F.lit(0), (shards - 1).cast("int"))
    return F.filter(numbers, lambda k: F.crc32(F.unhex(part(k))) != F.element_at(sums, k + 1))
