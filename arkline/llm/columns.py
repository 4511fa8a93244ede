"""Input columns called like an operator's own."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its columns of these names called otherwise, and what selects df's columns again from a result."""
    taken = {c: f"_ark_own_{c}" for c in df.columns if c in set(names)}
    back = [F.col(taken.get(c, c)).alias(c) for c in df.columns]
    return df.withColumnsRenamed(taken), lambda out: out.select(*back)
