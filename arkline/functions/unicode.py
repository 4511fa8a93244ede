"""Unicode forms that have no built-in function, as Arrow-batched functions of a string column."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def fold_char(c: str) -> str:
    """Simple case folding: one character for one character, those without such a folding as they are."""
    full = c.casefold()
    if len(full) == 1:
        return full
    low = c.lower()
    return low if len(low) == 1 else c


def fold_text(text: str) -> str:
    return text.lower() if text.isascii() else "".join(map(fold_char, text))


@pandas_udf(StringType())
def simple_fold(names: pd.Series) -> pd.Series:
    return names.map(fold_text, na_action="ignore")


@pandas_udf(StringType())
def nfc(names: pd.Series) -> pd.Series:
    return names.map(lambda s: s if s.isascii() else unicodedata.normalize("NFC", s), na_action="ignore")


@pandas_udf(StringType())
def cp437(raw: pd.Series) -> pd.Series:
    """Names of old archives, which Spark's decode doesn't read."""
    return raw.map(lambda b: bytes(b).decode("cp437"), na_action="ignore")
