"""Times of archive headers as column expressions; seconds since 1970 unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_1601 = 11_644_473_600
LATEST = 32_503_680_000  # the year 3000


def dos_to_unix(dos: Column) -> Column:
    """MS-DOS date and time (2 seconds steps); months and days out of range count as 1, 0 is 0."""
    dos = dos.cast("long")
    field = lambda shift, mask: F.shiftright(dos, shift).bitwiseAND(mask).cast("int")
    month, day = field(21, 15), field(16, 31)
    month = F.when(month.between(1, 12), month).otherwise(1)
    first = F.make_date(field(25, 127) + 1980, month, F.lit(1))
    days = F.date_diff(first, F.lit("1970-01-01").cast("date")) + F.when(day > 0, day).otherwise(1) - 1
    seconds = field(11, 31) * 3600 + field(5, 63) * 60 + field(0, 31) * 2
    return F.when(dos == 0, F.lit(0).cast("long")).otherwise(days.cast("long") * 86400 + seconds)


def unix_to_dos(seconds: Column) -> Column:
    """The other way; the year is clamped to 1980..2107, the other fields stay."""
    days = F.floor(seconds / 86400).cast("int")
    date, rest = F.date_add(F.lit("1970-01-01").cast("date"), days), F.pmod(seconds, F.lit(86400))
    year = F.least(F.greatest(F.year(date), F.lit(1980)), F.lit(2107)) - 1980
    left = lambda c, n: F.shiftleft(c.cast("long"), n)
    value = left(year, 25) + left(F.month(date), 21) + left(F.dayofmonth(date), 16) + left(F.floor(rest / 3600), 11) + left(F.floor(rest / 60) % 60, 5) + F.floor(rest % 60 / 2)
    return F.when(seconds == 0, F.lit(0).cast("long")).otherwise(value)


def filetime_to_unix(filetime: Column) -> Column:
    """100 nanoseconds since 1601 to whole seconds since 1970."""
    return F.call_function("div", filetime - F.pmod(filetime, F.lit(10_000_000)), F.lit(10_000_000)) - EPOCH_1601


def unix_to_filetime(seconds: Column, nanos: Column | None = None) -> Column:
    return (seconds + EPOCH_1601) * 10_000_000 + (F.lit(0) if nanos is None else F.floor(nanos / 100))


def resolved_mtime(htime_is_unix: Column, htime_mtime: Column, utime: Column, mtime_win: Column) -> Column:
    """The modification time of the best source: Unix extra record, header field, FILETIME."""
    return F.coalesce(F.when(htime_is_unix, htime_mtime), utime, F.when(mtime_win != 0, filetime_to_unix(mtime_win)))


def clamped(seconds: Column) -> tuple[Column, Column]:
    """(within 1970..3000, whether it was outside)."""
    inside = F.least(F.greatest(seconds, F.lit(0)), F.lit(LATEST))
    return inside, inside != seconds


def pax_time(text: Column) -> tuple[Column, Column]:
    """(seconds, nanoseconds) of a decimal time; nanoseconds are never negative."""
    whole = F.regexp_extract(text, r"^(-?[0-9]+)", 1).try_cast("long")
    nanos = F.rpad(F.substring(F.regexp_extract(text, r"\.([0-9]*)$", 1), 1, 9), 9, "0").cast("int")
    below = text.startswith("-") & (nanos > 0)
    return F.when(below, whole - 1).otherwise(whole), F.when(below, 1_000_000_000 - nanos).otherwise(nanos)
