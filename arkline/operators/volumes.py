"""Multi-volume sets: cutting data into volumes, and joining split entries again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stitch(entries: DataFrame, by: Sequence[str] = ("archive",)) -> DataFrame:
    """One row per logical entry: parts join while the file entry before has the same name and
    goes on (split_after) and the part continues (split_before). Sums come from the last part."""
    order = Window.partitionBy(*by).orderBy("volume_idx", "entry_idx")
    before = lambda c: F.lag(c).over(order)
    starts = ~F.coalesce((before("name") == F.col("name")) & before("split_after") & F.col("split_before"), F.lit(False))
    islands = entries.where("NOT coalesce(is_service, false)").withColumn("_start", starts).withColumn("_part", F.sum(F.col("_start").cast("long")).over(order))
    place = F.struct("volume_idx", "entry_idx")
    grouped = islands.groupBy(*by, "_part").agg(
        F.min("entry_idx").alias("entry_idx"),
        F.min_by("name", place).alias("name"),
        F.sum("data_size").alias("data_size"),
        F.max_by("crc32", place).alias("crc32"),
        F.max_by("split_after", place).alias("split_after"),
        F.count("*").alias("parts"),
        F.transform(F.array_sort(F.collect_list(F.struct("volume_idx", "entry_idx", F.struct("volume_path", F.col("data_offset").alias("offset"), F.col("data_size").alias("size")).alias("e")))), lambda x: x["e"]).alias("extents"),
    )
    return grouped.drop("_part")


def slices(entries: DataFrame, capacity: int, by: Sequence[str] = ("archive",)) -> DataFrame:
    """Which bytes of each entry go to which volume of capacity payload bytes: volume_idx, offset
    (in the volume), begin (in the entry), size. Empty entries take no volume bytes and give no row."""
    order = Window.partitionBy(*by).orderBy("entry_idx").rowsBetween(Window.unboundedPreceding, 0)
    placed = entries.where("pack_size > 0").withColumn("_end", F.sum("pack_size").over(order)).withColumn("_begin", F.col("_end") - F.col("pack_size"))
    cap = F.lit(capacity).cast("long")
    div = lambda a: F.call_function("div", a, cap)
    each = placed.withColumn("volume_idx", F.explode(F.sequence(div(F.col("_begin")), div(F.col("_end") - 1))))
    low, high = F.greatest(F.col("_begin"), F.col("volume_idx") * cap), F.least(F.col("_end"), (F.col("volume_idx") + 1) * cap)
    return each.withColumns({"offset": low - F.col("volume_idx") * cap, "begin": low - F.col("_begin"), "size": high - low}).drop("_begin", "_end")


def contiguous(headers: DataFrame, by: Sequence[str] = ("archive",)) -> DataFrame:
    """gap: bytes between a header and the end of the block before it (0: contiguous, null: first);
    an index may replace a scan only where every gap is 0."""
    order = Window.partitionBy(*by).orderBy("header_offset")
    end = F.lag(F.col("header_offset") + F.col("header_size") + F.coalesce("data_size", F.lit(0))).over(order)
    return headers.withColumn("gap", F.col("header_offset") - end)
