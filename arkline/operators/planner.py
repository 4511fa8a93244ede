"""Compression planning: windows, memory, and an order that puts similar files together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sizes
from ..sources.folders import scratch
from .ranks import numbered
from .solid import plan_solid

REPRESENTATIVES = 8
PERMILLE = 300


def plan(entries: DataFrame, dict_size: int = 0, solid: bool = False, by: Sequence[str] = ("archive",)) -> DataFrame:
    """decision (stored, block), dict_size, solid_chain and workspace_bytes of each entry.
    entries: entry_idx, method, raw_size, is_dir, is_reference."""
    packs = (F.col("method") > 0) & ~F.col("is_dir") & ~F.col("is_reference")
    requested = F.lit(dict_size).cast("long") if dict_size else sizes.by_method(F.col("method"), sizes.DEFAULT_DICT, 0x800000)
    window = sizes.resolved_dict(requested, F.col("method"), F.col("raw_size"))
    planned = entries.withColumns({"decision": F.when(packs, "block").otherwise("stored"), "dict_size": F.when(packs, window).otherwise(0).cast("long")})
    planned = planned.withColumn("workspace_bytes", sizes.workspace_bytes(packs, F.col("dict_size"), F.col("raw_size")))
    return plan_solid(planned, by) if solid else planned.withColumn("solid_chain", F.lit(False))


def memory(planned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return planned.groupBy(*by).agg(F.sum("workspace_bytes").alias("total_workspace"), F.max("workspace_bytes").alias("peak_workspace"))


def partners(chunks: DataFrame, permille: int = PERMILLE, representatives: int = REPRESENTATIVES) -> DataFrame:
    """file_idx, partner_idx, shared: the earlier file that shares most chunks, if these are at
    least permille of the smaller one's. chunks: file_idx, hash, a row for each chunk.

    Chunks count as often as they occur. For each hash only the first ``representatives``
    occurrences (by file) are looked at, so a hash that every file has makes no more pairs
    than that per occurrence: the occurrences are found by a rank and joined back.
    """
    counts = chunks.groupBy("hash", "file_idx").agg(F.count("*").alias("n"))
    # occurrences before a file's own, in file order; the join is on hash with few left rows each
    before = Window.partitionBy("hash").orderBy("file_idx").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("_before") < representatives)
    first = first.select(F.col("hash").alias("_h"), F.col("file_idx").alias("_f"), F.least(F.col("n"), representatives - F.col("_before")).alias("_n"))
    pairs = counts.join(first, (F.col("hash") == F.col("_h")) & (F.col("_f") < F.col("file_idx")))
    shared = pairs.groupBy("file_idx", F.col("_f").alias("partner_idx")).agg(F.sum(F.col("n") * F.col("_n")).alias("shared"))
    best = shared.groupBy("file_idx").agg(F.max_by(F.struct("partner_idx", "shared"), F.struct("shared", -F.col("partner_idx"))).alias("b")).select("file_idx", "b.*")
    size = chunks.groupBy("file_idx").agg(F.count("*").alias("size"))
    sized = best.join(size, "file_idx").join(size.select(F.col("file_idx").alias("partner_idx"), F.col("size").alias("_other")), "partner_idx")
    enough = F.col("shared") * 1000 >= permille * F.least("size", "_other")
    return sized.where(enough).select("file_idx", "partner_idx", "shared")


def affinity_order(files: DataFrame, chunks: DataFrame, permille: int = PERMILLE) -> DataFrame:
    """file_idx, group_idx (its first file) and position. files: file_idx, reference_of (or null).

    A file's group is its partner's; partners are earlier files, so following them ends, and
    pointer doubling takes as many joins as the longest chain has binary digits. A reference
    belongs to its master's group.
    """
    up = files.select("file_idx").join(partners(chunks, permille), "file_idx", "left").select("file_idx", F.coalesce("partner_idx", "file_idx").alias("group_idx"))
    folder, step = scratch(files.sparkSession, "affinity"), 0
    while True:
        up.write.parquet(f"{folder}/{step}")
        up, step = files.sparkSession.read.schema(up.schema).parquet(f"{folder}/{step}"), step + 1
        above = up.select(F.col("file_idx").alias("_f"), F.col("group_idx").alias("_g"))
        jumped = up.join(above, F.col("group_idx") == F.col("_f")).select("file_idx", "group_idx", "_g")
        if jumped.where("group_idx <> _g").isEmpty():
            break
        up = jumped.select("file_idx", F.col("_g").alias("group_idx"))
    master = up.select(F.col("file_idx").alias("_m"), F.col("group_idx").alias("_mg"))
    joined = up.join(files, "file_idx").join(master, F.col("reference_of") == F.col("_m"), "left")
    moved = joined.select("file_idx", F.when(F.col("reference_of") < F.col("file_idx"), F.col("_mg")).otherwise(F.col("group_idx")).alias("group_idx"))
    return numbered(moved, "group_idx", "file_idx", name="position").withColumn("position", F.col("position").cast("int"))


#: Fingerprints that a plan holds at most (a fixed value).
FINGERPRINT_CAP = 2_000_000


def fingerprinted(files: DataFrame, cap: int = FINGERPRINT_CAP, by: tuple[str, ...] = ("plan",)) -> DataFrame:
    """total (fingerprints up to and with the file, in order of file_idx) and fingerprinted: whether the
    file still takes part; from the first that would pass the cap on none does. files: file_idx, chunks
    and the columns of ``by``, a batch that is planned together."""
    order = Window.partitionBy(*by).orderBy("file_idx").rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumn("total", F.sum("chunks").over(order)).withColumn("fingerprinted", F.max(F.col("total") > cap).over(order) == F.lit(False))
