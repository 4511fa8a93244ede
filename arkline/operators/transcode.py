"""Other containers' entries to stored RAR5 archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import blake2sp_column
from . import dedup


def plan(entries: DataFrame) -> DataFrame:
    """entries (with content) and what becomes of each: dir, file, reference (of equal content that
    came before), link, skip (links whose target isn't there yet, broken members), with master_idx."""
    hashed = entries.withColumn("_digest", F.when(~F.col("is_dir") & F.col("content").isNotNull(), blake2sp_column("content"))).withColumn("_size", F.octet_length("content"))
    mastered = dedup.with_master(hashed, ["archive", "_size", "_digest"])
    links = dedup.migratable_links(entries).where("migrates").select(F.col("archive").alias("_a"), F.col("entry_idx").alias("_i"))
    joined = mastered.join(links, (F.col("archive") == F.col("_a")) & (F.col("entry_idx") == F.col("_i")), "left")
    kind = (
        F.when(F.col("error").isNotNull(), "skip")
        .when(F.col("is_dir"), "dir")
        .when(F.col("redir.type").isin(1, 2), "link")
        .when(F.col("redir.type") == 4, F.when(F.col("_i").isNotNull(), "link").otherwise("skip"))
        .when(F.col("master_idx").isNotNull() & (F.col("_size") > 0), "reference")
        .when(F.col("content").isNotNull(), "file")
        .otherwise("skip")
    )
    return joined.withColumn("becomes", kind).drop("_digest", "_size", "_a", "_i")


def checked(entries: DataFrame) -> DataFrame:
    """The collisions that keep an archive from being transcoded, by archive."""
    names = entries.select("archive", "entry_idx", F.concat_ws("\u0000", "archive", "name").alias("name"), "is_dir")
    return dedup.collisions(names.drop("archive"))
