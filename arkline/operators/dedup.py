"""Equal files, links and names that collide.

Groups may hold a large share of the rows, so masters are found by aggregates (combined
before the shuffle) and joined back, not by windows over a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors
from ..functions.unicode import nfc, simple_fold


def with_master(entries: DataFrame, keys: Sequence[str], order: str = "entry_idx") -> DataFrame:
    """master_idx: the first entry with the same keys; null for it and for rows with a null key."""
    firsts = entries.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    joined = entries.join(firsts, same, "left")
    return joined.withColumn("master_idx", F.when(F.col("_first") < F.col(order), F.col("_first"))).drop("_first", "_n", *[f"_k{i}" for i in range(len(keys))])


def hardlinks(files: DataFrame) -> DataFrame:
    """Files with the device and inode of an earlier one."""
    return with_master(files, ["dev", "ino"])


def identical(files: DataFrame, min_size: int = 65_536, by: Sequence[str] = ()) -> DataFrame:
    """Files of at least min_size with the content of an earlier one (size and SHA-256)."""
    hashed = files.withColumn("_size", F.octet_length("content")).withColumn("_sha", F.sha2(F.col("content").cast("binary"), 256))
    eligible = hashed.where(F.col("_size") >= min_size)
    mastered = with_master(eligible, [*by, "_size", "_sha"])
    rest = hashed.where(~F.coalesce(F.col("_size") >= min_size, F.lit(False))).withColumn("master_idx", F.lit(None).cast("long"))
    return mastered.unionByName(rest).drop("_size", "_sha")


def filecopy_masters(entries: DataFrame) -> DataFrame:
    """References (redirection 5) with the master's index: the entry of the target's name that is
    no redirection; error where there is none."""
    masters = entries.where("coalesce(redir.type, 0) = 0 AND NOT coalesce(is_service, false)").groupBy(F.col("name").alias("_name")).agg(F.min("entry_idx").alias("master_idx"))
    refs = entries.where("redir.type = 5")
    return refs.join(masters, F.col("redir.target") == F.col("_name"), "left").drop("_name").withColumn("error", F.when(F.col("master_idx").isNull(), "missing master"))


def migratable_links(entries: DataFrame) -> DataFrame:
    """Hard links (redirection 4) whose target comes earlier and isn't a link itself."""
    targets = entries.where("coalesce(redir.type, 0) = 0").groupBy(F.col("name").alias("_name")).agg(F.min("entry_idx").alias("target_idx"))
    links = entries.where("redir.type = 4").join(targets, F.col("redir.target") == F.col("_name"), "left").drop("_name")
    return links.withColumn("migrates", F.coalesce(F.col("target_idx") < F.col("entry_idx"), F.lit(False)))


def collisions(entries: DataFrame) -> DataFrame:
    """first, second, cls: names that cannot stand side by side on disk. entries: entry_idx, name, is_dir.

    duplicate (equal bytes), case_fold and nfc report a name with the earliest that has the
    same form under another spelling; file_vs_dir every file with each entry below its path,
    found by an equi join of names with the ancestors of names. A pair is reported once, in
    this order of classes.
    """
    named = entries.select("entry_idx", "name", "is_dir", simple_fold("name").alias("folded"), nfc("name").alias("norm"))

    def earliest(form):
        firsts = named.groupBy(F.col(form).alias("_form")).agg(F.min(F.struct("entry_idx", "name", "folded")).alias("_e"))
        return named.join(firsts, F.col(form) == F.col("_form")).where(F.col("_e.entry_idx") < F.col("entry_idx"))

    pair = lambda df, rank, cls: df.select(F.col("_e.entry_idx").alias("i"), F.col("entry_idx").alias("j"), F.col("_e.name").alias("first"), F.col("name").alias("second"), F.lit(rank).alias("rank"), F.lit(cls).alias("cls"))
    duplicate = pair(earliest("name"), 0, "duplicate")
    fold = pair(earliest("folded").where("_e.name <> name"), 1, "case_fold")
    norm = pair(earliest("norm").where("_e.name <> name AND _e.folded <> folded"), 2, "nfc")
    below = named.select("entry_idx", "name", F.explode(ancestors(F.col("norm"))).alias("_up"))
    files = named.where("NOT is_dir").select(F.col("entry_idx").alias("_i"), F.col("name").alias("_first"), F.array_join(F.filter(F.split("norm", "/"), lambda p: p != ""), "/").alias("_path"))
    tree = below.join(files, F.col("_up") == F.col("_path")).select(F.col("_i").alias("i"), F.col("entry_idx").alias("j"), F.col("_first").alias("first"), F.col("name").alias("second"), F.lit(3).alias("rank"), F.lit("file_vs_dir").alias("cls"))
    every = duplicate.unionByName(fold).unionByName(norm).unionByName(tree)
    return every.groupBy("i", "j").agg(F.min(F.struct("rank", "cls", "first", "second")).alias("r")).select("r.first", "r.second", "r.cls")


def target_conflicts(entries: DataFrame) -> DataFrame:
    """Targets of an extraction that more than one entry writes, or that stand above another: target, conflict."""
    targets = entries.groupBy("target").agg(F.count("*").alias("n"))
    twice = targets.where("n > 1").select("target", F.lit("duplicate target").alias("conflict"))
    above = entries.where("NOT is_dir").select("target").distinct()
    parents = entries.select(F.explode(ancestors(F.col("target"))).alias("target")).distinct()
    return twice.unionByName(above.join(parents, "target").withColumn("conflict", F.lit("file above another")))


