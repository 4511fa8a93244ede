"""Solid runs: entries that can only be decoded after those before them in the run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(by: Sequence[str], last: int = 0):
    return Window.partitionBy(*by).orderBy("entry_idx").rowsBetween(Window.unboundedPreceding, last)


def _compressed() -> Column:
    return ~F.coalesce(F.col("is_service"), F.lit(False)) & (F.col("method") > 0)


def run_heads(entries: DataFrame, by: Sequence[str] = ("archive",)) -> DataFrame:
    """run_head: the index of the last compressed non-solid entry so far; -1 before the first."""
    head = F.last(F.when(_compressed() & ~F.col("is_solid"), F.col("entry_idx")), True).over(_order(by))
    return entries.withColumn("run_head", F.coalesce(head, F.lit(-1)))


def reader_heads(entries: DataFrame, by: Sequence[str] = ("archive",)) -> DataFrame:
    """reader_head: where decoding an entry starts; the archive's first entry where no head is found."""
    plain = _compressed() & ~F.coalesce(F.col("is_dir"), F.lit(False)) & ~F.col("is_solid")
    head = F.last(F.when(plain, F.col("entry_idx")), True).over(_order(by))
    return entries.withColumn("reader_head", F.coalesce(head, F.min("entry_idx").over(_order(by))))


def previous_in_chain(entries: DataFrame, by: Sequence[str] = ("archive",)) -> DataFrame:
    """prev_chain: the compressed file before an entry, null for the first."""
    data = _compressed() & ~F.coalesce(F.col("is_dir"), F.lit(False))
    return entries.withColumn("prev_chain", F.last(F.when(data, F.col("entry_idx")), True).over(_order(by, -1)))


def delete_guard(entries: DataFrame, by: Sequence[str] = ("archive",)) -> DataFrame:
    """refusal of each removed entry (column removed): it heads, or stands in, a run in which a
    solid member stays behind it; null where the removal is allowed."""
    run = Window.partitionBy(*by, "run_head")
    stays = _compressed() & F.col("is_solid") & ~F.col("removed")
    judged = run_heads(entries, by).withColumn("_last", F.max(F.when(stays, F.col("entry_idx"))).over(run))
    broken = F.col("removed") & (F.col("_last") > F.col("entry_idx"))
    refusal = F.when(broken, F.when(F.col("run_head") == F.col("entry_idx"), "head of solid run").otherwise("inside solid run"))
    return judged.withColumn("refusal", refusal).drop("_last")


def replace_guard(entries: DataFrame, by: Sequence[str] = ("archive",)) -> DataFrame:
    """refusal of each replaced entry (column removed): it is solid, or compressed in a run that keeps a solid member."""
    run = Window.partitionBy(*by, "run_head")
    stays = _compressed() & F.col("is_solid") & ~F.col("removed")
    judged = run_heads(entries, by).withColumn("_any", F.max(stays.cast("int")).over(run))
    broken = F.col("removed") & _compressed() & (F.col("is_solid") | (F.col("_any") == 1))
    return judged.withColumn("refusal", F.when(broken, "solid chain")).drop("_any")


def plan_solid(entries: DataFrame, by: Sequence[str] = ("archive",)) -> DataFrame:
    """solid_chain of entries to be packed solid: compressed ones and references after the first
    compressed entry. is_reference marks entries without data of their own."""
    packs = (F.col("method") > 0) & ~F.coalesce(F.col("is_dir"), F.lit(False)) & ~F.coalesce(F.col("is_reference"), F.lit(False))
    seen = F.coalesce(F.max(packs.cast("int")).over(_order(by, -1)), F.lit(0)) == 1
    return entries.withColumn("solid_chain", seen & (packs | F.coalesce(F.col("is_reference"), F.lit(False))))


def independent(entries: DataFrame) -> DataFrame:
    """Entries that any task can decode alone: not solid, in one volume."""
    return entries.withColumn("independent", ~F.col("is_solid") & (F.coalesce(F.size("extents"), F.lit(1)) <= 1))
