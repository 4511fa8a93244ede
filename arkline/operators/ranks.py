"""Row numbers over a whole frame without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import scratch


def numbered(df: DataFrame, *order: str | Column, name: str) -> DataFrame:
    """df with name, from 0 in this order. Ranges are sorted on their own and written; each range's
    rows count on from the ranges before, of which only the counts come to the driver."""
    spark = df.sparkSession
    folder = scratch(spark, "ranks")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in the range
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()).withColumn("_place", place).write.parquet(folder)
    rows = spark.read.parquet(folder)
    before, upto = [], 0
    for number, count in sorted(tuple(r) for r in rows.groupBy("_range").count().collect()):
        before.append((number, upto))
        upto += count
    starts = F.broadcast(spark.createDataFrame(before, "_r int, _before long"))  # a row for each partition
    return rows.join(starts, F.col("_range") == F.col("_r")).withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_r", "_before")
