"""Positions and running sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvox.session import materialize


def running_before(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    measure: Column,
    name: str,
    partitions: int | None = None,
) -> DataFrame:
    """Sum of `measure` over the earlier rows of the group; (keys, order) must be unique.

    A window over the keys alone would put a whole group into one task. Rows are range-partitioned
    by (keys, order) instead, summed inside (partition, keys), and the sums of earlier partitions,
    at most one row per key and partition, are added.
    """
    by = [*keys, *order]
    measured = df.withColumn("_m", measure)
    spread = (
        measured.repartitionByRange(partitions, *by) if partitions else measured.repartitionByRange(*by)
    )
    placed = materialize(spread.withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    local = placed.withColumn("_in", F.sum("_m").over(inside) - F.col("_m"))
    totals = placed.groupBy(*keys, "_part").agg(F.sum("_m").alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy("_part")
    offsets = totals.select(*keys, "_part", (F.sum("_t").over(earlier) - F.col("_t")).alias("_off"))
    return (
        local.join(offsets, [*keys, "_part"])
        .withColumn(name, F.col("_in") + F.col("_off"))
        .drop("_m", "_part", "_in", "_off")
    )


def numbered(
    df: DataFrame, keys: list[str], order: list[str], name: str, partitions: int | None = None
) -> DataFrame:
    """Row number from 1 within each group."""
    counted = running_before(df, keys, order, F.lit(1).cast("long"), name, partitions)
    return counted.withColumn(name, F.col(name) + 1)
