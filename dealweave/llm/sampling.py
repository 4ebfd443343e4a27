"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLASSES = 10_000  # up to as many classes their sizes are broadcast


def stratified(rows: DataFrame, by: str, key: str, sample: int) -> DataFrame:
    """At most ``sample`` rows of each value of ``by``, by the smallest hashes of ``key``; which rows is the same in every run.

    A share that leaves a few more rows of a class than the sample goes before any exchange, so that no task reads or ranks a whole class.
    """
    order = F.xxhash64(key)
    size = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_rows"))
    few = size.limit(CLASSES + 1).count() <= CLASSES
    place = (order / F.lit(2.0**64) + 0.5) * F.col("_rows")  # about the rank of the row in its class
    near = rows.join(F.broadcast(size) if few else size, by).where(place < sample + 8 * sample**0.5 + 64).drop("_rows")
    ranked = near.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order, key)))
    return ranked.where(F.col("_n") <= sample).drop("_n")
