"""Ordered operations over groups of any size.

A plain window over ``partitionBy(key)`` sorts a whole group in one task, which fails when one
key owns a third of the table. Here the group is cut into consecutive *blocks* (an expression
that never decreases along the order, e.g. the hour of a timestamp or ``idx / 4096``). Rows are
windowed inside (key, block); what crosses a block border is a tiny per-block summary that is
windowed per key and joined back. Results equal the plain window for every input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 4096


def index_block(idx: Column, rows: int = BLOCK_ROWS) -> Column:
    return F.floor(idx / rows)


def _parts(keys, order):
    inside = W.partitionBy(*keys, "_block").orderBy(*order)
    across = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    return inside, across


def _with_summary(df: DataFrame, keys, summary: DataFrame) -> DataFrame:
    """Join the per-block summary back; only the small side moves, rows keep their partitioning."""
    on = [*keys, "_block"]
    right = summary.withColumnsRenamed({k: f"__{k}" for k in on})
    cond = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in on]
    return df.join(right, cond, "left").drop(*[f"__{k}" for k in on])


def numbered(df: DataFrame, keys, block: Column, order, out: str) -> DataFrame:
    """1-based position of each row in its group."""
    inside, across = _parts(keys, order)
    df = df.withColumn("_block", block)
    summary = (
        df.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(across), F.lit(0))).drop("_n")
    )
    ranked = df.withColumn("_rn", F.row_number().over(inside))
    return (
        _with_summary(ranked, keys, summary)
        .withColumn(out, (F.col("_rn") + F.col("_before")).cast("long"))
        .drop("_rn", "_before", "_block")
    )


def last_before(df: DataFrame, keys, block: Column, order, value: Column, out: str) -> DataFrame:
    """Last non-null ``value`` strictly before each row."""
    inside, across = _parts(keys, order)
    df = df.withColumns({"_block": block, "_v": value})
    summary = (
        df.where(F.col("_v").isNotNull()).groupBy(*keys, "_block")
        .agg(F.max_by("_v", F.struct(*order)).alias("_last"))
    )
    blocks = df.select(*keys, "_block").distinct()
    summary = (
        _with_summary(blocks, keys, summary)
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(across)).drop("_last")
    )
    local = df.withColumn(
        "_l", F.last("_v", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, -1))
    )
    return (
        _with_summary(local, keys, summary)
        .withColumn(out, F.coalesce("_l", "_carry")).drop("_l", "_carry", "_block", "_v")
    )


def max_before(df: DataFrame, keys, block: Column, order, value: Column, out: str) -> DataFrame:
    """Maximum of ``value`` over all earlier rows of the group, null for the first."""
    inside, across = _parts(keys, order)
    df = df.withColumns({"_block": block, "_v": value})
    summary = (
        df.groupBy(*keys, "_block").agg(F.max("_v").alias("_m"))
        .withColumn("_carry", F.max("_m").over(across)).drop("_m")
    )
    local = df.withColumn("_l", F.max("_v").over(inside.rowsBetween(W.unboundedPreceding, -1)))
    return (
        _with_summary(local, keys, summary)
        .withColumn(out, F.greatest("_l", "_carry")).drop("_l", "_carry", "_block", "_v")
    )


def top_k(df: DataFrame, keys, order, k: int, out: str = "rank") -> DataFrame:
    """Best k rows per group; Spark limits each partition to k per group before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def first_distinct(df: DataFrame, keys, item: str, order, k: int | None, fold: bool = True) -> DataFrame:
    """Distinct ``item`` values per group in order of first appearance, at most k, as rows.

    De-duplication is a partial aggregation on (group, folded value), so a huge group shrinks
    before it moves; only then are the survivors ranked.
    """
    kept = df.where(F.coalesce(F.col(item), F.lit("")) != "")
    key = F.lower(F.col(item)) if fold else F.col(item)
    at = F.struct(*order)
    once = (
        kept.withColumn("_k", key).withColumn("_at", at)
        .groupBy(*keys, "_k").agg(F.min_by(item, "_at").alias(item), F.min("_at").alias("_at"))
        .drop("_k")
    )
    if k is None:
        return once.withColumnRenamed("_at", "first_at")
    return top_k(once, keys, ["_at"], k, "pos").drop("_at")


def gathered(rows: DataFrame, keys, item: str, out: str, sep: str = "; ") -> DataFrame:
    """Join already limited rows (at most k per group, with ``pos``) into one string."""
    packed = F.array_sort(F.collect_list(F.struct("pos", item)))
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(packed, lambda s: s[item]), sep).alias(out)
    )
