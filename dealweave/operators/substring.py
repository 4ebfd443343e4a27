"""Substring joins without comparing every pair.

``needle in haystack`` implies that every 3-gram of the needle occurs in the haystack, so
joining each needle's rarest gram with the grams of the haystacks finds every match. Needles of
one or two characters use grams of their own length. The result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.operators.hot import top_k


def _grams(c: Column, n: int) -> Column:
    last = F.length(c) - n + 1
    return F.when(
        last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    ).otherwise(F.array().cast("array<string>"))


def containing(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """Pairs (needle, haystack) of the distinct non-empty values of two one-column inputs."""
    n = needles.toDF("needle").where("needle <> ''").distinct()
    h = haystacks.toDF("haystack").where("haystack <> ''").distinct()
    posting = h.select(
        "haystack",
        F.explode(F.array_distinct(F.concat(*[_grams(F.col("haystack"), k) for k in (1, 2, 3)]))).alias("gram"),
    )
    size = F.least(F.length("needle"), F.lit(3))
    wanted = n.select(
        "needle",
        F.explode(F.array_distinct(
            F.when(size == 3, _grams(F.col("needle"), 3)).otherwise(F.array("needle"))
        )).alias("gram"),
    )
    # Only grams some needle asks for can matter, which keeps one- and two-letter grams out.
    posting = posting.join(wanted.select("gram").distinct(), "gram")
    spread = posting.groupBy("gram").agg(F.count(F.lit(1)).alias("spread"))
    rarest = top_k(wanted.join(spread, "gram"), ["needle"], ["spread", "gram"], 1).select("needle", "gram")
    return (
        rarest.join(posting, "gram").where(F.contains(F.col("haystack"), F.col("needle")))
        .select("needle", "haystack")
    )
