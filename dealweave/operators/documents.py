"""Bulk edits, reviewer change collation and usage statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave import lexicon as lx
from dealweave.functions import text as T


def unique_edits(edits: DataFrame) -> DataFrame:
    """Edit list without blank finds, first occurrence of each (find, replace), in order."""
    e = edits.select("seq", T.strip(F.coalesce("find_text", F.lit(""))).alias("find_text"), F.coalesce("replace_text", F.lit("")).alias("replace_text"),
                     T.strip(F.coalesce("reason", F.lit(""))).alias("reason")).where("find_text <> ''")
    return e.groupBy("find_text", "replace_text").agg(F.min("seq").alias("seq"), F.min_by("reason", "seq").alias("reason"))


def apply_edits(docs: DataFrame, edits: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """Edited text plus one occurrence count per edit. The list is part of the request, so it
    becomes a chain of built-in replacements."""
    new, counts = T.replace_all(F.col(text), edits)
    return docs.withColumns({"edited": new, "counts": F.array(*counts)})


def edit_counts(edited: DataFrame, edits: list[tuple[str, str]]) -> DataFrame:
    rows = edited.select(F.posexplode("counts").alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("replacements"))
    names = F.array(*[F.lit(f) for f, _ in edits])
    return rows.select(F.get(names, F.col("pos")).alias("find_text"), "replacements")


def collated(changes: DataFrame) -> DataFrame:
    """Reviewer changes with text, in merge order: reviewer, paragraph, time."""
    order = ["base_doc_id", "author", F.asc_nulls_last("paragraph_index"), "change_ts", "change_type", "change_text"]
    return changes.where("change_text <> ''").orderBy(*order)


def collation_counts(changes: DataFrame) -> DataFrame:
    def n(kind):
        return F.count_if(F.col("change_type") == kind)

    c = changes.where("change_text <> ''").groupBy("base_doc_id").agg(
        n("insertion").alias("insertions"), n("deletion").alias("deletions"), n("comment").alias("comments"), F.countDistinct("author").alias("sources"))
    return c.withColumn("total_changes", F.col("insertions") + F.col("deletions"))


def usage_measures() -> list:
    return [
        F.count(F.lit(1)).alias("uses"), F.sum("input_count").alias("inputs"), F.sum("output_count").alias("outputs"),
        F.round(F.avg("duration_ms"), 3).alias("avg_ms"), F.max("duration_ms").alias("max_ms")]


def usage_stats(usage: DataFrame, by: str) -> DataFrame:
    return usage.groupBy(by).agg(*usage_measures())


def collection_name(c):
    low = F.lower(T.strip(F.coalesce(c, F.lit(""))))
    return F.when(low.isin(*lx.TELEMETRY_COLLECTIONS), low).otherwise(F.lit(lx.DEFAULT_COLLECTION))
