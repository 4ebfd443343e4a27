"""JSON returned by a language model: find it in the text, parse it, normalise its fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave import lexicon as lx
from dealweave.functions import mail as M
from dealweave.functions import text as T

MATCH = (
    "row_id string, document_name string, status string, has_activity string, "
    "matching_email_indices array<string>, matching_thread_ids array<string>, confidence string, "
    "reasoning string, checklist_comment string, comment string"
)


# a string literal (to the end of the text when it is not closed), one brace, or a stretch without either
TOKENS = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"?|[{}]|[^"{}]+'


def balanced_object(c: Column) -> Column:
    """The first balanced {...} of a text, null if there is none. The level runs over tokens, so braces in strings do not count."""
    tokens = F.regexp_extract_all(F.regexp_extract(c, r"(?s)\{.*", 0), F.lit(TOKENS), F.lit(0))
    start = F.struct(F.lit(0).alias("level"), F.lit(0).alias("seen"), F.lit(0).alias("end"))

    def step(acc, token):
        level = acc["level"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        seen = acc["seen"] + 1
        return F.struct(level.alias("level"), seen.alias("seen"), F.when((acc["end"] == 0) & (level == 0), seen).otherwise(acc["end"]).alias("end"))

    end = F.aggregate(tokens, start, step)["end"]
    return F.when(end > 0, F.array_join(F.slice(tokens, 1, end), ""))


def _valid(c: Column) -> Column:
    """Whether the text parses as a JSON object or array."""
    return F.coalesce(F.try_parse_json(c).isNotNull() & F.trim(c).rlike(r"^[\[{]"), F.lit(False))


def json_text(c: Column) -> Column:
    """JSON inside a fence, the whole text when it is JSON, else the first balanced object."""
    text = T.strip(F.coalesce(c, F.lit("")))
    fenced = T.strip(F.regexp_extract(text, r"(?s)^```[^\n]*\n(.*?)(?:```|$)", 1))
    body = F.when(fenced != "", fenced).otherwise(text)
    return F.when(_valid(body), body).otherwise(balanced_object(body))


def decisions(df: DataFrame, keys, payload: str = "payload", most_indices: int | None = None, most_threads: int | None = None) -> DataFrame:
    """One row per decision. Accepts {"matches": [...]} and the older {"name": {...}} form.

    ``seq`` orders payloads; the last decision for a row or name is the one that counts. All listed mails and
    threads are kept; 15 and 8 are the usual bounds of a prompt.
    """
    def upto(c, n):
        return c if n is None else F.slice(c, 1, n)

    j = df.select(*keys, "seq", json_text(F.col(payload)).alias("_j"))
    new = j.select(*keys, "seq", F.explode(F.from_json("_j", f"matches array<struct<{_ddl(MATCH)}>>")["matches"]).alias("m"), F.lit(None).cast("string").alias("_k"))
    old = j.select(*keys, "seq", F.explode(F.from_json("_j", "map<string,string>")).alias("_k", "_v")).where("_k <> 'matches'")
    old = old.select(*keys, "seq", F.from_json("_v", MATCH).alias("m"), "_k").where("_v LIKE '{%'")
    rows = new.unionByName(old)
    idx = F.filter(F.transform(upto(F.coalesce("m.matching_email_indices", F.array().cast("array<string>")), most_indices), lambda x: x.try_cast("long")), lambda x: x >= 0)
    ids = F.filter(F.transform(upto(F.coalesce("m.matching_thread_ids", F.array().cast("array<string>")), most_threads), T.strip), lambda x: x != "")
    status = M.model_status(F.col("m.status"))
    conf = F.coalesce(F.col("m.confidence").try_cast("double"), F.lit(0.5))
    out = rows.select(
        *keys, "seq", T.strip(F.col("m.row_id")).try_cast("long").alias("row_id"),
        T.strip(T.first_filled(F.col("m.document_name"), F.col("_k"))).alias("document_name"),
        status.alias("status"), idx.alias("email_indices"), F.array_distinct(ids).alias("thread_ids"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)).alias("confidence"),
        T.strip(F.coalesce("m.reasoning", F.lit(""))).alias("reasoning"),
        T.strip(T.first_filled(F.col("m.checklist_comment"), F.col("m.comment"))).alias("checklist_comment"),
        F.col("m.has_activity").alias("_ha"))
    implied = F.col("status").isNotNull() | (F.size("email_indices") > 0)
    flag = F.lower(T.strip(F.coalesce("_ha", F.lit(""))))
    return out.withColumn("has_activity", F.when(flag.isin(*lx.MATCH_TRUE), True).when(flag.isin(*lx.MATCH_FALSE), False).otherwise(implied)).drop("_ha").where(
        (F.col("document_name") != "") | F.col("row_id").isNotNull())


def _ddl(fields: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (f.split(" ") for f in fields.split(", ")))


def actionable_tasks(c: Column) -> Column:
    """Tasks of a model answer without the NONE ones."""
    tasks = F.from_json(c, "tasks array<struct<task_type: string, row_id: bigint>>")["tasks"]
    return F.filter(tasks, lambda x: x["task_type"] != "NONE")
