"""Conversation threads built from distributive aggregates, never from one list per thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.functions import dates as D
from dealweave.functions import mail as M
from dealweave.functions import text as T
from dealweave.operators import hot

EARLIEST = "0001-01-01 00:00:00"


def thread_members(mail: DataFrame, group=()) -> DataFrame:
    """Mails with activity, thread key and sort time. ``group`` columns scope the threads."""
    m = M.with_activity(mail)
    return m.withColumns({
        "thread_key": M.thread_key(),
        "sort_ts": F.coalesce(D.any_time(M.message_date()), F.lit(EARLIEST).cast("timestamp")),
        "clean_subject": T.thread_subject(F.col("subject")),
    })


def message_order() -> list[Column]:
    return [F.col("sort_ts"), F.col("email_idx")]


def hour_block() -> Column:
    """Blocks of one hour: monotone along the message order, small even in a huge thread."""
    return F.date_trunc("hour", F.col("sort_ts"))


def numbered_messages(members: DataFrame, group=()) -> DataFrame:
    """Position of every message in its thread."""
    return hot.numbered(members, [*group, "thread_key"], hour_block(), message_order(), "pos")


def build_threads(members: DataFrame, group=()) -> DataFrame:
    """One row per thread. Capped lists (participants, issues) are ranked rows gathered at the
    end; uncapped lists are counted here and available as rows from :func:`thread_items`."""
    keys = [*group, "thread_key"]
    at = F.struct("sort_ts", "email_idx")
    core = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.min(at).alias("first_at"),
        F.max(at).alias("last_at"),
        F.max_by("subject", F.when(T.squash(F.col("subject")) != "", at)).alias("_subject"),
        F.max_by("clean_subject", at).alias("_fallback"),
        F.min_by("event_date", at).alias("first_date"),
        F.max_by("event_date", at).alias("last_date"),
        F.max_by(T.first_filled(F.col("body_current"), F.col("body")), at).alias("_body"),
        F.max_by("attachments", at).alias("latest_attachments"),
        F.max("priority").alias("status_priority"),
        F.min("email_idx").alias("first_idx"),
    ).withColumns({
        "subject": T.first_filled(T.squash(F.col("_subject")), F.col("_fallback")),
        "latest_body_excerpt": F.substring(T.clean_body(F.col("_body")), 1, 260),
        "status_signal": M.status_name(F.col("status_priority")),
    }).withColumn("normalized_subject", F.lower(T.thread_subject(F.col("subject"))))
    people = hot.gathered(thread_items(members, "participants", group, 8), keys, "item", "participants")
    issues = hot.gathered(thread_items(members, "issues", group, 3), keys, "item", "issue_text", " || ")
    files = thread_items(members, "attachments", group).groupBy(*keys).agg(F.count(F.lit(1)).alias("attachment_count"))
    out = core.drop("_subject", "_fallback", "_body")
    for extra in (people, issues, files):
        out = out.join(extra, keys, "left")
    return out.withColumns({
        "participants": F.coalesce("participants", F.lit("")),
        "issue_text": F.coalesce("issue_text", F.lit("")),
        "attachment_count": F.coalesce("attachment_count", F.lit(0)),
        "issue_count": F.when(F.coalesce("issue_text", F.lit("")) == "", 0)
        .otherwise(F.size(F.split("issue_text", r" \|\| "))),
    })


def thread_items(members: DataFrame, what: str, group=(), k: int | None = None) -> DataFrame:
    """Distinct participants, attachments, folders or issues of each thread, first seen first."""
    arrays = {
        "participants": lambda: F.concat(
            F.array(T.squash(F.col("sender"))), T.split_people(F.col("recipients")), T.split_people(F.col("cc"))),
        "attachments": lambda: T.split_attachments(F.col("attachments")),
        "folders": lambda: F.array(T.squash(F.col("folder"))),
        "root_folders": lambda: F.array(T.squash(F.col("root_folder"))),
        "issues": lambda: F.col("issues"),
    }
    rows = members.select(
        *group, "thread_key", "sort_ts", "email_idx", F.posexplode(arrays[what]()).alias("at", "item"))
    return hot.first_distinct(rows, [*group, "thread_key"], "item", ["sort_ts", "email_idx", "at"], k)


def thread_order() -> list[Column]:
    """Newest day first, then thread id as text, descending."""
    return [F.desc(F.coalesce(F.to_date("last_at.sort_ts"), F.lit("0001-01-01").cast("date"))), F.desc("thread_id")]


def with_thread_ids(threads: DataFrame) -> DataFrame:
    """``thread-N`` by order of each thread's lowest mail index.

    The number of threads is the only global order needed; it is taken per block of indexes.
    """
    t = threads.withColumn("_one", F.lit(1))
    idx = F.col("first_idx")
    return (
        hot.numbered(t, ["_one"], hot.index_block(idx), [idx], "_n")
        .withColumn("thread_id", F.concat(F.lit("thread-"), F.col("_n").cast("string"))).drop("_n", "_one")
    )
