"""Telemetry events as a stream: ingest, routing, queue flush, daily usage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dealweave import lexicon as lx
from dealweave.functions import text as T
from dealweave.operators import hot
from dealweave.operators.documents import collection_name, usage_measures
from dealweave.session import prepare, shared_folder

RAW = "collection string, event_type string, app_version string, machine_id string, timestamp string, payload string, user_agent string"


def read_events(spark: SparkSession, folder: str, schema: str = RAW) -> DataFrame:
    return prepare(spark).readStream.schema(schema).json(folder)


def normalized_events(raw: DataFrame, keep=()) -> DataFrame:
    """Trimmed fields, default event type, payload only when it is a JSON object, receive time."""
    def text(name):
        return T.strip(F.coalesce(F.col(name), F.lit(""))) if name in raw.columns else F.lit("")

    is_object = F.coalesce(F.trim("payload").rlike(r"(?s)^\{.*\}$") & F.try_parse_json("payload").isNotNull(), F.lit(False))
    return raw.select(
        *keep, collection_name(F.col("collection")).alias("collection"), T.first_filled(text("event_type"), F.lit("event")).alias("event_type"),
        text("app_version").alias("app_version"), text("machine_id").alias("machine_id"), text("timestamp").alias("client_timestamp"),
        F.when(is_object, F.col("payload")).otherwise("{}").alias("payload"), text("user_agent").alias("user_agent"),
        F.current_timestamp().alias("received_at"))


def ingest(raw: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append every event, one folder per collection, exactly once per checkpoint."""
    return (
        normalized_events(raw).writeStream.format("parquet").partitionBy("collection").option("path", out)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


SHELF = 64  # chunks of each collection that one folder of a queue under way holds, at least
LEDGER = "batch_id long, collection string, chunk long, rows long"


class ChunkFailed(RuntimeError):
    """A chunk was not accepted; ``written`` rows of the queue were, those of earlier runs included."""

    def __init__(self, collection: str, chunk: int, written: int, reason: str):
        super().__init__(f"chunk {chunk} of {collection}: {reason}")
        self.collection, self.chunk, self.written = collection, chunk, written


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Committed chunks. A folder without any is an empty ledger."""
    try:
        return spark.read.schema(LEDGER).json(folder)
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def numbered_chunks(queue: DataFrame, order: str, chunk: int = lx.RETRY_CHUNK) -> DataFrame:
    """The queue with its chunk number from 0 within each collection, by the whole number ``order`` that identifies a row."""
    placed = hot.numbered(queue, ["collection"], hot.index_block(F.col(order)), [order], "_position")
    return placed.withColumn("chunk", F.floor((F.col("_position") - 1) / chunk).cast("long")).drop("_position")


def flush_chunks(queue: DataFrame, order: str, send: Callable[[str, int, list[dict]], None], folder: str, batch_id: int = 0,
                 chunk: int = lx.RETRY_CHUNK, wave: int = 1) -> int:
    """Send a queue in chunks, per collection in the order of ``order``; the number of rows written.

    ``send(collection, chunk, rows)`` runs in a task with the rows of one chunk (``chunk`` at most) and raises if they are not accepted. A chunk is committed to the
    ledger once all before it are. At the first failure of a collection nothing of it is sent any more, the chunks before stay committed and
    :class:`ChunkFailed` is raised; the next run of the same batch starts with the failed chunk. With a ``wave`` above 1 that many chunks of each collection are under way
    at once, so chunks after a failed one may have been sent and are sent again: ``send`` gets the chunk number to recognise them.
    What is left of the queue goes once to the shared folder, by consecutive chunks, and every wave reads only its own.
    """
    spark = queue.sparkSession
    last = queue.groupBy("collection").agg((F.ceil(F.count(F.lit(1)) / chunk) - 1).alias("last"))
    done = ledger(spark, folder).where(F.col("batch_id") == batch_id).groupBy("collection").agg(F.max("chunk").alias("done"), F.sum("rows").alias("rows"))
    state = {r.collection: r for r in last.join(done, "collection", "left").collect()}  # one row for each collection, a fixed list
    written, at = sum(r.rows or 0 for r in state.values()), {c: -1 if r.done is None else r.done for c, r in state.items()}

    def deliver(key, table):
        collection, number = (k.as_py() for k in key)
        reason = None
        try:
            send(collection, number, table.drop_columns(["collection", "chunk"]).sort_by(order).to_pylist())
        except Exception as failed:  # reported to the caller, who stops
            reason = f"{type(failed).__name__}: {failed}"
        return pa.table({"collection": [collection], "chunk": pa.array([number], pa.int64()), "rows": pa.array([table.num_rows], pa.int64()), "reason": pa.array([reason], pa.string())})

    shelf = wave * -(-SHELF // wave)
    start, shelves, turn = dict(at), f"{shared_folder(spark)}/queue-{uuid.uuid4().hex}", 0
    if any(at[c] < r.last for c, r in state.items()):
        parts = numbered_chunks(queue, order, chunk)
        before = F.lit(None).cast("long")
        for c, n in start.items():
            before = F.when(F.col("collection") == c, F.lit(n)).otherwise(before)
        left = parts.withColumn("shelf_no", F.floor((F.col("chunk") - before - 1) / shelf).cast("long")).where("shelf_no >= 0")
        left.repartition("shelf_no").write.partitionBy("shelf_no").parquet(shelves)
        kinds = parts.schema

    while any(at[c] < r.last for c, r in state.items()):
        parts = spark.read.schema(kinds).parquet(f"{shelves}/shelf_no={turn * wave // shelf}")
        turn += 1
        asked = F.lit(False)
        for c, r in state.items():
            asked = asked | ((F.col("collection") == c) & F.col("chunk").between(at[c] + 1, at[c] + wave))
        sent = parts.where(asked).groupBy("collection", "chunk").applyInArrow(deliver, "collection string, chunk long, rows long, reason string")
        answers = sorted(sent.collect(), key=lambda r: (r.collection, r.chunk))  # at most ``wave`` rows for each collection
        if not answers:
            raise RuntimeError("the queue changed while it was sent")
        failed, commit = {}, []
        for a in answers:
            if a.reason is not None:
                failed.setdefault(a.collection, a)
            elif a.collection not in failed:
                commit.append((batch_id, a.collection, a.chunk, a.rows))
                at[a.collection], written = a.chunk, written + a.rows
        if commit:
            spark.createDataFrame(commit, LEDGER).coalesce(1).write.mode("append").json(folder)
        if failed:
            first = failed[min(failed)]
            raise ChunkFailed(first.collection, first.chunk, written, first.reason)
    return written


def flush(raw: DataFrame, order: str, send: Callable[[str, int, list[dict]], None], folder: str, checkpoint: str, wave: int = 1) -> StreamingQuery:
    """Flush a stream of events: every micro-batch is a queue. A failed chunk fails the query; when it is started again, Spark repeats the
    batch with its number and :func:`flush_chunks` goes on with the chunk that failed."""
    def write(batch: DataFrame, batch_id: int) -> None:
        flush_chunks(batch, order, send, folder, batch_id, wave=wave)

    return (
        normalized_events(raw, keep=[order]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())


def daily_usage(usage: DataFrame, watermark: str | None = "1 hour") -> DataFrame:
    """Usage per day and feature. The watermark bounds the state of a stream; batch needs none."""
    u = usage.withColumn("event_ts", F.col("event_ts").cast("timestamp"))  # event time needs a zoned type
    u = u.withWatermark("event_ts", watermark) if watermark and usage.isStreaming else u
    g = u.groupBy(F.window("event_ts", "1 day"), "feature").agg(*usage_measures())
    return g.select(F.col("window.start").alias("day"), *[c for c in g.columns if c != "window"])
