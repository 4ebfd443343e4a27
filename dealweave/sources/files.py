"""File scans and sinks: mail and calendar exports, corpus listing, index, packets, reports."""

from __future__ import annotations

import re

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealweave.functions import text as T
from dealweave.sources import tables

MAIL_JSON = (
    "email_idx bigint, subject string, body string, sender string, `from` string, sender_email string, `to` string, "
    "cc string, attachments array<string>, date string, date_sent string, date_received string, folder string, "
    "root_folder string, store string, is_sent_folder string, has_attachments string, entry_id string, "
    "conversation_id string, conversation_topic string"
)
FIRST_BYTES = 2048  # fixed value: sample that decides delimiter and encoding


def sniff(spark: SparkSession, path: str) -> tuple[str, str]:
    """Delimiter and encoding from the first bytes of one file of the family."""
    head = (
        spark.read.format("binaryFile").load(path).orderBy("path").limit(1)
        .select(F.expr(f"substring(content, 1, {FIRST_BYTES})").alias("b")).first()
    )
    raw = bytes(head["b"]) if head else b""
    try:
        text, encoding = raw.decode("utf-8-sig"), "UTF-8"
    except UnicodeDecodeError as e:
        # a character cut at the sample's end is not a decoding error
        encoding = "UTF-8" if e.start >= len(raw) - 3 else "ISO-8859-1"
        text = raw.decode(encoding, errors="ignore")
    try:
        return csv.Sniffer().sniff(text, delimiters=",;\t").delimiter, encoding
    except csv.Error:
        return ",", encoding


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    if sep is None or encoding is None:
        found = sniff(spark, path)
        sep, encoding = sep or found[0], encoding or found[1]
    return spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=True, quote='"', escape='"')


def read_mail_csv(spark: SparkSession, path: str) -> DataFrame:
    return tables.mail_table(read_csv(spark, path))


def read_mail_csv_first(spark: SparkSession, path: str) -> DataFrame:
    return tables.mail_table_first(read_csv(spark, path))


def mail_from_json(texts: DataFrame, value: str = "value") -> DataFrame:
    """Mails of JSON texts holding {"emails": [...]} or a bare list."""
    ddl = ", ".join(f"{n}: {t}" for n, t in (f.rsplit(" ", 1) for f in MAIL_JSON.split(", ")))
    wrapped = F.when(F.ltrim(value).startswith("["), F.concat(F.lit('{"emails": '), F.col(value), F.lit("}"))).otherwise(F.col(value))
    rows = texts.select(F.explode(F.from_json(wrapped, f"emails array<struct<{ddl}>>")["emails"]).alias("m")).select("m.*")
    return rows.withColumns({
        "sender": T.first_filled(F.coalesce("from", F.lit("")), F.coalesce("sender", F.lit("")), F.coalesce("sender_email", F.lit(""))),
        "recipients": F.col("to"),
        "attachments": F.array_join("attachments", "; "),
    }).drop("from", "to", "sender_email")


def read_mail_json(spark: SparkSession, path: str) -> DataFrame:
    return mail_from_json(spark.read.text(path, wholetext=True))


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    return read_mail_json(spark, path) if path.lower().endswith(".json") else read_mail_csv_first(spark, path)


def read_calendar_csv(spark: SparkSession, path: str) -> DataFrame:
    return tables.calendar_table(read_csv(spark, path))


def read_ics(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return tables.ics_events(texts, ["file"])


def read_role_csv(spark: SparkSession, path: str) -> DataFrame:
    return tables.role_table(read_csv(spark, path))


def list_documents(spark: SparkSession, root: str, skip: str = "_output") -> DataFrame:
    """Document files below ``root`` without earlier outputs, with a name relative to it. File
    contents are never read: only the listing columns are selected."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{[pP][dD][fF],[dD][oO][cC][xX]}").load(root)
    )
    rel = F.regexp_replace("path", rf"^.*?{re.escape(root.rstrip('/'))}/", "")
    return files.select("path", rel.alias("name"), "length").where(~F.contains("name", F.lit(skip)))


# ---------------------------------------------------------------- sinks
def write_index(index: DataFrame, path: str) -> None:
    """Master signature index, range-partitioned by its sort order."""
    index.orderBy("signer_name", "doc_id", "page_num").write.mode("overwrite").parquet(path)


def write_packets(index: DataFrame, path: str, buckets: int | None = None) -> None:
    """One folder per signer, or ``buckets`` folders with whole signers sorted inside where there are too many
    signers for folders. Rows are spread by signer and document so that one signer with a
    third of all pages is written by many tasks, in several files."""
    if buckets:
        index = index.withColumn("packet_bucket", F.pmod(F.xxhash64("signer_name"), F.lit(buckets)).cast("int"))
        spread = index.repartition("packet_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8)))
        spread.sortWithinPartitions("packet_bucket", "signer_name", "doc_id", "page_num").write.mode("overwrite").partitionBy("packet_bucket").parquet(path)
        return
    spread = index.repartition("signer_name", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    spread.sortWithinPartitions("signer_name", "doc_id", "page_num").write.mode("overwrite").partitionBy("signer_name").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """Match report as JSON lines, one folder per section."""
    report.write.mode("overwrite").partitionBy("section").json(path)


def write_history(usage: DataFrame, path: str) -> None:
    usage.write.mode("overwrite").option("header", True).csv(path)
