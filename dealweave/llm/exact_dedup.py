"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

The first pass over the texts yields two small columns, the length and the hash of a short prefix.
Lengths that occur once are settled, then pairs of length and prefix that occur once. What is
left is marked in a bitmap of fixed size, so that the second pass finds the surviving texts
without moving any text, and only those are hashed in full. Groups form on the 256-bit
digest; a bit set by chance costs one more digest and never changes the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.llm.registry import query, read
from dealweave.session import cut_lineage

SPACES = r"[\x20\x09-\x0D]+"
SALTS = 16


def normal(text: Column) -> Column:
    """Text with runs of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _slot(bits: int) -> Column:
    return F.pmod(F.xxhash64("_n", "_p"), F.lit(bits)) + 1


def _sieve(keys: DataFrame, bits: int) -> DataFrame:
    """Bitmap of the surviving (length, prefix) pairs: at most bits / 32768 rows of 4 KB."""
    slot = keys.select(_slot(bits).alias("_slot"))
    return slot.groupBy(F.bitmap_bucket_number("_slot").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_map"))


def _bit_set(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
                 prefix_chars: int = 256, sieve_bits: int = 1 << 27) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept`` and the columns in ``carry``.

    Texts are equal when ``normal`` makes them identical. ``keep_id`` is the smallest id of the group,
    ``kept`` says that the row has it. Null text is empty text. A null id is kept only in a group
    without any other id. Rows that repeat an id count in ``group_size`` and share its decision.
    An empty table gives no rows; columns that are not named are ignored. ``sieve_bits`` bounds
    the broadcast bitmap (16 MB by default) and changes the work, never the result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), normal(F.col(text_col)).alias("_norm"), *carry)
    sized = rows.select("_id", "_norm", F.octet_length("_norm").alias("_n"),
                        F.xxhash64(F.substring("_norm", 1, prefix_chars)).alias("_p"), *carry)

    pairs = sized.groupBy("_n", "_p").agg(F.count(F.lit(1)).alias("_rows"))
    lengths = pairs.groupBy("_n").agg(F.sum("_rows").alias("_rows")).where("_rows > 1").select("_n")
    survivors = pairs.join(lengths, "_n", "left_semi").where("_rows > 1")

    sieve = F.broadcast(_sieve(survivors, sieve_bits))  # at most sieve_bits / 8 bytes
    placed = sized.withColumn("_slot", _slot(sieve_bits)).withColumn("_bucket", F.bitmap_bucket_number("_slot"))
    survives = _bit_set(F.col("_map"), F.bitmap_bit_position("_slot"))
    hashed = cut_lineage(placed.join(sieve, "_bucket", "left").select(
        "_id", "_n", F.when(F.coalesce(survives, F.lit(False)), F.sha2("_norm", 256)).alias("_full"), *carry))

    alone = hashed.where("_full IS NULL").select(
        F.col("_id").alias("doc_id"), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *carry)
    groups = hashed.where("_full IS NOT NULL").groupBy("_n", "_full").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # the rows of a large group meet their group in SALTS places
    groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = hashed.where("_full IS NOT NULL").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    grouped = salted.join(groups, ["_n", "_full", "_salt"]).select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), *carry)
    return alone.unionByName(grouped)


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""


@query("op7_exact_dedup", SQL)
def op7(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(normal(F.col("text")), 256))
    return exact_groups(docs, carry=("text_sha256",))
