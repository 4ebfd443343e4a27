"""Near-duplicates by SimHash fingerprints and pivot distance tables.

A fingerprint takes the majority, bit by bit, of the 64-bit hashes of a text's word shingles. For
each distinct fingerprint a table row holds its Hamming distances to reference fingerprints (the pivots), split by blocks of bits:
distances within a block add up to the distances of the whole. Two fingerprints that differ in at most r bits
agree in all but r blocks, so their table rows have coordinate difference 0 there; equal rows in
the remaining blocks are the key under which candidates meet. A pair whose whole distances to some pivot differ by more
than r is discarded (triangle inequality); the survivors are verified by their own distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.llm.components import connected
from dealweave.llm.registry import query, read
from dealweave.session import cut_lineage

SEED = 42
PIVOTS = 16  # distances within a block of at most 15 bits take 4 bits: one long for each block
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
PLACES = np.arange(8, dtype=np.int64) * 256
FEW = 32  # fingerprints under one key that are compared as pairs


def fingerprint(text: str, words: int) -> int:
    """Unsigned fingerprint of one whole text."""
    cut = text.encode().lower().split()  # bytes: lower-cases A-Z and splits at ASCII white space only
    if not cut:
        return 0
    shingles = map(b" ".join, zip(*[cut[i:] for i in range(words)])) if len(cut) > words else [b" ".join(cut)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)
    spread = hashes.view(np.uint8).reshape(-1, 8) + PLACES
    ones = (np.bincount(spread.ravel(), minlength=2048).reshape(8, 256) @ BITS).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, fp``: fingerprint as signed long. Null text counts as empty, which has fingerprint zero; a text of
    fewer words is one shingle. One row per input row, without a shuffle; other columns are ignored."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints, as signed longs."""
    return [_signed(xxhash.xxh64_intdigest(str(i), SEED)) for i in range(count)]


def block_masks(radius: int) -> list[int]:
    """Disjoint blocks of bits. With three blocks more than ``radius``, some three blocks of a linked pair are equal."""
    count = max(radius + 3, 5)
    edges = [64 * i // count for i in range(count + 1)]
    return [_signed(((1 << b) - 1) & ~((1 << a) - 1)) for a, b in zip(edges, edges[1:])]


def distance_table(prints: DataFrame, masks: list[int]) -> DataFrame:
    """Adds ``_blocks`` (per block, the distances to all pivots in one long) and ``_coords`` (distances of the whole)."""
    def to(p: int, mask: int = -1) -> Column:
        return F.bit_count(F.col("fp").bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(mask)))

    def row(mask: int) -> Column:
        out = F.lit(0).cast("long")
        for i, p in enumerate(pivots()):
            out = out.bitwiseOR(F.shiftleft(to(p, mask).cast("long"), 4 * i))
        return out

    return prints.withColumns({"_blocks": F.array(*[row(m) for m in masks]), "_coords": F.array(*[to(p).cast("byte") for p in pivots()])})


def near_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``a, b`` (a < b): links between rows of ``id, fp`` (ids distinct). Together they connect all chains of rows in which
    neighbours differ in at most ``radius`` bits; no link is longer than twice half the radius, rounded up.

    A key under which up to ``FEW`` rows meet gives all its pairs to the pivot test. Under a fuller key
    (a large group of near copies) rows meet at every value within half the radius of their fingerprint instead: two of them
    have such a value in common if they differ in at most ``radius`` bits, so each is linked with the smallest id there and
    no pairs are formed. For an even radius this is exact. The radius is 4 at most.
    """
    if not 1 <= radius <= 4:
        raise ValueError("a radius from 1 to 4 is supported")
    masks = block_masks(radius)
    table = cut_lineage(distance_table(prints.select("id", "fp"), masks))
    sets = list(combinations(range(len(masks)), len(masks) - radius))
    keys = F.array(*[F.xxhash64(F.lit(n), *[F.col("_blocks")[i] for i in s]) for n, s in enumerate(sets)])
    keyed = table.select("id", "fp", "_coords", F.explode(keys).alias("_key"))
    load = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = keyed.join(load, "_key")

    few = met.where(F.col("_n") <= FEW)
    left = few.select("_key", F.col("id").alias("a"), F.col("fp").alias("_fa"), F.col("_coords").alias("_ca"))
    right = few.select("_key", F.col("id").alias("b"), F.col("fp").alias("_fb"), F.col("_coords").alias("_cb"))
    apart = F.forall(F.zip_with("_ca", "_cb", lambda x, y: F.abs(x - y)), lambda d: d <= radius)
    pairs = left.join(right, "_key").where("a < b").where(apart)
    pairs = pairs.where(F.bit_count(F.col("_fa").bitwiseXOR(F.col("_fb"))) <= radius).select("a", "b").distinct()

    def flipped(*bits: Column) -> Column:
        return reduce(lambda x, i: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)), bits, F.col("fp"))

    places = F.sequence(F.lit(0), F.lit(63))
    around = F.concat(F.array("fp"), F.transform(places, lambda i: flipped(i)))
    if radius > 2:  # values two bits away
        around = F.concat(around, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.transform(F.sequence(i + 1, F.lit(63)), lambda j: flipped(i, j)))))
    full = met.where(F.col("_n") > FEW).select("id", "fp").distinct()
    full = full.repartition("id", "fp")  # dealt evenly before each becomes many values
    values = full.select("id", F.explode(around).alias("_value"))
    first = values.groupBy("_value").agg(F.min("id").alias("_first"))
    stars = values.join(first, "_value").where("_first < id").select(F.col("_first").alias("a"), F.col("id").alias("b")).distinct()
    return pairs.unionByName(stars).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fp, component_id``: one row per input row; ``component_id`` is the smallest id that links reach.

    Equal fingerprints are one node, so copies never meet as pairs. Rows with a null id have the component of their
    fingerprint, null if no other row has it; repeated rows stay. An empty table gives no rows.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, words))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("_first"))
    links = near_links(nodes.select(F.col("fp").alias("id"), "fp"), radius)
    by = connected(links).select(F.col("node").alias("fp"), F.col("component").alias("_root"))
    rooted = nodes.join(by, "fp", "left").select("fp", "_first", F.coalesce("_root", "fp").alias("_root"))
    least = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    of_print = rooted.join(least, "_root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


@query("op1_simhash")
def op1(spark, sf_dir):
    return near_groups(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
