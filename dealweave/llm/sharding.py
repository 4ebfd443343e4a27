"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Rows are dealt into source blocks, and the matrix says how many rows of each source block go to each
target cell. Its rows are multivariate hypergeometric draws from what the cells still lack, so column sums are
the exact cell sizes and, with a random order inside the blocks, every arrangement is equally likely. Each block permutes its
rows and hands out runs of them by its row of the matrix, the rows are exchanged, and each cell
permutes again. A shard is a run of cells, so no task ever holds a whole shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealweave.llm.registry import query, read

BLOCKS = 256
NUMPY_ROWS = 10**9  # numpy draws from fewer


def drawn(good: int, bad: int, picked: int, rng: np.random.Generator) -> int:
    """Hypergeometric draw for populations of any size, by inversion of the distribution about its mode.

    Neighbouring probabilities have simple ratios; beyond 12 standard deviations and 20 nothing of double precision is left."""
    total = good + bad
    least, most = max(0, picked - bad), min(good, picked)
    mode = (picked + 1) * (good + 1) // (total + 2)
    spread = int(12 * np.sqrt(picked * (good / total) * (bad / total) * ((total - picked) / max(total - 1, 1)))) + 20
    low, high = max(least, mode - spread), min(most, mode + spread)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) * (picked - k)) - np.log((k + 1) * (bad - picked + k + 1))
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    sums = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def communication_matrix(block_rows: list[int], cell_rows: list[int], seed: int) -> np.ndarray:
    """Rows by source block, columns by target cell; sums are exactly the two arguments."""
    rng = np.random.default_rng(seed)
    left = np.array(cell_rows, dtype=np.int64)
    out = np.zeros((len(block_rows), len(cell_rows)), dtype=np.int64)
    for i, n in enumerate(block_rows):
        if left.sum() < NUMPY_ROWS:
            out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        else:  # the same law, cell by cell
            rest = int(left.sum())
            for c, rows in enumerate(left.tolist()):
                rest -= rows
                out[i, c] = drawn(rows, rest, n, rng) if rows and rest and n else min(rows, n)
                n -= int(out[i, c])
        left -= out[i]
    return out


def cell_sizes(total: int, shards: int, rows_per_block: int) -> tuple[list[int], list[int]]:
    """Row counts of all cells and the shard of each; shard sizes differ by one at most."""
    sizes, owner = [], []
    for s in range(shards):
        rows = total // shards + (s < total % shards)
        cells = max(1, -(-rows // rows_per_block))
        sizes += [rows // cells + (c < rows % cells) for c in range(cells)]
        owner += [s] * cells
    return sizes, owner


def block_size(total: int) -> int:
    """Rows of a block: 4,096, or more where that would make more than about ``BLOCKS`` blocks."""
    return max(4096, -(-total // BLOCKS))


def shuffled_shards(rows: DataFrame, key: str = "doc_id", shards: int = 8, seed: int = 0, rows_per_block: int | None = None) -> DataFrame:
    """All columns of ``rows`` (those named ``shard`` or ``slot`` are replaced) with ``shard`` and ``slot``.

    Law ``rows``: shard sizes are at most one row apart, slots run from 0 without a gap, and every arrangement
    of the rows is equally likely over seeds. The block of a row and the order inside blocks and cells are hashes of
    (seed, key), so a recomputed task deals the same rows again; rows that share a key are told
    apart by all their other columns, and rows equal in all columns are interchangeable. Equal texts are not
    kept together: that law and a uniform shuffle exclude each other. Null keys are ordinary keys. An empty
    table gives no rows. A block has ``rows_per_block`` rows, by default ``block_size``: the driver holds the matrix and
    a tuple for each of its cells, at most 256 times 264 with 8 shards, however many rows there are. Blocks and cells are ordered by
    windows, which spill to disk.
    """
    rows = rows.drop("shard", "slot")
    names = rows.columns

    ties = [F.col(c) for c in (key, *[c for c, kind in rows.dtypes if c != key and "map<" not in kind and "variant" not in kind])]

    def mixed(salt: int) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(salt), *ties)

    total = rows.count()
    rows_per_block = rows_per_block or block_size(total)
    blocks = max(1, -(-total // rows_per_block))
    placed = rows.withColumn("_block", F.pmod(mixed(1), F.lit(blocks)).cast("int"))
    counts = {r["_block"]: r["n"] for r in placed.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per block
    sizes, owner = cell_sizes(total, shards, rows_per_block)
    block_rows = [counts.get(b, 0) for b in range(blocks)]
    matrix = communication_matrix(block_rows, sizes, seed)

    spark = rows.sparkSession
    starts = np.cumsum(matrix, axis=1) - matrix
    runs = [(b, c, int(starts[b, c]), int(matrix[b, c])) for b, c in zip(*map(np.ndarray.tolist, np.nonzero(matrix)))]
    deal = spark.createDataFrame(runs, "_block int, _cell int, _start long, _rows long")
    deal = deal.select("_block", "_cell", F.explode(F.sequence("_start", F.col("_start") + F.col("_rows") - 1)).alias("_k"))
    first_slot = [int(x) for x in np.cumsum(sizes) - sizes]
    shard_start = [first_slot[owner.index(s)] for s in range(shards)]
    cells = spark.createDataFrame([(c, owner[c], first_slot[c] - shard_start[owner[c]]) for c in range(len(sizes))], "_cell int, shard int, _first long")

    # permute inside the block and hand out runs by the matrix, exchange, permute inside the cell
    order = Window.partitionBy("_block").orderBy(mixed(2), *ties)
    sent = placed.withColumn("_k", (F.row_number().over(order) - 1).cast("long")).join(deal, ["_block", "_k"])
    again = Window.partitionBy("_cell").orderBy(mixed(3), *ties)
    return (sent.withColumn("_at", F.row_number().over(again) - 1).join(cells, "_cell")
            .select(*names, "shard", (F.col("_first") + F.col("_at")).cast("long").alias("slot")))


@query("op6_sharding")
def op6(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffled_shards(sized, seed=17).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
