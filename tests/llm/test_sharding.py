import numpy as np
from pyspark.sql import functions as F

from dealweave.llm.sharding import block_size, cell_sizes, communication_matrix, drawn, shuffled_shards
from tests.llm.helpers import documents, empty, rows


def test_matrix_has_exact_sums():
    sizes, owner = cell_sizes(1003, 8, 50)
    blocks = [200, 300, 0, 503]
    m = communication_matrix(blocks, sizes, 3)
    assert m.sum(axis=1).tolist() == blocks and m.sum(axis=0).tolist() == sizes
    by = np.bincount(owner, sizes)
    assert by.max() - by.min() <= 1


def test_shards_are_even_gapless_and_complete(spark):
    table = documents(spark, [(i, None if i % 3 else "x") for i in range(2003)] + [(None, "n"), (5, None), (5, None)])
    got = shuffled_shards(table.withColumn("shard", F.lit("clash")), rows_per_block=100)
    out = rows(got, "shard", "slot")
    sizes = np.bincount([s for s, _ in out], minlength=8)
    assert len(out) == 2006 and sizes.max() - sizes.min() <= 1
    assert out == [(s, k) for s in range(8) for k in range(sizes[s])]
    assert sorted(got.select(F.coalesce("doc_id", F.lit(-1))).toPandas().iloc[:, 0]) == sorted([*range(2003), -1, 5, 5])
    again = shuffled_shards(table.repartition(7), rows_per_block=100)
    key = F.coalesce("doc_id", F.lit(-1)).alias("k")
    assert sorted(map(tuple, again.select(key, "shard", "slot").collect())) == sorted(map(tuple, got.select(key, "shard", "slot").collect()))


def test_every_shard_is_equally_likely(spark):
    table = spark.range(200).withColumnRenamed("id", "doc_id")
    counts = np.zeros((2, 4))
    for seed in range(12):
        for i, s in rows(shuffled_shards(table, shards=4, seed=seed, rows_per_block=60), "doc_id", "shard"):
            counts[i % 2, s] += 1
    assert (abs(counts / 12 - 25) < 6).all()  # expected 25 a cell, standard error about 1


def test_small_and_empty_tables(spark):
    assert shuffled_shards(empty(spark)).count() == 0
    assert rows(shuffled_shards(documents(spark, [(1, "a")])), "slot") == [(0,)]


def test_what_the_driver_holds_does_not_grow_with_the_rows():
    for total in (10**6, 5 * 10**6, 33 * 10**6, 10**9):
        rows_per_block = block_size(total)
        assert -(-total // rows_per_block) * len(cell_sizes(total, 8, rows_per_block)[0]) <= 256 * 264


def test_matrix_of_more_rows_than_numpy_draws_from():
    total = 10**10 + 7
    size = block_size(total)
    cells, _ = cell_sizes(total, 8, size)
    blocks = [total // 200 + (b < total % 200) for b in range(200)]
    m = communication_matrix(blocks, cells, 3)
    assert m.sum(axis=1).tolist() == blocks and m.sum(axis=0).tolist() == cells and m.min() >= 0
    want = np.outer(blocks, cells) / total
    apart = ((m - want) ** 2 / want).sum() / ((len(blocks) - 1) * (len(cells) - 1))
    assert 0.95 < apart < 1.05  # chi-square over degrees of freedom, standard error 0.006


def test_draws_have_the_hypergeometric_law():
    rng = np.random.default_rng(5)
    got = np.array([drawn(30, 50, 20, rng) for _ in range(20_000)])
    other = rng.hypergeometric(30, 50, 20, 200_000)
    assert got.min() >= 0 and got.max() <= 20
    a, b = (np.bincount(x, minlength=21) / len(x) for x in (got, other))
    assert abs(a - b).max() < 0.015
    assert {drawn(3, 2, 5, rng) for _ in range(9)} == {3} and {drawn(2, 1, 2, rng) for _ in range(200)} == {1, 2}
