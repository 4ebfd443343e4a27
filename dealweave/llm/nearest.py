"""Nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes smallest distance: stored vectors are scaled by the largest norm and get one more component that fills them up to
length one; queries have length one and nothing there. A table hashes by several Gaussian projections cut into steps of one width (Gaussians are
2-stable: a projection of the difference of two vectors is normal with their distance as deviation). A query visits its own bucket and
perturbed ones around it in the order of the estimated chance that a neighbour lies there, until the chances add up to the table's share
of the wanted recall. There is no cap on buckets or visits: large buckets and many visitors meet in blocks of bounded size.
What a bucket holds is ranked by the exact inner product. The likeliest buckets are visited first; of the others a block passes on only
what is no worse than the k-th best found there. The best of all tables are the result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealweave.llm.registry import query, read
from dealweave.session import cut_lineage

SAMPLE = 2_048  # vectors that the index is fitted on
TABLES = 2
RECALL = 0.94  # estimated chance to visit a neighbour's bucket in some table
BUCKET = 512  # rows that a bucket holds on average
FIRST = 0.2  # chance of the buckets that are visited first
STEP = 2.0  # width of a hash step in deviations of the data
BLOCK = 1 << 18  # components on either side of a block
SEED = 13


# ---------------------------------------------------------------- vectors
def valid(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` of the rows that take part: id not null, vector not null, not zero, all components finite."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def matrix(vectors: pa.Array) -> np.ndarray:
    flat = np.asarray(vectors.flatten(), np.float64)
    return flat.reshape(len(vectors), -1)


def scaled(x: np.ndarray, largest: float) -> np.ndarray:
    """Stored vectors as points of length one."""
    x = x / largest
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]])


def pointed(q: np.ndarray) -> np.ndarray:
    """Queries as points of length one."""
    q = q / np.abs(q).max(axis=1, keepdims=True)
    return np.hstack([q / np.sqrt((q * q).sum(axis=1))[:, None], np.zeros((len(q), 1))])


# ---------------------------------------------------------------- index
class Index:
    """Projections, step widths and the distance of neighbours, from a bounded sample."""

    def __init__(self, sample: np.ndarray, largest: float, rows: int, k: int, tables: int, bucket: int):
        points, dim = scaled(sample, largest), sample.shape[1] + 1
        rng = np.random.default_rng(SEED)
        # about three steps of a function are in use
        self.functions = min(max(1, round(math.log(max(rows / bucket, 1)) / math.log(3))), 12)
        count, made = self.functions * tables, []
        while sum(len(m) for m in made) < count:  # orthogonal within each set of as many as there are components
            made.append(np.linalg.qr(rng.normal(size=(dim, dim)))[0].T * math.sqrt(dim))
        self.largest, self.tables = largest, tables
        self.a = np.vstack(made)[:count].T
        self.deviation = max(float(np.sqrt(np.mean((points - points.mean(axis=0)) ** 2) * dim)), 1e-9)
        self.width = STEP * self.deviation
        self.shift = rng.uniform(0, 1, size=count)
        # the k-th neighbour among all rows is no farther than the sample's neighbour of the same share, which is at least the nearest one
        rank = min(max(1, math.ceil(k * len(sample) / max(rows, 1))), max(len(sample) - 1, 1))
        if len(sample) > 1:
            asked = pointed(sample[:256])
            apart = np.sort(2 - 2 * asked @ points.T, axis=1)[:, min(rank, points.shape[0] - 1)]
            self.near = float(np.sqrt(np.maximum(np.quantile(apart, 0.75), 1e-12))) / self.width
        else:
            self.near = 1.0

    def places(self, points: np.ndarray) -> np.ndarray:
        return points @ self.a / self.width + self.shift

    def codes(self, cells: np.ndarray) -> np.ndarray:
        """One number for the cells of a table: 5 bits a function, 60 at most."""
        return ((np.clip(cells, -16, 15) + 16).astype(np.int64) << (5 * np.arange(cells.shape[1], dtype=np.int64))).sum(axis=1)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        cells = np.floor(self.places(scaled(x, self.largest)))
        return np.stack([self.codes(cells[:, t * self.functions:(t + 1) * self.functions]) for t in range(self.tables)], axis=1)

    def visits(self, q: np.ndarray, share: float) -> list[list[tuple[np.ndarray, int]]]:
        """Per query and table the buckets to visit in the order of estimated success, and how many of them come first."""
        places = self.places(pointed(q))
        reach = np.arange(-16, 16)
        out = []
        for row in places:
            # chance of each cell: a neighbour's place is normal around the query's own
            edges = _normal((np.arange(-16, 17)[None, :] - row[:, None]) / max(self.near, 1e-9))
            chance = np.diff(edges, axis=1)
            chance[:, 0] += edges[:, 0]  # the outermost cells reach on without end
            chance[:, -1] += 1 - edges[:, -1]
            order = np.argsort(-chance, axis=1, kind="stable")
            best = np.take_along_axis(chance, order, axis=1)
            out.append([self._walk(reach[order[s]], best[s], share) for s in (slice(t * self.functions, (t + 1) * self.functions) for t in range(self.tables))])
        return out

    def _walk(self, cells: np.ndarray, chance: np.ndarray, share: float) -> tuple[np.ndarray, int]:
        """Cells of the functions in falling order of the product of their chances, until these add up to ``share``; the number after which they add up to
        ``FIRST``."""
        with np.errstate(divide="ignore"):
            logs = np.log(chance).tolist()
        count, found, total, first = len(logs), [], 0.0, 0
        heap = [(-sum(c[0] for c in logs), 0, (0,) * count)]
        while heap and total < share:
            cost, last, at = heapq.heappop(heap)
            if cost == math.inf:
                break
            found.append([cells[i, j] for i, j in enumerate(at)])
            first += total < FIRST
            total += math.exp(-cost)
            for i in range(last, count):  # every set of steps is reached once: by its first functions first
                j = at[i] + 1
                if j < len(logs[i]):
                    heapq.heappush(heap, (cost + logs[i][j - 1] - logs[i][j], i, at[:i] + (j,) + at[i + 1:]))
        return self.codes(np.array(found)), first


def _normal(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x.ravel()]).reshape(x.shape)


# ---------------------------------------------------------------- search
def best_of_block(queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """``query_id, row_id, score`` of each query's k best rows of other ids that score ``least``. The product of matrices selects; scores of the selected are
    summed in one order, so that equal vectors score equal."""
    out = []
    for at in range(0, len(queries), 256):
        q, ids = queries[at:at + 256], query_ids[at:at + 256]
        rough = q @ rows.T
        rough[ids[:, None] == row_ids[None, :]] = -np.inf
        bound = least[at:at + 256]
        if rough.shape[1] > k:
            bound = np.maximum(bound, np.partition(rough, rough.shape[1] - k, axis=1)[:, -k])
        slack = 1e-9 * (np.abs(q) @ np.abs(rows).max(axis=0))
        a, b = np.nonzero((rough >= (bound - slack)[:, None]) & (rough > -np.inf))
        score = np.concatenate([(q[a[i:i + 8192]] * rows[b[i:i + 8192]]).sum(axis=1) for i in range(0, max(len(a), 1), 8192)])
        order = np.lexsort((row_ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        kept = place < k
        out.append((ids[a[kept]], row_ids[b[kept]], score[kept]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _in_blocks(rows: DataFrame, queries: DataFrame, keys: list[str], size: int, k: int) -> DataFrame:
    """``query_id, vec_id, score``: each query's best k, per block, of the rows that it meets under its keys and that score its ``least``. Rows and queries
    of one key are dealt over as many blocks as their numbers ask for; every pair of blocks is met once."""
    def load(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    met = load(rows, "_rn").join(load(queries, "_qn"), keys)

    def dealt(side: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        placed = side.join(met, keys).withColumn(mine, F.pmod(F.xxhash64("id", "v"), F.col(own)).cast("int"))
        return placed.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(*keys, "_r", "_q", *side.drop(*keys).columns)

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            found = best_of_block(matrix(right["v"].combine_chunks()), right["id"].to_numpy(), right["least"].to_numpy(), matrix(left["v"].combine_chunks()), left["id"].to_numpy(), k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    by = [*keys, "_r", "_q"]
    left, right = dealt(rows, "_rn", "_qn", "_r", "_q"), dealt(queries, "_qn", "_rn", "_q", "_r")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(search, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES,
            recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for every query, by the largest inner product; ties go to the smaller id.

    Queries are the rows for which ``is_query`` (a condition on the column ``id``) holds; all rows but those of the query's own id are candidates. Only rows with
    an id and a finite vector that isn't zero take part, and of vectors of several lengths those of the most frequent one (ties: the longest). Rows that
    repeat an id count as one row, whose best score counts; queries that repeat an id have one result. A query for which the visited buckets
    hold fewer than ``k`` rows is compared with all rows, so it has ``k`` results or all there are. An empty table gives no rows; other columns are ignored.
    """
    rows = valid(table, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("m"))
    top = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    empty = table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if top is None:
        return empty
    rows = rows.where(F.size("v") == top.d).dropDuplicates()
    drawn = rows.orderBy(F.xxhash64("id", F.lit(SEED)), "id", "v").limit(SAMPLE).select("v").toArrow()
    index = Index(matrix(drawn["v"].combine_chunks()), top.m, top.n, k, tables, bucket)
    share = 1 - (1 - recall) ** (1 / tables)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = index.buckets(matrix(b.column(1)))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), t, np.int32)), pa.array(codes[:, t]), b.column(0), b.column(1)], names=["t", "b", "id", "v"])

    def probed(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    for t, visits in enumerate(zip(*index.visits(matrix(part.column(1)), share))):
                        chosen = [x[:n] if first else x[n:] for x, n in visits]
                        origin = pa.array(np.repeat(np.arange(len(chosen)), [len(x) for x in chosen]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(origin), t, np.int32)), pa.array(np.concatenate(chosen)), *[c.take(origin) for c in part.columns]],
                                                         names=["t", "b", "id", "v", "least"])

        return run

    stored, asked = "t int, b long, id long, v array<double>", "t int, b long, id long, v array<double>, least double"
    asking = rows.where(is_query).withColumn("least", F.lit(-math.inf))
    size = max(64, BLOCK // top.d)
    placed = rows.mapInArrow(hashed, stored)
    begun = cut_lineage(_ranked(_in_blocks(placed, asking.mapInArrow(probed(True), asked), ["t", "b"], size, k), k))
    reached = begun.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("_k"))
    onward = asking.join(reached, "id", "left").select("id", "v", F.coalesce("_k", "least").alias("least"))
    further = _in_blocks(placed, onward.mapInArrow(probed(False), asked), ["t", "b"], size, k)
    found = cut_lineage(_ranked(begun.select(*further.columns).unionByName(further), k))
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select(F.col("query_id").alias("id"))
    short = cut_lineage(asking.join(full, "id", "left_anti"))
    if short.isEmpty():
        return found

    def everywhere(side: DataFrame) -> DataFrame:
        return side.select(F.lit(0).alias("b"), *[F.col(c).alias(c) for c in side.columns])

    rest = _ranked(_in_blocks(everywhere(rows), everywhere(short), ["b"], size, k), k)
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)


@query("op13_nearest")
def op13(spark, sf_dir):
    return nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
