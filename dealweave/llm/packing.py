"""Best-fit packing of token pieces into fixed-length sequences by a grouping genetic algorithm.

Pieces are dealt into blocks of bounded size; each block is a packing problem of its own, which
several islands evolve side by side. A solution is a set of bins. Crossover takes whole well-filled bins of one parent,
drops the bins of the other that hold any of their pieces, and best-fits what that displaced;
mutation empties a few of the worst-filled bins in the same way. After each epoch the best solution of
an island migrates to the next island. An island stops at a proven lower bound.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealweave.llm.registry import query, read
from dealweave.session import cut_lineage

END = 2
BLOCK = 8192  # pieces of a block
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 5
POPULATION = 4
WELL_FILLED = 0.995


@lru_cache(maxsize=2)
def _tokens(ranks_path: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    added, whole = {}, os.path.splitext(ranks_path)[0] + ".json"
    if os.path.exists(whole):
        with open(whole) as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, ranks_path: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: token ids of whole texts and an end id, cut where longer than ``size``.

    The ids are those of the tokenizers library with the same vocabulary: the file of ranks is read by a faster
    library, the added tokens, which count inside texts too, come from the .json file beside it. Only the first piece of a longer
    document may be shorter than ``size``. Null text is empty: one piece with the end id alone.
    """
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokens(path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for r, text in enumerate(batch.column(1)):
                ids = np.append(coder.encode_to_numpy(text.as_py(), allowed_special="all"), END).astype("<u4")
                first = len(ids) % size or size
                cuts = [0, *range(first, len(ids) + 1, size)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(r)
                    piece.append(n)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(bins: list[list[int]], loose: list[int], sizes: list[int], cap: int) -> list[list[int]]:
    """Puts each loose piece, the longest first, into the fullest bin with room. Changes and returns ``bins``."""
    room: list[list[int]] = [[] for _ in range(cap + 1)]
    some = 0  # bit r: a bin with r free tokens exists
    for b, items in enumerate(bins):
        free = cap - sum(map(sizes.__getitem__, items))
        room[free].append(b)
        some |= 1 << free
    for i in sorted(loose, key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        fit = some >> s
        if fit:
            free = s + (fit & -fit).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                some ^= 1 << free
            bins[b].append(i)
        else:
            free, b = cap, len(bins)
            bins.append([i])
        if not room[free - s]:
            some |= 1 << (free - s)
        room[free - s].append(b)
    return bins


def lower_bound(sizes: np.ndarray, cap: int) -> int:
    """Bins that any packing needs: by total length, and by pieces above half with what can't join them."""
    best = -(-int(sizes.sum()) // cap)
    ordered = np.sort(sizes)
    sums = np.concatenate([[0], np.cumsum(ordered)])
    for k in np.unique(ordered[ordered <= cap // 2]).tolist() + [cap // 2 + 1]:
        over = np.searchsorted(ordered, cap - k, side="right")  # longer than cap - k: alone
        half = np.searchsorted(ordered, cap // 2, side="right")
        small = np.searchsorted(ordered, k)
        if over < half:
            continue
        big = len(ordered) - over
        middle = over - half
        rest = sums[half] - sums[small] - (middle * cap - (sums[over] - sums[half]))
        best = max(best, big + middle + max(0, -(-int(rest) // cap)))
    return best


class Evolution:
    """One island: solutions of one block of pieces."""

    def __init__(self, sizes: np.ndarray, cap: int, seed: list[int]):
        self.array, self.sizes, self.cap = sizes, sizes.tolist(), cap
        self.rng = np.random.default_rng(seed)
        self.goal = lower_bound(sizes, cap)

    def fitness(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins first, then unevenly filled ones, which leave room."""
        fill = np.array([sum(map(self.sizes.__getitem__, b)) for b in bins], dtype=np.float64) / self.cap
        return len(bins), -float((fill**2).sum())

    def start(self) -> list[list[int]]:
        """Best fit in an order that is decreasing but for noise."""
        noisy = self.array * self.rng.uniform(0.9, 1.0, len(self.array))
        bins: list[list[int]] = []
        cut = np.array_split(np.argsort(-noisy, kind="stable"), 8)
        for part in cut:
            bins = best_fit(bins, part.tolist(), self.sizes, self.cap)
        return bins

    def crossover(self, a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
        full = self.cap * WELL_FILLED
        taken = [x for x, u in zip(b, self.rng.random(len(b))) if u < 0.5 and sum(map(self.sizes.__getitem__, x)) >= full]
        inside = {i for x in taken for i in x}
        child, loose = [list(x) for x in taken], []
        for x in a:
            if inside.isdisjoint(x):
                child.append(list(x))
            else:
                loose += [i for i in x if i not in inside]
        fills = sorted(range(len(child)), key=lambda j: sum(map(self.sizes.__getitem__, child[j])))
        emptied = set(fills[:max(2, len(child) // 20)])  # mutation
        loose += [i for j in emptied for i in child[j]]
        return best_fit([x for j, x in enumerate(child) if j not in emptied], loose, self.sizes, self.cap)

    def run(self, elites: list[list[list[int]]]) -> list[list[int]]:
        people = elites or [best_fit([], list(range(len(self.sizes))), self.sizes, self.cap)]
        people = sorted(people, key=self.fitness)
        if len(people[0]) <= self.goal:
            return people[0]
        while len(people) < POPULATION:
            people.append(self.start())
        for _ in range(GENERATIONS):
            children = []
            for _ in range(POPULATION // 2):
                a, b = self.rng.choice(len(people), 2, replace=False)
                children.append(self.crossover(people[min(a, b)], people[max(a, b)]))
            people = sorted(people + children, key=self.fitness)[:POPULATION]
            if len(people[0]) <= self.goal:
                break
        return people[0]


def packed(pieces: DataFrame, id_col: str = "doc_id", size_col: str = "length", cap: int = 1024, block: int = BLOCK, seed: int = 5) -> DataFrame:
    """All columns of ``pieces`` with ``sequence_id`` and ``offset`` (replaced if there): sequences of at most ``cap``.

    Lengths must be from 1 to ``cap``. Full pieces are sequences of their own. All others take part in a
    block of about ``block`` pieces, so a task's memory doesn't depend on the input; a sequence never spans two blocks, which costs less than one
    sequence for each block. The deal and the evolution depend only on the rows and ``seed``; rows that are equal in
    all columns are interchangeable, null ids are ordinary. An empty table gives no rows.
    """
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    order = [F.col(c) for c in (id_col, size_col, *[c for c, kind in pieces.dtypes if c not in (id_col, size_col) and "map<" not in kind and "variant" not in kind])]
    loose = pieces.where(F.col(size_col) < cap)
    blocks = max(1, -(-loose.count() // block))
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), *order), F.lit(blocks)).cast("int"))
    kind = (F.col(size_col) >= cap).cast("int")
    items = cut_lineage(dealt.withColumn("_full", kind).withColumn("_item", F.row_number().over(Window.partitionBy("_block", "_full").orderBy(*order)) - 1))

    def evolve(table: pa.Table) -> pa.Table:
        block_no, island, epoch = (table[c][0].as_py() for c in ("_block", "_island", "_epoch"))
        got = table.select(["_role", "_item", "_size", "_bin"]).to_pandas().sort_values(["_role", "_item"], kind="stable")
        own = got[got["_role"] == 0]
        elites = []
        if epoch:
            for role in sorted(got["_role"].unique().tolist()):
                of = got.loc[got["_role"] == role, "_bin"].to_numpy()
                by = np.argsort(of, kind="stable")
                elites.append([b.tolist() for b in np.split(by, np.flatnonzero(np.diff(of[by])) + 1)])
        bins = Evolution(own["_size"].to_numpy(), cap, [seed, block_no, island, epoch]).run(elites)
        place = np.zeros(len(own), dtype=np.int32)
        for b, members in enumerate(bins):
            place[members] = b
        n = len(own)
        return pa.table({"_block": pa.array([block_no] * n, pa.int32()), "_island": pa.array([island] * n, pa.int32()), "_item": pa.array(own["_item"].to_numpy(), pa.int32()),
                         "_size": pa.array(own["_size"].to_numpy(), pa.int64()), "_bin": pa.array(place), "_bins": pa.array([len(bins)] * n, pa.int32())})

    shape = "_block int, _island int, _item int, _size long, _bin int, _bins int"
    state = items.where("_full = 0").select("_block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("_island"), "_item", F.col(size_col).cast("long").alias("_size"),
                                            F.lit(0).alias("_bin"), F.lit(0).alias("_role"))
    for epoch in range(EPOCHS):
        state = state.withColumn("_epoch", F.lit(epoch))
        best = cut_lineage(state.groupBy("_block", "_island").applyInArrow(evolve, shape))
        own = best.drop("_bins").withColumn("_role", F.lit(0))
        migrant = own.withColumn("_island", F.pmod(F.col("_island") + 1, F.lit(ISLANDS)).cast("int")).withColumn("_role", F.lit(1))
        state = own.unionByName(migrant)

    winner = best.groupBy("_block").agg(F.min_by("_island", F.struct("_bins", "_island")).alias("_island"))
    placed = best.join(winner, ["_block", "_island"]).select("_block", "_item", "_bin")
    chosen = items.where("_full = 0").join(placed, ["_block", "_item"])
    number = F.shiftleft(F.col("_block").cast("long"), 32)
    run = Window.partitionBy("_block", "_bin").orderBy(F.col(size_col).desc(), "_item").rowsBetween(Window.unboundedPreceding, -1)
    filled = chosen.select(*names, (number + F.col("_bin")).alias("sequence_id"), F.coalesce(F.sum(F.col(size_col).cast("long")).over(run), F.lit(0)).cast("long").alias("offset"))
    full = items.where("_full = 1").select(*names, (-1 - number - F.col("_item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return filled.unionByName(full)


@query("op3_packing")
def op3(spark, sf_dir):
    return packed(cut_lineage(token_pieces(read(spark, sf_dir, "documents"))))
