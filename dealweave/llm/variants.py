"""Spelling variants: words one inserted, deleted or replaced letter apart, by pairs of trie nodes.

The words form a trie from their beginnings and another one from their ends; every node of either has a number. A word of n letters
splits into n + 1 pairs (node of the letters before, node of the letters after), and into n pairs that skip a letter. Two words differ in one
replaced letter exactly if they have a skipping pair in common, and by one inserted letter exactly if a skipping pair of the
longer is a splitting pair of the shorter: one exchange by two integers finds all neighbours. Under one pair stand at most one word that it splits and one word for each
letter of the alphabet, whatever the texts, so no group can grow with the input.

Nodes are numbered along the sorted words: a word opens the nodes beyond the letters it shares with the word before. Partitions of
the sorted words are numbered apart; the driver needs only the border words of each to connect them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealweave.llm.registry import query, read
from dealweave.session import cut_lineage

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 7, 2
DROP = 31  # a run loses a letter if this divides its hash
RATIO = 10  # a form is this many times as frequent
HELD = 200_000  # distinct words that a task holds before it passes their counts on


# ---------------------------------------------------------------- words of the texts
def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop: int = DROP) -> DataFrame:
    """``word, n``: the distinct words of the texts and how often they occur.

    A word is a maximal run of letters with A-Z lower-cased. If ``drop`` divides the CRC-32 of ``id:run``, the letter at that number modulo the length is
    left out. Words of at least ``min_length`` code points and ``min_count`` occurrences count; a null text has none, a null id has no
    digits, rows that repeat an id count again."""
    runs = re.compile(f"(?<![{LETTERS}])[{LETTERS}]{{{min_length},}}")
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                start = zlib.crc32(f"{i.as_py() or ''}:".encode())
                lowered = text.as_buffer().to_pybytes().lower().decode()  # bytes lower-case A-Z only
                for run, n in Counter(runs.findall(lowered)).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % drop == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                        if len(run) < min_length:
                            continue
                    found[run] = found.get(run, 0) + n
                if len(found) >= HELD:
                    yield _counts(found)
                    found = {}
        yield _counts(found)

    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _counts(found: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])


# ---------------------------------------------------------------- numbers of the trie nodes
def shared(a: str, b: str) -> int:
    """Number of letters that two words have in common from the beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    i = 0
    while a[i] == b[i]:
        i += 1
    return i


class Path:
    """Numbers of the nodes along the last word; the root is 0, depth d is at position d."""

    def __init__(self, word: str = "", nodes: list[int] | None = None, used: int = 0):
        self.word, self.nodes, self.used = word, nodes or [0], used

    def step(self, word: str) -> list[int]:
        same = shared(self.word, word)
        new = len(word) - same
        self.nodes[same + 1:] = range(self.used + 1, self.used + new + 1)
        self.word, self.used = word, self.used + new
        return self.nodes


def _borders(table: DataFrame) -> dict[int, Path]:
    """Per partition of the sorted words the path that its numbering starts from. The driver sees two words and the
    path of one for each partition."""
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, first, part = Path(), None, None
        for batch in batches:
            for part, word in zip(batch.column("_part").to_pylist(), batch.column("_key").to_pylist()):
                first = word if first is None else first
                path.step(word)
        if first is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "last": path.word, "nodes": path.nodes, "used": path.used}], schema=shape)

    shape = pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("nodes", pa.list_(pa.int64())), ("used", pa.int64())])
    start, now = {}, Path()
    for r in sorted(table.mapInArrow(ends, "part int, first string, last string, nodes array<long>, used long").collect(), key=lambda r: r.part):
        start[r.part] = Path(now.word, list(now.nodes), now.used)
        # numbers up to ``same`` are nodes that an earlier partition has opened; the others move up behind all earlier ones
        same = shared(now.word, r["first"])
        nodes = [now.nodes[x] if x <= same else x - same + now.used for x in r.nodes]
        now = Path(r["last"], nodes, now.used + r.used - same)
    return start


def numbered(table: DataFrame, key: Column, *carry: str) -> DataFrame:
    """``nodes`` and the columns in ``carry``: for each row the numbers of the trie nodes from the root to its whole key. Keys are distinct;
    among whole keys the numbers ascend in the order of code points."""
    ordered = cut_lineage(table.select(key.alias("_key"), *carry).repartitionByRange("_key").sortWithinPartitions("_key").withColumn("_part", F.spark_partition_id()))
    start = _borders(ordered)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if path is None:
                begin = start[batch.column("_part")[0].as_py()]
                path = Path(begin.word, list(begin.nodes), begin.used)
            flat, sizes = [], [0]
            for word in batch.column("_key").to_pylist():
                flat.extend(path.step(word))
                sizes.append(len(flat))
            nodes = pa.ListArray.from_arrays(pa.array(np.array(sizes, np.int32)), pa.array(np.array(flat, np.int64)))
            yield pa.RecordBatch.from_arrays([nodes, *[batch.column(c) for c in carry]], names=["nodes", *carry])

    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}
    return ordered.mapInArrow(number, ", ".join(["nodes array<bigint>", *[f"{c} {kinds[c]}" for c in carry]]))


def node_pairs(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, word, n)`` with ids in the order of code points, and the pair dictionary ``(p, s, id, n, skips, first)``: a pair that splits the word,
    or one that skips a letter; ``first`` is false where the letter before is the same, as skipping either leaves the same word."""
    forward = cut_lineage(numbered(vocabulary, F.col("word"), "word", "n").withColumn("id", F.element_at("nodes", -1)))
    backward = numbered(forward, F.reverse("word"), "id").withColumnRenamed("nodes", "ends")
    both = forward.join(backward, "id")
    splits = F.transform("nodes", lambda p, i: F.struct(
        p.alias("p"), F.get("ends", F.size("ends") - 1 - i).alias("s"), F.lit(False).alias("skips"), F.lit(False).alias("first")))
    letters = F.split("word", "")
    skipping = F.transform(F.slice("nodes", 1, F.size("nodes") - 1), lambda p, i: F.struct(
        p.alias("p"), F.get("ends", F.size("ends") - 2 - i).alias("s"), F.lit(True).alias("skips"),
        ((i == 0) | (F.get("letters", i) != F.get("letters", i - 1))).alias("first")))
    pairs = both.withColumn("letters", letters).select("id", "n", F.explode(F.concat(splits, skipping)).alias("x")).select("x.*", "id", "n")
    return forward.select("id", "word", "n"), pairs


# ---------------------------------------------------------------- neighbours
def neighbours(pairs: DataFrame) -> DataFrame:
    """``id, n_near, best``: number of near words and the most frequent of them (ties: smallest id) as struct(-n, id), for words that have any.

    All words under one pair are near to each other. Words a replaced letter apart share one pair; a word and the one without one of its letters share a pair for each letter
    of that run, of which the first counts."""
    here = W.partitionBy("p", "s")
    ranked = here.orderBy("_at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    met = pairs.withColumn("_at", F.struct((-F.col("n")).alias("minus"), F.col("id").alias("id"))).withColumns({
        "_skips": F.count_if("skips").over(here), "_first": F.count_if("first").over(here), "_all": F.count(F.lit(1)).over(here),
        "_1": F.first("_at").over(ranked), "_2": F.nth_value("_at", 2).over(ranked)}).where("_all > 1")
    count = F.when(F.col("skips"), F.col("_skips") - 1 + F.when(F.col("first"), F.col("_all") - F.col("_skips")).otherwise(0)).otherwise(F.col("_first"))
    return met.groupBy("id").agg(F.sum(count).alias("n_near"), F.min(F.when(F.col("_1.id") == F.col("id"), F.col("_2")).otherwise(F.col("_1"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``id, root`` for rows of ``id, form``: the last word that forms lead to. Every step leads to a word ``RATIO`` times as frequent, so there are no
    circles; the reach doubles each round."""
    now = cut_lineage(forms.select("id", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        moved = cut_lineage(now.join(onward, "root", "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        now = moved.select("id", "root")
        if moved.where("_moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                      drop: int = DROP, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``words``.

    ``form`` is the most frequent near word (ties: smallest in the order of code points) if it is at least ``ratio`` times as frequent, else null. ``root`` is reached from
    the word by following forms, the word itself without one. An empty table gives no rows; columns that are not named are ignored."""
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent")
    table, pairs = node_pairs(words(docs, id_col, text_col, min_length, min_count, drop))
    table = cut_lineage(table.join(neighbours(pairs), "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                                                           F.when(-F.col("best.minus") >= ratio * F.col("n"), F.col("best.id")).alias("form_id")))
    led = roots(table.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("form"))).withColumnRenamed("root", "root_id")
    names = table.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    ends = table.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    with_form = table.where("form_id IS NOT NULL").join(led, "id").join(names, "form_id").join(ends, "root_id").select("word", "form", "root", "n", "n_near", "form_n")
    alone = table.where("form_id IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", F.lit(None).cast("long").alias("form_n"))
    return alone.unionByName(with_form)


#: CRC-32 by its table of 256 remainders over the bytes of ``<doc_id>:<run>``; neighbours by the texts before and after a letter.
SQL = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i)),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS n, string_split(doc_id || ':' || run, '') AS cs FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
bytes AS (SELECT doc_id, run, n, list_prepend(4294967295::BIGINT, flatten(list_transform(cs, lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
  ELSE [192 + unicode(x)::BIGINT // 64, 128 + unicode(x)::BIGINT % 64] END))) AS b FROM per),
hashed AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, crc),
kept AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
w AS (SELECT word, sum(n)::BIGINT AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, word[1:i] || ' ' || word[i + 2:] AS gap, word[1:i] || word[i + 2:] AS less FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.gap = b.gap AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(struct_pack(o := other, m := n), struct_pack(a := -n, b := other)) AS f FROM near GROUP BY word),
t AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN f.m >= 10 * w.n THEN f.o END AS form, CASE WHEN f.m >= 10 * w.n THEN f.m END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS here, 0 AS depth FROM t UNION ALL SELECT walk.word, t.form, depth + 1 FROM walk JOIN t ON t.word = walk.here WHERE t.form IS NOT NULL),
root AS (SELECT word, arg_max(here, depth) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM t JOIN root USING (word)
"""


@query("op12_spelling_variants", SQL)
def op12(spark, sf_dir):
    return spelling_variants(read(spark, sf_dir, "documents"))
