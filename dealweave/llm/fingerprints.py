"""Document fingerprints as invertible Bloom lookup tables of paragraph digests.

A text is cut into paragraphs: lines, long lines at sentence ends, long sentences at fixed steps. The
k-th repetition of a paragraph is a digest of its own, so a text is a set of 64-bit digests. Each digest is added to
three cells, which hold a count and the exclusive-or of digests and of their check hashes. Tables of two versions
subtract cell by cell; what they share cancels, and peeling the cells that hold one digest recovers exactly the
differing digests. When peeling gets stuck, both tables are made again four times as large with other places.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.llm.registry import query, read

CELLS = 24  # of a stored fingerprint; a multiple of three
LONG = 200  # characters; longer lines are cut
BUCKET = 4096  # documents handled together

_sentences = re.compile(r"(?<=[.!?]) ").split


def paragraphs(text: str) -> list[str]:
    out = []
    for line in text.split("\n"):
        if len(line) <= LONG:
            out.append(line)
        else:
            for part in _sentences(line):
                out += [part[i:i + LONG] for i in range(0, len(part), LONG)]
    return [p for p in out if p]


def digests(text: str) -> np.ndarray:
    seen: dict[str, int] = {}
    out = []
    for p in paragraphs(text):
        k = seen.get(p, 0)
        seen[p] = k + 1
        out.append(xxhash.xxh64_intdigest(p.encode(), k))
    return np.array(out, dtype=np.uint64)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tables:
    """Sketches of many sets side by side: ``cells`` cells each, rows of three flat arrays."""

    def __init__(self, count, key, check, cells: int):
        self.count, self.key, self.check, self.cells = count, key, check, cells

    @staticmethod
    def places(owner: np.ndarray, keys: np.ndarray, cells: int) -> list[np.ndarray]:
        third = np.uint64(cells // 3)
        return [owner * cells + j * (cells // 3) + (_mix(keys, 3 * cells + j) % third).astype(np.int64) for j in range(3)]

    @classmethod
    def of(cls, sets: list[np.ndarray], cells: int) -> Tables:
        keys = np.concatenate([*sets, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        t = cls(np.zeros(len(sets) * cells, np.int32), np.zeros(len(sets) * cells, np.uint64), np.zeros(len(sets) * cells, np.uint64), cells)
        t.toggle(owner, keys, np.ones(len(keys), np.int32))
        return t

    def toggle(self, owner, keys, signs) -> None:
        checks = _mix(keys, 7)
        for at in self.places(owner, keys, self.cells):
            np.add.at(self.count, at, signs)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, checks)

    def minus(self, other: Tables) -> Tables:
        return Tables(self.count - other.count, self.key ^ other.key, self.check ^ other.check, self.cells)

    def peel(self, sets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a difference: owner and digest of all that could be recovered, and whether each table came out empty."""
        owners, keys = [], []
        at = np.flatnonzero(np.abs(self.count) == 1)
        while len(at):
            at = at[(np.abs(self.count[at]) == 1) & (self.check[at] == _mix(self.key[at], 7))]
            if not len(at):
                break
            owner, key, sign = at // self.cells, self.key[at], self.count[at]
            order = np.lexsort((key, owner))
            owner, key, sign = owner[order], key[order], sign[order]
            one = np.r_[True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])]
            owner, key, sign = owner[one], key[one], sign[one]
            self.toggle(owner, key, -sign)
            owners.append(owner)
            keys.append(key)
            at = np.unique(np.concatenate(self.places(owner, key, self.cells)))
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        empty = ~left.reshape(sets, self.cells).any(axis=1)
        return np.concatenate([*owners, np.zeros(0, np.int64)]), np.concatenate([*keys, np.zeros(0, np.uint64)]), empty

    def text(self, i: int, size: int) -> str:
        """Stored form: number of digests, cells, and the cells in base 64."""
        cut = slice(i * self.cells, (i + 1) * self.cells)
        raw = self.count[cut].astype("<i4").tobytes() + self.key[cut].astype("<u8").tobytes() + self.check[cut].astype("<u8").tobytes()
        return f"{size}.{self.cells}." + base64.b64encode(raw).decode()


def differences(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS) -> list[np.ndarray]:
    """Digests in one but not both, for each pair of sets; larger tables for the pairs that got stuck."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(left)
    todo = np.arange(len(left))
    while len(todo):
        a, b = [left[i] for i in todo], [right[i] for i in todo]
        owner, key, empty = Tables.of(a, cells).minus(Tables.of(b, cells)).peel(len(todo))
        order = np.argsort(owner, kind="stable")
        cut = np.split(key[order], np.cumsum(np.bincount(owner, minlength=len(todo)))[:-1])
        for i in np.flatnonzero(empty).tolist():
            out[todo[i]] = cut[i]
        todo, cells = todo[~empty], cells * 4
    return out


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> list[float]:
    """Share of digests that two sets have in common: 1 for equal sets (empty ones too), 0 for disjoint ones."""
    return [1 - len(d) / (len(a) + len(b)) if len(d) else 1.0 for a, b, d in zip(left, right, differences(left, right))]


def _edges(ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """First and last id of buckets of at most ``BUCKET`` distinct ids, ascending. The driver gets two numbers for each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.unique(np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in batches] or [np.zeros(0, np.int64)]))
        first = found[::BUCKET]
        yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(found[np.minimum(np.arange(1, len(first) + 1) * BUCKET, len(found)) - 1])], names=["a", "b"])

    got = sorted(map(tuple, ids.repartitionByRange("_id").mapInArrow(run, "a long, b long").collect()))
    return np.array([x[0] for x in got], np.int64), np.array([x[1] for x in got], np.int64)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``.

    ``edited`` is the text with its last third (rounded down) replaced by as many first code points of the next
    document in descending id (after the last one, the first). Null text is empty; rows with equal ids
    follow each other by text; a null id counts as the smallest whole number; ids must be whole numbers.
    Equal texts have equal fingerprints. An empty table gives no rows. Texts move once, into buckets of neighbouring ids that a task can hold;
    only the first document of a bucket is sent a second time, to the bucket before it.
    """
    least = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), least).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    first, last = _edges(rows.select("_id"))

    @F.pandas_udf("array<int>")
    def buckets(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(first, ids.to_numpy(), side="right") - 1
        ends = ids.to_numpy() == last[own]
        return pd.Series([[b, (b + 1) % len(first)] if e else [b] for b, e in zip(own.tolist(), ends.tolist())])

    def compare(table: pa.Table) -> pa.Table:
        got = sorted(zip(table["_guest"].to_pylist(), [-i for i in table["_id"].to_pylist()], table["text"].to_pylist(), table["doc_id"].to_pylist()), key=lambda r: r[:3])
        own = [r for r in got if not r[0]]
        follow = [r[2] for r in got[:len(own) + 1]][1:]  # the first guest follows the last own row
        texts = [r[2] for r in own]
        edited = [t[:len(t) - len(t) // 3] + n[:len(t) // 3] for t, n in zip(texts, follow)]
        sets, after = [digests(t) for t in texts], digests(follow[-1])
        new = [digests(t) for t in edited]
        old, changed = Tables.of(sets, CELLS), Tables.of(new, CELLS)
        return pa.table({
            "doc_id": pa.array([r[3] for r in own], pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "edited": pa.array(edited, pa.string()),
            "fingerprint": [old.text(i, len(s)) for i, s in enumerate(sets)], "edited_fingerprint": [changed.text(i, len(s)) for i, s in enumerate(new)],
            "near_edited": pa.array(likeness(sets, new), pa.float64()), "near_next": pa.array(likeness(sets, [*sets[1:], after]), pa.float64())})

    placed = rows.select("*", F.posexplode(buckets("_id")).alias("_copy", "_bucket")).withColumn("_guest", F.col("_copy") > 0).drop("_copy")
    return placed.groupBy("_bucket").applyInArrow(compare, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


@query("op9_fingerprint")
def op9(spark, sf_dir):
    return edited_fingerprints(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
