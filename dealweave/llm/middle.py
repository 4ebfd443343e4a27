"""Fill-in-middle examples: whole texts cut at line ends into prefix, middle and suffix, in two orders.

A batch of texts is one run of UTF-8 bytes, looked at as 64-bit words. Arithmetic on whole words marks the bytes that end a
line, and those that begin a code point, by their highest bit. Bit counts per word and their running sum answer both questions that cutting asks:
how many marks lie before a byte (rank), and where the k-th mark is (select: search of the running sums finds the word, clearing lowest bits
the byte in it). No text is split into lines.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.llm.registry import query, read

SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
SEED = "7"
BYTES = 32 << 20  # text that is cut at once

LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
HIGH = np.uint64(0x8080808080808080)
ONES = 0x0101010101010101
ONE, THREE = np.uint64(1), np.uint64(3)


def _equal(words: np.ndarray, byte: int) -> np.ndarray:
    """Highest bit of every byte that equals ``byte``; no carry leaves a byte, so the marks are exact."""
    x = words ^ np.uint64(byte * ONES)
    return ~(((x & LOW7) + LOW7) | x | LOW7)


def _begins(words: np.ndarray) -> np.ndarray:
    """Highest bit of every byte that isn't a continuation byte (10xxxxxx)."""
    return ~(words & ~(words << ONE)) & HIGH


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of marked bytes before each position."""
        below = (ONE << ((at & 7) << 3).astype(np.uint64)) - ONE
        return self.before[at >> 3] + np.bitwise_count(self.words[at >> 3] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th marked byte, counted from 0."""
        word = np.searchsorted(self.before, k, side="right") - 1
        left, bits = k - self.before[word], self.words[word]
        for _ in range(7):
            bits = np.where(left > 0, bits & (bits - ONE), bits)
            left = left - 1
        lowest = bits & (~bits + ONE)
        return (word << 3) + (np.bitwise_count(lowest - ONE).astype(np.int64) >> 3)


def draws(ids: list, seed: str = SEED) -> np.ndarray:
    """Four numbers below 2**32 for each id: the first hex digits of the SHA-256 of ``seed:id``. A null id has no digits."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def cut(data: np.ndarray, offsets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """``units, first cut, second cut, prefix_chars, middle_chars`` of the texts ``data[offsets[i]:offsets[i + 1]]``.

    Units are lines with their line end; a last line without one counts. The cuts are byte positions after the smaller and the larger of the
    two drawn numbers of units."""
    padded = np.zeros((len(data) >> 3) * 8 + 16, np.uint8)
    padded[:len(data)] = data
    words = padded.view("<u8")
    ends, begins = Marks(_equal(words, 0x0A)), Marks(_begins(words))
    start, stop = offsets[:-1], offsets[1:]
    before = ends.rank(start)
    whole = ends.rank(stop) - before
    units = whole + ((stop > start) & (padded[np.maximum(stop - 1, 0)] != 0x0A))

    def after(count: np.ndarray) -> np.ndarray:
        if not ends.before[-1]:
            return np.where(count == 0, start, stop)
        found = ends.select(np.clip(before + count - 1, 0, ends.before[-1] - 1)) + 1
        return np.where(count == 0, start, np.where(count <= whole, found, stop))

    drawn = h[:, :2] % (units + 1)[:, None]
    a, b = after(drawn.min(axis=1)), after(drawn.max(axis=1))
    chars = begins.rank(start), begins.rank(a), begins.rank(b)
    return units, a, b, chars[1] - chars[0], chars[2] - chars[1]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 100, spm_rate: int = 50,
                   seed: str = SEED, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row per input row, without a shuffle: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``n`` counts the lines of the whole text. ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain``, which leaves the text
    as it is: empty texts, texts that hold a sentinel, and the share beyond ``rate`` percent. What a document draws depends on ``seed`` and its id only,
    so repeated ids draw the same and a null id draws as an id without digits. Null text is empty. An empty table gives no rows; other columns are ignored.
    Texts are taken ``BYTES`` at a time. Sentinels are of the form ``<X>``, which no text next to them can complete or hide.
    """
    if len(set(sentinels)) != 3 or not all(re.fullmatch(r"<[^<>]+>", s) for s in sentinels):
        raise ValueError("sentinels are three different strings like <P>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    p, s, m = (x.encode() for x in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                base = size[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(size, base + BYTES, side="right")))
                yield build(batch.slice(at, to - at))
                at = to

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = memoryview(texts.buffers()[2] or b"")[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        h = draws(batch.column(0).to_pylist(), seed)
        n, a, b, prefix, middle = cut(np.frombuffer(raw, np.uint8), offsets, h)
        plain = (offsets[1:] == offsets[:-1]) | (h[:, 2] % 100 >= rate)
        for mark in sentinels:
            plain |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        spm = h[:, 3] % 100 < spm_rate
        forms, outputs = [], []
        for o, c1, c2, e, as_is, last in zip(offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist(), plain.tolist(), spm.tolist()):
            if as_is:
                forms.append("plain")
                outputs.append(bytes(raw[o:e]))
            elif last:
                forms.append("spm")
                outputs.append(b"".join((s, raw[c2:e], p, raw[o:c1], m, raw[c1:c2])))
            else:
                forms.append("psm")
                outputs.append(b"".join((p, raw[o:c1], s, raw[c2:e], m, raw[c1:c2])))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain),
             pa.array(outputs, pa.binary()).cast(pa.string())],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of ``fill_in_middle`` was made from."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines FROM d),
v AS (SELECT *, len(lines) AS n, ('0x' || h[1:8])::BIGINT % (len(lines) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(lines) + 1) AS c2,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
       WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
w AS (SELECT *, array_to_string(lines[1:least(c1, c2)], '') AS p, array_to_string(lines[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
  array_to_string(lines[greatest(c1, c2) + 1:], '') AS s FROM v)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM w
"""


@query("op11_fill_in_middle", SQL)
def op11(spark, sf_dir):
    made = fill_in_middle(read(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
