"""Text features of a page for matching executed pages to their originals."""

from __future__ import annotations

import difflib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from dealweave import lexicon as lx
from dealweave.functions import text as T

BULLETS = r"\s\-–—•·\*"


def page_text(c: Column) -> Column:
    return T.squash(F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"\x00", " ")))


def page_line(c: Column) -> Column:
    return F.regexp_replace(page_text(c), rf"^[{BULLETS}]+|[{BULLETS}]+$", "")


def clean_stem(c: Column) -> Column:
    base = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\.pdf$", "")
    return page_text(F.regexp_replace(base, r"\s*\([^)]*\)", ""))


def safe_name(c: Column, fallback: str = "document") -> Column:
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r'[<>:"/\\|?*]', "_"), r"\s+", " ")
    t = F.regexp_replace(t, r"^[ ._]+|[ ._]+$", "")
    return F.when(t == "", F.lit(fallback)).otherwise(t)


def footer_name(c: Column) -> Column:
    """Document name after or before "signature page". The text is collapsed to one line first,
    so a name after the phrase runs to the end of the page."""
    up = page_text(c)

    def one(p):
        n = T.strip(F.regexp_replace(T.strip(F.regexp_extract(up, p, 1)), r"[.\-–—]+$", ""))
        n = T.strip(F.regexp_replace(n, r"\s*\(CONTINUED\)$", ""))
        return F.when((F.length(n) > 3) & ~n.rlike("^(?:THIS|THE |A |AN )"), n)

    return F.coalesce(*map(one, lx.FOOTER_NAME_PATTERNS))


def title_name(c: Column) -> Column:
    """First known document type in the text, extended to the words that follow it."""
    up, out = page_text(c), F.lit(None).cast("string")
    for kind in reversed(lx.TITLE_TYPES):
        longer = T.strip(F.regexp_extract(up, rf"({kind}[A-Z\s]*?)(?:\n|BY:|DATED|$)", 1))
        out = F.when(F.contains(up, F.lit(kind)), F.coalesce(T.null_if_blank(longer), F.lit(kind))).otherwise(out)
    return out


def is_schedule(text: Column, filename: Column) -> Column:
    return T.any_rlike(page_text(text), lx.SCHEDULE_CUES) | T.any_rlike(page_text(filename), lx.SCHEDULE_CUES)


def is_execution_page(c: Column) -> Column:
    t = page_text(c)
    enough = F.length(F.regexp_replace(t, r"[_\s\-\=]+", "")) >= 30
    by = t.rlike(r"\bBY\s*:") & t.rlike(r"\b(?:NAME|TITLE|DATE|ITS)\s*:")
    rule = t.rlike("_{8,}") & t.rlike(r"\b(?:NAME|TITLE|DATE)\s*:")
    return enough & (F.contains(t, F.lit("SIGNATURE PAGE")) | by | rule)


def meaningful_lines(c: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\n|\r"), page_line)
    return F.array_distinct(F.filter(
        lines, lambda x: (F.length(x) >= 2) & ~T.any_rlike(x, lx.NOISE_LINES) & ~x.rlike(r"^[_\-–—=\s]{6,}$")))


def tail_of(arr: Column, n: int) -> Column:
    return F.slice(arr, F.greatest(F.size(arr) - n + 1, F.lit(1)), F.lit(n))


def compressed(arr: Column, max_lines: int, max_chars: int) -> Column:
    """Leading lines joined by a bar while the joined length stays within ``max_chars``."""
    start = F.struct(F.lit("").alias("t"), F.lit(False).alias("full"))

    def add(acc, x):
        nxt = F.when(acc["t"] == "", x).otherwise(F.concat(acc["t"], F.lit(" | "), x))
        full = acc["full"] | (F.length(nxt) > max_chars)
        return F.struct(F.when(full, acc["t"]).otherwise(nxt).alias("t"), full.alias("full"))

    return F.aggregate(F.slice(arr, 1, max_lines), start, add)["t"]


def anchor_lines(lines: Column) -> Column:
    """Lines naming a document type or a signature label, with one line around, at most 18."""
    hints = "|".join((*lx.DOC_TYPE_HINTS, "^BY:", "^NAME:", "^TITLE:", "^DATE:", "^ITS:"))
    around = F.transform(lines, lambda x, i: F.when(
        x.rlike(hints), F.slice(lines, F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3))))
    found = F.array_distinct(F.flatten(F.array_compact(around)))
    ends = F.array_distinct(F.filter(F.concat(F.slice(lines, 1, 8), tail_of(lines, 8)), lambda x: F.length(x) >= 8))
    return F.slice(F.when(F.size(found) > 0, found).otherwise(ends), 1, 18)


def signature_lines(lines: Column) -> Column:
    zone = F.transform(lines, lambda x, i: F.when(x.rlike(lx.SIGNATURE_ZONE), F.slice(lines, i + 1, F.lit(4))))
    found = F.array_distinct(F.flatten(F.array_compact(zone)))
    ends = F.filter(tail_of(lines, 16), lambda x: F.length(x) >= 4)
    return F.slice(F.when(F.size(found) > 0, found).otherwise(ends), 1, 16)


def with_page_features(pages: DataFrame, text: str = "page_text") -> DataFrame:
    p = pages.withColumns({"lines": meaningful_lines(F.col(text)), "footer_name": footer_name(F.col(text)), "title_name": title_name(F.col(text))})
    ln = F.col("lines")
    ends = F.when(F.size(ln) > 14, F.concat(F.slice(ln, 1, 14), tail_of(ln, 14))).otherwise(ln)
    return p.withColumns({
        "doc_name": F.coalesce("footer_name", "title_name"),
        "header_text": compressed(ln, 12, 800), "tail_text": compressed(tail_of(ln, 18), 18, 1000),
        "footer_text": compressed(F.filter(tail_of(ln, 8), lambda x: F.length(x) >= 4), 8, 500),
        "signature_block_text": compressed(signature_lines(ln), 14, 900),
        "match_text": compressed(F.array_distinct(ends), 28, 1400),
        "anchor_lines": anchor_lines(ln),
    })


def line_overlap(a: Column, b: Column) -> Column:
    """Shared share of distinct lines of four or more characters."""
    a, b = (F.array_distinct(F.filter(x, lambda y: F.length(y) >= 4)) for x in (a, b))
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def visual_similarity(a: Column, b: Column) -> Column:
    """1 - mean absolute difference / 255 of two equally long grey vectors, within 0..1."""
    diff = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    sim = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - diff / F.size(a) / 255))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), sim).otherwise(F.lit(0.0))


@lru_cache(maxsize=65536)
def _compared(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@lru_cache(maxsize=65536)
def _digits(text: str) -> str | None:
    """The distinct digits of a text as they occur; None if it holds the characters that stand for digits of one text only."""
    return None if "\0" in text or "\1" in text else "".join(dict.fromkeys(c for c in text if c in "0123456789"))


def ratio(a: str, b: str) -> float:
    """The ratio depends on which characters are equal, not on what they are. So digits are renamed, those of both texts by their order
    in the first one, and texts that differ in their numbers only are compared once for each pattern of equal digits."""
    own, other = _digits(a), _digits(b)
    if own is None or other is None or not (own or other):
        return _compared(a, b)
    names = {ord(c): str(i) for i, c in enumerate(c for c in own if c in other)}
    return _compared(a.translate({**dict.fromkeys(map(ord, own), "\0"), **names}), b.translate({**dict.fromkeys(map(ord, other), "\1"), **names}))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, for which Spark has no built-in; 0 when either is blank."""
    return pd.Series([ratio(x, y) if x and y else 0.0 for x, y in zip(a, b)], dtype="float64")
