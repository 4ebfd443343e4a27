"""Mail search: boolean queries compiled to one Column, relevance scoring, date filters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealweave import lexicon as lx
from dealweave.functions import dates as D
from dealweave.functions import text as T

SEARCH_FIELDS = ("subject", "body", "sender", "recipients", "attachments")


@dataclass(frozen=True)
class Term:
    kind: str  # text | attachment | has_attachment
    value: str = ""
    negated: bool = False


def read_query(text: str) -> tuple[list[list[Term]], list[Term]]:
    """Split a search string into OR-ed groups of AND-ed terms, plus the flat list of terms.

    No parentheses; adjacent terms are AND-ed; NOT applies to the next term only.
    """
    import re

    groups: list[list[Term]] = []
    flat: list[Term] = []
    negate, joiner = False, "and"
    for phrase, word in re.findall(r'"([^"]*)"?|([^\s"]+)', text):
        low = (phrase.strip() if not word else word).lower()
        if word and low in ("and", "or", "not"):
            if low == "not":
                negate = True
            else:
                joiner = low
            continue
        if not low:
            continue
        if word and low.startswith("attachment:"):
            term = Term("attachment", low[len("attachment:"):], negate)
        elif word and low in ("has:attachment", "has:attachments"):
            term = Term("has_attachment", "", negate)
        else:
            term = Term("text", low, negate)
        flat.append(term)
        if not groups or joiner == "or":
            groups.append([term])
        else:
            groups[-1].append(term)
        negate, joiner = False, "and"
    return groups, flat


def query_column(text: str, fields=SEARCH_FIELDS) -> Column:
    """The whole search string as one boolean Column."""
    groups, _ = read_query(text)
    filled = [T.null_if_blank(F.lower(F.coalesce(F.col(f), F.lit("")))) for f in fields]
    haystack = F.concat_ws(" ", *filled)

    def test(term: Term) -> Column:
        if term.kind == "has_attachment":
            hit = F.col("has_attachments")
        elif term.kind == "attachment":
            hit = F.contains(F.lower(F.col("attachments")), F.lit(term.value))
        else:
            hit = F.contains(haystack, F.lit(term.value))
        return ~hit if term.negated else hit

    ands = [reduce(lambda a, b: a & b, map(test, g)) for g in groups]
    return reduce(lambda a, b: a | b, ands) if ands else F.lit(False)


def matched_fields(text: str, fields=SEARCH_FIELDS) -> Column:
    """Sorted names of the fields that contain any of the query's texts."""
    _, flat = read_query(text)

    def in_field(name: str) -> Column:
        values = [t.value for t in flat if t.kind == "text" or (t.kind == "attachment" and name == "attachments")]
        low = F.lower(F.coalesce(F.col(name), F.lit("")))
        hits = [F.contains(low, F.lit(v)) for v in values]
        return F.when((low != "") & (reduce(lambda a, b: a | b, hits) if hits else F.lit(False)), F.lit(name))

    return F.array_sort(F.array_compact(F.array(*[in_field(f) for f in fields])))


def search_mail(mail: DataFrame, text: str, fields=SEARCH_FIELDS, attachment_only=False) -> DataFrame:
    fields = ("attachments",) if attachment_only else fields
    return mail.where(query_column(text, fields)).withColumn("matched_fields", matched_fields(text, fields))


def search_attachments(mail: DataFrame, text: str) -> DataFrame:
    """Mails with attachments whose attachment text contains any term; operators are ignored."""
    _, flat = read_query(text)
    low = F.lower(F.col("attachments"))
    hits = [F.contains(low, F.lit(t.value)) for t in flat if t.kind != "has_attachment"]
    anyhit = reduce(lambda a, b: a | b, hits) if hits else F.lit(False)
    return mail.where(F.col("has_attachments") & anyhit)


def with_relevance(mail: DataFrame, text: str, body_chars: int | None = None) -> DataFrame:
    """Add ``score`` and ``matched_titles`` for one query. The query is analysed on the driver,
    so each mail is scored by plain substring tests against literals. Whole bodies are searched;
    ``body_chars`` looks at the first so many characters (4,000 for a prompt)."""
    raw = text.strip().lower()
    norm = " ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in raw).split())
    tokens = [t for t in norm.split() if len(t) >= 3 and t not in lx.QUERY_STOPWORDS]

    def has(c: Column, value: str, points: int) -> Column:
        return F.when(F.contains(c, F.lit(value)), points).otherwise(0) if value else F.lit(0)

    def hits(c: Column) -> Column:
        return reduce(lambda a, b: a + b, [has(c, t, 1) for t in tokens], F.lit(0))

    def title_score(title: Column) -> Column:
        n = T.search_form(title)
        h = hits(n)
        full = F.when(h == len(tokens), 75).otherwise(0) if len(tokens) >= 2 else F.lit(0)
        return F.greatest(has(F.lower(title), raw, 90), has(n, norm, 110), h * 14, full)

    body = T.clean_body(F.col("body"))
    mail = mail.withColumns({
        "titles": T.split_titles(F.col("attachments")),
        "_subj": T.search_form(F.col("subject")),
        "_body": T.search_form(F.substring(body, 1, body_chars) if body_chars else body),
        "_from": T.search_form(F.col("sender")),
        "_to": T.search_form(F.concat_ws(" ", F.col("recipients"), F.col("cc"))),
    })
    mail = mail.withColumn("_scored", F.transform("titles", lambda t: F.struct(title_score(t).alias("s"), t.alias("t"))))
    att = F.coalesce(F.array_max(F.transform("_scored", lambda x: x["s"])), F.lit(0))
    whole = F.concat_ws(" ", "_subj", "_body", "_from", "_to")
    score = (
        att + has(F.col("_subj"), norm, 24) + has(F.col("_body"), norm, 10)
        + has(F.col("_from"), norm, 8) + has(F.col("_to"), norm, 5)
        + hits(whole) * 3 + F.when(att > 0, 5).otherwise(0)
    )
    matched = F.transform(F.filter("_scored", lambda x: x["s"] > 0), lambda x: x["t"])
    return mail.withColumns({"score": score.cast("long"), "matched_titles": F.slice(matched, 1, 5)}).drop(
        "_subj", "_body", "_from", "_to", "_scored")


def relevance_top(mail: DataFrame, text: str, k: int = 120) -> DataFrame:
    """Best k mails: hits by score, newest first; padded with the newest others up to 40.

    Ordering by (tier, score, time, index) and taking k is a distributed top-k; the final rank is
    computed over those at most 200 rows.
    """
    k = max(lx.RELEVANCE_MIN_K, min(int(k or 120), lx.RELEVANCE_MAX_K))
    scored = with_relevance(mail, text).withColumns({
        "ts": D.epoch_of(F.col("date_received"), F.col("date_sent")),
        "tier": F.when(F.col("score") > 0, 0).otherwise(1),
    })
    order = [F.asc("tier"), F.when(F.col("tier") == 0, -F.col("score")).otherwise(0), F.desc("ts"), F.asc("email_idx")]
    best = scored.orderBy(*order).limit(k)
    rank = F.row_number().over(W.orderBy(*order))
    return best.withColumn("rank", rank).where(
        (F.col("tier") == 0) | (F.col("rank") <= min(k, lx.RELEVANCE_CONTEXT))
    )


def relevance_context(mail: DataFrame, text: str, k: int = 120) -> DataFrame:
    """Ranked rows with body preview and titles, as handed to a language model."""
    top = relevance_top(mail, text, k)
    return top.select(
        "rank", "email_idx", "sender", "recipients", "subject",
        T.truncated(T.clean_body(F.col("body")), 300).alias("body_preview"),
        T.first_filled(F.col("date_received"), F.col("date_sent")).alias("date"),
        "attachments", "titles", "matched_titles", "score", "has_attachments",
    )
