"""Map raw exported tables (any header spelling) onto the library's schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave import lexicon as lx
from dealweave.functions import dates as D
from dealweave.functions import text as T

# fixed values: header aliases of mail and calendar exports
MAIL_ALIASES = {
    "subject": ("subject", "title"),
    "body": ("body", "message", "content", "message body"),
    "sender": ("from", "sender", "from: (address)", "from: (name)"),
    "recipients": ("to", "recipient", "to: (address)", "to: (name)"),
    "cc": ("cc", "carbon copy", "cc: (name)", "cc: (address)"),
    "date_sent": ("date sent", "sent", "send date"),
    "date_received": ("date received", "received", "receive date", "date"),
    "attachments": ("attachments", "attachment"),
    "has_attachments": ("has attachments",),
}
FIRST_ALIASES = {
    "subject": ("subject", "email subject", "title"),
    "body": ("body", "content", "message", "email body", "notes"),
    "sender": ("from", "sender", "from email", "from address"),
    "recipients": ("to", "recipient", "to email", "to address", "recipients"),
    "cc": ("cc", "cc recipients", "cc list"),
    "attachments": ("attachments", "attachment", "files", "file names", "attachment names"),
    "has_attachments": ("has attachments", "has attachment", "attachments?", "hasattachments"),
    "date": ("date", "sent", "received", "date sent", "date received", "sent date", "received time", "sent time"),
}
CALENDAR_ALIASES = {
    "summary": ("subject", "title", "summary"),
    "start": ("start date", "start", "begin"),
    "end": ("end date", "end"),
    "location": ("location",),
    "description": ("description", "body", "notes"),
    "duration": ("duration", "length"),
}
NO_WORDS = ("no", "false", "0", "")


def _named(df: DataFrame) -> list[tuple[str, str]]:
    return [(c, c.replace("﻿", "").strip().lower()) for c in df.columns]


def _raw(name: str):
    return T.strip(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))


def mail_table(df: DataFrame, keep=()) -> DataFrame:
    """Mail export to mail schema. Several address columns are concatenated; dates become ISO text;
    without an attachment column, file names are taken from subject and body."""
    by_alias = {f: [c for c, low in _named(df) if low in names] for f, names in MAIL_ALIASES.items()}
    has_column = any("attachment" in low for _, low in _named(df))

    def last(field):
        cols = by_alias[field]
        return _raw(cols[-1]) if cols else F.lit("")

    def joined(field):
        # separator appears once something stands before it
        out = F.lit("")
        for c in by_alias[field]:
            out = F.when(out != "", F.concat(out, F.lit("; "), _raw(c))).otherwise(_raw(c))
        return out

    flag_cols = [c for c, low in _named(df) if low in MAIL_ALIASES["has_attachments"] + MAIL_ALIASES["attachments"]]
    out = df.select(
        *keep, last("subject").alias("subject"), last("body").alias("body"), joined("sender").alias("sender"),
        joined("recipients").alias("recipients"), joined("cc").alias("cc"),
        F.coalesce(D.mail_date(last("date_sent")), F.lit("")).alias("date_sent"),
        F.coalesce(D.mail_date(last("date_received")), F.lit("")).alias("date_received"),
        last("attachments").alias("attachments"),
        (~F.lower(_raw(flag_cols[-1])).isin(*NO_WORDS) if flag_cols else F.lit(False)).alias("has_attachments"),
    )
    if not has_column:
        files = F.array_distinct(F.concat(T.file_names_in(F.col("subject")), T.file_names_in(F.col("body"))))
        out = out.withColumn("_f", files).withColumns({
            "attachments": F.array_join("_f", "; "), "has_attachments": F.size("_f") > 0}).drop("_f")
    return out.withColumns({"from_domain": T.domain_of(F.col("sender")), "to_domain": T.domain_of(F.col("recipients"))})


def mail_table_first(df: DataFrame, keep=()) -> DataFrame:
    """Second export reader: per field, the first present alias with a value in that row."""
    names = {low: c for c, low in reversed(_named(df))}

    def pick(field):
        cols = [F.col(f"`{names[a]}`").cast("string") for a in FIRST_ALIASES[field] if a in names]
        return T.strip(F.coalesce(*cols, F.lit("")))

    fields = [pick(f).alias(f) for f in FIRST_ALIASES if f != "has_attachments"]
    return df.select(*keep, *fields, T.truthy(pick("has_attachments")).alias("has_attachments"))


def calendar_table(df: DataFrame, keep=()) -> DataFrame:
    """Calendar export: given duration wins, else whole minutes from start to end; no start, no row."""
    by_alias = {f: [c for c, low in _named(df) if low in names] for f, names in CALENDAR_ALIASES.items()}

    def last(field):
        return _raw(by_alias[field][-1]) if by_alias[field] else F.lit("")

    given = last("duration").try_cast("double").cast("int")
    out = df.select(*keep, last("summary").alias("summary"), D.calendar_time(last("start")).alias("start_ts"),
                    D.calendar_time(last("end")).alias("end_ts"), last("location").alias("location"),
                    last("description").alias("description"), F.nullif(given, F.lit(0)).alias("_d"))
    minutes = F.coalesce("_d", D.minutes_between(F.col("start_ts"), F.col("end_ts")), F.lit(0))
    return out.withColumn("duration_minutes", minutes).drop("_d").where("start_ts IS NOT NULL")


def ics_events(files: DataFrame, keep=(), text: str = "value") -> DataFrame:
    """Events of iCalendar texts: lines unfolded first, then one row per VEVENT block."""
    unfolded = F.regexp_replace(F.col(text), r"\r?\n[ \t]", "")
    blocks = files.select(*keep, F.posexplode(
        F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"), F.lit(1))).alias("pos", "b"))

    def field(name):
        return T.strip(F.regexp_extract("b", rf"{name}[^:\n]*:([^\r\n]+)", 1))

    def moment(name):
        return D.calendar_time(F.regexp_extract("b", rf"{name}[^:\n]*:(\d{{8}}T?\d{{0,6}}Z?)", 1))

    out = blocks.select(*keep, "pos", field("SUMMARY").alias("summary"), moment("DTSTART").alias("start_ts"),
                        moment("DTEND").alias("end_ts"), field("LOCATION").alias("location"))
    minutes = F.coalesce(D.minutes_between(F.col("start_ts"), F.col("end_ts")), F.lit(0))
    return out.withColumn("duration_minutes", minutes).where("start_ts IS NOT NULL")


def role_table(df: DataFrame) -> DataFrame:
    """Find the document and signatory columns of a checklist table by header words.

    Without a document header the first column serves; without a signatory header, the first other
    column whose first five values hold a comma or semicolon. Fails when there is none.
    """
    ids = [c for c in ("row_id", "checklist_id") if c in df.columns]
    rest = [c for c in df.columns if c not in ids]

    def by_words(words):
        return next((c for c in rest if any(w in c.lower() for w in words)), None)

    doc = by_words(lx.ROLE_DOC_KEYWORDS) or rest[0]
    sig = by_words(lx.ROLE_SIGNATORY_KEYWORDS)
    if sig is None:
        for c in rest:
            if c == doc:
                continue
            sample = [str(r[0]) for r in df.select(f"`{c}`").where(F.col(f"`{c}`").isNotNull()).limit(5).collect()]
            if any("," in v or ";" in v for v in sample):
                sig = c
                break
    if sig is None:
        raise ValueError("no signatory column found: expected a header like 'Signatories' or 'Signed By'")
    return df.select(*ids, F.col(f"`{doc}`").cast("string").alias("document_name"), F.col(f"`{sig}`").cast("string").alias("signatories"))
