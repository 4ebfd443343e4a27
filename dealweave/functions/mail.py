"""Mail-level expressions: record normalisation, status tiers, activity label, thread key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave import lexicon as lx
from dealweave.functions import dates as D
from dealweave.functions import text as T

MAIL_FIELDS = (
    "subject", "body", "sender", "recipients", "cc", "attachments", "date", "date_sent",
    "date_received", "folder", "root_folder", "store", "entry_id", "conversation_id",
    "conversation_topic",
)


def normalize_mail(df: DataFrame) -> DataFrame:
    """Fill the mail schema: trimmed strings, flags, fallback date, current body, searchable text.

    Missing columns become blank. Attachments may be an array or a string.
    """
    out = {}
    for name in MAIL_FIELDS:
        if name not in df.columns:
            out[name] = F.lit("")
        elif name == "attachments" and df.schema[name].dataType.typeName() == "array":
            items = F.filter(F.transform(F.col(name), T.strip), lambda x: x != "")
            out[name] = F.coalesce(F.array_join(items, "; "), F.lit(""))
        else:
            out[name] = T.strip(F.coalesce(F.col(name), F.lit("")))
    keys = [c for c in df.columns if c not in out and c not in ("has_attachments", "is_sent_folder")]
    given = T.truthy(F.col("has_attachments")) if "has_attachments" in df.columns else F.lit(False)
    sent = T.truthy(F.col("is_sent_folder")) if "is_sent_folder" in df.columns else F.lit(False)
    base = df.select(*keys, *[c.alias(n) for n, c in out.items()],
                     given.alias("_given"), sent.alias("is_sent_folder"))
    att = F.lower(F.col("attachments"))
    base = base.withColumns({
        "has_attachments": F.col("_given") | ((att != "") & ~att.isin("none", "false", "no", "n/a")),
        "date": T.first_filled(F.col("date"), F.col("date_received"), F.col("date_sent")),
        "body_current": T.clean_body(F.col("body")),
    }).drop("_given")
    parts = ["subject", None, "sender", "recipients", "cc", "attachments", "folder", "root_folder",
             "store", "conversation_topic"]
    cols = [T.first_filled(F.col("body_current"), F.col("body")) if p is None else F.col(p) for p in parts]
    return base.withColumn("searchable", F.lower(F.concat_ws(" ", *cols)))


def message_date() -> Column:
    return T.first_filled(F.col("date_received"), F.col("date_sent"), F.col("date"))


def status_priority(text: Column) -> Column:
    """Priority of the highest status tier mentioned, 0 when none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(
        lambda acc, tier: F.when(T.any_rlike(low, tier[2]), F.lit(tier[1])).otherwise(acc),
        reversed(lx.STATUS_TIERS),
        F.lit(0),
    )


def status_name(priority: Column) -> Column:
    """Status wording of a tier priority; null for 0."""
    return F.element_at(
        F.create_map(*[F.lit(x) for s, p, _ in lx.STATUS_TIERS for x in (p, s)]), priority
    )


def model_status(c: Column) -> Column:
    """A supported status, directly or through its alias, else null."""
    text = T.strip(F.coalesce(c, F.lit("")))
    alias = F.create_map(*[F.lit(x) for kv in lx.STATUS_ALIASES.items() for x in kv])
    return F.when(text.isin(*lx.STATUS_VALUES), text).otherwise(F.try_element_at(alias, F.lower(text)))


def status_category(c: Column) -> Column:
    low = T.strip(F.lower(F.coalesce(c, F.lit(""))))
    return reduce(
        lambda acc, cat: F.when(T.any_rlike(low, cat[2]), F.lit(cat[0])).otherwise(acc),
        reversed(lx.STATUS_CATEGORIES),
        F.lit("pending"),
    )


def direction() -> Column:
    root = F.lower(T.squash(T.first_filled(F.col("root_folder"), F.col("folder"))))
    return (
        F.when(F.col("is_sent_folder"), "sent")
        .when(F.contains(root, F.lit("sent items")), "sent")
        .when(F.lower(T.squash(F.col("sender"))).isin("me", "myself"), "sent")
        .when((F.col("date_sent") != "") & (F.col("date_received") == ""), "sent")
        .otherwise("received")
    )


def with_activity(mail: DataFrame) -> DataFrame:
    """Status, label, direction, party, sentence and issue snippets of each mail."""
    s = F.col("searchable")
    mail = mail.withColumns({
        "priority": status_priority(s),
        "direction": direction(),
        "issues": T.issue_snippets(F.col("body")),
        "event_date": D.short_date(message_date()),
        "_doc": F.col("has_attachments") | T.any_rlike(s, lx.DOCUMENT_ACTIVITY_KEYWORDS),
    })
    drafty = F.contains(s, F.lit("draft")) | (F.contains(s, F.lit("revised")) & F.col("has_attachments"))
    party = F.when(F.col("direction") == "sent", F.col("recipients")).otherwise(F.col("sender"))
    mail = mail.withColumns({
        "status": status_name(F.col("priority")),
        "has_document_activity": F.col("_doc") | (F.col("priority") > 0),
        "label": F.when(F.col("priority") == 5, "executed copy")
        .when(F.col("priority") == 4, "execution version")
        .when(drafty, "draft")
        .when(T.any_rlike(s, lx.MARKUP_WORDS), "markup/comments")
        .when(F.col("_doc"), "draft")
        .otherwise(""),
        "party": T.party_label(party, "counterparty"),
    }).drop("_doc")
    return mail.withColumn("event_text", activity_sentence())


def activity_sentence() -> Column:
    sent = F.col("direction") == "sent"
    label = F.when(F.col("label") != "", F.col("label")).otherwise("document update")
    body = F.concat_ws(
        " ", F.when(sent, "Sent").otherwise("Received"), label,
        F.when(sent, "to").otherwise("from"), F.col("party"),
        F.when(F.col("event_date") != "", F.concat(F.lit("on "), F.col("event_date"))),
    )
    return F.when(body.endswith("."), body).otherwise(F.concat(body, F.lit(".")))


def thread_key(fallback: str = "email_idx") -> Column:
    """Conversation id, else topic, else subject, else first attachment stem, entry id, index."""
    first_file = F.get(T.split_attachments(F.col("attachments")), F.lit(0))
    stem = F.lower(T.squash(T.file_stem(F.regexp_replace(first_file, "/", "⁄"))))
    stem = F.replace(stem, F.lit("⁄"), F.lit("/"))

    def tagged(tag, c):
        return F.concat(F.lit(f"{tag}:"), T.null_if_blank(c))

    return F.coalesce(
        tagged("conversation", F.lower(T.squash(F.col("conversation_id")))),
        tagged("topic", F.lower(T.thread_subject(F.col("conversation_topic")))),
        tagged("subject", F.lower(T.thread_subject(F.col("subject")))),
        F.when(first_file.isNotNull(), F.concat(F.lit("attachment:"), stem)),
        tagged("entry", F.lower(T.squash(F.col("entry_id")))),
        F.concat(F.lit("email:"), F.col(fallback).cast("string")),
    )
