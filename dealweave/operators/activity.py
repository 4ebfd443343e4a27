"""Mailbox and time summaries over mails and meetings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave import lexicon as lx
from dealweave.functions import dates as D
from dealweave.functions import text as T
from dealweave.operators import hot
from dealweave.session import cut_lineage


def mailbox_summary(mail: DataFrame) -> DataFrame:
    date = T.first_filled(F.col("date_sent"), F.col("date_received"))
    return mail.select(
        "has_attachments", T.null_if_blank(date).alias("d"),
        F.when(T.domain_of(F.col("sender")) != "", T.address_of(F.col("sender"))).alias("f"),
        F.when(T.domain_of(F.col("recipients")) != "", T.address_of(F.col("recipients"))).alias("r"),
    ).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("has_attachments").alias("with_attachments"),
        F.countDistinct("f").alias("unique_senders"),
        F.countDistinct("r").alias("unique_recipients"),
        F.min("d").alias("earliest"), F.max("d").alias("latest"),
    )


def domain_counts(mail: DataFrame) -> DataFrame:
    sides = F.explode(F.array(
        F.struct(F.lit("sender").alias("side"), T.domain_of(F.col("sender")).alias("domain")),
        F.struct(F.lit("recipient").alias("side"), T.domain_of(F.col("recipients")).alias("domain")),
    )).alias("s")
    return (
        mail.select(sides).select("s.*").where("domain <> ''")
        .groupBy("side", "domain").agg(F.count(F.lit(1)).alias("mails"))
    )


def work_items(mail: DataFrame, calendar: DataFrame) -> DataFrame:
    """Mails and meetings as one table of dated, matter-tagged work items."""
    sent = F.col("date_sent") != ""
    mails = mail.select(
        F.lit("mail").alias("kind"), T.matter_key(F.col("subject")).alias("matter_key"),
        sent.cast("int").alias("sent"), (~sent).cast("int").alias("received"),
        F.lit(0).alias("meeting"), F.lit(0).alias("minutes"),
        D.calendar_time(T.first_filled(F.col("date_sent"), F.col("date_received"))).alias("at"),
    ).where(F.col("at").isNotNull())
    meetings = calendar.select(
        F.lit("meeting").alias("kind"), T.matter_key(F.col("summary")).alias("matter_key"),
        F.lit(0).alias("sent"), F.lit(0).alias("received"),
        F.lit(1).alias("meeting"), F.col("duration_minutes").alias("minutes"), F.col("start_ts").alias("at"),
    )
    return mails.unionByName(meetings)


def _hours(minutes):
    return F.round(minutes / 60, 1)


def by_matter(items: DataFrame) -> DataFrame:
    mails = F.col("sent") + F.col("received")
    g = items.groupBy("matter_key").agg(
        F.sum("sent").alias("emails_sent"), F.sum("received").alias("emails_received"),
        F.sum("meeting").alias("meetings"), F.sum("minutes").alias("meeting_minutes"),
        F.sum(F.col("minutes") + lx.MINUTES_PER_MAIL * mails).alias("total"),
    ).withColumn("_one", F.lit(1))
    # The matter table is used twice below; written once, the mails are scanned once.
    g = cut_lineage(g)
    # One total row, joined on a constant key: no window over all matters.
    whole = g.groupBy("_one").agg(F.greatest(F.sum("total"), F.lit(1)).alias("whole"))
    return g.join(F.broadcast(whole), "_one").select(
        "matter_key", "emails_sent", "emails_received", "meetings", "meeting_minutes",
        _hours(F.col("total")).alias("hours"),
        F.round(F.col("total") * 100 / F.col("whole")).cast("long").alias("percent"),
        _hours(F.col("meeting_minutes")).alias("meeting_hours"),
    )


def period_totals(items: DataFrame) -> DataFrame:
    mails = F.sum(F.col("sent") + F.col("received"))
    mins = F.sum("minutes")
    return items.agg(
        F.sum("meeting").alias("total_meetings"), mins.alias("total_meeting_minutes"), mails.alias("total_emails"),
        _hours(mins + lx.MINUTES_PER_MAIL * mails).alias("total_active_hours"),
        _hours(mins).alias("total_meeting_hours"),
    )


def hourly_mail(items: DataFrame) -> DataFrame:
    """Mails per hour label and matter, with the label's totals. Equal hours of different days merge."""
    per = cut_lineage(items.where("kind = 'mail'").groupBy(D.hour_label(F.col("at")).alias("time_label"), "matter_key").agg(
        F.count(F.lit(1)).alias("matter_emails")))
    labels = per.groupBy("time_label").agg(
        F.sum("matter_emails").alias("label_emails"), F.count(F.lit(1)).alias("label_matters"))
    return per.join(F.broadcast(labels), "time_label")  # at most 24 labels


def meetings_by_matter(calendar: DataFrame) -> DataFrame:
    m = calendar.withColumn("matter_key", T.matter_key(F.col("summary")))
    n = hot.numbered(m, ["matter_key"], F.date_trunc("hour", "start_ts"), ["start_ts", "event_id"], "pos")
    return n.select("matter_key", "pos", "summary", F.date_format("start_ts", D.ISO_OUT).alias("start"),
                    F.col("duration_minutes").cast("long").alias("duration"))


def timeline(items: DataFrame, calendar: DataFrame) -> DataFrame:
    """Meetings and hourly mail buckets in one table, with the display label and a real time."""
    meetings = calendar.select(
        F.date_format("start_ts", "hh:mm a").alias("time_label"), F.lit("meeting").alias("kind"),
        F.col("summary").alias("description"), F.col("duration_minutes").cast("long").alias("duration"),
        F.col("start_ts").alias("at"))
    hourly = hourly_mail(items).groupBy("time_label").agg(
        F.first("label_emails").alias("emails"), F.first("label_matters").alias("n"))
    mails = hourly.select(
        "time_label", F.lit("emails").alias("kind"),
        F.concat(F.lit("Email activity ("), F.col("emails").cast("string"), F.lit(" emails, "),
                 F.col("n").cast("string"), F.lit(" matters)")).alias("description"), "emails")
    return meetings.unionByName(mails, allowMissingColumns=True)
