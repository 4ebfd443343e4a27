"""Queries over mails and calendars: search, relevance, threads, mailbox and activity summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealweave import lexicon as lx
from dealweave.functions import dates as D
from dealweave.functions import mail as M
from dealweave.functions import text as T
from dealweave.operators import activity as A
from dealweave.operators import hot
from dealweave.operators import search as S
from dealweave.operators import threads as TH
from dealweave.plans import duck as q
from dealweave.plans.registry import query

BOOLEAN_QUERY = '"purchase agreement" AND revised OR attachment:escrow NOT executed has:attachment'
RELEVANCE_QUERY = "find the purchase agreement draft"


def mails(t):
    """v_emails under the mail schema; attachments decide the flag."""
    return t.v_emails.withColumn("has_attachments", F.col("attachments") != "")


def long(c):
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


# ---------------------------------------------------------------- search
HAY = "lower(concat_ws(' ', nullif(subject,''), nullif(body,''), nullif(sender,''), nullif(recipients,''), nullif(attachments,'')))"
FLT1_SQL = f"""
SELECT email_idx, subject FROM v_emails WHERE
 (contains({HAY}, 'purchase agreement') AND contains({HAY}, 'revised'))
 OR (contains(lower(attachments), 'escrow') AND NOT contains({HAY}, 'executed') AND attachments <> '')
"""


@query("flt_01", FLT1_SQL)
def flt_01(t):
    return S.search_mail(mails(t), BOOLEAN_QUERY).select("email_idx", "subject")


def _field_sql(f):
    words = ["purchase agreement", "revised", "executed"] + (["escrow"] if f == "attachments" else [])
    test = " OR ".join(f"contains(lower({f}), '{w}')" for w in words)
    return f"CASE WHEN {test} THEN '{f}' END"


@query("flt_02", f"""
SELECT email_idx, concat_ws(',', {', '.join(_field_sql(f) for f in sorted(S.SEARCH_FIELDS))}) AS matched_fields
FROM ({FLT1_SQL.replace('email_idx, subject', '*')}) m
""")
def flt_02(t):
    found = S.search_mail(mails(t), BOOLEAN_QUERY)
    return found.select("email_idx", F.array_join("matched_fields", ",").alias("matched_fields"))


@query("flt_03", """
SELECT email_idx, attachments FROM v_emails WHERE attachments <> ''
 AND (contains(lower(attachments), 'escrow') OR contains(lower(attachments), 'building'))
""")
def flt_03(t):
    return S.search_attachments(mails(t), "escrow OR building").select("email_idx", "attachments")


def _relevance_sql():
    norm = "find the purchase agreement draft"
    toks = ["purchase", "agreement", "draft"]
    hit = lambda c: " + ".join(f"CASE WHEN contains({c}, '{w}') THEN 1 ELSE 0 END" for w in toks)
    return f"""
WITH {q.clean_body_cte('v_emails', 'email_idx', 'body')},
ti AS (SELECT email_idx, unnest(ts) AS title, unnest(range(1, len(ts) + 1)) AS pos FROM (SELECT email_idx,
  list_filter(list_transform(CASE WHEN contains(attachments, ';') THEN string_split(attachments, ';') ELSE string_split(attachments, ',') END, lambda x: trim(x)), lambda x: x <> '') AS ts FROM v_emails) z),
tn AS (SELECT *, {q.norm('title')} AS n FROM ti),
th AS (SELECT *, {hit('n')} AS h FROM tn),
tsc AS (SELECT *, greatest(CASE WHEN contains(lower(title), '{norm}') THEN 90 ELSE 0 END, CASE WHEN contains(n, '{norm}') THEN 110 ELSE 0 END, 14 * h, CASE WHEN h = 3 THEN 75 ELSE 0 END) AS s FROM th),
tat AS (SELECT email_idx, max(s) AS att, coalesce(string_agg(CASE WHEN s > 0 AND pos <= 5 THEN title END, '|' ORDER BY pos), '') AS matched FROM tsc GROUP BY email_idx),
f AS (SELECT e.*, clean, coalesce(att, 0) AS att, coalesce(matched, '') AS matched, {q.norm('subject')} AS sj, {q.norm('clean')} AS bd, {q.norm('sender')} AS fr, {q.norm("recipients || ' ' || cc")} AS rc
  FROM v_emails e JOIN cb USING (email_idx) LEFT JOIN tat USING (email_idx)),
sc AS (SELECT *, att + CASE WHEN contains(sj, '{norm}') THEN 24 ELSE 0 END + CASE WHEN contains(bd, '{norm}') THEN 10 ELSE 0 END
  + CASE WHEN contains(fr, '{norm}') THEN 8 ELSE 0 END + CASE WHEN contains(rc, '{norm}') THEN 5 ELSE 0 END
  + 3 * ({hit("concat_ws(' ', sj, bd, fr, rc)")}) + CASE WHEN att > 0 THEN 5 ELSE 0 END AS score,
  CAST(epoch(CAST(CASE WHEN date_received <> '' THEN date_received ELSE date_sent END AS TIMESTAMP)) AS BIGINT) AS ts FROM f),
pos AS (SELECT *, row_number() OVER (ORDER BY score DESC, ts DESC, email_idx) AS rank FROM sc WHERE score > 0),
neg AS (SELECT *, (SELECT least(count(*), 120) FROM pos) + row_number() OVER (ORDER BY ts DESC, email_idx) AS rank FROM sc WHERE score <= 0),
top AS (SELECT * FROM pos WHERE rank <= 120 UNION ALL SELECT * FROM neg WHERE rank <= 40)
"""


@query("sco_01", _relevance_sql() + "SELECT email_idx, CAST(score AS BIGINT) AS score, matched AS matched_titles FROM sc")
def sco_01(t):
    s = S.with_relevance(mails(t), RELEVANCE_QUERY)
    return s.select("email_idx", "score", F.array_join("matched_titles", "|").alias("matched_titles"))


@query("top_01", _relevance_sql() + "SELECT CAST(rank AS BIGINT) AS rank, email_idx, CAST(score AS BIGINT) AS score FROM top")
def top_01(t):
    return S.relevance_top(mails(t), RELEVANCE_QUERY).select(long("rank").alias("rank"), "email_idx", "score")


@query("prj_02", _relevance_sql() + """SELECT CAST(rank AS BIGINT) AS rank, email_idx, sender, subject,
 CASE WHEN length(clean) > 300 THEN clean[1:300] || '...' ELSE clean END AS body_preview,
 CASE WHEN date_received <> '' THEN date_received ELSE date_sent END AS date, matched AS matched_titles, CAST(score AS BIGINT) AS score FROM top""")
def prj_02(t):
    c = S.relevance_context(mails(t), RELEVANCE_QUERY)
    return c.select(long("rank").alias("rank"), "email_idx", "sender", "subject", "body_preview", "date",
                    F.array_join("matched_titles", "|").alias("matched_titles"), "score")


DEAL = r"regexp_extract(recipients, '^deal(\d+)@', 1)"


@query("prj_03", rf"""
SELECT * EXCLUDE (rn), CAST(rn AS BIGINT) AS pos FROM (SELECT {DEAL} AS mailbox, email_idx, CASE WHEN sender = '' THEN 'Unknown' ELSE sender END AS sender,
 CASE WHEN subject = '' THEN '(No Subject)' ELSE subject END AS subject, CASE WHEN length({q.strip('body')}) > 500 THEN {q.strip('body')}[1:500] || '...' ELSE {q.strip('body')} END AS body_text,
 row_number() OVER (PARTITION BY {DEAL} ORDER BY email_idx) AS rn FROM v_emails) z
""")
def prj_03(t):
    m = mails(t).withColumn("mailbox", F.regexp_extract("recipients", r"^deal(\d+)@", 1))
    top = hot.numbered(m, ["mailbox"], hot.index_block(F.col("email_idx")), ["email_idx"], "pos")  # a prompt takes pos <= 50
    return top.select(
        "mailbox", "email_idx", T.first_filled(F.col("sender"), F.lit("Unknown")).alias("sender"),
        T.first_filled(F.col("subject"), F.lit("(No Subject)")).alias("subject"),
        T.truncated(F.col("body"), 500).alias("body_text"), long("pos").alias("pos"))


@query("flt_04", """
SELECT email_idx, 'mail' AS kind FROM v_emails WHERE CAST(CASE WHEN date_sent <> '' THEN date_sent ELSE date_received END AS TIMESTAMP) >= DATE '1995-06-12'
 AND CAST(CASE WHEN date_sent <> '' THEN date_sent ELSE date_received END AS TIMESTAMP) < DATE '1995-06-19'
UNION ALL SELECT event_id, 'meeting' FROM v_calendar WHERE date_trunc('week', start_ts) = DATE '2024-01-15'
""")
def flt_04(t):
    when = F.to_timestamp(T.first_filled(F.col("date_sent"), F.col("date_received")))
    m = t.v_emails.where(D.in_period(when, "1995-06-14", "week")).select("email_idx", F.lit("mail").alias("kind"))
    c = t.v_calendar.where(D.in_period(F.col("start_ts"), "2024-01-17", "week"))
    return m.unionByName(c.select(F.col("event_id").alias("email_idx"), F.lit("meeting").alias("kind")))


# ---------------------------------------------------------------- strings and dates on mails
@query("str_01", f"SELECT email_idx, {q.address('sender')} AS address FROM v_emails")
def str_01(t):
    return t.v_emails.select("email_idx", T.address_of(F.col("sender")).alias("address"))


@query("str_02", f"SELECT email_idx, coalesce(split_part({q.address('sender')}, '@', 2), '') AS domain, split_part({q.address('recipients')}, '@', 2) AS to_domain FROM v_emails")
def str_02(t):
    return t.v_emails.select("email_idx", T.domain_of(F.col("sender")).alias("domain"), T.domain_of(F.col("recipients")).alias("to_domain"))


FILES = lambda c: f"list_filter(list_transform(regexp_extract_all({c}, {q.lit(lx.FILENAME_PATTERN.replace(chr(92) + "w", "_" + chr(92) + "p{L}" + chr(92) + "p{M}" + chr(92) + "p{N}").replace(chr(92) + "s]", chr(92) + "s" + chr(92) + "p{Z}]"))}), lambda x: {q.strip('x')}), lambda x: length(x) > 4)"


@query("str_03", f"SELECT email_idx, array_to_string({FILES('body')}, '|') AS files FROM v_emails")
def str_03(t):
    return t.v_emails.select("email_idx", F.array_join(T.file_names_in(F.col("body")), "|").alias("files"))


@query("str_04", f"SELECT email_idx AS id, {q.norm('subject')} AS norm FROM v_emails UNION ALL SELECT -doc_id - 1, {q.norm('text')} FROM documents")
def str_04(t):
    e = t.v_emails.select(F.col("email_idx").alias("id"), T.search_form(F.col("subject")).alias("norm"))
    return e.unionAll(t.documents.select((-F.col("doc_id") - 1).alias("id"), T.search_form(F.col("text")).alias("norm")))


@query("str_05", f"""
SELECT email_idx, array_to_string({q.tokens('body', 3, lx.QUERY_STOPWORDS)}, ' ') AS query_tokens,
 array_to_string({q.ordered_distinct(q.tokens('body', 3, lx.SEARCH_STOPWORDS))}, ' ') AS search_tokens,
 array_to_string({q.ordered_distinct(q.tokens('body', 4, lx.DEAL_STOPWORDS))}, ' ') AS deal_tokens FROM v_emails
""")
def str_05(t):
    b = F.col("body")
    return t.v_emails.select("email_idx", F.array_join(T.query_tokens(b), " ").alias("query_tokens"),
                             F.array_join(T.search_tokens(b), " ").alias("search_tokens"),
                             F.array_join(T.deal_tokens(b), " ").alias("deal_tokens"))


@query("str_06", f"SELECT email_idx AS id, {q.lookup('attachments')} AS lookup FROM v_emails UNION ALL SELECT -row_id, {q.lookup('document_name')} FROM v_checklist")
def str_06(t):
    e = t.v_emails.select(F.col("email_idx").alias("id"), T.lookup_form(F.col("attachments")).alias("lookup"))
    return e.unionAll(t.v_checklist.select(-F.col("row_id"), T.lookup_form(F.col("document_name"))))


@query("str_07", f"""
SELECT email_idx, array_to_string(list_filter(list_transform(CASE WHEN contains(attachments, ';') THEN string_split(attachments, ';') ELSE string_split(attachments, ',') END, lambda x: trim(x)), lambda x: x <> ''), '|') AS titles,
 array_to_string({q.cased_distinct("string_split_regex(cc, '[;,]')")}, '|') AS names FROM v_emails
""")
def str_07(t):
    return t.v_emails.select("email_idx", F.array_join(T.split_titles(F.col("attachments")), "|").alias("titles"),
                             F.array_join(T.split_attachments(F.col("cc")), "|").alias("names"))


@query("str_08", f"SELECT email_idx, {q.thread_subject('subject')} AS thread_subject, lower({q.thread_subject('subject')}) AS normalized FROM v_emails")
def str_08(t):
    s = T.thread_subject(F.col("subject"))
    return t.v_emails.select("email_idx", s.alias("thread_subject"), F.lower(s).alias("normalized"))


@query("str_09", f"WITH {q.clean_body_cte('v_emails', 'email_idx', 'body')} SELECT email_idx, clean FROM cb")
def str_09(t):
    return t.v_emails.select("email_idx", T.clean_body(F.col("body")).alias("clean"))


ISSUES = lambda key: f"""
is_p AS (SELECT {key}, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT {key}, string_split_regex(regexp_replace(clean, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') AS ps FROM cb) z),
is_k AS (SELECT {key}, {q.squash('p')} AS p, min(i) AS i FROM is_p WHERE length({q.squash('p')}) BETWEEN 25 AND 240 AND NOT regexp_matches(lower(p), {q.HDR}) AND {q.any_of('lower(p)', lx.ISSUE_KEYWORDS)} GROUP BY 1, 2),
iss AS (SELECT {key}, string_agg(p, '|' ORDER BY i) AS issues, count(*) AS n_issues FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY i) AS rn FROM is_k) z WHERE rn <= 3 GROUP BY {key})"""


@query("str_10", f"WITH {q.clean_body_cte('v_emails', 'email_idx', 'body')}, {ISSUES('email_idx')} SELECT email_idx, coalesce(issues, '') AS issues FROM cb LEFT JOIN iss USING (email_idx)")
def str_10(t):
    return t.v_emails.select("email_idx", F.array_join(T.issue_snippets(F.col("body")), "|").alias("issues"))


@query("str_11", f"""
SELECT doc_id, CASE WHEN length({q.strip('text')}) > 300 THEN {q.strip('text')}[1:300] || '...' ELSE {q.strip('text')} END AS preview,
 CASE WHEN length(text) > 1000 THEN text[1:500] || chr(10) || chr(10) || '...[truncated]...' || chr(10) || chr(10) || right(text, 500) ELSE text END AS head_tail FROM documents
""")
def str_11(t):
    return t.documents.select("doc_id", T.truncated(F.col("text"), 300).alias("preview"), T.head_and_tail(F.col("text"), 1000).alias("head_tail"))


@query("str_12", f"SELECT email_idx, CASE WHEN {q.squash('cc')} = '' THEN 'counterparty' ELSE coalesce(nullif({q.squash('split_part(' + q.squash('cc') + ', chr(59), 1)')}[1:80], ''), 'counterparty') END AS party, {q.squash('split_part(' + q.squash('recipients') + ', chr(59), 1)')}[1:80] AS to_party FROM v_emails")
def str_12(t):
    return t.v_emails.select("email_idx", T.party_label(F.col("cc"), "counterparty").alias("party"), T.party_label(F.col("recipients")).alias("to_party"))


@query("str_19", f"SELECT email_idx AS id, 'mail' AS kind, {q.matter('subject')} AS matter_key FROM v_emails UNION ALL SELECT event_id, 'meeting', {q.matter('summary')} FROM v_calendar")
def str_19(t):
    e = t.v_emails.select(F.col("email_idx").alias("id"), F.lit("mail").alias("kind"), T.matter_key(F.col("subject")).alias("matter_key"))
    return e.unionAll(t.v_calendar.select("event_id", F.lit("meeting"), T.matter_key(F.col("summary"))))


# Dates of orders and events rendered in every accepted shape, in both engines.
SHAPES = (
    ("MM/dd/yyyy hh:mm a", "%m/%d/%Y %I:%M %p"), ("M/d/yyyy HH:mm", "%-m/%-d/%Y %H:%M"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    ("dd/MM/yyyy HH:mm", "%d/%m/%Y %H:%M"), ("M/d/yy h:mm a", "%-m/%-d/%y %-I:%M %p"),
)
ICS_SHAPES = (("yyyyMMdd'T'HHmmss'Z'", "%Y%m%dT%H%M%SZ"), ("yyyyMMdd'T'HHmmss", "%Y%m%dT%H%M%S"), ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"))


def shaped(ts, key, shapes):
    out = F.lit("not a date")
    for i, (fmt, _) in enumerate(shapes):
        out = F.when(key % (len(shapes) + 1) == i, F.date_format(ts, fmt)).otherwise(out)
    return out


def shaped_sql(ts, key, shapes):
    return f"CASE CAST({key} % {len(shapes) + 1} AS INT) " + " ".join(f"WHEN {i} THEN strftime({ts}, {q.lit(d)})" for i, (_, d) in enumerate(shapes)) + " ELSE 'not a date' END"


def parsed_sql(raw, strp):
    def one(f):
        fits = {"/%Y": r"/\d{4} ", "/%y": r"/\d\d "}.get(f[5:8], ".")
        return f"CASE WHEN regexp_matches({raw}, '{fits}') THEN try_strptime({raw}, {q.lit(f)}) END"

    return "coalesce(" + ", ".join(map(one, strp)) + ")"


MAIL_STRP = ("%m/%d/%Y %I:%M %p", "%m/%d/%Y %H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%d/%m/%Y %H:%M", "%m/%d/%y %I:%M %p")
CAL_STRP = MAIL_STRP[:4] + ("%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%SZ") + MAIL_STRP[4:] + ("%Y%m%dT%H%M%SZ", "%Y%m%dT%H%M%S")


@query("dat_01", f"""SELECT o_orderkey, raw, coalesce(strftime({parsed_sql('raw', MAIL_STRP)}, '%Y-%m-%dT%H:%M:%S'), raw) AS parsed
FROM (SELECT o_orderkey, {shaped_sql("o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT))", 'o_orderkey', SHAPES)} AS raw FROM orders) z""")
def dat_01(t):
    ts = F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    o = t.orders.select("o_orderkey", shaped(ts, F.col("o_orderkey"), SHAPES).alias("raw"))
    return o.withColumn("parsed", D.mail_date(F.col("raw")))


@query("dat_02", f"""SELECT event_id, raw, strftime({parsed_sql('raw', CAL_STRP)}, '%Y-%m-%dT%H:%M:%S') AS parsed
FROM (SELECT event_id, {shaped_sql("date_trunc('second', ts)", 'event_id', SHAPES + ICS_SHAPES)} AS raw FROM events) z""")
def dat_02(t):
    e = t.events.select("event_id", shaped(F.date_trunc("second", "ts"), F.col("event_id"), SHAPES + ICS_SHAPES).alias("raw"))
    return e.withColumn("parsed", F.date_format(D.calendar_time(F.col("raw")), D.ISO_OUT))


MSG = "CASE WHEN date_received <> '' THEN date_received ELSE date_sent END"


@query("dat_03", f"SELECT email_idx, strftime(CAST({MSG} AS TIMESTAMP), '%m/%d/%Y') AS short_date, CAST(epoch(CAST({MSG} AS TIMESTAMP)) AS BIGINT) AS epoch FROM v_emails")
def dat_03(t):
    msg = T.first_filled(F.col("date_received"), F.col("date_sent"))
    return t.v_emails.select("email_idx", D.short_date(msg).alias("short_date"), D.epoch_of(F.col("date_received"), F.col("date_sent")).alias("epoch"))


@query("dat_04", """SELECT event_id, strftime(date_trunc('week', start_ts), '%Y-%m-%d') AS week_start, strftime(start_ts, '%I:00 %p') AS hour_label,
 CAST(trunc((epoch(date_trunc('second', start_ts)) - epoch(date_trunc('week', start_ts))) / 60) AS BIGINT) AS minutes_into_week FROM v_calendar""")
def dat_04(t):
    s = F.col("start_ts")
    return t.v_calendar.select("event_id", F.date_format(F.date_trunc("week", s), "yyyy-MM-dd").alias("week_start"), D.hour_label(s).alias("hour_label"),
                               long(D.minutes_between(F.date_trunc("week", s), s)).alias("minutes_into_week"))


# ---------------------------------------------------------------- record level
SEARCHABLE = "lower(concat(trim(subject), ' ', CASE WHEN clean <> '' THEN clean ELSE body END, ' ', sender, ' ', recipients, ' ', cc, ' ', attachments, '  ', root_folder, '  '))"
NORM_CTE = f"{q.clean_body_cte('v_emails', 'email_idx', 'body')}, nm AS (SELECT e.*, clean, {SEARCHABLE} AS searchable, attachments <> '' AS has_att FROM v_emails e JOIN cb USING (email_idx))"
DIRECTION = "CASE WHEN contains(lower(root_folder), 'sent items') OR (date_sent <> '' AND date_received = '') THEN 'sent' ELSE 'received' END"
DOC_ACT = f"(has_att OR {q.any_of('searchable', lx.DOCUMENT_ACTIVITY_KEYWORDS)})"
LABEL = f"""CASE WHEN priority = 5 THEN 'executed copy' WHEN priority = 4 THEN 'execution version'
 WHEN contains(searchable, 'draft') OR (contains(searchable, 'revised') AND has_att) THEN 'draft'
 WHEN {q.any_of('searchable', lx.MARKUP_WORDS)} THEN 'markup/comments' WHEN {DOC_ACT} THEN 'draft' ELSE '' END"""
ACT_CTE = f"""{NORM_CTE}, {ISSUES('email_idx')},
ac AS (SELECT z.*, {LABEL} AS label, {DOC_ACT} OR priority > 0 AS has_document_activity, coalesce(issues, '') AS issues, coalesce(n_issues, 0) AS n_issues,
 {q.status_name('priority')} AS status, {q.squash("split_part(CASE WHEN direction = 'sent' THEN recipients ELSE sender END, chr(59), 1)")}[1:80] AS party,
 strftime(CAST({MSG} AS TIMESTAMP), '%m/%d/%Y') AS event_date, CAST({MSG} AS TIMESTAMP) AS sort_ts
 FROM (SELECT *, {q.priority('searchable')} AS priority, {DIRECTION} AS direction FROM nm) z LEFT JOIN iss USING (email_idx))"""
TKEY = f"""CASE WHEN conversation_id <> '' THEN 'conversation:' || lower(conversation_id)
 WHEN {q.thread_subject('subject')} <> '' THEN 'subject:' || lower({q.thread_subject('subject')})
 WHEN attachments <> '' THEN 'attachment:' || lower({q.squash(q.stem("trim(string_split_regex(attachments, '[;,]')[1])"))})
 ELSE 'email:' || CAST(email_idx AS VARCHAR) END"""


@query("src_05", f"WITH {NORM_CTE} SELECT email_idx, searchable, has_att AS has_attachments, {MSG} AS date FROM nm")
def src_05(t):
    return M.normalize_mail(t.v_emails).select("email_idx", "searchable", "has_attachments", "date")


@query("cls_01", f"WITH {NORM_CTE} SELECT email_idx, CAST({q.priority('searchable')} AS BIGINT) AS priority, {q.status_name(q.priority('searchable'))} AS status FROM nm")
def cls_01(t):
    p = M.status_priority(F.col("searchable"))
    return M.normalize_mail(t.v_emails).select("email_idx", long(p).alias("priority"), M.status_name(p).alias("status"))


@query("cls_02", f"WITH {ACT_CTE} SELECT email_idx, label, has_document_activity, issues FROM ac")
def cls_02(t):
    return M.with_activity(M.normalize_mail(t.v_emails)).select("email_idx", "label", "has_document_activity", F.array_join("issues", "|").alias("issues"))


@query("cls_03", f"SELECT email_idx, {DIRECTION} AS direction FROM v_emails")
def cls_03(t):
    return M.normalize_mail(t.v_emails).select("email_idx", M.direction().alias("direction"))


@query("cls_07", f"SELECT email_idx, {TKEY} AS thread_key FROM v_emails")
def cls_07(t):
    return M.normalize_mail(t.v_emails).select("email_idx", M.thread_key().alias("thread_key"))


# ---------------------------------------------------------------- threads
THREAD_CTE = f"""{ACT_CTE},
tm AS (SELECT *, {TKEY} AS thread_key FROM ac),
tp AS (SELECT *, row_number() OVER (PARTITION BY thread_key ORDER BY sort_ts, email_idx) AS pos FROM tm)"""


def members(t):
    return TH.thread_members(M.normalize_mail(t.v_emails))


@query("win_01", f"WITH {THREAD_CTE} SELECT thread_key, email_idx, CAST(pos AS BIGINT) AS pos FROM tp")
def win_01(t):
    return TH.numbered_messages(members(t)).select("thread_key", "email_idx", "pos")


@query("win_02", f"WITH {THREAD_CTE} SELECT thread_key, coalesce(max_by(subject, (sort_ts, email_idx)) FILTER (WHERE subject <> ''), '') AS subject FROM tm GROUP BY thread_key")
def win_02(t):
    return TH.build_threads(members(t)).select("thread_key", "subject")


PEOPLE_SQL = f"""
pp AS (SELECT thread_key, sort_ts, email_idx, unnest(ps) AS person, unnest(range(1, len(ps) + 1)) AS i FROM
 (SELECT thread_key, sort_ts, email_idx, list_concat(list_concat([{q.squash('sender')}], list_transform(string_split(recipients, ';'), lambda x: {q.squash('x')})), list_transform(string_split(cc, ';'), lambda x: {q.squash('x')})) AS ps FROM tm) z),
pd AS (SELECT thread_key, lower(person) AS lp, arg_min(person, (sort_ts, email_idx, i)) AS person, min((sort_ts, email_idx, i)) AS at_ FROM pp WHERE person <> '' GROUP BY 1, 2),
pr AS (SELECT *, row_number() OVER (PARTITION BY thread_key ORDER BY at_) AS rn FROM pd),
pa AS (SELECT thread_key, string_agg(person, '; ' ORDER BY rn) AS participants FROM pr WHERE rn <= 8 GROUP BY 1),
ip AS (SELECT thread_key, lower(p) AS lp, arg_min(p, (sort_ts, email_idx, i)) AS p, min((sort_ts, email_idx, i)) AS at_ FROM (SELECT thread_key, sort_ts, email_idx, unnest(string_split(issues, '|')) AS p, unnest(range(1, len(string_split(issues, '|')) + 1)) AS i FROM tm WHERE issues <> '') z GROUP BY 1, 2),
ia AS (SELECT thread_key, string_agg(p, ' || ' ORDER BY rn) AS issue_text FROM (SELECT *, row_number() OVER (PARTITION BY thread_key ORDER BY at_) AS rn FROM ip) z WHERE rn <= 3 GROUP BY 1),
fa AS (SELECT thread_key, count(DISTINCT lower(trim(f))) AS attachment_count FROM (SELECT thread_key, unnest(string_split_regex(attachments, '[;,]')) AS f FROM tm WHERE attachments <> '') z WHERE trim(f) <> '' GROUP BY 1)"""


@query("agg_07", f"""WITH {THREAD_CTE}, {PEOPLE_SQL},
co AS (SELECT thread_key, count(*) AS message_count, coalesce(max_by(subject, (sort_ts, email_idx)) FILTER (WHERE subject <> ''), '') AS subject, min_by(event_date, (sort_ts, email_idx)) AS first_date,
 max_by(event_date, (sort_ts, email_idx)) AS last_date, {q.status_name('max(priority)')} AS status_signal, max_by(CASE WHEN clean <> '' THEN clean ELSE body END, (sort_ts, email_idx))[1:260] AS latest_body_excerpt FROM tm GROUP BY thread_key)
SELECT co.*, coalesce(participants, '') AS participants, coalesce(issue_text, '') AS issue_text, coalesce(attachment_count, 0) AS attachment_count
FROM co LEFT JOIN pa USING (thread_key) LEFT JOIN ia USING (thread_key) LEFT JOIN fa USING (thread_key)""")
def agg_07(t):
    return TH.build_threads(members(t)).select(
        "thread_key", "message_count", "subject", "first_date", "last_date", "status_signal", "latest_body_excerpt",
        "participants", "issue_text", "attachment_count")


@query("top_04", f"""WITH {THREAD_CTE}, th AS (SELECT thread_key, min(email_idx) AS fi, max(sort_ts) AS la FROM tm GROUP BY 1),
ti AS (SELECT thread_key, 'thread-' || CAST(row_number() OVER (ORDER BY fi) AS VARCHAR) AS thread_id, CAST(la AS DATE) AS d FROM th)
SELECT thread_key, thread_id, strftime(d, '%Y-%m-%d') AS last_day FROM ti ORDER BY d DESC, thread_id DESC""")
def top_04(t):
    m = members(t)
    th = m.groupBy("thread_key").agg(F.min("email_idx").alias("first_idx"), F.max(F.struct("sort_ts")).alias("last_at"))
    return TH.with_thread_ids(th).orderBy(*TH.thread_order()).select(
        "thread_key", "thread_id", F.date_format("last_at.sort_ts", "yyyy-MM-dd").alias("last_day"))


@query("top_09", f"""WITH {THREAD_CTE}, {PEOPLE_SQL} SELECT thread_key, CAST(rn AS BIGINT) AS pos, person AS item FROM pr WHERE rn <= 8""")
def top_09(t):
    return TH.thread_items(members(t), "participants", k=8).select("thread_key", long("pos").alias("pos"), "item")


@query("pip_03", f"""WITH {THREAD_CTE} SELECT thread_key, count(*) AS message_count, count(*) FILTER (WHERE direction = 'sent') AS sent, count(*) FILTER (WHERE has_document_activity) AS with_documents,
 {q.status_name('max(priority)')} AS status_signal, max_by(event_text, (sort_ts, email_idx)) AS last_event
 FROM (SELECT *, concat(CASE direction WHEN 'sent' THEN 'Sent ' ELSE 'Received ' END, CASE WHEN label <> '' THEN label ELSE 'document update' END, CASE direction WHEN 'sent' THEN ' to ' ELSE ' from ' END, party, ' on ', event_date, '.') AS event_text FROM tm) z GROUP BY thread_key""")
def pip_03(t):
    at = F.struct("sort_ts", "email_idx")
    return members(t).groupBy("thread_key").agg(
        F.count(F.lit(1)).alias("message_count"), F.count_if(F.col("direction") == "sent").alias("sent"),
        F.count_if("has_document_activity").alias("with_documents"),
        M.status_name(F.max("priority")).alias("status_signal"), F.max_by("event_text", at).alias("last_event"))


# ---------------------------------------------------------------- mailbox summaries
FROM_D = f"split_part({q.address('sender')}, '@', 2)"
TO_D = f"split_part({q.address('recipients')}, '@', 2)"


@query("agg_01", f"""SELECT count(*) AS total, count(*) FILTER (WHERE attachments <> '') AS with_attachments,
 count(DISTINCT CASE WHEN {FROM_D} <> '' THEN {q.address('sender')} END) AS unique_senders, count(DISTINCT CASE WHEN {TO_D} <> '' THEN {q.address('recipients')} END) AS unique_recipients,
 min(CASE WHEN date_sent <> '' THEN date_sent ELSE date_received END) AS earliest, max(CASE WHEN date_sent <> '' THEN date_sent ELSE date_received END) AS latest FROM v_emails""")
def agg_01(t):
    return A.mailbox_summary(mails(t))


@query("agg_02", f"""SELECT 'sender' AS side, {FROM_D} AS domain, count(*) AS mails FROM v_emails WHERE {FROM_D} <> '' GROUP BY 2
UNION ALL SELECT 'recipient', {TO_D}, count(*) FROM v_emails WHERE {TO_D} <> '' GROUP BY 2""")
def agg_02(t):
    return A.domain_counts(mails(t))


SENT_AT = "CAST(CASE WHEN date_sent <> '' THEN date_sent ELSE date_received END AS TIMESTAMP)"
WORK = f"""wk AS (SELECT {q.matter('subject')} AS matter_key, CASE WHEN date_sent <> '' THEN 1 ELSE 0 END AS s, CASE WHEN date_sent <> '' THEN 0 ELSE 1 END AS r, 0 AS m, 0 AS mm, {SENT_AT} AS ts FROM v_emails
 UNION ALL SELECT {q.matter('summary')}, 0, 0, 1, duration_minutes, start_ts FROM v_calendar)"""


@query("agg_03", f"""WITH {WORK}, g AS (SELECT matter_key, sum(s) AS emails_sent, sum(r) AS emails_received, sum(m) AS meetings, sum(mm) AS meeting_minutes, sum(mm + 3 * (s + r)) AS minutes FROM wk GROUP BY 1)
SELECT matter_key, CAST(emails_sent AS BIGINT) AS emails_sent, CAST(emails_received AS BIGINT) AS emails_received, CAST(meetings AS BIGINT) AS meetings, CAST(meeting_minutes AS BIGINT) AS meeting_minutes,
 round(minutes / 60.0, 1)::DOUBLE AS hours, CAST(round(minutes * 100.0 / greatest((SELECT sum(minutes) FROM g), 1)) AS BIGINT) AS percent, round(meeting_minutes / 60.0, 1)::DOUBLE AS meeting_hours FROM g""")
def agg_03(t):
    return A.by_matter(A.work_items(mails(t), t.v_calendar))


@query("agg_04", f"""WITH {WORK} SELECT CAST(sum(m) AS BIGINT) AS total_meetings, CAST(sum(mm) AS BIGINT) AS total_meeting_minutes, CAST(sum(s + r) AS BIGINT) AS total_emails,
 round(sum(mm + 3 * (s + r)) / 60.0, 1)::DOUBLE AS total_active_hours, round(sum(mm) / 60.0, 1)::DOUBLE AS total_meeting_hours FROM wk""")
def agg_04(t):
    return A.period_totals(A.work_items(mails(t), t.v_calendar))


HOUR_SQL = f"""hm AS (SELECT strftime({SENT_AT}, '%I:00 %p') AS time_label, {q.matter('subject')} AS matter_key, count(*) AS matter_emails FROM v_emails GROUP BY 1, 2),
hl AS (SELECT time_label, CAST(sum(matter_emails) AS BIGINT) AS label_emails, count(*) AS label_matters FROM hm GROUP BY 1)"""


@query("agg_05", f"WITH {HOUR_SQL} SELECT hm.*, label_emails, label_matters FROM hm JOIN hl USING (time_label)")
def agg_05(t):
    return A.hourly_mail(A.work_items(mails(t), t.v_calendar))


@query("agg_06", f"""SELECT {q.matter('summary')} AS matter_key, CAST(row_number() OVER (PARTITION BY {q.matter('summary')} ORDER BY start_ts, event_id) AS BIGINT) AS pos, summary,
 strftime(start_ts, '%Y-%m-%dT%H:%M:%S') AS start, CAST(duration_minutes AS BIGINT) AS duration FROM v_calendar""")
def agg_06(t):
    return A.meetings_by_matter(t.v_calendar)


@query("top_05", f"""WITH {WORK} SELECT matter_key, CAST(sum(mm) AS BIGINT) AS meeting_minutes FROM wk GROUP BY 1 ORDER BY 2 DESC, 1""")
def top_05(t):
    return A.by_matter(A.work_items(mails(t), t.v_calendar)).orderBy(F.desc("meeting_minutes"), "matter_key").select("matter_key", "meeting_minutes")


TIMELINE_SQL = f"""tl AS (SELECT strftime(start_ts, '%I:%M %p') AS time_label, 'meeting' AS kind, summary AS description, CAST(duration_minutes AS BIGINT) AS duration, CAST(NULL AS BIGINT) AS emails FROM v_calendar
 UNION ALL SELECT time_label, 'emails', concat('Email activity (', label_emails, ' emails, ', label_matters, ' matters)'), NULL, label_emails FROM hl)"""


@query("set_01", f"WITH {HOUR_SQL}, {TIMELINE_SQL} SELECT * FROM tl")
def set_01(t):
    return A.timeline(A.work_items(mails(t), t.v_calendar), t.v_calendar).drop("at")


@query("top_06", f"WITH {HOUR_SQL}, {TIMELINE_SQL} SELECT time_label, kind, description FROM tl ORDER BY time_label, kind, description")
def top_06(t):
    tl = A.timeline(A.work_items(mails(t), t.v_calendar), t.v_calendar)
    return tl.orderBy("time_label", "kind", "description").select("time_label", "kind", "description")


@query("pip_01", f"""WITH {WORK.replace('FROM v_emails', "FROM v_emails WHERE date_trunc('week', " + SENT_AT + ") = DATE '1995-06-12'").replace('FROM v_calendar', "FROM v_calendar WHERE date_trunc('week', start_ts) = DATE '1995-06-12'")}, g AS (SELECT matter_key, sum(s) AS s, sum(r) AS r, sum(m) AS m, sum(mm) AS mm, sum(mm + 3 * (s + r)) AS minutes FROM wk GROUP BY 1)
SELECT matter_key, CAST(s AS BIGINT) AS emails_sent, CAST(r AS BIGINT) AS emails_received, CAST(m AS BIGINT) AS meetings, round(minutes / 60.0, 1)::DOUBLE AS hours,
 CAST(round(minutes * 100.0 / greatest((SELECT sum(minutes) FROM g), 1)) AS BIGINT) AS percent FROM g""")
def pip_01(t):
    items = A.work_items(mails(t), t.v_calendar).where(D.in_period(F.col("at"), "1995-06-14", "week"))
    return A.by_matter(items).select("matter_key", "emails_sent", "emails_received", "meetings", "hours", "percent")


@query("pip_02", _relevance_sql() + f"""SELECT 'search' AS part, email_idx FROM ({FLT1_SQL}) a UNION ALL
SELECT 'attachments', email_idx FROM v_emails WHERE attachments <> '' AND contains(lower(attachments), 'escrow') UNION ALL SELECT 'relevance', email_idx FROM top""")
def pip_02(t):
    m = mails(t)
    parts = {"search": S.search_mail(m, BOOLEAN_QUERY), "attachments": S.search_attachments(m, "escrow"), "relevance": S.relevance_top(m, RELEVANCE_QUERY)}
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("part"), "email_idx")
        out = df if out is None else out.unionAll(df)
    return out


# ---------------------------------------------------------------- set helpers on mails
@query("arr_01", f"SELECT email_idx, array_to_string({q.cased_distinct("string_split_regex(concat(cc, ';', attachments), '[;,]')")}, '|') AS names FROM v_emails")
def arr_01(t):
    both = F.concat_ws(";", "cc", "attachments")
    return t.v_emails.select("email_idx", F.array_join(T.unique_cased(F.split(both, "[;,]")), "|").alias("names"))


FLAG_WORDS = ("Yes", "no", "TRUE", "0", "blocked", "on", "not found", "none", "")
FLAG_PICK_SQL = "CASE CAST(email_idx % 9 AS INT) " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(FLAG_WORDS)) + " END"


def _flag_sql(yes, no, default):
    y, n = ", ".join(f"'{w}'" for w in yes), ", ".join(f"'{w}'" for w in no)
    return f"CASE WHEN lower(raw) IN ({y}) THEN TRUE WHEN lower(raw) IN ({n}) THEN FALSE ELSE {default} END"


@query("arr_03", f"""SELECT email_idx, raw, lower(raw) NOT IN ({', '.join(f"'{w}'" for w in lx.FLAG_FALSE)}) AS mail_flag, {_flag_sql(lx.MATCH_TRUE, lx.MATCH_FALSE, 'FALSE')} AS match_flag, {_flag_sql(lx.POLICY_TRUE, lx.POLICY_FALSE, 'TRUE')} AS policy_flag
FROM (SELECT email_idx, {FLAG_PICK_SQL} AS raw FROM v_emails) z""")
def arr_03(t):
    raw = F.element_at(T.words_array(FLAG_WORDS), (F.col("email_idx") % 9 + 1).cast("int"))
    return t.v_emails.select("email_idx", raw.alias("raw")).withColumns({
        "mail_flag": T.truthy(F.col("raw")),
        "match_flag": T.as_flag(F.col("raw"), lx.MATCH_TRUE, lx.MATCH_FALSE, False),
        "policy_flag": T.as_flag(F.col("raw"), lx.POLICY_TRUE, lx.POLICY_FALSE, True)})
