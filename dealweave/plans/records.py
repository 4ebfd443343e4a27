"""Queries over identities and policies, edits, reviewer changes, usage, clauses and raw exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dealweave import lexicon as lx
from dealweave.fixtures import spark_sql
from dealweave.functions import model_output as J
from dealweave.functions import text as T
from dealweave.operators import clauses as CL
from dealweave.operators import documents as DO
from dealweave.operators import policy as PO
from dealweave.plans import duck as q
from dealweave.plans.mail import FILES, FLAG_PICK_SQL, long
from dealweave.plans.registry import query
from dealweave.session import shared_folder
from dealweave.sources import tables as S

# ---------------------------------------------------------------- policy
MATCH = "(r.entry IN ('*', 'all') OR v = r.entry OR (contains(v, '@') AND ((starts_with(r.entry, '*@') AND ends_with(v, substr(r.entry, 2))) OR (starts_with(r.entry, '@') AND ends_with(v, r.entry)))) OR (starts_with(r.entry, '*.') AND ends_with(v, substr(r.entry, 2))) OR (starts_with(r.entry, '.') AND ends_with(v, r.entry)))"
PARTS = """pt AS (SELECT ident_id, email, username, user_id, split_part(email, '@', 2) AS domain, split_part(email, '@', 1) AS local FROM v_identities),
pv AS (""" + " UNION ".join(f"SELECT ident_id, '{n}' AS list_name, {p} AS v FROM pt" for n, ps in PO.TESTED.items() for p in ps) + ")"
HITS = f"{PARTS}, ht AS (SELECT DISTINCT ident_id, pv.list_name FROM pv JOIN v_policy_rules r ON r.list_name = pv.list_name AND v <> '' AND {MATCH})"


@query("jon_11", f"WITH {HITS} SELECT * FROM ht")
def jon_11(t):
    return PO.list_hits(PO.identity_parts(t.v_identities), t.v_policy_rules)


H = lambda n: f"EXISTS (SELECT 1 FROM ht WHERE ht.ident_id = pt.ident_id AND list_name = '{n}')"


@query("flt_11", f"""WITH {HITS}, fl AS (SELECT ident_id, {H('blocked_emails')} AS be, {H('blocked_domains')} AS bd, {H('blocked_users')} AS bu, {H('allowed_emails')} OR {H('allowed_domains')} OR {H('allowed_users')} AS al, {H('admin_emails')} OR {H('admin_domains')} OR {H('admin_users')} AS ad FROM pt)
SELECT ident_id, NOT (be OR bd OR bu) AND al AS allowed, ad AS is_admin, CASE WHEN be THEN 'blocked email' WHEN bd THEN 'blocked domain' WHEN bu THEN 'blocked user' WHEN NOT al THEN 'not on an allow list' ELSE 'allowed' END AS reason FROM fl""")
def flt_11(t):
    p = PO.identity_parts(t.v_identities)
    names = F.broadcast(t.v_policy_rules.select("list_name").distinct().withColumn("_one", F.lit(1)))
    present = p.select("ident_id", F.lit(1).alias("_one")).join(names, "_one").select("ident_id", "list_name")
    return PO.decide(p, PO.list_hits(p, t.v_policy_rules), present).select("ident_id", "allowed", "is_admin", "reason")


@query("arr_05", "SELECT ident_id, replace(replace(email, '@', '%40'), ' ', '+') AS override_key FROM v_identities")
def arr_05(t):
    return t.v_identities.select("ident_id", PO.override_key(F.upper("email")).alias("override_key"))


RAW_LIST = "concat(upper(email), '; ', username, ',,', chr(10), ' ', user_id, ' ;')"


@query("arr_04", f"SELECT ident_id, array_to_string(list_filter(list_transform(string_split_regex({RAW_LIST}, '[,\\n;]+'), lambda x: lower({q.strip('x')})), lambda x: x <> ''), '|') AS entries FROM v_identities")
def arr_04(t):
    return t.v_identities.select("ident_id", F.array_join(T.policy_entries(F.expr(RAW_LIST)), "|").alias("entries"))


# Policy documents: one global, overrides for some mails, user names and user ids.
DOCS = """SELECT 'global' AS scope, '' AS scope_key, 'blocked_domains' AS field, concat('machinery.example.com; .', lower(max(c_mktsegment)), '.example.org') AS value FROM customer
UNION ALL SELECT 'global', '', 'allowed_emails', '*' FROM customer WHERE c_custkey = 1
UNION ALL SELECT 'global', '', 'role', 'member' FROM customer WHERE c_custkey = 1
UNION ALL SELECT 'email', replace(lower(concat('c', CAST(c_custkey AS STRING), '@', c_mktsegment, '.example.com')), '@', '%40'), CASE WHEN c_custkey % 2 = 0 THEN 'blocked' ELSE 'role' END, CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'admin' END FROM customer WHERE c_custkey % 10 < 3
UNION ALL SELECT 'username', concat('user', CAST(c_custkey AS STRING)), 'allowed_emails', 'nobody@example.com' FROM customer WHERE c_custkey < 20
UNION ALL SELECT 'username', concat('user', CAST(c_custkey AS STRING)), 'banned_domains', 'other.org; .building.example.com' FROM customer WHERE c_custkey % 4 = 1
UNION ALL SELECT 'userid', concat('uid-', CAST(c_custkey AS STRING)), 'blocked_domains', '' FROM customer WHERE c_custkey % 9 = 0
UNION ALL SELECT 'userid', concat('uid-', CAST(c_custkey AS STRING)), CASE WHEN c_custkey % 3 = 0 THEN 'role' ELSE 'blocked' END, CASE WHEN c_custkey % 3 = 0 THEN 'owner' ELSE 'off' END FROM customer WHERE c_custkey % 7 = 0"""
OWN = f"""dc AS ({DOCS}), ow0 AS (SELECT ident_id, field, value, 1 AS r FROM v_identities JOIN dc ON scope = 'email' AND scope_key = replace(email, '@', '%40') UNION ALL SELECT ident_id, field, value, 2 FROM v_identities JOIN dc ON scope = 'username' AND scope_key = username UNION ALL SELECT ident_id, field, value, 3 FROM v_identities JOIN dc ON scope = 'userid' AND scope_key = user_id),
ow AS (SELECT ident_id, field, arg_max(value, r) AS value FROM ow0 GROUP BY 1, 2), gl AS (SELECT field, value FROM dc WHERE scope = 'global'),
ef AS (SELECT i.ident_id, g.field, coalesce(ow.value, g.value) AS value FROM v_identities i JOIN gl g ON TRUE LEFT JOIN ow ON ow.ident_id = i.ident_id AND ow.field = g.field UNION ALL SELECT ident_id, field, value FROM ow WHERE field NOT IN (SELECT field FROM gl))"""


@query("jon_12", f"WITH {OWN} SELECT ident_id, field, value FROM ef")
def jon_12(t):
    docs = spark_sql(t.spark, t.sf_dir, DOCS)
    p = PO.identity_parts(t.v_identities)
    return PO.with_global(p, PO.effective_policy(p, docs), docs)


def _first_filled(*aliases):
    return "coalesce(" + ", ".join(f"max(CASE WHEN field = '{a}' AND trim(value) <> '' THEN value END)" for a in aliases) + ", '')"


def _matches(entries, *values):
    """Whether an entry of a list matches one of the values, as the rule is written."""
    one = lambda v: f"e = {v} OR e IN ('*', 'all') OR (e[1] = '.' AND ends_with({v}, e)) OR (e[1:2] = '*.' AND ends_with({v}, e[2:])) OR (contains({v}, '@') AND ((e[1] = '@' AND ends_with({v}, e)) OR (e[1:2] = '*@' AND ends_with({v}, e[2:]))))"
    rule = " OR ".join(f"({v} <> '' AND ({one(v)}))" for v in values)
    return f"len(list_filter(list_transform(string_split_regex({entries}, '[,\\n;]+'), lambda x: lower(trim(x))), lambda e: e <> '' AND ({rule}))) > 0"


@query("pip_14", f"""WITH {OWN}, sc AS (SELECT ident_id, max(CASE WHEN field = 'blocked' THEN value END) AS blocked, max(CASE WHEN field = 'role' THEN value END) AS role,
 {_first_filled('allowed_emails', 'allowedEmails', 'allowlist', 'approved_emails')} AS ae, {_first_filled('blocked_domains', 'blockedDomains', 'denied_domains', 'banned_domains')} AS bl FROM ef GROUP BY 1),
id AS (SELECT ident_id, lower(email) AS em, split_part(lower(email), '@', 1) AS lo, split_part(lower(email), '@', 2) AS dm FROM v_identities),
ds AS (SELECT ident_id, coalesce(blocked = 'yes', FALSE) AS hard, {_matches('bl', 'dm')} AS bd, ae = '' OR {_matches('ae', 'em', 'lo')} AS al, role FROM id JOIN sc USING (ident_id))
SELECT ident_id, NOT hard AND NOT bd AND al AS allowed, NOT hard AND role IN ('admin', 'owner') AS is_admin, CASE WHEN hard THEN 'policy' WHEN bd THEN 'blocked domain' WHEN NOT al THEN 'not on an allow list' ELSE 'allowed' END AS reason FROM ds""")
def pip_14(t):
    return PO.access_decisions(t.v_identities, spark_sql(t.spark, t.sf_dir, DOCS)).drop("message")


# ---------------------------------------------------------------- edits
EDITS = [("ta", "TA"), ("ri", "r-i"), ("ta", "x")]


def _edit_sql():
    text, parts = "text", []
    for f, n in EDITS:
        parts.append(f"CAST((length({text}) - length(replace({text}, '{f}', ''))) / {len(f)} AS BIGINT)")
        text = f"replace({text}, '{f}', '{n}')"
    return text, parts


@query("str_26", f"SELECT doc_id, {_edit_sql()[0]} AS edited FROM documents")
def str_26(t):
    return DO.apply_edits(t.documents, EDITS).select("doc_id", "edited")


@query("agg_20", " UNION ALL ".join(f"SELECT {i} AS pos, '{EDITS[i][0]}' AS find_text, CAST(sum({p}) AS BIGINT) AS replacements FROM documents" for i, p in enumerate(_edit_sql()[1])))
def agg_20(t):
    e = DO.apply_edits(t.documents, EDITS).select(F.posexplode("counts").alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("replacements"))
    return e.select("pos", F.get(T.words_array([f for f, _ in EDITS]), F.col("pos")).alias("find_text"), "replacements")


@query("pip_16", f"SELECT doc_id, md5({_edit_sql()[0]}) AS edited_hash, {' + '.join(_edit_sql()[1])} AS replacements FROM documents")
def pip_16(t):
    e = DO.apply_edits(t.documents, EDITS)
    return e.select("doc_id", F.md5("edited").alias("edited_hash"), F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("replacements"))


EDIT_ROWS = "SELECT p_partkey AS seq, CASE WHEN p_partkey % 11 = 0 THEN '  ' ELSE concat(' ', p_brand, ' ') END AS find_text, CASE WHEN p_size < 25 THEN p_type ELSE 'new' END AS replace_text, p_name AS reason FROM part"


@query("set_05", f"SELECT trim(find_text) AS find_text, replace_text, min(seq) AS seq, arg_min(reason, seq) AS reason FROM ({EDIT_ROWS}) e WHERE trim(find_text) <> '' GROUP BY 1, 2")
def set_05(t):
    return DO.unique_edits(spark_sql(t.spark, t.sf_dir, EDIT_ROWS))


STAMPED = "CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'DRAFT 3/10/2026 and 4/1/2026' WHEN 1 THEN concat('Draft of 03-10-26 no. ', CAST(o_orderkey AS STRING)) WHEN 2 THEN concat('Draft dated March 9, 2026 for ', CAST(o_custkey AS STRING)) ELSE 'no date here' END"


@query("str_25", f"""SELECT o_orderkey, CASE WHEN regexp_matches(s, '\\b\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}\\b') THEN regexp_replace(s, '\\b\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}\\b', '06/30/2026') WHEN regexp_matches(s, '\\b\\d{{1,2}}-\\d{{1,2}}-\\d{{2,4}}\\b') THEN regexp_replace(s, '\\b\\d{{1,2}}-\\d{{1,2}}-\\d{{2,4}}\\b', '06-30-2026')
 ELSE regexp_replace(s, {q.lit(lx.MONTH_DATE)}, 'June 30, 2026') END AS stamped FROM (SELECT o_orderkey, {STAMPED} AS s FROM orders) z""")
def str_25(t):
    s = T.stamp_date(F.expr(STAMPED), F.lit("06/30/2026"), F.lit("06-30-2026"), F.lit("June 30, 2026"))
    return t.orders.select("o_orderkey", s.alias("stamped"))


LINES = "string_split(replace(text, '. ', chr(10)), chr(10))"


@query("str_30", f"""SELECT doc_id, coalesce(list_filter(list_transform((string_split(text, chr(10)))[1:5], lambda x: {q.strip('x')}), lambda x: length(x) BETWEEN 6 AND 99 AND NOT regexp_matches(lower(x), 'document|status|party|item'))[1], 'deal ' || doc_id) AS transaction_name FROM documents""")
def str_30(t):
    path = F.concat(F.lit("/x/deal_"), F.col("doc_id").cast("string"), F.lit("_closing_checklist.docx"))
    return t.documents.select("doc_id", F.regexp_replace(T.transaction_name(F.split("text", "\n"), path), "_closing$| closing$", "").alias("transaction_name"))


# ---------------------------------------------------------------- reviewer changes and usage
@query("agg_16", "SELECT *, insertions + deletions AS total_changes FROM (SELECT base_doc_id, count(*) FILTER (WHERE change_type = 'insertion') AS insertions, count(*) FILTER (WHERE change_type = 'deletion') AS deletions, count(*) FILTER (WHERE change_type = 'comment') AS comments, count(DISTINCT author) AS sources FROM v_track_changes WHERE change_text <> '' GROUP BY 1) z")
def agg_16(t):
    return DO.collation_counts(t.v_track_changes)


@query("pip_10", "SELECT base_doc_id, author, change_type, strftime(change_ts, '%Y-%m-%d %H:%M:%S') AS change_at, paragraph_index, change_text FROM v_track_changes WHERE change_text <> '' ORDER BY 1, 2")
def pip_10(t):
    return DO.collated(t.v_track_changes).select("base_doc_id", "author", "change_type", F.date_format("change_ts", "yyyy-MM-dd HH:mm:ss").alias("change_at"), "paragraph_index", "change_text")


MEAS = "count(*) AS uses, CAST(sum(input_count) AS BIGINT) AS inputs, CAST(sum(output_count) AS BIGINT) AS outputs, round(avg(duration_ms), 3) AS avg_ms, max(duration_ms) AS max_ms"


@query("agg_18", f"SELECT 'feature' AS grouping, feature AS name, {MEAS} FROM v_usage GROUP BY feature UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), {MEAS} FROM v_usage GROUP BY user_id")
def agg_18(t):
    f = DO.usage_stats(t.v_usage, "feature").withColumnRenamed("feature", "name").select(F.lit("feature").alias("grouping"), "*")
    u = DO.usage_stats(t.v_usage, "user_id").withColumn("name", F.col("user_id").cast("string")).drop("user_id").select(F.lit("user").alias("grouping"), "*")
    return f.unionByName(u)


@query("stm_04", f"SELECT strftime(event_ts, '%Y-%m-%d') AS day, feature, {MEAS} FROM v_usage GROUP BY 1, 2")
def stm_04(t):
    from dealweave.streaming.telemetry import daily_usage

    return daily_usage(t.v_usage, None).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


COLL = "CASE CAST(event_id % 4 AS INT) WHEN 0 THEN ' Usage_History' WHEN 1 THEN 'prompt_logs' WHEN 2 THEN 'unknown' ELSE '' END"


@query("cls_11", f"SELECT event_id, CASE WHEN lower(trim(c)) IN ({', '.join(repr(c) for c in lx.TELEMETRY_COLLECTIONS)}) THEN lower(trim(c)) ELSE 'usage_history' END AS collection FROM (SELECT event_id, {COLL} AS c FROM v_usage) z")
def cls_11(t):
    return t.v_usage.select("event_id", DO.collection_name(F.expr(COLL)).alias("collection"))


@query("stm_01", f"SELECT event_id, CASE WHEN lower(trim(c)) IN ({', '.join(repr(c) for c in lx.TELEMETRY_COLLECTIONS)}) THEN lower(trim(c)) ELSE 'usage_history' END AS collection, CASE WHEN feature = 'click' THEN 'event' ELSE feature END AS event_type, CASE WHEN feature = 'view' THEN '{{}}' ELSE props END AS payload FROM (SELECT *, {COLL} AS c FROM v_usage) z")
def stm_01(t):
    from dealweave.streaming.telemetry import normalized_events

    raw = t.v_usage.select(
        "event_id", F.expr(COLL).alias("collection"), F.when(F.col("feature") == "click", "  ").otherwise(F.concat(F.lit(" "), "feature")).alias("event_type"),
        F.when(F.col("feature") == "view", "[1, 2]").otherwise(F.col("props")).alias("payload"))
    return normalized_events(raw, keep=["event_id"]).select("event_id", "collection", "event_type", "payload")


@query("stm_02", f"SELECT CASE WHEN lower(trim(c)) IN ({', '.join(repr(c) for c in lx.TELEMETRY_COLLECTIONS)}) THEN lower(trim(c)) ELSE 'usage_history' END AS collection, count(*) AS events FROM (SELECT *, {COLL} AS c FROM v_usage) z GROUP BY 1")
def stm_02(t):
    from dealweave.streaming.telemetry import normalized_events

    raw = t.v_usage.select(F.expr(COLL).alias("collection"), F.col("feature").alias("event_type"), F.col("props").alias("payload"))
    return normalized_events(raw).groupBy("collection").agg(F.count(F.lit(1)).alias("events"))


def accepted(collection, chunk, rows):
    """A sink that takes every chunk of its size."""
    if not 0 < len(rows) <= lx.RETRY_CHUNK:
        raise ValueError("chunk of a wrong size")


@query("stm_03", f"SELECT collection, chunk, count(*) AS rows FROM (SELECT collection, CAST(floor((row_number() OVER (PARTITION BY collection ORDER BY event_id) - 1) / {lx.RETRY_CHUNK}) AS BIGINT) AS chunk FROM (SELECT event_id, CASE WHEN lower(trim(c)) IN ({', '.join(repr(c) for c in lx.TELEMETRY_COLLECTIONS)}) THEN lower(trim(c)) ELSE 'usage_history' END AS collection FROM (SELECT event_id, {COLL} AS c FROM v_usage) a) b) z GROUP BY 1, 2")
def stm_03(t):
    from dealweave.streaming.telemetry import flush_chunks, ledger, normalized_events

    raw = t.v_usage.select("event_id", F.expr(COLL).alias("collection"), F.col("feature").alias("event_type"), F.col("props").alias("payload"))
    folder = f"{shared_folder(t.spark)}/ledger-{uuid.uuid4().hex}"
    flush_chunks(normalized_events(raw, keep=["event_id"]), "event_id", accepted, folder, wave=64)
    return ledger(t.spark, folder).select("collection", "chunk", "rows")


@query("mat_01", "SELECT event_id, round(value, 1) AS one, round(value, 4) AS four, CAST(round(value) AS BIGINT) AS whole FROM events")
def mat_01(t):
    return t.events.select("event_id", F.round("value", 1).alias("one"), F.round("value", 4).alias("four"), F.round("value").cast("long").alias("whole"))


# ---------------------------------------------------------------- clauses
# Template clauses are part of the request; every customer is one record.
TEMPLATE = [
    (1, "[Internal drafting note]", ""),
    (2, "[Advisor [ADVISOR_NAME] of [MAILING_ADDRESS] is engaged]", ""),
    (3, "[US tax clause for [ADVISOR_NAME]]", "Only include if advisor is a US taxpayer."),
    (4, "[Pay [DAILY_RATE] in [$/EUROS/GBP] only]", "Remove if engaged without additional fee"),
    (5, "[European rules apply]", "Include if not in EU"),
    (6, "[Entity wording for [ADVISOR_NAME]]", "Only include if the advisor is an entity"),
]
RECORD = """SELECT c_custkey AS record_id, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat(CAST(c_nationkey AS STRING), ' Main St') END AS address,
 CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'EU' WHEN 1 THEN 'us/uk' WHEN 2 THEN 'LATAM' ELSE '' END AS region, CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'usd' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency,
 CASE WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS taxpayer, CASE WHEN c_custkey % 3 = 1 THEN 'Entity' ELSE 'individual' END AS mode, CASE WHEN c_custkey % 6 = 0 THEN 'WITHOUT_FEE' ELSE 'WITH_FEE' END AS fee, CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING) AS rate FROM customer"""


def records(t):
    r = spark_sql(t.spark, t.sf_dir, RECORD)
    keys = ("name", "address", "region", "currency", "taxpayer", "mode", "fee", "rate")
    return r.select("record_id", F.lit(1).alias("template_id"), F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k))]).alias("data"))


def template(t):
    return t.spark.createDataFrame([(1, *c) for c in TEMPLATE], "template_id int, clause_id int, clause_text string, footnote_text string")


CLAUSE_SQL = f"""rc AS ({RECORD}),
cl AS (SELECT record_id, 1 AS clause_id, FALSE AS keep, '' AS txt, '' AS missing FROM rc
 UNION ALL SELECT record_id, 2, TRUE, CASE WHEN address = '' THEN '[Advisor [ADVISOR_NAME] of [MAILING_ADDRESS] is engaged]' ELSE 'Advisor ' || name || ' of ' || address || ' is engaged' END, CASE WHEN address = '' THEN 'MAILING_ADDRESS' ELSE '' END FROM rc
 UNION ALL SELECT record_id, 3, taxpayer = 'Yes', 'US tax clause for ' || name, '' FROM rc
 UNION ALL SELECT record_id, 4, fee <> 'WITHOUT_FEE', 'Pay ' || rate || ' in ' || CASE currency WHEN 'usd' THEN '$' WHEN 'EUR' THEN 'EUROS' ELSE 'GBP' END || ' only', '' FROM rc
 UNION ALL SELECT record_id, 5, region <> 'EU', 'European rules apply', '' FROM rc
 UNION ALL SELECT record_id, 6, mode = 'Entity', 'Entity wording for ' || name, '' FROM rc)"""


@query("pip_17", f"WITH {CLAUSE_SQL} SELECT record_id, clause_id, CASE WHEN NOT keep THEN 'deleted' WHEN missing <> '' THEN 'preserved' ELSE 'filled' END AS outcome, CASE WHEN keep THEN txt ELSE '' END AS text, CASE WHEN keep THEN missing ELSE '' END AS missing FROM cl")
def pip_17(t):
    return CL.assemble(records(t), template(t))


@query("cls_08", f"WITH {CLAUSE_SQL} SELECT record_id, clause_id, keep FROM cl WHERE clause_id > 1")
def cls_08(t):
    j = records(t).withColumn("data", CL.normalized_record(F.col("data"))).join(template(t), "template_id").where("clause_id > 1")
    return j.select("record_id", "clause_id", CL.clause_applies(F.col("footnote_text"), F.col("data")).alias("keep"))


@query("str_27", f"WITH {CLAUSE_SQL} SELECT record_id, clause_id, txt AS text FROM cl WHERE keep")
def str_27(t):
    return CL.assemble(records(t), template(t)).where("outcome <> 'deleted'").select("record_id", "clause_id", "text")


# ---------------------------------------------------------------- raw exports
@query("src_01", """SELECT email_idx, subject, concat(sender, '; ', 'Team') AS sender, recipients, attachments, lower(raw_flag) NOT IN ('no', 'false', '0', '') AS has_attachments, split_part(lower(trim(regexp_extract(sender, '<([^>]+)>', 1))), '@', 2) AS from_domain
FROM (SELECT *, attachments AS raw_flag FROM v_emails) z""")
def src_01(t):
    raw = t.v_emails.select(
        "email_idx", F.col("subject").alias("﻿Subject"), F.col("sender").alias("From: (Name)"), F.lit("Team").alias("From: (Address)"),
        F.col("recipients").alias("To"), F.col("body").alias("Message Body"), F.col("date_sent").alias("Sent"), F.col("attachments").alias("Attachments"))
    return S.mail_table(raw, ["email_idx"]).select("email_idx", "subject", "sender", "recipients", "attachments", "has_attachments", "from_domain")


@query("src_02", f"""WITH f AS (SELECT email_idx, list_concat({FILES('subject')}, {FILES('body')}) AS fs FROM v_emails) SELECT email_idx, array_to_string({q.uniq('fs')}, '; ') AS attachments, len(fs) > 0 AS has_attachments FROM f""")
def src_02(t):
    raw = t.v_emails.select("email_idx", "subject", "body", F.col("sender").alias("from"))
    return S.mail_table(raw, ["email_idx"]).select("email_idx", "attachments", "has_attachments")


@query("src_03", f"""SELECT email_idx, subject, body, CASE WHEN date_sent <> '' THEN date_sent ELSE date_received END AS date, lower(raw) NOT IN ({', '.join(f"'{w}'" for w in lx.FLAG_FALSE)}) AS has_attachments FROM (SELECT *, {FLAG_PICK_SQL} AS raw FROM v_emails) z""")
def src_03(t):
    nul = lambda c: F.when(F.col(c) != "", F.col(c))
    raw = t.v_emails.select("email_idx", F.col("subject").alias("Title"), F.col("body").alias(" Content "), nul("date_sent").alias("Sent"),
                            nul("date_received").alias("Received"), F.expr(FLAG_PICK_SQL).alias("Has Attachment"))
    return S.mail_table_first(raw, ["email_idx"]).select("email_idx", "subject", "body", "date", "has_attachments")


@query("src_04", "SELECT email_idx, subject, attachments FROM v_emails")
def src_04(t):
    from dealweave.sources import files

    text = F.to_json(F.struct(F.array(F.struct("email_idx", "subject", F.filter(F.transform(F.split("attachments", ";"), T.strip), lambda x: x != "").alias("attachments"))).alias("emails")))
    return files.mail_from_json(t.v_emails.select(text.alias("value"))).select("email_idx", "subject", "attachments")


@query("src_06", """SELECT event_id, summary, strftime(date_trunc('minute', start_ts), '%Y-%m-%dT%H:%M:%S') AS start, CAST(CASE WHEN event_id % 3 = 0 AND duration_minutes > 0 THEN duration_minutes ELSE 45 END AS BIGINT) AS duration_minutes FROM v_calendar WHERE event_id % 10 <> 0""")
def src_06(t):
    day = F.date_trunc("minute", "start_ts")
    raw = t.v_calendar.select(
        "event_id", F.col("summary").alias("Subject"), F.when(F.col("event_id") % 10 != 0, F.date_format(day, "M/d/yyyy h:mm a")).otherwise("tbd").alias("Start Date"),
        F.date_format(day + F.expr("INTERVAL 45 MINUTES"), "M/d/yyyy h:mm a").alias("End"), F.when(F.col("event_id") % 3 == 0, F.col("duration_minutes").cast("string")).otherwise("").alias("Duration"))
    c = S.calendar_table(raw, ["event_id"])
    return c.select("event_id", "summary", F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("start"), long("duration_minutes").alias("duration_minutes"))


@query("src_07", """SELECT event_id, CAST(0 AS BIGINT) AS pos, summary, strftime(date_trunc('second', start_ts), '%Y-%m-%dT%H:%M:%S') AS start, CAST(duration_minutes AS BIGINT) AS duration_minutes FROM v_calendar""")
def src_07(t):
    z = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    end = F.col("start_ts") + F.make_dt_interval(mins=F.col("duration_minutes"))
    text = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY;LANGUAGE=en:"), F.substring("summary", 1, 7), F.lit("\r\n "), F.expr("substr(summary, 8)"),
                    F.lit("\r\nDTSTART:"), z(F.col("start_ts")), F.lit("\r\nDTEND:"), z(end), F.lit("\r\nLOCATION:Room 1\r\nEND:VEVENT\r\nEND:VCALENDAR"))
    e = S.ics_events(t.v_calendar.select("event_id", text.alias("value")), ["event_id"])
    return e.select("event_id", long("pos").alias("pos"), "summary", F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("start"), long("duration_minutes").alias("duration_minutes"))


@query("udf_04", "SELECT checklist_id, row_id, nullif(regexp_extract(payload, '(?s)\\{.*\\}'), '') AS fragment FROM v_decisions")
def udf_04(t):
    return t.v_decisions.select("checklist_id", "row_id", J.balanced_object(F.col("payload")).alias("fragment"))
