"""Queries over checklists: grids, row typing, matching against mails, punch lists, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealweave import lexicon as lx
from dealweave.functions import mail as M
from dealweave.functions import model_output as J
from dealweave.functions import text as T
from dealweave.operators import checklist as C
from dealweave.operators import hot
from dealweave.operators import matching as MT
from dealweave.operators import threads as TH
from dealweave.plans import duck as q
from dealweave.plans.mail import ACT_CTE, TKEY, long
from dealweave.plans.registry import query
from dealweave.session import cut_lineage


# ---------------------------------------------------------------- grids
def grid(t):
    return t.v_grid.select("file_id", "table_id", "row_idx", F.array("c0", "c1", "c2", "c3", "c4").alias("cells"))


def _col_sql(patterns):
    # position of the first header whose start matches
    tests = f"list_transform(cells, lambda h: regexp_matches(lower(trim(h)), {q.alt(patterns)}))"
    return f"CAST(coalesce(list_position({tests}, TRUE), 0) - 1 AS BIGINT)"


def _header_sql(profile):
    max_len, roles = lx.HEADER_PROFILES[profile]
    cols = ", ".join(f"{_col_sql(p)} AS {n}_col" for n, _, p in roles)
    bonus = " + ".join(f"CASE WHEN {n}_col >= 0 THEN {b} ELSE 0 END" for n, b, _ in roles)
    return f"""
g AS (SELECT file_id, table_id, row_idx, [{', '.join(q.squash(f'c{i}') for i in range(5))}] AS cells FROM v_grid),
h AS (SELECT g.*, len(list_filter(cells, lambda c: c <> '')) AS filled, length(array_to_string(cells, '')) AS chars, {cols},
 (SELECT count(*) FROM g b WHERE b.file_id = g.file_id AND b.table_id = g.table_id AND b.row_idx BETWEEN g.row_idx + 1 AND g.row_idx + 10 AND array_to_string(b.cells, '') <> '') AS below FROM g WHERE row_idx <= 6),
hs AS (SELECT *, filled + 3 * below + CASE WHEN chars * 1.0 / filled <= {max_len} THEN 1 ELSE -5 END + {bonus} AS score FROM h WHERE filled >= 2),
hb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, table_id, row_idx) AS rn FROM hs) z WHERE rn = 1)"""


@query("src_09", " UNION ALL ".join(
    f"SELECT * FROM (WITH {_header_sql(p)} SELECT '{p}' AS profile, file_id, table_id, CAST(row_idx AS BIGINT) AS header_idx, CAST(score AS BIGINT) AS score, doc_col, status_col FROM hb) x{i}"
    for i, p in enumerate(lx.HEADER_PROFILES)))
def src_09(t):
    out = None
    for p in lx.HEADER_PROFILES:
        h = C.header_rows(grid(t), p).select(F.lit(p).alias("profile"), "file_id", "table_id", long("header_idx").alias("header_idx"),
                                             long("score").alias("score"), long("doc_col").alias("doc_col"), long("status_col").alias("status_col"))
        out = h if out is None else out.unionAll(h)
    return out


def _doc_col_sql(profile):
    blocked, _, max_len = lx.COLUMN_PROFILES[profile]
    ban = " OR ".join(f"contains(lower(hd), '{w}')" for w in blocked)
    pen = f"CASE WHEN length(c) > {max_len} OR regexp_full_match(c, '[\\d\\W_]+') THEN 2 ELSE 0 END" if max_len else "0"
    return f"""{_header_sql('checklist')},
d AS (SELECT g.file_id, g.table_id, g.row_idx, g.cells, hb.cells AS heads, row_number() OVER (PARTITION BY g.file_id ORDER BY g.row_idx) AS rn FROM g JOIN hb ON g.file_id = hb.file_id AND g.table_id = hb.table_id WHERE g.row_idx > hb.row_idx AND array_to_string(g.cells, '') <> ''),
x AS (SELECT file_id, table_id, unnest(cells) AS c, unnest(heads) AS hd, unnest(range(0, 5)) AS col_idx FROM d),
s AS (SELECT file_id, table_id, col_idx, sum(CASE WHEN c = '' THEN 0 ELSE 2 + CASE WHEN regexp_matches(c, '[a-zA-Z]') THEN 3 ELSE 0 END - {pen} END) AS score FROM x WHERE NOT ({ban}) GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, col_idx) AS rn FROM s)"""


@query("src_10", " UNION ALL ".join(
    f"SELECT * FROM (WITH {_doc_col_sql(p)} SELECT '{p}' AS profile, file_id, table_id, CAST(col_idx AS BIGINT) AS col_idx, CAST(score AS BIGINT) AS score FROM b WHERE rn = 1) x{i}"
    for i, p in enumerate(lx.COLUMN_PROFILES)))
def src_10(t):
    g, out = grid(t), None
    for p in lx.COLUMN_PROFILES:
        d = C.document_columns(g, C.header_rows(g), p).select(
            F.lit(p).alias("profile"), "file_id", "table_id", long("col_idx").alias("col_idx"), long("score").alias("score"))
        out = d if out is None else out.unionAll(d)
    return out


# ---------------------------------------------------------------- rows
@query("flt_05", rf"""SELECT row_id, {q.squash('document_name')} = '' OR length({q.squash('document_name')}) < 3 OR regexp_matches(lower({q.squash('document_name')}), '{lx.SKIP_NAME_PATTERN}')
 OR regexp_full_match({q.squash('document_name')}, '[\d\W_]+') AS skipped FROM v_checklist""")
def flt_05(t):
    return t.v_checklist.select("row_id", C.skip_name(F.col("document_name")).alias("skipped"))


CTX = lambda *hs: "concat_ws(' | ', " + ", ".join(f"CASE WHEN {q.squash(c)} <> '' THEN '{h}: ' || {q.squash(c)} END" for h, c in hs) + ")"
ROW_CTX = CTX(("Party", "party"), ("Signatories", "signatories"), ("Notes", "notes"))


@query("prj_01", f"SELECT checklist_id, row_id, {ROW_CTX} AS row_context FROM v_rows")
def prj_01(t):
    c = C.context([("Party", F.col("party")), ("Signatories", F.col("signatories")), ("Notes", F.col("notes"))])
    return t.v_rows.select("checklist_id", "row_id", c.alias("row_context"))


DOCTOK = lambda name: q.ordered_distinct(q.tokens(f"CASE WHEN {q.lookup(name)} <> '' THEN {q.lookup(name)} ELSE {name} END", 3, lx.SEARCH_STOPWORDS))
TYPED = rf"""
ty0 AS (SELECT *, {q.squash('document_name')} AS nm, {q.lookup('document_name')} AS lk, {DOCTOK('document_name')} AS tk,
 (party <> '')::INT + (signatories <> '')::INT AS n_other FROM v_rows),
ty1 AS (SELECT *, n_other + (nm <> '')::INT + (status <> '')::INT + (notes <> '')::INT AS n_all, {q.any_of('lk', lx.DOCUMENT_ROW_KEYWORDS)} AS kw, {q.any_of('lk', lx.SECTION_ROW_KEYWORDS)} AS sk FROM ty0),
ty2 AS (SELECT *, n_all <= 2 AND n_other <= 1 AND (nm LIKE '%:' OR sk OR (upper(nm) = nm AND lower(nm) <> nm AND length(nm) <= 80)) AS hd,
 len(tk) <= 2 AND NOT kw AS short, regexp_matches(nm, {q.lit(lx.ROW_NUMBER_PREFIX)}) AS mk FROM ty1),
ty3 AS (SELECT *, max(CASE WHEN nm <> '' AND NOT hd THEN 1 ELSE 0 END) OVER (PARTITION BY checklist_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ty2),
ty4 AS (SELECT *, CASE WHEN nm = '' THEN 'blank' WHEN hd THEN 'section_header' WHEN seen = 1 AND (mk OR (short AND (sk OR n_other <= 2))) THEN 'subrow' ELSE 'document' END AS row_type FROM ty3),
ty AS (SELECT *, CASE row_type WHEN 'blank' THEN '' WHEN 'document' THEN nm ELSE coalesce(last_value(CASE WHEN row_type = 'document' THEN nm END IGNORE NULLS) OVER (PARTITION BY checklist_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS match_document_name FROM ty4)"""


@query("win_03", f"WITH {TYPED} SELECT checklist_id, row_id, row_type, match_document_name FROM ty")
def win_03(t):
    return C.typed_rows(t.v_rows).select("checklist_id", "row_id", "row_type", "match_document_name")


@query("win_05", f"""WITH k AS (SELECT checklist_id, row_id, {q.squash('document_name')} AS nm FROM v_checklist WHERE length({q.squash('document_name')}) >= 3 AND NOT regexp_matches(lower({q.squash('document_name')}), '{lx.SKIP_NAME_PATTERN}')
 AND NOT regexp_full_match({q.squash('document_name')}, '[\\d\\W_]+')),
r AS (SELECT *, row_number() OVER (PARTITION BY checklist_id, lower(nm) ORDER BY length(nm) DESC, row_id) AS rn, min(row_id) OVER (PARTITION BY checklist_id, lower(nm)) AS first_row_id FROM k)
SELECT checklist_id, row_id, nm AS document_name, first_row_id FROM r WHERE rn = 1""")
def win_05(t):
    return C.document_names(t.v_checklist).select("checklist_id", "row_id", "document_name", "first_row_id")


@query("pip_15", f"""WITH k AS (SELECT *, {q.squash('document_name')} AS nm, {CTX(("Status", "status"), ("Party", "party"), ("Signatories", "signatories"), ("Notes", "notes"))} AS row_context FROM v_checklist WHERE length({q.squash('document_name')}) >= 3 AND NOT regexp_matches(lower({q.squash('document_name')}), '{lx.SKIP_NAME_PATTERN}')),
r AS (SELECT *, row_number() OVER (PARTITION BY checklist_id, lower(nm) ORDER BY length(nm) DESC, row_id) AS rn FROM k)
SELECT checklist_id, row_id, nm AS document_name, row_context FROM r WHERE rn = 1""")
def pip_15(t):
    return C.document_names(t.v_checklist).select("checklist_id", "row_id", "document_name", "row_context")


ITEMS = f"{TYPED}, it AS (SELECT checklist_id AS deal_id, row_id, nm AS document_name, match_document_name, {q.squash('status')} AS current_status, {q.squash('notes')} AS existing_notes, {ROW_CTX} AS row_context FROM ty WHERE row_type = 'document')"


def items(t):
    return C.checklist_items(t.v_rows.repartition("row_id"))  # a small file is one split


def _batch_sql(src, size, cap):
    return f"""SELECT deal_id, CAST(floor((rn - 1) / {size}) AS BIGINT) AS batch, count(*) AS items, '[' || string_agg('{{"row_id":' || row_id || ',"document_name":"' || document_name || '","row_context":"' || row_context || '"}}', ',' ORDER BY rn) || ']' AS payload
 FROM (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY row_id) AS rn FROM {src}) z WHERE rn <= {cap} GROUP BY 1, 2"""


@query("prj_04", f"WITH {ITEMS}, pu AS (SELECT checklist_id AS deal_id, row_id, {q.squash('document_name')} AS document_name, {CTX(('Signatories', 'signatories'))} AS row_context FROM v_rows WHERE {q.squash('document_name')} <> '') SELECT 'checklist' AS kind, * FROM ({_batch_sql('it', 10, 10**12)}) a UNION ALL SELECT 'punchlist', * FROM ({_batch_sql('pu', 40, 10**12)}) b")
def prj_04(t):
    f = ["row_id", "document_name", "row_context"]
    a = C.prompt_batches(items(t), "deal_id", 10, None, f).select(F.lit("checklist").alias("kind"), "*")
    return a.unionByName(C.prompt_batches(C.punch_items(t.v_rows), "deal_id", 40, None, f).select(F.lit("punchlist").alias("kind"), "*"))


@query("agg_19", rf"""WITH r AS (SELECT checklist_id, trim(document_name) AS d, row_id, list_filter(list_transform(string_split_regex(signatories, '[,;]|\band\b'), lambda x: trim(x)), lambda x: length(x) > 1) AS roles FROM v_rows WHERE trim(document_name) <> ''),
l AS (SELECT checklist_id, d, arg_max(roles, row_id) AS roles FROM r WHERE len(roles) > 0 GROUP BY 1, 2)
SELECT checklist_id, count(DISTINCT d) AS documents, string_agg(DISTINCT role, '|' ORDER BY role) AS roles FROM (SELECT checklist_id, d, unnest(roles) AS role FROM l) z GROUP BY 1""")
def agg_19(t):
    roles = C.signatory_roles(t.v_rows)
    names = roles.groupBy("checklist_id").agg(F.countDistinct("document_name").alias("documents"))
    uniq = roles.select("checklist_id", "role").distinct().groupBy("checklist_id").agg(
        F.array_join(F.array_sort(F.collect_set("role")), "|").alias("roles"))
    return names.join(uniq, "checklist_id")


@query("str_20", r"""SELECT row_id, pos, role FROM (SELECT row_id, unnest(roles) AS role, unnest(range(0, len(roles))) AS pos FROM
 (SELECT row_id, list_filter(list_transform(string_split_regex(signatories, '[,;]|\band\b'), lambda x: trim(x)), lambda x: length(x) > 1) AS roles FROM v_checklist) a) b""")
def str_20(t):
    return t.v_checklist.select("row_id", F.posexplode(T.role_names(F.col("signatories"))).alias("pos", "role")).withColumn("pos", long("pos"))


@query("src_08", r"""WITH r AS (SELECT checklist_id, trim(document_name) AS document_name, row_id, list_filter(list_transform(string_split_regex(signatories, '[,;]|\band\b'), lambda x: trim(x)), lambda x: length(x) > 1) AS roles FROM v_rows WHERE trim(document_name) <> ''),
l AS (SELECT checklist_id, document_name, arg_max(roles, row_id) AS roles FROM r WHERE len(roles) > 0 GROUP BY 1, 2)
SELECT checklist_id, document_name, array_to_string(roles, '|') AS roles FROM l""")
def src_08(t):
    from dealweave.sources import tables as S

    raw = t.v_rows.select("row_id", "checklist_id", F.col("document_name").alias("Closing Document"), F.col("status").alias("State"),
                          F.col("signatories").alias("Who Signs"))
    r = C.signatory_roles(S.role_table(raw))
    packed = F.array_sort(F.collect_list(F.struct("pos", "role")))  # roles of one document row
    return r.groupBy("checklist_id", "document_name").agg(F.array_join(F.transform(packed, lambda x: x["role"]), "|").alias("roles"))


# ---------------------------------------------------------------- statuses and punch list
@query("cls_04", f"SELECT row_id, {q.category('status')} AS category FROM v_checklist")
def cls_04(t):
    return t.v_checklist.select("row_id", M.status_category(F.col("status")).alias("category"))


MODEL_STATUS = "CASE " + " ".join(f"WHEN trim({{0}}) = '{s}' THEN '{s}'" for s in lx.STATUS_VALUES) + " " + " ".join(f"WHEN lower(trim({{0}})) = '{a}' THEN '{s}'" for a, s in lx.STATUS_ALIASES.items()) + " END"


@query("cls_05", f"SELECT row_id, {MODEL_STATUS.format('status')} AS model_status FROM v_checklist")
def cls_05(t):
    return t.v_checklist.select("row_id", M.model_status(F.col("status")).alias("model_status"))


# Categories a model returned for part of the rows, some by row id, some by document name.
PUNCH_DEC = """SELECT checklist_id AS deal_id, CASE WHEN row_id % 4 = 1 THEN row_id END AS row_id, CASE WHEN row_id % 4 = 3 THEN lower(document_name) ELSE '' END AS doc_key, row_id AS seq,
 CASE CAST(row_id % 5 AS INT) WHEN 0 THEN 'Review' WHEN 1 THEN 'executed' WHEN 2 THEN 'signature' WHEN 3 THEN 'other' ELSE 'pending' END AS category FROM v_rows WHERE row_id % 4 IN (1, 3) AND row_id % 3 = 0 AND document_name <> ''"""
KNOWN = ", ".join(f"'{c}'" for c, _, _ in lx.STATUS_CATEGORIES)
PUNCH = f"""pd AS ({PUNCH_DEC}), pbr AS (SELECT deal_id, row_id, max_by(category, seq) AS c FROM pd WHERE row_id IS NOT NULL GROUP BY 1, 2), pbd AS (SELECT deal_id, doc_key, max_by(category, seq) AS c FROM pd WHERE doc_key <> '' GROUP BY 1, 2),
pi AS (SELECT checklist_id AS deal_id, row_id, {q.squash('document_name')} AS document_name, {q.squash('status')} AS status, {q.squash('notes')} AS notes, {CTX(('Signatories', 'signatories'))} AS row_context FROM v_rows WHERE {q.squash('document_name')} <> ''),
pj AS (SELECT pi.*, lower(coalesce(pbr.c, pbd.c, '')) AS given FROM pi LEFT JOIN pbr ON pi.deal_id = pbr.deal_id AND pi.row_id = pbr.row_id LEFT JOIN pbd ON pi.deal_id = pbd.deal_id AND lower(pi.document_name) = pbd.doc_key),
pl AS (SELECT *, given IN ({KNOWN}) AS assigned_by_model, CASE WHEN given IN ({KNOWN}) THEN given ELSE {q.category("concat_ws(' ', status, notes, row_context)")} END AS category FROM pj)"""


def punch(t):
    from dealweave.fixtures import spark_sql

    return C.punch_list(C.punch_items(t.v_rows), spark_sql(t.spark, t.sf_dir, PUNCH_DEC))


@query("jon_13", f"WITH {PUNCH} SELECT deal_id, row_id, assigned_by_model, category FROM pl")
def jon_13(t):
    return punch(t).select("deal_id", "row_id", "assigned_by_model", "category")


@query("win_11", f"WITH {PUNCH} SELECT deal_id, row_id, CASE WHEN given = '' THEN 'no decision' ELSE given END AS decision FROM pj")
def win_11(t):
    from dealweave.fixtures import spark_sql

    j = C.overlay(C.punch_items(t.v_rows), spark_sql(t.spark, t.sf_dir, PUNCH_DEC), ["category"])
    return j.select("deal_id", "row_id", F.lower(F.coalesce("decision.category", F.lit("no decision"))).alias("decision"))


@query("flt_06", f"WITH {PUNCH} SELECT deal_id, row_id, category FROM pl WHERE category <> 'executed'")
def flt_06(t):
    return punch(t).where(F.col("category").isin(*lx.OPEN_CATEGORIES)).select("deal_id", "row_id", "category")


@query("agg_11", f"WITH {PUNCH} SELECT deal_id, category, count(*) AS items FROM pl WHERE category <> 'executed' GROUP BY 1, 2 UNION ALL SELECT deal_id, 'total open', count(*) FROM pl WHERE category <> 'executed' GROUP BY 1")
def agg_11(t):
    p = punch(t).where(F.col("category").isin(*lx.OPEN_CATEGORIES))
    r = p.rollup("deal_id", "category").agg(F.count(F.lit(1)).alias("items"), F.grouping_id().alias("g"))
    return r.where("g <= 1").select("deal_id", F.coalesce("category", F.lit("total open")).alias("category"), "items")


@query("agg_12", f"WITH {PUNCH} SELECT deal_id, count(*) FILTER (WHERE assigned_by_model) AS model_assigned, count(*) FILTER (WHERE NOT assigned_by_model) AS fallback_assigned FROM pl GROUP BY 1")
def agg_12(t):
    return punch(t).groupBy("deal_id").agg(F.count_if("assigned_by_model").alias("model_assigned"), F.count_if(~F.col("assigned_by_model")).alias("fallback_assigned"))


TITLES = "CASE category " + " ".join(f"WHEN '{c}' THEN '{ti}'" for c, ti, _ in lx.STATUS_CATEGORIES) + " END"


@query("pip_05", f"WITH {PUNCH} SELECT deal_id, {TITLES} AS section, row_id, document_name || CASE WHEN lower(status) NOT IN ('pending', 'tbd', '') THEN ' - ' || status ELSE '' END AS line FROM pl WHERE category <> 'executed'")
def pip_05(t):
    titles = F.create_map(*[F.lit(x) for c, ti, _ in lx.STATUS_CATEGORIES for x in (c, ti)])
    extra = F.when(~F.lower("status").isin("pending", "tbd", ""), F.concat(F.lit(" - "), F.col("status"))).otherwise("")
    p = punch(t).where(F.col("category").isin(*lx.OPEN_CATEGORIES))
    return p.select("deal_id", F.element_at(titles, F.col("category")).alias("section"), "row_id", F.concat("document_name", extra).alias("line"))


# ---------------------------------------------------------------- deal profile
NAME_SQL = "SELECT DISTINCT checklist_id AS deal_id, concat('Automobile Building Closing Checklist ', CAST(checklist_id AS STRING), '.docx') AS checklist_name FROM v_rows"
ANCHORS = f"""
an AS (SELECT deal_id, unnest(ts) AS token, unnest(range(0, len(ts))) AS pos FROM (SELECT deal_id, {q.ordered_distinct(q.tokens(q.stem('checklist_name'), 4, lx.DEAL_STOPWORDS))} AS ts FROM ({NAME_SQL}) z) y),
ac0 AS (SELECT deal_id, token, count(*) AS n FROM (SELECT deal_id, unnest(list_distinct({q.tokens("document_name || ' ' || row_context", 4, lx.DEAL_STOPWORDS)})) AS token FROM (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY row_id) AS rn FROM it) z) y GROUP BY 1, 2),
ac1 AS (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY n DESC, token) AS rn FROM ac0 WHERE n >= 2 AND (deal_id, token) NOT IN (SELECT (deal_id, token) FROM an)),
ac2 AS (SELECT deal_id, token, row_number() OVER (PARTITION BY deal_id ORDER BY tier, pos) AS anchor_pos FROM (SELECT deal_id, token, 0 AS tier, pos FROM an UNION ALL SELECT deal_id, token, 1, rn FROM ac1 WHERE rn <= 6) z),
anc AS (SELECT * FROM ac2 WHERE anchor_pos <= 12)"""


def anchors(t, its=None):
    from dealweave.fixtures import spark_sql

    return C.deal_anchors(its if its is not None else items(t), spark_sql(t.spark, t.sf_dir, NAME_SQL))


@query("agg_08", f"WITH {ITEMS}, {ANCHORS} SELECT deal_id, CAST(anchor_pos AS BIGINT) AS anchor_pos, token FROM anc")
def agg_08(t):
    return anchors(t).withColumn("anchor_pos", long("anchor_pos"))


# ---------------------------------------------------------------- matching against mails
def deal_mail(t):
    """Mails of the deals that have a checklist, with activity and thread key."""
    deal = F.regexp_extract(T.strip(F.col("recipients")), r"^deal(\d+)@", 1).cast("long")
    listed = t.v_emails.withColumn("deal_id", deal).join(t.v_rows.select(F.col("checklist_id").alias("deal_id")).distinct(), "deal_id", "left_semi")
    # a small file is one split; the text work that follows is worth an exchange
    return TH.thread_members(M.normalize_mail(listed.repartition("email_idx")))


def _lst(expr, col):
    return f"list_transform({col}, lambda k: {expr})"


TS = "(CASE WHEN dl <> '' AND (contains(u, dl) OR contains(dl, u)) THEN 10.5 ELSE 0 END)"
SCORES = f"""{ITEMS}, {ACT_CTE},
em AS (SELECT a.*, {TKEY} AS thread_key, CAST(regexp_extract(recipients, '^deal(\\d+)@', 1) AS BIGINT) AS deal_id, {q.norm('subject')} AS s, {q.norm("CASE WHEN clean <> '' THEN clean ELSE body END")} AS b, {q.norm('searchable')} AS a,
 {q.norm("concat_ws(' ', sender, recipients, cc)")} AS r, {q.cased_distinct("string_split_regex(attachments, '[;,]')")} AS titles FROM ac a WHERE CAST(regexp_extract(recipients, '^deal(\\d+)@', 1) AS BIGINT) IN (SELECT deal_id FROM it)),
em2 AS (SELECT *, list_transform(titles, lambda x: {q.lookup('x')}) AS tls FROM em),
em3 AS (SELECT *, array_to_string(tls, ' ') AS t FROM em2),
pf AS (SELECT DISTINCT deal_id, match_document_name, row_context, {q.lookup('match_document_name')} AS dl, {DOCTOK('match_document_name')} AS dk,
 ({q.ordered_distinct(q.tokens('row_context', 3, lx.SEARCH_STOPWORDS))})[1:8] AS ck FROM it),
p0 AS (SELECT pf.*, em3.email_idx, em3.thread_key, em3.sort_ts, em3.s, em3.b, em3.a, em3.r, em3.t, em3.tls, em3.has_att FROM pf JOIN em3 USING (deal_id)),
p1 AS (SELECT *, list_filter(list_transform(tls, lambda u: greatest({TS}, least(8.8, 2.2 * len(list_filter(dk, lambda k: contains(u, k))))) + CASE WHEN len(list_filter(dk, lambda k: contains(u, k))) >= 2 THEN 0.9 ELSE 0 END), lambda v: v > 0) AS tsv FROM p0),
p2 AS (SELECT *, coalesce(list_max(tsv), 0) AS title_score,
 coalesce(list_sum({_lst("CASE WHEN contains(t, k) THEN 2.4 WHEN contains(s, k) THEN 1.8 WHEN contains(b, k) THEN 1.0 WHEN contains(a, k) THEN 0.9 ELSE 0 END", 'dk')}), 0) AS ds,
 len(list_filter(dk, lambda k: contains(t, k) OR contains(s, k) OR contains(b, k) OR contains(a, k))) AS dh,
 coalesce(list_sum({_lst("CASE WHEN contains(s, k) OR contains(t, k) THEN 0.9 WHEN contains(r, k) THEN 0.6 WHEN contains(b, k) OR contains(a, k) THEN 0.35 ELSE 0 END", 'ck')}), 0) AS cs,
 len(list_filter(ck, lambda k: contains(s, k) OR contains(t, k) OR contains(r, k) OR contains(b, k) OR contains(a, k))) AS ch FROM p1),
ps AS (SELECT *, round(CAST(CASE WHEN title_score > 0 THEN title_score WHEN dl <> '' AND contains(s, dl) THEN 6.5 WHEN dl <> '' AND (contains(b, dl) OR contains(a, dl)) THEN 3.2 ELSE 0 END
 + ds + CASE WHEN dh >= 2 THEN 1.6 ELSE 0 END + cs + CASE WHEN ch >= 2 THEN 0.7 ELSE 0 END + CASE WHEN has_att THEN 0.2 ELSE 0 END + least(0.8, 0.25 * least(len(tsv), 4)) AS DOUBLE), 4) AS score FROM p2)"""


def sides(t):
    its = cut_lineage(items(t))
    return its, MT.row_profiles(its), MT.mail_features(deal_mail(t))


@query("sco_02", f"WITH {SCORES} SELECT deal_id, match_document_name, row_context, email_idx, score, round(CAST(title_score AS DOUBLE), 4) AS title_score FROM ps WHERE score >= 0.9")
def sco_02(t):
    _, pr, fe = sides(t)
    return MT.mail_scores(MT.equal_once(pr, fe)).select(
        "deal_id", "match_document_name", "row_context", "email_idx", "score", "title_score")


@query("jon_04", f"WITH {SCORES} SELECT it.deal_id, it.row_id, count(*) AS candidates, max(score) AS best FROM it JOIN ps USING (deal_id, match_document_name, row_context) WHERE score >= 1.2 GROUP BY 1, 2")
def jon_04(t):
    its, pr, fe = sides(t)
    per = MT.candidate_counts(pr, fe).where("for_row > 0").withColumnRenamed("for_row", "candidates")
    return MT.to_rows(per, its).select("deal_id", "row_id", "candidates", "best")


TOP2 = "t2 AS (SELECT *, row_number() OVER (PARTITION BY deal_id, match_document_name, row_context ORDER BY score DESC, email_idx) AS rn FROM ps WHERE score >= 1.2)"


@query("top_02", f"WITH {SCORES}, {TOP2} SELECT it.deal_id, it.row_id, email_idx, score, CAST(rn AS BIGINT) AS rank FROM it JOIN t2 USING (deal_id, match_document_name, row_context) WHERE rn <= 8")
def top_02(t):
    its, pr, fe = sides(t)
    top = MT.to_rows(MT.top_mails(MT.equal_once(pr, fe)), its)
    return top.select("deal_id", "row_id", "email_idx", "score", long("rank").alias("rank"))


BIT8 = lambda c: f"list_sum(list_transform(dk[1:8], lambda k, i: CASE WHEN contains({c}, k) THEN CAST(pow(2, i - 1) AS INT) ELSE 0 END))"
THREADS = f"""{ANCHORS}, {{iss}}
al AS (SELECT deal_id, list(token) AS ats FROM anc GROUP BY 1),
tb AS (SELECT e.deal_id, e.thread_key, count(*) AS message_count, max(sort_ts) AS last_ts, min(email_idx) AS first_idx, max(priority) AS pr, string_agg(a, ' ') AS ta, coalesce(max_by(subject, (sort_ts, email_idx)) FILTER (WHERE subject <> ''), '') AS subject FROM em3 e GROUP BY 1, 2),
tb2 AS (SELECT tb.*, {q.norm('subject')} AS ns, len(list_filter(coalesce(ats, []::VARCHAR[]), lambda k: contains(ta, k))) AS ah, coalesce(len(ats), 0) AS na, least(3, coalesce(ni, 0)) AS ni FROM tb LEFT JOIN al USING (deal_id) LEFT JOIN ic USING (deal_id, thread_key)),
pe AS (SELECT *, row_number() OVER (PARTITION BY deal_id, match_document_name, row_context, thread_key ORDER BY score DESC, sort_ts, email_idx) AS rk FROM ps WHERE score >= 0.9),
pb AS (SELECT deal_id, match_document_name, row_context, thread_key, CAST(sum(CASE WHEN rk = 1 THEN score ELSE greatest(score - 0.75, 0) * 0.35 END) + CASE WHEN count(*) >= 2 THEN 1.2 ELSE 0 END AS DOUBLE) AS best FROM pe WHERE rk <= 3 GROUP BY 1, 2, 3, 4),
pt AS (SELECT deal_id, match_document_name, row_context, any_value(dl) AS dl, any_value(dk) AS dk, thread_key, max(title_score) AS title_score, bit_or(CAST(coalesce({BIT8('t')}, 0) AS INT)) AS tbits, bit_or(CAST(coalesce({BIT8('a')}, 0) AS INT)) AS abits, bool_or(dl <> '' AND (contains(t, dl) OR contains(a, dl))) AS nh FROM ps GROUP BY 1, 2, 3, 6),
t0 AS (SELECT pt.*, best, ns, ah, na, ni, message_count, last_ts, first_idx, pr, subject, nh OR (dl <> '' AND contains(ns, dl)) AS exact_name FROM pt LEFT JOIN pb USING (deal_id, match_document_name, row_context, thread_key) JOIN tb2 USING (deal_id, thread_key)),
t1 AS (SELECT *, coalesce(best, CASE WHEN exact_name THEN 4.5 ELSE 0 END) + title_score + bit_count(tbits) * 0.9 + len(list_filter(dk[1:8], lambda k: contains(ns, k))) * 0.6 + bit_count(abits) * 0.25 AS sc FROM t0),
tsx AS (SELECT *, round(CAST(CASE WHEN ah > 0 THEN sc + least(2.5, 0.8 * ah) WHEN na > 0 AND sc < 6 THEN sc - 1.8 ELSE sc END + least(1.0, 0.2 * (message_count - 1)) + least(0.6, 0.2 * ni) + least(0.8, 0.2 * pr) AS DOUBLE), 4) AS score FROM t1),
tr AS (SELECT *, row_number() OVER (PARTITION BY deal_id, match_document_name, row_context ORDER BY score DESC, CAST(last_ts AS DATE) DESC, first_idx) AS rn FROM tsx WHERE score >= 2)""".replace("{iss}", """ic AS (SELECT deal_id, thread_key, count(DISTINCT lower(p)) AS ni FROM (SELECT deal_id, thread_key, unnest(string_split(issues, '|')) AS p FROM em WHERE issues <> '') z GROUP BY 1, 2),""")


def thread_side(t, every=False):
    its, pr, fe = sides(t)
    match, _ = MT.thread_pairs(pr, fe, MT.thread_bases(fe, anchors(t, its)), every)
    return its, pr, fe, match


@query("top_03", f"WITH {SCORES}, {THREADS} SELECT it.deal_id, it.row_id, thread_key, score, CAST(rn AS BIGINT) AS rank FROM it JOIN tr USING (deal_id, match_document_name, row_context) WHERE rn <= 3")
def top_03(t):
    its, _, _, match = thread_side(t)
    return MT.to_rows(MT.top_threads(match), its).select("deal_id", "row_id", "thread_key", "score", long("rank").alias("rank"))


HIT = "(best IS NOT NULL OR title_score > 0 OR tbits > 0 OR abits > 0)"


@query("jon_05", f"WITH {SCORES}, {THREADS} SELECT deal_id, match_document_name, row_context, thread_key, score, exact_name FROM tsx WHERE score >= 2")
def jon_05(t):
    *_, match = thread_side(t, every=True)
    return MT.all_threads(match).select(
        "deal_id", "match_document_name", "row_context", "thread_key", "score", "exact_name")


@query("sco_03", f"WITH {SCORES}, {THREADS} SELECT deal_id, match_document_name, row_context, thread_key, score, CAST(ah AS BIGINT) AS anchor_hits, message_count FROM tr WHERE rn = 1")
def sco_03(t):
    _, pr, _, match = thread_side(t)
    return MT.top_threads(match, 1).join(pr.select("deal_id", "pid", "match_document_name", "row_context"), ["deal_id", "pid"]).select(
        "deal_id", "match_document_name", "row_context", "thread_key", "score", long("anchor_hits").alias("anchor_hits"), "message_count")


@query("agg_09", f"WITH {SCORES}, {THREADS} SELECT deal_id, match_document_name, row_context, thread_key, round(best, 4) AS best FROM pb")
def agg_09(t):
    _, pr, fe = sides(t)
    return MT.thread_bests(MT.equal_once(pr, fe)).select(
        "deal_id", "match_document_name", "row_context", "thread_key", F.round("best", 4).alias("best"))


# Summaries of the strongest thread per row profile, then status and comment.
SUMMARY = f"""
rl AS (SELECT pe.*, tr.exact_name AS ex FROM pe JOIN tr USING (deal_id, match_document_name, row_context, thread_key) WHERE tr.rn = 1 AND rk <= 8),
r4 AS (SELECT * FROM (SELECT deal_id, match_document_name, row_context, thread_key, email_idx, row_number() OVER (PARTITION BY deal_id, match_document_name, row_context ORDER BY sort_ts, email_idx) AS o FROM rl) z WHERE o <= 4),
hd AS (SELECT * FROM (SELECT deal_id, thread_key, email_idx, row_number() OVER (PARTITION BY deal_id, thread_key ORDER BY sort_ts, email_idx) AS o FROM em) z WHERE o <= 4),
rr AS (SELECT deal_id, match_document_name, row_context, thread_key, email_idx, o FROM r4 UNION ALL
 SELECT tr.deal_id, match_document_name, row_context, thread_key, hd.email_idx, o FROM tr JOIN hd USING (deal_id, thread_key) WHERE rn = 1 AND exact_name AND (tr.deal_id, match_document_name, row_context) NOT IN (SELECT (deal_id, match_document_name, row_context) FROM r4)),
ev AS (SELECT rr.*, priority, direction, n_issues, issues, concat(CASE direction WHEN 'sent' THEN 'Sent ' ELSE 'Received ' END, CASE WHEN label <> '' THEN label ELSE 'document update' END, CASE direction WHEN 'sent' THEN ' to ' ELSE ' from ' END, party, ' on ', event_date, '.') AS txt FROM rr JOIN em USING (deal_id, email_idx)),
sm AS (SELECT deal_id, match_document_name, row_context, max(priority) AS tp, count(*) FILTER (WHERE direction = 'sent') AS sent, count(*) FILTER (WHERE direction <> 'sent') AS recv, sum(n_issues) AS nis FROM ev GROUP BY 1, 2, 3),
e2 AS (SELECT deal_id, match_document_name, row_context, txt, min(o) AS o FROM ev GROUP BY 1, 2, 3, 4),
e3 AS (SELECT deal_id, match_document_name, row_context, string_agg(txt, ' ' ORDER BY o) AS said FROM (SELECT *, row_number() OVER (PARTITION BY deal_id, match_document_name, row_context ORDER BY o) AS k FROM e2) z WHERE k <= 2 GROUP BY 1, 2, 3),
i2 AS (SELECT deal_id, match_document_name, row_context, lower(p) AS lp, arg_min(p, o * 10 + i) AS p, min(o * 10 + i) AS o FROM (SELECT *, unnest(string_split(issues, '|')) AS p, unnest(range(1, len(string_split(issues, '|')) + 1)) AS i FROM ev WHERE issues <> '') z GROUP BY 1, 2, 3, 4),
i3 AS (SELECT deal_id, match_document_name, row_context, string_agg(p, '; ' ORDER BY o) AS flagged FROM (SELECT *, row_number() OVER (PARTITION BY deal_id, match_document_name, row_context ORDER BY o) AS k FROM i2) z WHERE k <= 2 GROUP BY 1, 2, 3),
cs AS (SELECT tr.deal_id, match_document_name, row_context, tr.score,
 CASE WHEN coalesce(tp, 0) <= 1 AND sent > 0 AND (recv > 0 OR nis > 0) THEN 'With Opposing Counsel' WHEN tp > 0 THEN {q.status_name('tp')} WHEN sent > 0 THEN 'With Opposing Counsel' WHEN recv > 0 THEN 'Draft Circulated' ELSE {q.status_name('tr.pr')} END AS status_signal,
 CASE WHEN flagged IS NOT NULL THEN trim(concat_ws(' ', coalesce(said, ''), 'Issues flagged: ' || flagged || '.')) ELSE coalesce(said, '') END AS suggested_comment
 FROM tr LEFT JOIN sm USING (deal_id, match_document_name, row_context) LEFT JOIN e3 USING (deal_id, match_document_name, row_context) LEFT JOIN i3 USING (deal_id, match_document_name, row_context) WHERE tr.rn = 1)"""


def summaries(t):
    _, pr, fe, match = thread_side(t)
    return MT.thread_summaries(MT.top_threads(match, 1), match, fe).join(
        pr.select("deal_id", "pid", "match_document_name", "row_context"), ["deal_id", "pid"])


@query("agg_10", f"WITH {SCORES}, {THREADS}, {SUMMARY} SELECT deal_id, match_document_name, row_context, status_signal FROM cs")
def agg_10(t):
    return summaries(t).select("deal_id", "match_document_name", "row_context", "status_signal")


@query("str_24", f"WITH {SCORES}, {THREADS}, {SUMMARY} SELECT deal_id, match_document_name, row_context, suggested_comment FROM cs")
def str_24(t):
    return summaries(t).select("deal_id", "match_document_name", "row_context", "suggested_comment")


MENTION = r"""
mn AS (SELECT DISTINCT deal_id, lower(document_name) AS doc_key, regexp_extract_all(lower(document_name), '\w+') AS ws FROM it),
mm AS (SELECT mn.deal_id, doc_key, email_idx, subject, priority FROM mn JOIN em USING (deal_id) WHERE len(list_filter(ws, lambda w: length(w) > 3 AND contains(searchable, w))) >= 2 OR contains(searchable, doc_key)),
mr AS (SELECT *, max(priority) OVER (PARTITION BY deal_id, doc_key ORDER BY email_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM mm WHERE priority > 0),
mv AS (SELECT *, row_number() OVER (PARTITION BY deal_id, doc_key ORDER BY email_idx) AS k FROM mr WHERE priority > coalesce(prev, 0)),
ms AS (SELECT deal_id, doc_key, max(priority) AS p, string_agg(CAST(email_idx AS VARCHAR), ',' ORDER BY k) AS ids, string_agg(subject, '; ' ORDER BY k) FILTER (WHERE k <= 2) AS ex FROM mv GROUP BY 1, 2)"""


@query("win_07", f"WITH {SCORES}, {MENTION} SELECT deal_id, doc_key, {q.status_name('p')} AS status, ids AS evidence FROM ms")
def win_07(t):
    s = MT.mention_status(items(t), MT.mail_features(deal_mail(t)))
    return s.select("deal_id", "doc_key", "status", F.array_join(F.transform("evidence_idx", lambda x: x.cast("string")), ",").alias("evidence"))


P = f"'{lx.COMMENT_PREFIX} '"
UPDATE = f"""
uj AS (SELECT it.*, cs.score AS ts, status_signal, suggested_comment, ms.p AS mp, ms.ex FROM it LEFT JOIN cs USING (deal_id, match_document_name, row_context) LEFT JOIN ms ON it.deal_id = ms.deal_id AND lower(it.document_name) = ms.doc_key),
uk AS (SELECT *, CASE WHEN ts >= 8.5 THEN coalesce({MODEL_STATUS.format('status_signal')}, 'Draft Circulated') ELSE {q.status_name('mp')} END AS ns, CASE WHEN ts >= 8.5 THEN suggested_comment WHEN mp IS NOT NULL THEN trim('Email activity indicates ' || {q.status_name('mp')} || '. Example emails: ' || ex) ELSE '' END AS cm FROM uj),
ul AS (SELECT *, CASE WHEN {q.squash('cm')} = '' THEN existing_notes WHEN existing_notes = '' THEN {P} || {q.squash('cm')} ELSE existing_notes || ' | ' || {P} || {q.squash('cm')} END AS comment FROM uk)"""


@query("pip_04", f"WITH {SCORES}, {THREADS}, {SUMMARY}, {MENTION}, {UPDATE} SELECT deal_id, row_id, document_name, current_status, coalesce(ns, current_status) AS new_status, comment FROM ul WHERE (coalesce(ns, '') <> '' AND ns <> current_status) OR (comment <> '' AND comment <> existing_notes)")
def pip_04(t):
    its = cut_lineage(items(t))
    return MT.checklist_update(its, deal_mail(t), anchors(t, its))


# ---------------------------------------------------------------- model output
JS = "CASE WHEN starts_with(payload, '```') THEN trim(regexp_extract(payload, '(?s)```(?:json)?\\s*(.*?)```', 1), ' ' || chr(10)) WHEN starts_with(payload, 'Here') THEN regexp_extract(payload, '(?s)\\{.*\\}') ELSE payload END"


@query("jsn_01", f"SELECT checklist_id, row_id, {JS} AS json FROM v_decisions")
def jsn_01(t):
    return t.v_decisions.select("checklist_id", "row_id", J.json_text(F.col("payload")).alias("json"))


@query("jsn_02", f"""WITH j AS (SELECT checklist_id, row_id AS src_row, CAST(({JS}) AS JSON) -> '$.matches[0]' AS m FROM v_decisions),
k AS (SELECT checklist_id, CAST(m ->> '$.row_id' AS BIGINT) AS row_id, m ->> '$.document_name' AS document_name, m ->> '$.status' AS st, m ->> '$.has_activity' AS ha, CAST(m -> '$.matching_email_indices' AS BIGINT[]) AS ix, CAST(m -> '$.matching_thread_ids' AS VARCHAR[]) AS th, CAST(m ->> '$.confidence' AS DOUBLE) AS cf, m ->> '$.checklist_comment' AS checklist_comment FROM j)
SELECT checklist_id, row_id, document_name, {MODEL_STATUS.format('st')} AS status, CASE WHEN lower(ha) = 'yes' THEN TRUE WHEN lower(ha) = 'no' THEN FALSE ELSE {MODEL_STATUS.format('st')} IS NOT NULL OR len(list_filter(ix, lambda x: x >= 0)) > 0 END AS has_activity,
 array_to_string(list_filter(ix, lambda x: x >= 0), ',') AS email_indices, array_to_string({q.uniq('th')}, ',') AS thread_ids, greatest(0.0::DOUBLE, least(1.0::DOUBLE, cf)) AS confidence, checklist_comment FROM k""")
def jsn_02(t):
    d = J.decisions(t.v_decisions.withColumn("seq", F.col("row_id")).withColumnRenamed("row_id", "src_row"), ["checklist_id"])
    return d.select("checklist_id", "row_id", "document_name", "status", "has_activity",
                    F.array_join(F.transform("email_indices", lambda x: x.cast("string")), ",").alias("email_indices"),
                    F.array_join("thread_ids", ",").alias("thread_ids"), "confidence", "checklist_comment")


TASK = "CASE CAST(row_id % 3 AS INT) WHEN 0 THEN 'NONE' WHEN 1 THEN 'REVIEW' ELSE 'DRAFT' END"


@query("flt_09", f"SELECT checklist_id, row_id, {TASK} AS task_type FROM v_rows WHERE row_id % 3 <> 0")
def flt_09(t):
    # Model answers arrive as JSON with a list of tasks; the filter runs on the parsed list.
    answer = F.to_json(F.struct(F.array(F.struct(F.expr(TASK).alias("task_type"), F.col("row_id"))).alias("tasks")))
    parsed = t.v_rows.select("checklist_id", J.actionable_tasks(answer).alias("tasks"))
    return parsed.select("checklist_id", F.explode("tasks").alias("x")).select("checklist_id", "x.row_id", "x.task_type")


@query("flt_10", f"WITH {SCORES} SELECT deal_id, match_document_name, row_context, count(*) FILTER (WHERE score >= 1.2) AS for_row, count(*) FILTER (WHERE score >= 0.9) AS for_thread FROM ps WHERE score >= 0.9 GROUP BY 1, 2, 3")
def flt_10(t):
    _, pr, fe = sides(t)
    g = MT.candidate_counts(pr, fe).drop("best")
    return g.join(pr.select("deal_id", "pid", "match_document_name", "row_context"), ["deal_id", "pid"]).drop("pid")
