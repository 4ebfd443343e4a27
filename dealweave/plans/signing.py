"""Queries over pages: signature detection, index and checks, executed-page matching, incumbency."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealweave import lexicon as lx
from dealweave.functions import pages as P
from dealweave.functions import signing as SG
from dealweave.functions import text as T
from dealweave.operators import checklist as C
from dealweave.operators import execution as X
from dealweave.operators import hot
from dealweave.operators import signatures as S
from dealweave.plans import duck as q
from dealweave.plans.mail import long
from dealweave.plans.registry import query
from dealweave.session import once_per_content

# ---------------------------------------------------------------- names, one line at a time
IGN = ", ".join(f"'{w}'" for w in lx.IGNORED_SIGNERS)


def cand_sql(x):
    t = q.strip(f"coalesce({x}, '')")
    t = rf"regexp_replace(regexp_replace({t}, '(?i)^/s/\s*', ''), '(?i)^(?:by|name|printed\s+name|print\s+name|signatory|signer|title)\s*:?', '')"
    t = rf"trim(regexp_replace(regexp_replace({t}, '\[[^\]]*\]|_{{2,}}|\.{{2,}}', ' ', 'g'), '\s+', ' ', 'g'), ' :;/,-')"
    return f"CASE WHEN upper({t}) IN ({IGN}) THEN '' ELSE {q.squash(f'''regexp_replace(upper({t}), '[.,]', '', 'g')''')} END"


def words_sql(x):
    return f"len(list_filter(string_split({q.squash(x)}, ' '), lambda w: w <> ''))"


ENT = "(?:" + "|".join(w.replace(".", r"\.") for w in lx.ENTITY_TERMS) + ")"
person_sql = lambda x: f"(regexp_matches({x}, '[A-Za-z]{{2,}}') AND NOT regexp_matches(upper({x}), '{ENT}') AND {words_sql(x)} BETWEEN 1 AND 5)"
entity_sql = lambda x: f"({x} <> '' AND upper({x}) NOT IN ({IGN}) AND {words_sql(x)} <= 10 AND (regexp_matches(upper({x}), '{ENT}') OR (upper({x}) = {x} AND len(list_filter(string_split({x}, ' '), lambda w: regexp_matches(w, '[A-Z]'))) >= 2)))"
LBL = r"(?i)\b(?:NAME|PRINTED NAME|PRINT NAME|SIGNATORY|SIGNER)\s*:\s*(.+)"
# The page texts repeat, so the reference works on distinct texts and joins back.
SIG = rf"""
tx AS (SELECT DISTINCT page_text AS x FROM v_pages),
ln0 AS (SELECT x, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT x, list_filter(list_transform(string_split(x, chr(10)), lambda l: trim(l)), lambda l: l <> '') AS ls FROM tx) z),
ln AS (SELECT *, {cand_sql('l')} AS c, {cand_sql(f"regexp_extract(l, '(?i)BY{chr(92)}s*:{chr(92)}s*(.+)$', 1)")} AS ic, regexp_matches(l, '(?i)\bBY\s*:') AS by_, regexp_matches(l, '{LBL}') AS haslab, {cand_sql(f"regexp_extract(l, '{LBL}', 1)")} AS lc, regexp_matches(l, '(?i)\bTITLE\s*:') AS ti FROM ln0),
lf AS (SELECT *, {person_sql('c')} AS cp, {entity_sql('c')} AS ce, {words_sql('c')} AS cw, {person_sql('ic')} AS ip, {person_sql('lc')} AS lp, {entity_sql('lc')} AS le, max(i) OVER (PARTITION BY x) AS mx FROM ln),
nx AS (SELECT a.x, a.i, min(b.i) FILTER (WHERE b.haslab) AS li, min(b.i) FILTER (WHERE b.cp) AS ni FROM lf a JOIN lf b ON a.x = b.x AND b.i BETWEEN a.i + 1 AND a.i + 6 WHERE a.by_ GROUP BY 1, 2),
byb AS (SELECT a.x, CASE WHEN a.ip THEN a.ic WHEN li IS NOT NULL THEN CASE WHEN b.lp THEN b.lc END WHEN a.mx - a.i >= 6 THEN d.c END AS s FROM lf a LEFT JOIN nx USING (x, i) LEFT JOIN lf b ON b.x = a.x AND b.i = li LEFT JOIN lf d ON d.x = a.x AND d.i = ni WHERE a.by_),
up AS (SELECT a.x, a.i, max(b.i) AS j FROM lf a JOIN lf b ON a.x = b.x AND b.i BETWEEN a.i - 3 AND a.i - 1 WHERE a.by_ AND b.c <> '' AND b.c NOT IN ('AND', 'ITS', 'BY') AND (b.ce OR b.cw > 6) GROUP BY 1, 2),
pers AS (SELECT x, s FROM byb WHERE s IS NOT NULL UNION SELECT x, lc FROM lf WHERE lp),
ents AS (SELECT x, lc AS s FROM lf WHERE haslab AND NOT lp AND le UNION SELECT up.x, b.c FROM up JOIN lf b ON b.x = up.x AND b.i = up.j WHERE b.ce AND up.x NOT IN (SELECT x FROM pers)),
sgn AS (SELECT x, s, FALSE AS rev FROM pers UNION ALL SELECT x, s, TRUE FROM ents WHERE x NOT IN (SELECT x FROM pers)),
cu AS (SELECT x, regexp_matches(upper(x), '\bBY\s*:') AS c1, regexp_matches(upper(x), '\b(?:NAME|PRINTED NAME|PRINT NAME|SIGNATORY|SIGNER)\s*:') AS c2, regexp_matches(upper(x), '\bTITLE\s*:') AS c3, regexp_matches(upper(x), '\bDATE\s*:') AS c4, regexp_matches(x, '_{{6,}}') AS c5, {q.any_of('upper(x)', lx.TRIGGER_PHRASES)} AS c6 FROM tx),
an AS (SELECT x, 3 * (c1::INT + c2::INT) + 2 * (c3::INT + c4::INT + c6::INT) + c5::INT AS cue_score, concat_ws(',', CASE WHEN c1 THEN 'BY' END, CASE WHEN c2 THEN 'NAME_LABEL' END, CASE WHEN c3 THEN 'TITLE_LABEL' END, CASE WHEN c4 THEN 'DATE_LABEL' END, CASE WHEN c5 THEN 'UNDERSCORE' END, CASE WHEN c6 THEN 'TRIGGER_PHRASE' END) AS cues,
 coalesce((SELECT string_agg(DISTINCT s, '|' ORDER BY s) FROM sgn WHERE sgn.x = cu.x), '') AS signers, coalesce((SELECT bool_or(rev) FROM sgn WHERE sgn.x = cu.x), FALSE) AS rev,
 EXISTS (SELECT 1 FROM byb WHERE byb.x = cu.x AND s IS NOT NULL) AS m1, EXISTS (SELECT 1 FROM lf WHERE lf.x = cu.x AND lp) AS m2, EXISTS (SELECT 1 FROM lf WHERE lf.x = cu.x AND haslab AND NOT lp AND le) AS m3,
 EXISTS (SELECT 1 FROM lf a JOIN lf b ON a.x = b.x AND b.i BETWEEN a.i + 1 AND a.i + 3 WHERE a.x = cu.x AND a.lp AND b.ti AND regexp_matches(a.l, '(?i)\bNAME\s*:')) AS m4 FROM cu),
ana0 AS (SELECT an.*, signers <> '' OR cue_score >= 5 AS is_page, rev OR (signers = '' AND cue_score >= 5) AS needs_review,
 concat_ws(',', CASE WHEN m1 THEN 'BY_BLOCK' END, CASE WHEN m2 THEN 'LABEL' END, CASE WHEN m3 THEN 'LABEL_ENTITY' END, CASE WHEN m4 THEN 'NAME_TITLE' END, CASE WHEN rev THEN 'ENTITY_FALLBACK' END, CASE WHEN signers = '' AND cue_score >= 5 THEN 'SIGNATURE_CUE_REVIEW' END) AS method FROM an),
tb0 AS (SELECT deal_id, doc_id, page_num, table_no, list_position([regexp_matches(upper(trim(c0)), '{'|'.join(lx.SIGN_NAME_HEADERS)}'), regexp_matches(upper(trim(c1)), '{'|'.join(lx.SIGN_NAME_HEADERS)}')], TRUE) AS at_ FROM v_page_tables
 WHERE row_no = 0 AND (regexp_matches(upper(c0), '{'|'.join(lx.SIGN_NAME_HEADERS)}') OR regexp_matches(upper(c1), '{'|'.join(lx.SIGN_NAME_HEADERS)}')) AND (regexp_matches(upper(c0), '{'|'.join(lx.SIGN_HEADERS)}') OR regexp_matches(upper(c1), '{'|'.join(lx.SIGN_HEADERS)}'))),
tb1 AS (SELECT deal_id, doc_id, page_num, {cand_sql(q.squash("CASE at_ WHEN 1 THEN c0 ELSE c1 END"))} AS s FROM v_page_tables JOIN tb0 USING (deal_id, doc_id, page_num, table_no) WHERE row_no > 0),
tb2 AS (SELECT deal_id, doc_id, page_num, string_agg(DISTINCT s, '|' ORDER BY s) AS ts FROM tb1 WHERE s <> '' AND ({person_sql('s')} OR {entity_sql('s')}) GROUP BY 1, 2, 3),
pt AS (SELECT p.deal_id, p.doc_id, p.page_num, a.*, CASE WHEN a.signers <> '' AND NOT a.rev THEN a.signers ELSE '' END AS own, coalesce(ts, '') AS ts, EXISTS (SELECT 1 FROM tb0 WHERE tb0.deal_id = p.deal_id AND tb0.doc_id = p.doc_id AND tb0.page_num = p.page_num) AS st FROM v_pages p JOIN ana0 a ON p.page_text = a.x LEFT JOIN tb2 t ON t.deal_id = p.deal_id AND t.doc_id = p.doc_id AND t.page_num = p.page_num),
pt2 AS (SELECT * REPLACE (cue_score + CASE WHEN st THEN 3 ELSE 0 END AS cue_score, concat_ws(',', nullif(cues, ''), CASE WHEN st THEN 'SIGNATURE_TABLE' END) AS cues,
 CASE WHEN ts = '' THEN signers WHEN own = '' THEN ts ELSE array_to_string(list_sort(list_distinct(list_concat(string_split(own, '|'), string_split(ts, '|')))), '|') END AS signers, CASE WHEN ts = '' THEN rev ELSE FALSE END AS rev) FROM pt),
ana AS (SELECT * REPLACE (signers <> '' OR cue_score >= 5 AS is_page, rev OR (signers = '' AND cue_score >= 5) AS needs_review,
 concat_ws(',', CASE WHEN m1 THEN 'BY_BLOCK' END, CASE WHEN m2 THEN 'LABEL' END, CASE WHEN m3 THEN 'LABEL_ENTITY' END, CASE WHEN m4 THEN 'NAME_TITLE' END, CASE WHEN ts <> '' THEN 'TABLE' END, CASE WHEN rev THEN 'ENTITY_FALLBACK' END, CASE WHEN signers = '' AND cue_score >= 5 THEN 'SIGNATURE_CUE_REVIEW' END) AS method) FROM pt2),
ix AS (SELECT unnest(string_split(CASE WHEN signers = '' THEN '{lx.UNASSIGNED}' ELSE signers END, '|')) AS signer_name, deal_id, doc_id, page_num, method, needs_review OR signers = '' AS review_required, CAST(cue_score AS BIGINT) AS cue_score, cues, x AS page_text FROM ana WHERE is_page)"""


def page_rows(t):
    """Table rows of the pages."""
    return t.v_page_tables.select("deal_id", "doc_id", "page_num", "table_no", "row_no", F.array("c0", "c1").alias("cells"))


@query("sco_04", f"WITH {SIG} SELECT deal_id, doc_id, page_num, CAST(cue_score AS BIGINT) AS cue_score, cues, is_page AS is_signature_page, needs_review FROM ana")
def sco_04(t):
    return SG.with_signature_analysis(t.v_pages, tables=page_rows(t)).select("deal_id", "doc_id", "page_num", long("cue_score").alias("cue_score"), F.array_join("cue_hits", ",").alias("cues"), "is_signature_page", "needs_review")


@query("set_04", f"WITH {SIG} SELECT deal_id, doc_id, page_num, signers, method FROM ana")
def set_04(t):
    return SG.with_signature_analysis(t.v_pages, tables=page_rows(t)).select("deal_id", "doc_id", "page_num", F.array_join("signers", "|").alias("signers"), "method")


LINES = "SELECT deal_id, doc_id, page_num, unnest(string_split(page_text, chr(10))) AS l, unnest(range(0, len(string_split(page_text, chr(10))))) AS i FROM v_pages"


@query("str_13", f"SELECT doc_id, page_num, i, {cand_sql('l')} AS candidate FROM ({LINES}) z")
def str_13(t):
    x = t.v_pages.select("doc_id", "page_num", F.posexplode(F.split("page_text", "\n")).alias("i", "l"))
    return x.select("doc_id", "page_num", long("i").alias("i"), SG.signer_candidate(F.col("l")).alias("candidate"))


@query("cls_06", f"SELECT doc_id, page_num, i, {person_sql(cand_sql('l'))} AS person, {entity_sql(cand_sql('l'))} AS entity FROM ({LINES}) z")
def cls_06(t):
    def judged(p):
        x = p.select("_cid", F.posexplode(F.split("page_text", "\n")).alias("i", "l")).withColumn("c", SG.signer_candidate(F.col("l")))
        line = F.struct("i", SG.is_person(F.col("c")).alias("person"), SG.is_entity(F.col("c")).alias("entity"))
        return x.groupBy("_cid").agg(F.collect_list(line).alias("_lines"))  # lines of one page

    x = once_per_content(t.v_pages.select("doc_id", "page_num", "page_text"), ["page_text"], judged)
    return x.select("doc_id", "page_num", F.explode("_lines").alias("x")).select("doc_id", "page_num", F.col("x.i").cast("long").alias("i"), "x.person", "x.entity")


@query("pip_06", f"WITH {SIG} SELECT * EXCLUDE (page_text) FROM ix")
def pip_06(t):
    return S.signature_index(t.v_pages, page_rows(t)).withColumn("cue_score", long("cue_score"))


@query("top_08", f"WITH {SIG} SELECT signer_name, doc_id, page_num FROM ix ORDER BY 1, 2, 3")
def top_08(t):
    return S.signature_index(t.v_pages, page_rows(t)).orderBy(*S.index_order()).select("signer_name", "doc_id", "page_num")


@query("agg_13", f"WITH {SIG} SELECT deal_id, signer_name, count(*) AS pages FROM ix GROUP BY 1, 2")
def agg_13(t):
    return S.signature_index(t.v_pages, page_rows(t)).groupBy("deal_id", "signer_name").agg(F.count(F.lit(1)).alias("pages"))


@query("agg_14", f"WITH {SIG} SELECT *, CASE WHEN \"rows\" = 0 OR review_required_count > 0 OR unassigned_count > 0 THEN 'review_required' ELSE 'passed' END AS status FROM (SELECT deal_id, count(*) AS \"rows\", count(*) FILTER (WHERE review_required) AS review_required_count, count(*) FILTER (WHERE signer_name = '{lx.UNASSIGNED}') AS unassigned_count, count(DISTINCT CASE WHEN signer_name = '{lx.UNASSIGNED}' THEN doc_id END) AS documents_to_review FROM ix GROUP BY deal_id) z")
def agg_14(t):
    return S.verification(S.signature_index(t.v_pages, page_rows(t)), ["deal_id"])


@query("jon_15", f"WITH {SIG}, e AS (SELECT deal_id, signer_name AS packet, count(*) AS u FROM ix GROUP BY 1, 2), a AS (SELECT o.deal_id, signer_name AS packet, count(DISTINCT ix.page_text) AS u FROM ix JOIN (SELECT deal_id, signed_doc_id - 10000000 AS doc_id, page_num FROM v_signed_pages) o ON ix.deal_id = o.deal_id AND ix.doc_id = o.doc_id AND ix.page_num = o.page_num GROUP BY 1, 2) SELECT e.deal_id, e.packet, e.u AS expected_units, a.u AS actual_units, CASE WHEN a.u IS NULL THEN 'missing' WHEN a.u = e.u THEN 'verified' ELSE 'count_mismatch' END AS status FROM e LEFT JOIN a USING (deal_id, packet)")
def jon_15(t):
    key = ["deal_id", "doc_id", "page_num"]
    ix = S.signature_index(t.v_pages, page_rows(t)).join(t.v_pages.select(*key, "page_text"), key)
    units = lambda df, n: df.groupBy("deal_id", F.col("signer_name").alias("packet")).agg(n.alias("units"))
    back = t.v_signed_pages.select("deal_id", (F.col("signed_doc_id") - 10_000_000).alias("doc_id"), "page_num")  # packets that came back
    want, have = units(ix, F.count(F.lit(1))), units(ix.join(back, key), F.countDistinct("page_text"))
    return S.packet_checks(want, have)


@query("win_04", f"SELECT deal_id, md5(trim(regexp_replace(lower(page_text), '\\s+', ' ', 'g'))) AS content_hash, (min((doc_id, page_num)))[1] AS doc_id, CAST((min((doc_id, page_num)))[2] AS INT) AS page_num, count(*) AS copies FROM v_pages GROUP BY 1, 2")
def win_04(t):
    return S.first_pages(t.v_pages)


@query("pip_07", f"WITH {SIG}, f AS (SELECT deal_id, md5(trim(regexp_replace(lower(x), '\\s+', ' ', 'g'))) AS content_hash, arg_min(signers, (doc_id, page_num)) AS s, min((doc_id, page_num)) AS at_ FROM ana WHERE is_page GROUP BY 1, 2) SELECT deal_id, content_hash, at_[1] AS doc_id, CAST(at_[2] AS INT) AS page_num, unnest(string_split(s, '|')) AS signer_name FROM f WHERE s <> ''")
def pip_07(t):
    return S.packet_shell(t.v_pages, page_rows(t))


DOCS = f"{SIG}, dc AS (SELECT deal_id, doc_id, max(page_num) AS total_pages, min(CASE WHEN signers <> '' THEN page_num END) AS first_signature_page FROM ana GROUP BY 1, 2), dw AS (SELECT *, total_pages - first_signature_page AS pages_after FROM dc WHERE first_signature_page IS NOT NULL AND total_pages - first_signature_page > 3)"


@query("win_06", f"WITH {DOCS} SELECT deal_id, doc_id, CAST(total_pages AS BIGINT) AS total_pages, CAST(first_signature_page AS BIGINT) AS first_signature_page, CAST(pages_after AS BIGINT) AS pages_after FROM dw")
def win_06(t):
    w = S.annex_warnings(t.v_pages, 3, page_rows(t))
    return w.select("deal_id", "doc_id", *[long(c).alias(c) for c in ("total_pages", "first_signature_page", "pages_after")])


ANNEX = "EXISTS (SELECT 1 FROM v_pages p WHERE p.doc_id = dw.doc_id AND p.deal_id = dw.deal_id AND p.page_num BETWEEN first_signature_page + 1 AND first_signature_page + 5 AND regexp_matches(upper(p.page_text), 'SCHEDULE|EXHIBIT|ANNEX|APPENDIX'))"


@query("jon_16", f"WITH {DOCS} SELECT deal_id, doc_id, {ANNEX} AS annex_found FROM dw")
def jon_16(t):
    return S.annex_warnings(t.v_pages, 3, page_rows(t)).select("deal_id", "doc_id", "annex_found")


@query("pip_12", f"WITH {DOCS} SELECT deal_id, doc_id, CAST(pages_after AS BIGINT) AS pages_after, {ANNEX} AS annex_found FROM dw WHERE pages_after > 4")
def pip_12(t):
    return S.annex_warnings(t.v_pages, 4, page_rows(t)).select("deal_id", "doc_id", long("pages_after").alias("pages_after"), "annex_found")


@query("str_29", f"""WITH l AS (SELECT doc_id, page_num, list_transform(string_split(page_text, chr(10)), lambda x: trim(x)) AS ls FROM v_pages)
SELECT doc_id, page_num, coalesce(list_filter(ls, lambda x: contains(upper(x), 'SIGNATURE PAGE'))[1], list_filter(ls, lambda x: length(x) > 3 AND NOT regexp_matches(x, '^[\\d\\s\\-\\.]+$'))[1], 'N/A') AS footer FROM l""")
def str_29(t):
    return t.v_pages.select("doc_id", "page_num", SG.footer_choice(F.transform(F.split("page_text", "\n"), T.strip)).alias("footer"))


FOOT = "CASE CAST(page_num % 4 AS INT) WHEN 0 THEN concat('Doc ID: AB-', CAST(doc_id AS STRING)) WHEN 1 THEN CAST(doc_id AS STRING) WHEN 2 THEN 'Page 3 of the closing set' ELSE 'draft copy' END"


@query("str_28", rf"""SELECT doc_id, page_num, foot, CASE WHEN regexp_extract(foot, {q.lit(lx.DOC_ID_PREFIXED)}, 1) <> '' THEN regexp_extract(foot, {q.lit(lx.DOC_ID_PREFIXED)}, 1) WHEN regexp_matches(foot, {q.lit(lx.DOC_ID_CODE)}) AND NOT regexp_matches(foot, '^\d{{1,3}}$') THEN foot
 WHEN foot <> '' AND length(foot) <= 30 AND NOT regexp_matches(foot, '(?i)^Page\s') THEN foot ELSE 'N/A' END AS document_id FROM (SELECT doc_id, page_num, {FOOT} AS foot FROM v_pages) z""")
def str_28(t):
    return t.v_pages.select("doc_id", "page_num", F.expr(FOOT).alias("foot")).withColumn("document_id", SG.document_id(F.col("foot")))


# ---------------------------------------------------------------- page features
PT = lambda x: q.squash(f"upper({x})")
ENOUGH = r"length(regexp_replace(u, '[_\s\-\=]+', '', 'g')) >= 30"
EXEC = rf"({ENOUGH} AND (contains(u, 'SIGNATURE PAGE') OR (regexp_matches(u, '\bBY\s*:') AND regexp_matches(u, '\b(NAME|TITLE|DATE|ITS)\s*:')) OR (regexp_matches(u, '_{{8,}}') AND regexp_matches(u, '\b(NAME|TITLE|DATE)\s*:'))))"


@query("flt_07", f"SELECT deal_id, doc_id, page_num FROM (SELECT *, {PT('page_text')} AS u FROM v_pages) z WHERE {EXEC}")
def flt_07(t):
    return t.v_pages.where(P.is_execution_page(F.col("page_text"))).select("deal_id", "doc_id", "page_num")


KIND = f"CASE WHEN {q.any_of('u', lx.SCHEDULE_CUES)} THEN 'schedule' WHEN {EXEC} THEN 'signature' ELSE 'other' END"


@query("flt_08", f"SELECT deal_id, signed_doc_id, page_num, {KIND} AS kind FROM (SELECT *, {PT('page_text')} AS u FROM v_signed_pages) z WHERE {KIND} <> 'other'")
def flt_08(t):
    s = X.signed_pages(t.v_signed_pages.withColumnRenamed("signed_doc_id", "doc_id"))
    return s.select("deal_id", F.col("doc_id").alias("signed_doc_id"), "page_num", "kind")


def _footer_sql(u):
    def one(p):
        n = rf"trim(regexp_replace(trim(regexp_replace(trim(regexp_extract({u}, {q.lit(p)}, 1)), '[.\-–—]+$', '')), '\s*\(CONTINUED\)$', ''))"
        return f"CASE WHEN length({n}) > 3 AND NOT regexp_matches({n}, '^(?:THIS|THE |A |AN )') THEN {n} END"

    return "coalesce(" + ", ".join(map(one, lx.FOOTER_NAME_PATTERNS)) + ")"


@query("str_15", f"SELECT doc_id, page_num, {_footer_sql('u')} AS footer_name FROM (SELECT *, {PT('page_text')} AS u FROM v_pages) z")
def str_15(t):
    p = once_per_content(t.v_pages, ["page_text"], lambda p: p.withColumn("footer_name", P.footer_name(F.col("page_text"))))
    return p.select("doc_id", "page_num", "footer_name")


def _title_sql(u):
    return "CASE " + " ".join(f"WHEN contains({u}, {q.lit(k)}) THEN coalesce(nullif(trim(regexp_extract({u}, {q.lit(f'({k}[A-Z{chr(92)}s]*?)(?:{chr(92)}n|BY:|DATED|$)')}, 1)), ''), {q.lit(k)})" for k in lx.TITLE_TYPES) + " END"


@query("str_16", f"SELECT doc_id, page_num, {_title_sql('u')} AS title_name FROM (SELECT *, {PT('page_text')} AS u FROM v_pages) z")
def str_16(t):
    return t.v_pages.select("doc_id", "page_num", P.title_name(F.col("page_text")).alias("title_name"))


ML = rf"""ml0 AS (SELECT DISTINCT page_text AS x FROM v_signed_pages UNION SELECT page_text FROM v_pages),
ml1 AS (SELECT x, regexp_replace(regexp_replace({PT('l')}, '^[\s\-–—•·\*]+', ''), '[\s\-–—•·\*]+$', '') AS l, i FROM (SELECT x, unnest(string_split(x, chr(10))) AS l, unnest(range(0, len(string_split(x, chr(10))))) AS i FROM ml0) z),
ml2 AS (SELECT x, l, min(i) AS i FROM ml1 WHERE length(l) >= 2 AND NOT {q.any_of('l', lx.NOISE_LINES)} AND NOT regexp_full_match(l, '[_\-–—=\s]{{6,}}') GROUP BY 1, 2),
ml AS (SELECT x, l, row_number() OVER (PARTITION BY x ORDER BY i) AS i, count(*) OVER (PARTITION BY x) AS n FROM ml2)"""


@query("str_17", f"WITH {ML}, a AS (SELECT x, string_agg(l, '|' ORDER BY i) AS lines FROM ml GROUP BY 1) SELECT signed_doc_id, page_num, coalesce(lines, '') AS lines FROM v_signed_pages LEFT JOIN a ON page_text = x")
def str_17(t):
    return t.v_signed_pages.select("signed_doc_id", "page_num", F.array_join(P.meaningful_lines(F.col("page_text")), "|").alias("lines"))


ZONE = f"""zn AS (SELECT b.x, b.l, min(a.i * 100 + b.i) AS o FROM ml a JOIN ml b ON a.x = b.x AND b.i BETWEEN a.i AND a.i + 3 WHERE regexp_matches(a.l, {q.lit(lx.SIGNATURE_ZONE)}) GROUP BY 1, 2),
sb AS (SELECT x, string_agg(l, ' | ' ORDER BY o) AS signature_block_text FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY o) AS k FROM zn) z WHERE k <= 14 GROUP BY 1),
sb2 AS (SELECT x, string_agg(l, ' | ' ORDER BY i) AS signature_block_text FROM ml WHERE i > n - 16 AND length(l) >= 4 AND x NOT IN (SELECT x FROM zn) GROUP BY 1),
hd AS (SELECT x, string_agg(l, ' | ' ORDER BY i) FILTER (WHERE i <= 12) AS header_text, string_agg(l, ' | ' ORDER BY i) FILTER (WHERE i > n - 18) AS tail_text, string_agg(l, ' | ' ORDER BY i) FILTER (WHERE i > n - 8 AND length(l) >= 4) AS footer_text FROM ml GROUP BY 1)"""


@query("str_18", f"WITH {ML}, {ZONE} SELECT signed_doc_id, page_num, coalesce(header_text, '') AS header_text, coalesce(tail_text, '') AS tail_text, coalesce(footer_text, '') AS footer_text, coalesce(sb.signature_block_text, sb2.signature_block_text, '') AS signature_block_text FROM v_signed_pages s LEFT JOIN hd ON page_text = hd.x LEFT JOIN sb ON page_text = sb.x LEFT JOIN sb2 ON page_text = sb2.x")
def str_18(t):
    f = P.with_page_features(t.v_signed_pages)
    return f.select("signed_doc_id", "page_num", "header_text", "tail_text", "footer_text", "signature_block_text")


HINTS = "|".join((*lx.DOC_TYPE_HINTS, "^BY:", "^NAME:", "^TITLE:", "^DATE:", "^ITS:"))
ANCH = f"""aw AS (SELECT b.x, b.l, min(a.i * 100 + b.i) AS o FROM ml a JOIN ml b ON a.x = b.x AND b.i BETWEEN a.i - 1 AND a.i + 1 WHERE regexp_matches(a.l, '{HINTS}') GROUP BY 1, 2),
al AS (SELECT x, string_agg(l, '|' ORDER BY o) AS anchors FROM aw GROUP BY 1)"""


@query("win_10", f"WITH {ML}, {ANCH}, ed AS (SELECT x, string_agg(l, '|' ORDER BY i) AS anchors FROM ml WHERE length(l) >= 8 AND x NOT IN (SELECT x FROM aw) GROUP BY 1) SELECT doc_id, page_num, coalesce(al.anchors, ed.anchors, '') AS anchors FROM v_pages LEFT JOIN al ON page_text = al.x LEFT JOIN ed ON page_text = ed.x")
def win_10(t):
    anchors = F.array_join(P.anchor_lines(P.meaningful_lines(F.col("page_text"))), "|")
    return once_per_content(t.v_pages, ["page_text"], lambda p: p.withColumn("anchors", anchors)).select("doc_id", "page_num", "anchors")


@query("set_03", f"""WITH {ML}, s AS (SELECT doc_id, page_num, x FROM v_pages JOIN ml0 ON page_text = x), p AS (SELECT a.doc_id, a.page_num, a.x AS x1, b.x AS x2 FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.page_num = a.page_num + 1)
SELECT doc_id, page_num, CASE WHEN n1 > 0 AND n2 > 0 THEN round(sh * 1.0 / (n1 + n2 - sh), 4)::DOUBLE ELSE 0 END AS overlap FROM (SELECT doc_id, page_num, (SELECT count(*) FROM ml WHERE x = x1 AND length(l) >= 4) AS n1, (SELECT count(*) FROM ml WHERE x = x2 AND length(l) >= 4) AS n2, (SELECT count(*) FROM ml a JOIN ml b ON a.l = b.l WHERE a.x = x1 AND b.x = x2 AND length(a.l) >= 4) AS sh FROM p) z""")
def set_03(t):
    p = once_per_content(t.v_pages, ["page_text"], lambda p: p.withColumn("a", P.meaningful_lines(F.col("page_text")))).select("doc_id", "page_num", "a")
    nxt = p.select("doc_id", (F.col("page_num") - 1).alias("page_num"), F.col("a").alias("b"))
    return p.join(nxt, ["doc_id", "page_num"]).select("doc_id", "page_num", F.round(P.line_overlap(F.col("a"), F.col("b")), 4).alias("overlap"))


STEM = "concat(' draft/', c1, CASE WHEN row_idx % 2 = 0 THEN ' (copy).pdf' ELSE ': v2.PDF' END)"


@query("str_14", rf"""WITH s AS (SELECT table_id, row_idx, {STEM} AS f, c1 FROM v_table_orig) SELECT table_id, row_idx, {PT(r"regexp_replace(regexp_replace(f, '(?i)\.pdf$', ''), '\s*\([^)]*\)', '', 'g')")} AS clean_stem,
 coalesce(nullif(trim(regexp_replace(regexp_replace(f, '[<>:"/\\|?*]', '_', 'g'), '\s+', ' ', 'g'), ' ._'), ''), 'document') AS safe_name, lower({q.squash('c1')}) AS doc_key FROM s""")
def str_14(t):
    s = t.v_table_orig.select("table_id", "row_idx", F.expr(STEM).alias("f"), "c1")
    return s.select("table_id", "row_idx", P.clean_stem(F.col("f")).alias("clean_stem"), P.safe_name(F.col("f")).alias("safe_name"), F.lower(T.squash(F.col("c1"))).alias("doc_key"))


@query("sco_08", """WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 100) AS v FROM embeddings)
SELECT a.vec_id, round(greatest(0, least(1, 1 - list_avg(list_transform(range(1, len(a.v) + 1), lambda i: abs(a.v[i] - b.v[i]))) / 255)), 6)::DOUBLE AS similarity FROM a JOIN a b ON b.vec_id = a.vec_id + 1""")
def sco_08(t):
    a = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 100).alias("v"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return a.join(b, "vec_id").select("vec_id", F.round(P.visual_similarity(F.col("v"), F.col("w")), 6).alias("similarity"))


# ---------------------------------------------------------------- executed pages
def both_sides(t):
    o = X.original_pages(t.v_pages)
    s = X.signed_pages(t.v_signed_pages.withColumnRenamed("signed_doc_id", "doc_id"))
    return s, o


@query("jon_06")
def jon_06(t):
    return X.match_pages(*both_sides(t))


@query("udf_03")
def udf_03(t):
    m = X.match_pages(*both_sides(t))
    return m.groupBy("deal_id").agg(F.count(F.lit(1)).alias("matches"), F.min("score").alias("lowest"))


@query("sco_05")
def sco_05(t):
    s, o = both_sides(t)
    sp, op = X.profiles(X.profiled(s.where("kind = 'signature'"), [])), X.profiles(X.profiled(o, ["clean_name", "detected_name", "footer_name", "title_name"]))
    return X.scored_pages(sp, op)


@query("top_07")
def top_07(t):
    return sco_05(t).orderBy(F.desc("score"), F.desc("doc_name_score"), F.desc("tail_score"), F.desc("visual_score"), F.desc("text_score"), "sp", "op")


@query("sco_07")
def sco_07(t):
    names = t.v_checklist.select(F.lower(T.squash(F.col("document_name"))).alias("a"), F.lower("party").alias("b")).distinct()
    return names.withColumn("ratio", P.sequence_ratio(F.col("a"), F.col("b")))


@query("jon_07")
def jon_07(t):
    # Schedules that carry the heading of the agreement they belong to.
    heading = F.concat(
        F.lit("\nSIGNATURE PAGE TO "), F.when(F.col("signed_doc_id") % 2 == 0, "CREDIT").otherwise("GUARANTY"), F.lit(" AGREEMENT\nBIRCHFIELD "),
        (F.col("signed_doc_id") % 5).cast("string"), F.lit(" ESTATES LLC\nName: Rosa Lind\nTitle: Managing Director"))
    named = F.when(F.col("page_num") % 4 == 3, F.concat("page_text", heading)).otherwise(F.col("page_text"))
    s = X.signed_pages(t.v_signed_pages.withColumn("page_text", named).withColumnRenamed("signed_doc_id", "doc_id"), X.SCHEDULE_COLUMNS)
    return X.match_schedules(s, X.original_pages(t.v_pages, X.SCHEDULE_COLUMNS))


def report(t):
    s, o = both_sides(t)
    return X.match_report(s, o, t.v_pages.select("deal_id", "doc_id"), X.match_pages(s, o), X.match_schedules(s, o))


@query("agg_17")
def agg_17(t):
    return X.report_totals(report(t))


@query("pip_08")
def pip_08(t):
    return report(t)


# ---------------------------------------------------------------- incumbency and signature blocks
TITLE_RE = "(?:" + "|".join(lx.OFFICER_TITLES) + ")"
NT = lambda c, g: rf"regexp_extract({c}, {q.lit(lx.NAME_AND_TITLE)}, {g})"
valid = lambda x: f"(length({x}) >= 3 AND {words_sql(x)} BETWEEN 2 AND 5 AND NOT regexp_matches(upper({x}), 'LLC|INC|CORP|LP|TRUST|N\\.A\\.') AND regexp_matches({x}, '^[A-Z]'))"
INC = f"""ic0 AS (SELECT entity_name, row_idx, {q.squash('cell0')} AS a, {q.squash('cell1')} AS b FROM v_incumbency),
ic1 AS (SELECT *, CASE WHEN {valid(NT('a', 1))} AND regexp_matches(upper({NT('a', 2)}), '{TITLE_RE}') THEN {NT('a', 1)} WHEN {valid('a')} THEN a WHEN {valid('b')} THEN b END AS name,
 CASE WHEN {valid(NT('a', 1))} AND regexp_matches(upper({NT('a', 2)}), '{TITLE_RE}') THEN trim({NT('a', 2)}) WHEN {valid('a')} AND regexp_matches(upper(b), '{TITLE_RE}') THEN b ELSE '' END AS title FROM ic0),
inc AS (SELECT entity_name, arg_min(name, row_idx) AS name, arg_min(title, row_idx) AS title, min(row_idx) AS row_idx FROM ic1 WHERE name IS NOT NULL GROUP BY entity_name, upper(name), upper(title))"""


def incumbents(t):
    return S.table_signers(t.v_incumbency.select("entity_name", "row_idx", F.array("cell0", "cell1").alias("cells")))


@query("str_22", f"WITH {INC} SELECT row_idx, coalesce(name, '') AS name, title FROM ic1")
def str_22(t):
    s = SG.row_signer(F.array("cell0", "cell1"))
    return t.v_incumbency.select("row_idx", F.coalesce(s["name"], F.lit("")).alias("name"), F.coalesce(s["title"], F.lit("")).alias("title"))


@query("pip_13", f"WITH {INC} SELECT entity_name, row_idx, name, title FROM inc")
def pip_13(t):
    return incumbents(t)


CERT = "concat('I, the undersigned, am Secretary of ', entity_name, ', a Delaware company.')"


@query("str_21", rf"SELECT row_idx, trim(regexp_extract({CERT}, {q.lit(lx.ENTITY_PATTERNS[0])}, 1)) AS entity FROM v_incumbency")
def str_21(t):
    return t.v_incumbency.select("row_idx", SG.entity_from_certificate(F.expr(CERT)).alias("entity"))


HEADS = "CASE CAST(row_idx % 4 AS INT) WHEN 0 THEN 'Officer Name|Title|Signature' WHEN 1 THEN 'Name|Sign here' WHEN 2 THEN 'Item|Office' ELSE 'No.|Printed Name|Capacity' END"
_idx = lambda words: f"CAST(coalesce(list_position(list_transform(hs, lambda h: regexp_matches(upper(h), '{'|'.join(words)}')), TRUE), 0) - 1 AS BIGINT)"


@query("cls_09", f"""SELECT row_idx, {_idx(lx.SIGN_NAME_HEADERS)} >= 0 AND {_idx(lx.SIGN_HEADERS)} >= 0 AS signature_table, {_idx(lx.INCUMBENCY_NAME_HEADERS)} >= 0 AND {_idx(lx.INCUMBENCY_TITLE_HEADERS)} >= 0 AS incumbency_table, {_idx(lx.SIGN_NAME_HEADERS)} AS name_col
FROM (SELECT row_idx, string_split({HEADS}, '|') AS hs FROM v_incumbency) z""")
def cls_09(t):
    h = F.split(F.expr(HEADS), r"\|")
    return t.v_incumbency.select("row_idx", SG.is_signature_table(h).alias("signature_table"), SG.is_incumbency_table(h).alias("incumbency_table"), long(SG.header_index(h, lx.SIGN_NAME_HEADERS)).alias("name_col"))


@query("src_12", r"""WITH l AS (SELECT deal_id, doc_id, page_num, unnest(string_split(page_text, chr(10))) AS l, unnest(range(0, len(string_split(page_text, chr(10))))) AS i FROM v_pages),
n AS (SELECT *, nullif(regexp_extract(trim(l), '(?i)^Name:\s*(.+)', 1), '') AS nm, nullif(regexp_extract(trim(l), '(?i)^Title:\s*(.+)', 1), '') AS ti FROM l),
p AS (SELECT *, last_value(nm IGNORE NULLS) OVER (PARTITION BY deal_id, doc_id, page_num ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM n)
SELECT deal_id, doc_id, page_num, prev AS name, ti AS title FROM p WHERE ti IS NOT NULL AND prev IS NOT NULL AND len(string_split(prev, ' ')) BETWEEN 2 AND 5 AND regexp_matches(prev, '^[A-Z]')""")
def src_12(t):
    return S.line_signers(t.v_pages)


# Roles of the checklists are played by entities; the mapping picks a signer by position.
MAPS = """SELECT CAST(c_custkey % 20 AS BIGINT) AS checklist_id, concat('BIRCHFIELD ', CAST(c_custkey % 17 AS STRING), ' Estates, LLC') AS entity_name, CASE CAST(floor(c_custkey / 20) AS INT) % 4 WHEN 0 THEN 'Borrower' WHEN 1 THEN 'Agent' WHEN 2 THEN 'Company' ELSE 'Lenders' END AS role,
 CAST(c_custkey % 3 AS BIGINT) AS signer_index, c_custkey AS seq FROM customer"""
RS = f"""{INC}, ip AS (SELECT *, row_number() OVER (PARTITION BY entity_name ORDER BY row_idx) - 1 AS pos FROM inc), mp AS ({MAPS}),
rs AS (SELECT checklist_id, role, arg_max(entity_name, seq) AS entity_name, arg_max(name, seq) AS name, arg_max(title, seq) AS title FROM mp JOIN ip USING (entity_name) WHERE pos = signer_index GROUP BY 1, 2)"""


def chosen(t):
    from dealweave.fixtures import spark_sql

    s = hot.numbered(incumbents(t), ["entity_name"], hot.index_block(F.col("row_idx")), ["row_idx"], "n").withColumn("pos", F.col("n") - 1)
    return S.role_signers(spark_sql(t.spark, t.sf_dir, MAPS), s)


@query("jon_02", f"WITH {RS} SELECT checklist_id, role, entity_name, name, title FROM rs")
def jon_02(t):
    return chosen(t)


ROLES = r"""ro AS (SELECT checklist_id, document_name, unnest(roles) AS role, unnest(range(0, len(roles))) AS pos FROM (SELECT checklist_id, trim(document_name) AS document_name, arg_max(list_filter(list_transform(string_split_regex(signatories, '[,;]|\band\b'), lambda x: trim(x)), lambda x: length(x) > 1), row_id) AS roles FROM v_rows WHERE trim(document_name) <> '' AND signatories <> '' GROUP BY 1, 2) z)"""


@query("jon_03", f"WITH {RS}, {ROLES} SELECT checklist_id, document_name, pos, role, coalesce(entity_name, '[' || role || ']') AS entity, coalesce(name, '') AS signer FROM ro LEFT JOIN rs USING (checklist_id, role)")
def jon_03(t):
    j = C.signatory_roles(t.v_rows).join(chosen(t), ["checklist_id", "role"], "left")
    return j.select("checklist_id", "document_name", long("pos").alias("pos"), "role", F.coalesce("entity_name", F.concat(F.lit("["), F.col("role"), F.lit("]"))).alias("entity"), F.coalesce("name", F.lit("")).alias("signer"))


RULE = "'________________________'"
BLOCKS = f"""bl AS (SELECT checklist_id, document_name, pos, concat(upper(coalesce(entity_name, '[' || role || ']')), ',', chr(10), 'as ', role, chr(10), chr(10), chr(10), 'By: ', {RULE}, chr(10), 'Name: ', coalesce(name, {RULE}), chr(10), 'Title: ', coalesce(title, {RULE})) AS b FROM ro LEFT JOIN rs USING (checklist_id, role)),
pg AS (SELECT checklist_id, document_name, count(*) AS blocks, concat('SIGNATURE PAGE TO ', upper(document_name), chr(10), chr(10), '[Signature Page Follows]', chr(10), chr(10), chr(10), string_agg(b || chr(10) || chr(10), chr(10) ORDER BY pos)) AS page_text FROM bl GROUP BY 1, 2)"""


@query("str_23", f"WITH {RS}, {ROLES}, {BLOCKS} SELECT checklist_id, document_name, blocks, page_text FROM pg")
def str_23(t):
    return S.signature_pages(C.signatory_roles(t.v_rows), chosen(t)).withColumn("blocks", long("blocks"))


FILES_SQL = "SELECT checklist_id, row_id AS file_id, CASE CAST(row_id % 4 AS INT) WHEN 0 THEN concat('final ', document_name) WHEN 1 THEN replace(document_name, ' ', '') WHEN 2 THEN document_name ELSE concat('memo ', CAST(row_id AS STRING)) END AS stem FROM v_rows WHERE document_name <> ''"
MATCHED = f"""fi AS ({FILES_SQL}), na AS (SELECT checklist_id, min(row_id) AS seq, document_name AS name FROM v_rows WHERE document_name <> '' GROUP BY 1, 3),
fs AS (SELECT DISTINCT checklist_id, lower(stem) AS f FROM fi), fm AS (SELECT fs.checklist_id, f, min(seq) AS seq FROM fs JOIN na ON fs.checklist_id = na.checklist_id AND (contains(lower(name), f) OR contains(f, lower(name)) OR contains(replace(lower(name), ' ', ''), replace(f, ' ', ''))) GROUP BY 1, 2),
mf AS (SELECT fi.checklist_id, file_id, stem, name AS matched_name, CASE WHEN name IS NULL THEN 'copied' ELSE 'processed' END AS status FROM fi LEFT JOIN fm ON lower(stem) = f AND fi.checklist_id = fm.checklist_id LEFT JOIN na ON na.checklist_id = fm.checklist_id AND na.seq = fm.seq)"""


def file_matches(t):
    from dealweave.fixtures import spark_sql

    names = t.v_rows.where("document_name <> ''").groupBy("checklist_id", F.col("document_name").alias("name")).agg(F.min("row_id").alias("seq"))
    return S.match_files(spark_sql(t.spark, t.sf_dir, FILES_SQL), names)


@query("jon_01", f"WITH {MATCHED} SELECT checklist_id, file_id, stem, matched_name, status FROM mf")
def jon_01(t):
    return file_matches(t)


@query("pip_11", f"WITH {RS}, {ROLES}, {BLOCKS}, {MATCHED} SELECT file_id, mf.checklist_id, matched_name, blocks FROM mf JOIN pg ON document_name = matched_name AND mf.checklist_id = pg.checklist_id")
def pip_11(t):
    pages = S.signature_pages(C.signatory_roles(t.v_rows), chosen(t)).select("checklist_id", F.col("document_name").alias("matched_name"), long("blocks").alias("blocks"))
    return file_matches(t).where("status = 'processed'").join(pages, ["checklist_id", "matched_name"]).select("file_id", "checklist_id", "matched_name", "blocks")
