"""Queries over table versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealweave.functions import text as T
from dealweave.operators import redline as R
from dealweave.plans import duck as q
from dealweave.plans.mail import long
from dealweave.plans.registry import query


def cells(df):
    return df.select("table_id", long("row_idx").alias("row_idx"), F.array("c0", "c1", "c2", "c3").alias("cells"))


def sides(t):
    return cells(t.v_table_orig), cells(t.v_table_mod)


CC = lambda c: rf"lower(trim(regexp_replace(regexp_replace({c}, '[\t\r]+', ' ', 'g'), ' +', ' ', 'g')))"
FP = "substr(md5(concat_ws('|', " + ", ".join(f"substr(md5({CC(f'c{i}')}), 1, 8)" for i in range(4)) + ")), 1, 16)"
K3 = "concat_ws(chr(1), " + ", ".join(CC(f"c{i}") for i in range(3)) + ")"
PRINTS = f"""
o AS (SELECT *, {FP} AS fp, {K3} AS k3, row_number() OVER (PARTITION BY table_id, {FP} ORDER BY row_idx) AS k FROM v_table_orig),
m AS (SELECT *, {FP} AS fp, {K3} AS k3, row_number() OVER (PARTITION BY table_id, {FP} ORDER BY row_idx) AS k FROM v_table_mod),
x1 AS (SELECT o.table_id, o.row_idx AS orig_idx, m.row_idx AS mod_idx, 1.0::DOUBLE AS confidence FROM o JOIN m USING (table_id, fp, k)),
o2 AS (SELECT *, row_number() OVER (PARTITION BY table_id, k3 ORDER BY row_idx) AS k2 FROM o WHERE (table_id, row_idx) NOT IN (SELECT (table_id, orig_idx) FROM x1)),
m2 AS (SELECT *, row_number() OVER (PARTITION BY table_id, k3 ORDER BY row_idx) AS k2 FROM m WHERE (table_id, row_idx) NOT IN (SELECT (table_id, mod_idx) FROM x1)),
x2 AS (SELECT o2.table_id, o2.row_idx AS orig_idx, m2.row_idx AS mod_idx, 0.8::DOUBLE AS confidence FROM o2 JOIN m2 USING (table_id, k3, k2) WHERE replace(k3, chr(1), '') <> ''),
mt AS (SELECT * FROM x1 UNION ALL SELECT * FROM x2)"""
DIFFS = " + ".join(f"({CC(f'o.c{i}')} <> {CC(f'm.c{i}')})::INT" for i in range(4))
CHANGES = f"""{PRINTS},
b AS (SELECT mt.table_id, orig_idx, mod_idx, CAST({DIFFS} AS BIGINT) AS changed_cells FROM mt JOIN o ON o.table_id = mt.table_id AND o.row_idx = orig_idx JOIN m ON m.table_id = mt.table_id AND m.row_idx = mod_idx),
ch AS (SELECT table_id, orig_idx, mod_idx, CASE WHEN changed_cells > 0 THEN 'modified' WHEN orig_idx <> mod_idx THEN 'moved' ELSE 'unchanged' END AS change_type, changed_cells,
 coalesce(max(mod_idx) OVER (PARTITION BY table_id ORDER BY orig_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > mod_idx, FALSE) AS out_of_order FROM b
 UNION ALL SELECT table_id, row_idx, NULL, 'deleted', 4, FALSE FROM o WHERE (table_id, row_idx) NOT IN (SELECT (table_id, orig_idx) FROM mt)
 UNION ALL SELECT table_id, NULL, row_idx, 'added', 4, FALSE FROM m WHERE (table_id, row_idx) NOT IN (SELECT (table_id, mod_idx) FROM mt))"""


def changes(t, fuzzy=False):
    o, m = sides(t)
    return R.row_changes(o, m, R.match_rows(o, m, fuzzy))


@query("arr_02", f"SELECT 'row' AS kind, table_id AS a, row_idx AS b, {FP} AS print FROM v_table_orig UNION ALL SELECT 'page', doc_id, page_num, md5(trim(regexp_replace(lower(page_text), '\\s+', ' ', 'g'))) FROM v_pages")
def arr_02(t):
    o = R.printed(cells(t.v_table_orig)).select(F.lit("row").alias("kind"), F.col("table_id").alias("a"), F.col("row_idx").alias("b"), F.col("fp").alias("print"))
    return o.unionAll(t.v_pages.select(F.lit("page"), "doc_id", long("page_num"), T.page_hash(F.col("page_text"))))


@query("win_08", f"WITH {PRINTS} SELECT table_id, row_idx, k FROM m")
def win_08(t):
    return R.occurrences(R.printed(cells(t.v_table_mod)), "fp").select("table_id", "row_idx", "k")


@query("jon_09", f"WITH {PRINTS} SELECT table_id, orig_idx, mod_idx, confidence FROM mt")
def jon_09(t):
    return R.match_rows(*sides(t), fuzzy=False)


@query("udf_02")
def udf_02(t):
    m = R.match_rows(*sides(t))
    return m.groupBy("table_id").agg(F.count(F.lit(1)).alias("matched"), F.count_if(~F.col("confidence").isin(1.0, 0.8)).alias("fuzzy"))


@query("cls_10", f"WITH {CHANGES} SELECT table_id, orig_idx, mod_idx, change_type, changed_cells FROM ch")
def cls_10(t):
    return changes(t).drop("out_of_order")


@query("win_09", f"WITH {CHANGES} SELECT table_id, bool_or(out_of_order) AS is_resorted, count(*) FILTER (WHERE out_of_order) AS out_of_order FROM ch GROUP BY 1")
def win_09(t):
    return changes(t).groupBy("table_id").agg(F.max("out_of_order").alias("is_resorted"), F.count_if("out_of_order").alias("out_of_order"))


STATS = ", ".join(f"count(*) FILTER (WHERE change_type = '{k}') AS {k}" for k in ("unchanged", "added", "deleted", "modified", "moved"))


@query("agg_15", f"WITH {CHANGES} SELECT table_id, {STATS}, bool_or(out_of_order) AS is_resorted FROM ch GROUP BY 1")
def agg_15(t):
    return R.change_stats(changes(t))


@query("jon_14", f"WITH {CHANGES} SELECT table_id, coalesce(orig_idx, mod_idx) AS row_idx, change_type FROM ch WHERE change_type IN ('added', 'deleted')")
def jon_14(t):
    c = changes(t).where(F.col("change_type").isin("added", "deleted"))
    return c.select("table_id", F.coalesce("orig_idx", "mod_idx").alias("row_idx"), "change_type")


@query("pip_09")
def pip_09(t):
    return R.change_stats(changes(t, fuzzy=True))


# Tables with header rows: two spellings of the same columns, one column new.
HO = "SELECT DISTINCT table_id, CAST(0 AS BIGINT) AS row_idx, 'Part' AS c0, 'Name' AS c1, 'Brand' AS c2, 'Size' AS c3 FROM v_table_orig"
HM = "SELECT DISTINCT table_id, CAST(0 AS BIGINT) AS row_idx, 'Name' AS c0, CASE WHEN table_id % 2 = 0 THEN 'Parts' ELSE 'Part' END AS c1, 'Brand' AS c2, CASE WHEN table_id % 3 = 0 THEN 'Weight' ELSE 'Size' END AS c3 FROM v_table_mod"


def heads(t, sql):
    from dealweave.fixtures import spark_sql

    return cells(spark_sql(t.spark, t.sf_dir, sql))


def grids(t):
    def one(rows, head):
        both = cells(rows).withColumn("is_header", F.lit(False)).unionByName(heads(t, head).withColumn("is_header", F.lit(True)))
        return both.withColumns({"pair_id": F.col("table_id") % 2, "page": F.col("table_id")})

    return one(t.v_table_orig, HO), one(t.v_table_mod, HM)


SIM = f"""og AS (SELECT table_id, {FP} AS fp FROM v_table_orig), mg AS (SELECT table_id, {FP} AS fp FROM v_table_mod),
oh AS (SELECT table_id, {FP} AS hfp, [lower(c0), lower(c1), lower(c2), lower(c3)] AS hc FROM ({HO}) a), mh AS (SELECT table_id, {FP} AS hfp, [lower(c0), lower(c1), lower(c2), lower(c3)] AS hc FROM ({HM}) b),
sm AS (SELECT oh.table_id % 2 AS pair_id, oh.table_id AS ot, mh.table_id AS mt, CASE WHEN oh.hfp = mh.hfp THEN 0.5 ELSE len(list_intersect(oh.hc, mh.hc)) / 4.0 * 0.5 END
 + (SELECT count(*) FROM (SELECT fp FROM og WHERE table_id = oh.table_id INTERSECT SELECT fp FROM mg WHERE table_id = mh.table_id) i) * 0.3 / (SELECT count(*) FROM (SELECT fp FROM og WHERE table_id = oh.table_id UNION SELECT fp FROM mg WHERE table_id = mh.table_id) u)
 + CASE WHEN oh.table_id = mh.table_id THEN 0.2 ELSE 0 END AS score FROM oh JOIN mh ON oh.table_id % 2 = mh.table_id % 2)"""


@query("sco_06", f"WITH {SIM} SELECT pair_id, ot, mt, round(score::DOUBLE, 6) AS score FROM sm")
def sco_06(t):
    return R.table_scores(*grids(t)).withColumn("score", F.round("score", 6))


@query("jon_08")
def jon_08(t):
    return R.match_tables(*grids(t))


@query("jon_10")
def jon_10(t):
    m = R.column_mappings(heads(t, HO), heads(t, HM))
    return m.select("table_id", F.explode("map").alias("p")).select("table_id", "p.o", "p.m")


@query("set_02", f"""SELECT a.table_id, array_to_string(list_filter(['part', 'name', 'brand', 'size'], lambda x: NOT list_contains([lower(b.c0), lower(b.c1), lower(b.c2), lower(b.c3)], x)), ',') AS deleted,
 array_to_string(list_filter([lower(b.c0), lower(b.c1), lower(b.c2), lower(b.c3)], lambda x: NOT list_contains(['part', 'name', 'brand', 'size'], x)), ',') AS added FROM ({HO}) a JOIN ({HM}) b USING (table_id)""")
def set_02(t):
    low = lambda c: F.transform(c, lambda x: F.lower(T.clean_cell(x)))
    j = heads(t, HO).select("table_id", low("cells").alias("a")).join(heads(t, HM).select("table_id", low("cells").alias("b")), "table_id")
    return j.select("table_id", F.array_join(F.array_except("a", "b"), ",").alias("deleted"), F.array_join(F.array_except("b", "a"), ",").alias("added"))


@query("udf_01")
def udf_01(t):
    from dealweave.functions.pages import sequence_ratio

    o = cells(t.v_table_orig).select("table_id", "row_idx", F.array_join("cells", " | ").alias("a"))
    m = cells(t.v_table_mod).select("table_id", "row_idx", F.array_join("cells", " | ").alias("b"))
    return o.join(m, ["table_id", "row_idx"]).select("table_id", "row_idx", sequence_ratio("a", "b").alias("ratio"))
