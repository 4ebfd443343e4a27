"""Table redlining: tables, columns and rows matched between two versions, then classified.

Rows are matched in three passes. Passes one and two are equi-joins on (content key, occurrence
number), so the k-th copy meets the k-th copy without pairing copies. Only rows without any
counterpart after that are compared by text similarity, in row order and by falling bounds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from dealweave.functions import text as T
from dealweave.functions.pages import ratio
from dealweave.operators import hot, similarity
from dealweave.operators.assign import first_come
from dealweave.session import cut_lineage

FUZZY_ROW, FUZZY_HEADER, TABLE_SCORE = 0.6, 0.7, 0.3  # fixed values
ORDERED, STRIP = 2048, 64  # original rows of a table that choose in one turn, and whose bounds are held at a time
MAPPING = ArrayType(StructType([StructField("o", IntegerType()), StructField("m", IntegerType())]))


def printed(rows: DataFrame) -> DataFrame:
    """(table_id, row_idx, cells) with fingerprint, three-cell key and comparison text."""
    clean = F.transform("cells", lambda c: F.lower(T.clean_cell(c)))
    return rows.withColumns({
        "fp": T.row_print(F.col("cells")),
        "key3": F.array_join(F.slice(clean, 1, 3), "\u0001"),
        "row_text": F.array_join(F.transform("cells", T.clean_cell), " | "),
    })


def occurrences(rows: DataFrame, key: str) -> DataFrame:
    """Number the copies of a key inside its table."""
    return hot.numbered(rows, ["table_id", key], hot.index_block(F.col("row_idx")), ["row_idx"], "k")


def _equal_pass(orig: DataFrame, mod: DataFrame, key: str, confidence: float) -> DataFrame:
    o = occurrences(orig, key).select("table_id", key, "k", F.col("row_idx").alias("orig_idx"))
    m = occurrences(mod, key).select("table_id", key, "k", F.col("row_idx").alias("mod_idx"))
    return o.join(m, ["table_id", key, "k"]).select("table_id", "orig_idx", "mod_idx", F.lit(confidence).alias("confidence"))


def _rest(rows: DataFrame, taken: DataFrame, idx: str) -> DataFrame:
    used = taken.select("table_id", F.col(idx).alias("row_idx"))
    return rows.join(used, ["table_id", "row_idx"], "left_anti")


def match_rows(orig: DataFrame, mod: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(table_id, orig_idx, mod_idx, confidence) for tables already paired under one table_id."""
    o, m = cut_lineage(printed(orig)), cut_lineage(printed(mod))
    first = cut_lineage(_equal_pass(o, m, "fp", 1.0))
    o2, m2 = _rest(o, first, "orig_idx"), _rest(m, first, "mod_idx")
    filled = F.regexp_replace("key3", "\u0001", "") != ""
    second = cut_lineage(_equal_pass(o2.where(filled), m2.where(filled), "key3", 0.8))
    taken = first.unionByName(second)
    if not fuzzy:
        return taken
    o3, m3 = _rest(o2, second, "orig_idx"), _rest(m2, second, "mod_idx")
    return taken.unionByName(fuzzy_rows(o3, m3))


def _closest(left: list[str], right: list[str]) -> list[tuple[int, int, float]]:
    """Every left text in order takes the most similar free right text above 0.6 (ties: the first). The ratio is asked by falling bounds,
    until no other bound could win."""
    free, found = np.ones(len(right), bool), []
    for s in range(0, len(left), STRIP):
        for i, bounds in enumerate(similarity.order_bound(left[s:s + STRIP], right), s):
            bounds = np.where(free, bounds, 0.0)
            best, taken = FUZZY_ROW, -1
            while True:
                j = int(bounds.argmax())
                if bounds[j] < best or bounds[j] <= FUZZY_ROW or (bounds[j] == best and j > taken >= 0):
                    break
                got = ratio(left[i], right[j])
                if got > best or (got == best and j < taken):
                    best, taken = got, j
                bounds[j] = 0.0
            if taken >= 0:
                free[taken] = False
                found.append((i, taken, best))
                if not free.any():
                    return found
    return found


def fuzzy_rows(orig: DataFrame, mod: DataFrame) -> DataFrame:
    """Rows left over on both sides: most similar above 0.6, in original order, one to one.

    Each row depends on what those before it took, so original rows of a table go by ``ORDERED`` at a time, all tables at once, against
    the modified rows that are still free. Pairs are not listed: bounds of one strip of rows are held at a time."""
    o = hot.numbered(orig.where("table_id IS NOT NULL"), ["table_id"], hot.index_block(F.col("row_idx")), ["row_idx"], "_n")
    o = cut_lineage(o.select("table_id", F.floor((F.col("_n") - 1) / ORDERED).cast("int").alias("_turn"), F.col("row_idx").alias("orig_idx"), F.col("row_text").alias("a")))
    kinds = dict(mod.dtypes)
    schema = f"table_id {kinds['table_id']}, orig_idx {dict(o.dtypes)['orig_idx']}, mod_idx {kinds['row_idx']}, confidence double, b string"
    none = F.lit(None).cast(dict(o.dtypes)["orig_idx"])
    state = mod.where("table_id IS NOT NULL").select("table_id", none.alias("orig_idx"), F.col("row_idx").alias("mod_idx"), F.lit(None).cast("double").alias("confidence"), F.col("row_text").alias("b"))

    def turn(left: pa.Table, right: pa.Table) -> pa.Table:
        """Modified rows of a table, those that were taken with the row that took them; none if no original row asks."""
        if not left.num_rows or not right.num_rows:
            return right.slice(0, 0)
        left, right = left.sort_by("orig_idx"), right.sort_by("mod_idx")
        at, score = [None] * right.num_rows, [None] * right.num_rows
        own = left["orig_idx"].to_pylist()
        for i, j, s in _closest([x or "" for x in left["a"].to_pylist()], [x or "" for x in right["b"].to_pylist()]):
            at[j], score[j] = own[i], s
        right = right.set_column(1, "orig_idx", pa.array(at, right["orig_idx"].type))
        return right.set_column(3, "confidence", pa.array(score, pa.float64()))

    done, turns = [], o.agg(F.max("_turn")).first()[0]
    for n in range(0 if turns is None else turns + 1):
        free = state.where("orig_idx IS NULL")
        state = cut_lineage(o.where(F.col("_turn") == n).groupBy("table_id").cogroup(free.groupBy("table_id")).applyInArrow(turn, schema))
        done.append(state)
        if state.where("orig_idx IS NULL").isEmpty():
            break
    found = reduce(DataFrame.unionByName, done or [state])
    return found.where("orig_idx IS NOT NULL").select("table_id", "orig_idx", "mod_idx", "confidence")


def row_changes(orig: DataFrame, mod: DataFrame, matches: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """unchanged, modified, moved, added or deleted per row. A matched row whose absolute index
    differs counts as moved, so rows after an insertion are moved too; ``out_of_order`` tells
    which of them really changed their relative order.

    ``mapping`` is (table_id, map array of struct(o, m)); without it columns pair by position."""
    o = orig.select("table_id", F.col("row_idx").alias("orig_idx"), F.col("cells").alias("oc"))
    m = mod.select("table_id", F.col("row_idx").alias("mod_idx"), F.col("cells").alias("mc"))
    both = matches.join(o, ["table_id", "orig_idx"]).join(m, ["table_id", "mod_idx"])
    if mapping is None:
        n = F.greatest(F.size("oc"), F.size("mc"))
        both = both.withColumn("map", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("o"), i.alias("m"))))
    else:
        both = both.join(mapping, "table_id")

    def differs(p):
        a, b = F.get("oc", p["o"]), F.get("mc", p["m"])
        return a.isNotNull() & (b.isNull() | (F.lower(T.clean_cell(a)) != F.lower(T.clean_cell(b))))

    both = both.withColumn("changed_cells", F.size(F.filter("map", differs)))
    moved = F.col("mod_idx") != F.col("orig_idx")
    kind = F.when(F.col("changed_cells") > 0, "modified").when(moved, "moved").otherwise("unchanged")
    both = hot.max_before(both, ["table_id"], hot.index_block(F.col("orig_idx")), ["orig_idx"], F.col("mod_idx"), "_seen")
    both = both.select("table_id", "orig_idx", "mod_idx", kind.alias("change_type"), F.col("changed_cells").cast("long").alias("changed_cells"),
                       F.coalesce(F.col("_seen") > F.col("mod_idx"), F.lit(False)).alias("out_of_order"))
    none = F.lit(None).cast(dict(matches.dtypes)["orig_idx"])
    gone = o.join(matches.select("table_id", "orig_idx"), ["table_id", "orig_idx"], "left_anti").select(
        "table_id", "orig_idx", none.alias("mod_idx"), F.lit("deleted").alias("change_type"), F.size("oc").cast("long").alias("changed_cells"), F.lit(False).alias("out_of_order"))
    new = m.join(matches.select("table_id", "mod_idx"), ["table_id", "mod_idx"], "left_anti").select(
        "table_id", none.alias("orig_idx"), "mod_idx", F.lit("added").alias("change_type"), F.size("mc").cast("long").alias("changed_cells"), F.lit(False).alias("out_of_order"))
    return both.unionByName(gone).unionByName(new)


def change_stats(changes: DataFrame, header_rows: int = 0) -> DataFrame:
    """Counts per table; a matched header row counts as one unchanged row."""
    def n(kind):
        return F.count_if(F.col("change_type") == kind)

    return changes.groupBy("table_id").agg(
        (n("unchanged") + header_rows).alias("unchanged"), *[n(k).alias(k) for k in ("added", "deleted", "modified", "moved")],
        F.max("out_of_order").alias("is_resorted"))


# ---------------------------------------------------------------- tables and columns
def table_scores(orig: DataFrame, mod: DataFrame) -> DataFrame:
    """Similarity of the tables of two documents: .5 header, .3 shared rows, .2 same page.

    Input: (pair_id, table_id, page, is_header, row_idx, cells). Tables that share neither a header
    cell nor a row reach at most .2, below the threshold, so candidates come from those joins."""
    def side(df, t):
        p = df.withColumns({"fp": T.row_print(F.col("cells")), "clean": F.transform("cells", lambda c: F.lower(T.clean_cell(c)))})
        heads = p.where("is_header").select("pair_id", F.col("table_id").alias(t), F.col("fp").alias(f"{t}_hfp"), F.size("clean").alias(f"{t}_w"), "clean", F.col("page").alias(f"{t}_page"))
        rows = p.where("NOT is_header").select("pair_id", F.col("table_id").alias(t), "fp").distinct()
        return heads, rows

    (ho, ro), (hm, rm) = side(orig, "ot"), side(mod, "mt")
    cells = lambda h, t: h.select("pair_id", t, F.explode(F.array_distinct("clean")).alias("c"))
    shared_cells = cells(ho, "ot").join(cells(hm, "mt"), ["pair_id", "c"]).groupBy("pair_id", "ot", "mt").agg(F.count(F.lit(1)).alias("hc"))
    shared_rows = ro.join(rm, ["pair_id", "fp"]).groupBy("pair_id", "ot", "mt").agg(F.count(F.lit(1)).alias("rc"))
    size = lambda r, t: r.groupBy("pair_id", t).agg(F.count(F.lit(1)).alias(f"{t}_n"))
    j = shared_cells.join(shared_rows, ["pair_id", "ot", "mt"], "full_outer")
    for h, r, t in ((ho, ro, "ot"), (hm, rm, "mt")):
        j = j.join(h.drop("clean"), ["pair_id", t], "left").join(size(r, t), ["pair_id", t], "left")
    zero = F.lit(0)
    head = F.when(F.col("ot_hfp") == F.col("mt_hfp"), 0.5).otherwise(F.coalesce(F.col("hc") / F.greatest("ot_w", "mt_w") * 0.5, F.lit(0.0)))
    rc = F.coalesce("rc", zero)
    union = F.coalesce("ot_n", zero) + F.coalesce("mt_n", zero) - rc
    rows = F.when(union > 0, rc / union * 0.3).otherwise(0.0)
    page = F.when(F.col("ot_page") == F.col("mt_page"), 0.2).otherwise(0.0)
    return j.select("pair_id", "ot", "mt", (head + rows + page).alias("score"))


def match_tables(orig: DataFrame, mod: DataFrame) -> DataFrame:
    """Tables paired greedily in original order, with unmatched tables of both sides kept."""
    pairs = table_scores(orig, mod).where(F.col("score") > TABLE_SCORE).select(
        "pair_id", F.col("ot").alias("left"), F.col("mt").alias("right"), "score")
    got = first_come(pairs, [(-F.col("score")).alias("s")], ["pair_id"]).select(
        "pair_id", F.col("left").alias("orig_table"), F.col("right").alias("mod_table"))
    all_o = orig.select("pair_id", F.col("table_id").alias("orig_table")).distinct()
    all_m = mod.select("pair_id", F.col("table_id").alias("mod_table")).distinct()
    return all_o.join(got, ["pair_id", "orig_table"], "left").join(all_m, ["pair_id", "mod_table"], "full_outer")


@F.pandas_udf(MAPPING)
def column_map(orig: pd.Series, mod: pd.Series) -> pd.Series:
    """Column pairs of two header rows: equal text, then similarity above 0.7, then position."""
    def pair(a, b):
        out, free = {}, set(range(len(b)))
        for i, x in enumerate(a):
            j = next((j for j in sorted(free) if x and b[j] == x), None)
            if j is not None:
                out[i] = j
                free.discard(j)
        for i, x in enumerate(a):
            if i in out or not x:
                continue
            best = max(((ratio(x, b[j]), -j) for j in free if b[j]), default=(0.0, 0))
            if best[0] > FUZZY_HEADER:
                out[i] = -best[1]
                free.discard(-best[1])
        for i in range(len(a)):
            if i not in out and i in free:
                out[i] = i
                free.discard(i)
        return [{"o": i, "m": j} for i, j in sorted(out.items())]

    return pd.Series([pair(list(x), list(y)) for x, y in zip(orig, mod)])


def column_mappings(orig_heads: DataFrame, mod_heads: DataFrame) -> DataFrame:
    """(table_id, map, deleted_columns, added_columns) from header rows (table_id, cells)."""
    clean = lambda c: F.transform(c, lambda x: F.lower(T.clean_cell(x)))
    j = orig_heads.select("table_id", clean("cells").alias("a")).join(mod_heads.select("table_id", clean("cells").alias("b")), "table_id")
    j = j.withColumn("map", column_map("a", "b"))
    index = lambda c: F.transform(c, lambda x, i: i)
    return j.select(
        "table_id", "map", F.array_except(index("a"), F.transform("map", lambda p: p["o"])).alias("deleted_columns"),
        F.array_except(index("b"), F.transform("map", lambda p: p["m"])).alias("added_columns"))
