"""Checklist grids: header and column inference, row typing, context, deal anchors, punch lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealweave import lexicon as lx
from dealweave.functions import mail as M
from dealweave.functions import text as T
from dealweave.operators import hot
from dealweave.session import computed_once


# ---------------------------------------------------------------- grids
def column_index(headers: Column, patterns) -> Column:
    """0-based index of the first header that starts with any pattern, -1 when none does."""
    hits = F.transform(headers, lambda h: T.any_rlike(F.lower(T.strip(h)), patterns))
    return (F.array_position(hits, True) - 1).cast("int")


def header_rows(grid: DataFrame, profile: str = "checklist", file_key: str = "file_id") -> DataFrame:
    """Best header row per file. ``grid`` is (file, table_id, row_idx from 0, cells array).

    Only the first 17 rows of a table can matter, so the scan is cut before any shuffle.
    """
    max_len, roles = lx.HEADER_PROFILES[profile]
    head = grid.where(F.col("row_idx") <= 16).withColumn("cells", F.transform("cells", T.squash))
    filled = F.filter("cells", lambda c: c != "")
    following = W.partitionBy(file_key, "table_id").orderBy("row_idx").rangeBetween(1, 10)
    head = head.withColumn(
        "below", F.coalesce(F.sum(F.when(F.size(filled) > 0, 1).otherwise(0)).over(following), F.lit(0))
    ).where((F.col("row_idx") <= 6) & (F.size(filled) >= 2))
    mean_len = F.aggregate(filled, F.lit(0), lambda a, c: a + F.length(c)) / F.size(filled)
    score = F.size(filled) + 3 * F.col("below") + F.when(mean_len <= max_len, 1).otherwise(-5)
    for name, bonus, patterns in roles:
        head = head.withColumn(f"{name}_col", column_index(F.col("cells"), patterns))
        score = score + F.when(F.col(f"{name}_col") >= 0, bonus).otherwise(0)
    head = head.withColumn("score", score)
    order = [F.desc("score"), F.asc("table_id"), F.asc("row_idx")]
    return hot.top_k(head, [file_key], order, 1).drop("rank", "below").withColumnRenamed("row_idx", "header_idx")


def document_columns(grid: DataFrame, headers: DataFrame, profile: str = "checklist", file_key: str = "file_id", rows: int | None = None) -> DataFrame:
    """Most document-like column per table; first best column wins. All data rows vote, or the first ``rows``
    (the profile names a usual number)."""
    blocked, _, max_len = lx.COLUMN_PROFILES[profile]
    top = headers.select(file_key, "table_id", "header_idx", F.col("cells").alias("headers"))
    filled = F.exists("cells", lambda c: T.squash(c) != "")
    data = grid.join(top, [file_key, "table_id"]).where((F.col("row_idx") > F.col("header_idx")) & filled)
    if rows:
        data = hot.top_k(data, [file_key, "table_id"], ["row_idx"], rows)
    cells = data.select(file_key, "table_id", "headers", F.posexplode("cells").alias("col_idx", "raw"))
    cells = cells.withColumns({
        "cell": T.squash(F.col("raw")),
        "header": F.lower(T.squash(F.get("headers", F.col("col_idx")))),
    }).where(~T.any_contains(F.col("header"), blocked))
    penalty = F.lit(0)
    if max_len:
        odd = (F.length("cell") > max_len) | F.col("cell").rlike(r"^[\d\W_]+$")
        penalty = F.when(odd, 2).otherwise(0)
    value = F.when(F.col("cell") != "", 2 + F.when(F.col("cell").rlike("[a-zA-Z]"), 3).otherwise(0) - penalty).otherwise(0)
    scored = cells.groupBy(file_key, "table_id", "col_idx").agg(F.sum(value).alias("score"))
    return hot.top_k(scored, [file_key, "table_id"], [F.desc("score"), F.asc("col_idx")], 1).drop("rank")


# ---------------------------------------------------------------- rows
def context(pairs, limit: int = 8) -> Column:
    """``Header: value`` of the non-empty cells, first eight, joined by a bar."""
    parts = F.array(*[F.when(T.squash(c) != "", F.concat(F.lit(f"{h}: "), T.squash(c))) for h, c in pairs])
    return F.array_join(F.slice(F.array_compact(parts), 1, limit), " | ")


def skip_name(c: Column) -> Column:
    text = T.squash(c)
    return F.lower(text).rlike(lx.SKIP_NAME_PATTERN) | (F.length(text) < 3) | text.rlike(r"^[\d\W_]+$")


def typed_rows(rows: DataFrame, key="checklist_id", doc="document_name", status="status", notes="notes", other=("party", "signatories")) -> DataFrame:
    """blank, section_header, subrow or document, plus the document name each row belongs to.

    The first filled non-header row of a list is always a document, so "a document was seen
    before" is a comparison with one aggregated row id per list.
    """
    name = T.squash(F.col(doc))
    lookup = T.lookup_form(F.col(doc))
    n_other = sum((F.when(T.squash(F.col(c)) != "", 1).otherwise(0) for c in other), F.lit(0))
    n_all = n_other + sum((F.when(T.squash(F.col(c)) != "", 1).otherwise(0) for c in (doc, status, notes)), F.lit(0))
    keyworded = T.any_contains(lookup, lx.DOCUMENT_ROW_KEYWORDS)
    section = T.any_contains(lookup, lx.SECTION_ROW_KEYWORDS)
    short = (F.size(T.document_tokens(F.col(doc))) <= 2) & ~keyworded
    capitals = (F.upper(name) == name) & (F.lower(name) != name) & (F.length(name) <= 80)
    header = (n_all <= 2) & (n_other <= 1) & (name.endswith(":") | section | capitals)
    marked = name.rlike(lx.ROW_NUMBER_PREFIX)
    r = computed_once(rows.withColumns({
        "_name": name, "_header": header,
        "_sub": marked | (short & section) | (short & (n_other <= 2)),
    }), "_name", "_header", "_sub")
    first = r.where((F.col("_name") != "") & ~F.col("_header")).groupBy(key).agg(F.min("row_id").alias("_first"))
    r = r.join(first, key, "left")
    kind = (
        F.when(F.col("_name") == "", "blank").when(F.col("_header"), "section_header")
        .when((F.col("row_id") > F.col("_first")) & F.col("_sub"), "subrow").otherwise("document")
    )
    r = computed_once(r.withColumn("row_type", kind), "row_type")
    is_doc = F.col("row_type") == "document"
    r = hot.last_before(r, [key], hot.index_block(F.col("row_id")), ["row_id"], F.when(is_doc, F.col("_name")), "_prev")
    own = F.when(is_doc, F.col("_name")).when(F.col("row_type") == "blank", "").otherwise(F.coalesce("_prev", F.lit("")))
    return r.withColumn("match_document_name", own).drop("_name", "_header", "_sub", "_first", "_prev")


def checklist_items(rows: DataFrame) -> DataFrame:
    """Document rows with their status, notes and row context."""
    items = typed_rows(rows).where("row_type = 'document'")
    return items.select(
        F.col("checklist_id").alias("deal_id"), "row_id", T.squash(F.col("document_name")).alias("document_name"),
        "match_document_name", T.squash(F.col("status")).alias("current_status"), T.squash(F.col("notes")).alias("existing_notes"),
        context([("Party", F.col("party")), ("Signatories", F.col("signatories")), ("Notes", F.col("notes"))]).alias("row_context"),
    )


def deal_anchors(items: DataFrame, names: DataFrame, rows: int | None = None) -> DataFrame:
    """Up to 12 anchor tokens per deal: tokens of the list's name, then up to six tokens shared
    by two or more of its rows (most frequent first); ``rows`` looks at the first so many of a list (250 is usual).
    Returns (deal_id, pos, token)."""
    early = hot.top_k(items, ["deal_id"], ["row_id"], rows) if rows else items
    both = F.concat_ws(" ", "document_name", "row_context")
    counts = (
        early.select("deal_id", F.explode(T.deal_tokens(both)).alias("token"))
        .groupBy("deal_id", "token").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    )
    named = names.select("deal_id", F.posexplode(T.deal_tokens(T.file_stem(F.col("checklist_name")))).alias("pos", "token"))
    shared = hot.top_k(counts.join(named, ["deal_id", "token"], "left_anti"), ["deal_id"], [F.desc("n"), F.asc("token")], 6)
    both = named.select("deal_id", F.lit(0).alias("tier"), "pos", "token").unionAll(
        shared.select("deal_id", F.lit(1), "rank", "token"))
    return hot.top_k(both, ["deal_id"], ["tier", "pos"], 12, "anchor_pos").select("deal_id", "anchor_pos", "token")


def document_names(rows: DataFrame) -> DataFrame:
    """Longest spelling of each document name per list, in order of first appearance."""
    kept = rows.where(~skip_name(F.col("document_name"))).select(
        "checklist_id", "row_id", T.squash(F.col("document_name")).alias("document_name"),
        context([("Status", F.col("status")), ("Party", F.col("party")), ("Signatories", F.col("signatories")),
                 ("Notes", F.col("notes"))]).alias("row_context"))
    best = F.struct(-F.length("document_name"), "row_id")
    return kept.groupBy("checklist_id", F.lower("document_name").alias("doc_key")).agg(
        F.min_by("row_id", best).alias("row_id"), F.min_by("document_name", best).alias("document_name"),
        F.min_by("row_context", best).alias("row_context"), F.min("row_id").alias("first_row_id"))


def prompt_batches(items: DataFrame, key: str, size: int, cap: int | None, fields) -> DataFrame:
    """Rows of a list in chunks of ``size``, each chunk serialised to one JSON array."""
    if cap:
        n = hot.top_k(items, [key], ["row_id"], cap, "pos")
    else:
        n = hot.numbered(items, [key], hot.index_block(F.col("row_id")), ["row_id"], "pos")
    packed = F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("item"))))
    return n.groupBy(key, F.floor((F.col("pos") - 1) / size).alias("batch")).agg(
        F.count(F.lit(1)).alias("items"),
        F.to_json(F.transform(packed, lambda s: s["item"])).alias("payload"))


# ---------------------------------------------------------------- decisions and punch list
def overlay(items: DataFrame, decisions: DataFrame, fields) -> DataFrame:
    """Attach a decision by row id, else by document name; later decisions win per name.

    ``decisions`` is (deal_id, row_id or null, doc_key or blank, seq, fields...).
    """
    pack = F.struct(*fields)
    by_row = decisions.where("row_id IS NOT NULL").groupBy("deal_id", "row_id").agg(F.max_by(pack, "seq").alias("_by_row"))
    by_doc = decisions.where("doc_key <> ''").groupBy("deal_id", "doc_key").agg(F.max_by(pack, "seq").alias("_by_doc"))
    joined = (
        items.withColumn("doc_key", F.lower(T.squash(F.col("document_name"))))
        .join(by_row, ["deal_id", "row_id"], "left").join(by_doc, ["deal_id", "doc_key"], "left")
    )
    return joined.withColumn("decision", F.coalesce("_by_row", "_by_doc")).drop("_by_row", "_by_doc", "doc_key")


def punch_items(rows: DataFrame) -> DataFrame:
    return rows.where(T.squash(F.col("document_name")) != "").select(
        F.col("checklist_id").alias("deal_id"), "row_id", T.squash(F.col("document_name")).alias("document_name"),
        T.squash(F.col("status")).alias("status"), T.squash(F.col("party")).alias("party"), T.squash(F.col("notes")).alias("notes"),
        context([("Signatories", F.col("signatories"))]).alias("row_context"))


def punch_list(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Category per row: the model's when it is a known one, else from status, notes, context."""
    known = [c for c, _, _ in lx.STATUS_CATEGORIES]
    joined = overlay(items, decisions, ["category"])
    given = F.lower(T.strip(F.coalesce(F.col("decision.category"), F.lit(""))))
    fallback = M.status_category(F.concat_ws(" ", "status", "notes", "row_context"))
    return joined.withColumns({
        "assigned_by_model": given.isin(*known),
        "category": F.when(given.isin(*known), given).otherwise(fallback),
    }).drop("decision")


def merged_comment(existing: Column, comment: Column) -> Column:
    """Idempotent merge: keep, replace an earlier generated note, or append after a bar."""
    old, new = T.squash(existing), T.squash(comment)
    generated = F.concat(F.lit(lx.COMMENT_PREFIX + " "), new)
    return (
        F.when(new == "", old).when(old == "", generated).when(F.contains(old, generated), old)
        .when(old.startswith(lx.COMMENT_PREFIX), generated)
        .otherwise(F.concat(old, F.lit(" | "), generated))
    )


def signatory_roles(rows: DataFrame) -> DataFrame:
    """Document to roles; the last row of a document name wins. Returns one row per role."""
    r = rows.where(T.strip(F.coalesce(F.col("document_name"), F.lit(""))) != "").select(
        "checklist_id", T.strip(F.col("document_name")).alias("document_name"), "row_id",
        T.role_names(F.col("signatories")).alias("roles")).where(F.size("roles") > 0)
    last = r.groupBy("checklist_id", "document_name").agg(
        F.max_by("roles", "row_id").alias("roles"), F.min("row_id").alias("first_row_id"))
    return last.select("checklist_id", "document_name", "first_row_id", F.posexplode("roles").alias("pos", "role"))
