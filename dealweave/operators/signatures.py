"""Signature index, packets, verification, annex checks, incumbency signers, signature blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave import lexicon as lx
from dealweave.functions import signing as SG
from dealweave.functions import text as T
from dealweave.operators import hot
from dealweave.operators.substring import containing


def signature_index(pages: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """One row per (page, signer); pages with cues but no signer go to the unassigned bucket. ``tables`` as in ``with_signature_analysis``."""
    p = SG.with_signature_analysis(pages, tables=tables).where("is_signature_page")
    who = F.when(F.size("signers") > 0, F.col("signers")).otherwise(F.array(F.lit(lx.UNASSIGNED)))
    return p.select(
        F.explode(who).alias("signer_name"), "deal_id", "doc_id", "page_num", "method",
        (F.col("needs_review") | (F.size("signers") == 0)).alias("review_required"), "cue_score",
        F.array_join("cue_hits", ",").alias("cues"))


def index_order():
    return ["signer_name", "doc_id", "page_num"]


def verification(index: DataFrame, keys=()) -> DataFrame:
    """Counts that decide whether a set of packets needs a human look, per ``keys`` (such as the deal). Without keys
    it is one row, also for an empty index."""
    un = F.col("signer_name") == lx.UNASSIGNED
    agg = index.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("review_required").alias("review_required_count"),
        F.count_if(un).alias("unassigned_count"), F.countDistinct(F.when(un, F.col("doc_id"))).alias("documents_to_review"))
    bad = (F.col("rows") == 0) | (F.col("review_required_count") > 0) | (F.col("unassigned_count") > 0)
    return agg.withColumn("status", F.when(bad, "review_required").otherwise("passed"))


def packet_checks(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Units a packet should have against units found; both inputs are (deal_id, packet, units)."""
    j = expected.withColumnRenamed("units", "expected_units").join(
        actual.withColumnRenamed("units", "actual_units"), ["deal_id", "packet"], "left")
    return j.withColumn("status", F.when(F.col("actual_units").isNull(), "missing").when(
        F.col("actual_units") == F.col("expected_units"), "verified").otherwise("count_mismatch"))


def packet_shell(pages: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Signature pages with distinct content in their deal (first seen by document and page), one row per signer.

    The first page of each content hash is an aggregate, so a text repeated a billion times is
    reduced before the shuffle."""
    p = SG.with_signature_analysis(pages, tables=tables).where("is_signature_page").withColumn("content_hash", T.page_hash(F.col("page_text")))
    first = p.groupBy("deal_id", "content_hash").agg(F.min_by(F.struct("doc_id", "page_num", "signers"), F.struct("doc_id", "page_num")).alias("p"))
    return first.select("deal_id", "content_hash", "p.*").select("deal_id", "content_hash", "doc_id", "page_num", F.explode("signers").alias("signer_name"))


def first_pages(pages: DataFrame) -> DataFrame:
    """First content occurrence of every page text of a deal."""
    p = pages.withColumn("content_hash", T.page_hash(F.col("page_text")))
    return p.groupBy("deal_id", "content_hash").agg(F.min(F.struct("doc_id", "page_num")).alias("at"), F.count(F.lit(1)).alias("copies")).select(
        "deal_id", "content_hash", "at.*", "copies")


def annex_warnings(pages: DataFrame, threshold: int = lx.LONG_ANNEX_PAGES, tables: DataFrame | None = None) -> DataFrame:
    """Documents with more than ``threshold`` pages after their first page with a named signer,
    and whether an annex word shows on the five pages after it."""
    p = SG.with_signature_analysis(pages, tables=tables)
    named = F.size("signers") > 0
    docs = p.groupBy("deal_id", "doc_id").agg(
        F.max("page_num").alias("total_pages"), F.min(F.when(named, F.col("page_num"))).alias("first_signature_page")
    ).where("first_signature_page IS NOT NULL").withColumn("pages_after", F.col("total_pages") - F.col("first_signature_page")).where(F.col("pages_after") > threshold)
    annex = pages.where(T.any_contains(F.upper("page_text"), lx.ANNEX_KEYWORDS)).select("deal_id", "doc_id", "page_num")
    near = docs.join(annex, ["deal_id", "doc_id"]).where(
        F.col("page_num").between(F.col("first_signature_page") + 1, F.col("first_signature_page") + 5)).select("deal_id", "doc_id").distinct()
    return docs.join(near.withColumn("annex_found", F.lit(True)), ["deal_id", "doc_id"], "left").withColumn(
        "annex_found", F.coalesce("annex_found", F.lit(False)))


# ---------------------------------------------------------------- incumbency
def table_signers(rows: DataFrame) -> DataFrame:
    """Signers of headerless incumbency tables, distinct by (name, title). Input: entity_name,
    row_idx, cells."""
    r = rows.withColumn("s", SG.row_signer(F.col("cells"))).where("s IS NOT NULL AND s.name <> ''")
    return r.groupBy("entity_name", F.upper("s.name").alias("_n"), F.upper("s.title").alias("_t")).agg(
        F.min_by("s", "row_idx").alias("s"), F.min("row_idx").alias("row_idx")).select("entity_name", "row_idx", "s.name", "s.title")


def line_signers(pages: DataFrame) -> DataFrame:
    """``Name:`` line, then ``Title:`` line, within one document's pages.

    The last name before a title line counts, once. Lines live in one array per page; each title
    looks back over the lines since the previous title."""
    lines = F.transform(F.split("page_text", r"\r?\n"), T.strip)
    tagged = F.transform(lines, lambda x: F.struct(
        F.regexp_extract(x, r"(?i)^Name:\s*(.+)", 1).alias("n"), F.regexp_extract(x, r"(?i)^Title:\s*(.+)", 1).alias("t")))
    start = F.struct(F.lit("").alias("n"), F.array().cast("array<struct<name:string,title:string>>").alias("out"))

    def step(acc, x):
        hit = (x["t"] != "") & (acc["n"] != "")
        made = F.struct(acc["n"].alias("name"), x["t"].alias("title"))
        return F.struct(
            F.when(x["n"] != "", T.strip(x["n"])).when(hit, "").otherwise(acc["n"]).alias("n"),
            F.when(hit & SG.is_valid_name(acc["n"]), F.array_append(acc["out"], made)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(tagged, start, step)["out"]
    return pages.select("deal_id", "doc_id", "page_num", F.explode(found).alias("s")).select("deal_id", "doc_id", "page_num", "s.name", "s.title")


def role_signers(mappings: DataFrame, signers: DataFrame, keys=("checklist_id",)) -> DataFrame:
    """Role to chosen signer within each deal (``keys``): ``mappings`` is (keys, entity_name, role, signer_index, seq), ``signers``
    has the 0-based ``pos`` of each signer in its entity. A later mapping of a role in its deal replaces an
    earlier one when its signer exists; the same role of another deal is another role."""
    j = mappings.join(signers, (mappings.entity_name == signers.entity_name) & (mappings.signer_index == signers.pos)).select(
        *keys, mappings.entity_name, "role", "seq", "name", "title")
    return j.groupBy(*keys, "role").agg(F.max_by(F.struct("entity_name", "name", "title"), "seq").alias("m")).select(*keys, "role", "m.*")


def signature_pages(roles: DataFrame, signers: DataFrame) -> DataFrame:
    """Signature-page text per document: its roles in order with the signers of its checklist, placeholders for unknown roles."""
    j = roles.join(signers, ["checklist_id", "role"], "left")
    block = SG.signature_block(F.coalesce("entity_name", F.concat(F.lit("["), F.col("role"), F.lit("]"))), F.col("role"), F.col("name"), F.col("title"))
    packed = F.array_sort(F.collect_list(F.struct("pos", block.alias("b"))))  # roles of one document row
    head = F.concat(F.lit("SIGNATURE PAGE TO "), F.upper("document_name"), F.lit("\n\n[Signature Page Follows]\n\n\n"))
    return j.groupBy("checklist_id", "document_name").agg(packed.alias("p")).select(
        "checklist_id", "document_name", F.size("p").alias("blocks"),
        F.concat(head, F.array_join(F.transform("p", lambda x: F.concat(x["b"], F.lit("\n\n"))), "\n")).alias("page_text"))


def match_files(files: DataFrame, names: DataFrame, keys=("checklist_id",)) -> DataFrame:
    """Files of a deal to the names of its checklist by containment either way, or with spaces removed; the first
    checklist entry wins. ``files`` is (keys, file_id, stem), ``names`` (keys, checklist order ``seq``, name). Keys are not null."""
    keys = list(keys)
    f = files.withColumn("f", F.lower("stem")).withColumn("fs", F.replace("f", F.lit(" "), F.lit("")))
    n = names.withColumn("n", F.lower("name")).withColumn("ns", F.replace("n", F.lit(" "), F.lit("")))
    stems, firsts = f.select(*keys, "f", "fs").distinct(), n.groupBy(*keys, "n", "ns").agg(F.min("seq").alias("seq"))
    within = containing(stems.select("f"), firsts.select("n")).toDF("f", "n")
    around = containing(firsts.select("n"), stems.select("f")).toDF("n", "f").select("f", "n")
    tight = containing(stems.select("fs"), firsts.select("ns")).toDF("fs", "ns")
    tight = tight.join(stems.select("f", "fs").distinct(), "fs").join(firsts.select("n", "ns").distinct(), "ns").select("f", "n")
    texts = within.unionAll(around).unionAll(tight).distinct()
    best = stems.join(texts, "f").join(firsts, [*keys, "n"]).groupBy(*keys, "f").agg(F.min("seq").alias("seq"))
    out = f.join(best, [*keys, "f"], "left").join(names.select(*keys, "seq", "name"), [*keys, "seq"], "left")
    return out.select(*keys, "file_id", "stem", F.col("name").alias("matched_name"), F.when(F.col("name").isNull(), "copied").otherwise("processed").alias("status"))
