"""Signature-page expressions: signer names, entity fallbacks, cues. Lines are analysed once into
an array of structs; the detectors are array functions over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave import lexicon as lx
from dealweave.functions import text as T
from dealweave.session import computed_once, once_per_content

EMPTY = "array<string>"
RESULT = ("signers", "method", "cue_score", "cue_hits", "needs_review", "is_signature_page")


def upper_name(c: Column) -> Column:
    return T.squash(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[.,]", ""))


def signer_candidate(c: Column) -> Column:
    """Text of a signature line reduced to an upper-case name, blank when only a label is left."""
    t = T.strip(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, r"(?i)^/s/\s*", "")
    t = F.regexp_replace(t, r"(?i)^(?:by|name|printed\s+name|print\s+name|signatory|signer|title)\s*:?", "")
    t = F.regexp_replace(t, r"\[[^\]]*\]|_{2,}|\.{2,}", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ :;/,\-]+|[ :;/,\-]+$", "")
    return F.when(F.upper(t).isin(*lx.IGNORED_SIGNERS), "").otherwise(upper_name(t))


def n_words(c: Column) -> Column:
    return F.when(T.squash(c) == "", 0).otherwise(F.size(F.split(T.squash(c), " ")))


def is_person(c: Column) -> Column:
    return (
        F.coalesce(c, F.lit("")).rlike("[A-Za-z]{2,}") & ~T.any_contains(F.upper(c), lx.ENTITY_TERMS)
        & n_words(c).between(1, 5)
    )


def is_entity(c: Column) -> Column:
    """Entity-style signatory: an entity term, or at least two words in capitals."""
    t = T.squash(c)
    return (
        (t != "") & ~F.upper(t).isin(*lx.IGNORED_SIGNERS) & (n_words(t) <= 10)
        & (T.any_contains(F.upper(t), lx.ENTITY_TERMS) | ((F.upper(t) == t) & t.rlike(r"[A-Z]\S*\s+(?:\S+\s+)*?\S*[A-Z]")))
    )


def cue_hits(text: Column) -> Column:
    up = F.upper(F.coalesce(text, F.lit("")))
    tests = (
        ("BY", up.rlike(r"\bBY\s*:")), ("NAME_LABEL", up.rlike(lx.NAME_LABEL)), ("TITLE_LABEL", up.rlike(r"\bTITLE\s*:")),
        ("DATE_LABEL", up.rlike(r"\bDATE\s*:")), ("UNDERSCORE", up.rlike("_{6,}")),
        ("TRIGGER_PHRASE", T.any_contains(up, lx.TRIGGER_PHRASES)),
    )
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))


def cue_score(hits: Column) -> Column:
    return reduce(lambda a, w: a + F.when(F.array_contains(hits, w[0]), w[1]).otherwise(0), lx.CUE_WEIGHTS, F.lit(0))


def page_tables(cells: DataFrame, keys=("deal_id", "doc_id", "page_num")) -> DataFrame:
    """Per page ``has_signature_table`` and ``table_signers`` from table rows (keys, table_no, row_no, cells); row 0 heads a table.

    Rows meet their header by a join, so no table is gathered into one row: a table of any length yields one distinct name after another, and only
    the distinct names of a page come together, as they do in its text."""
    keys = list(keys)
    on = [*keys, "table_no"]
    heads = cells.where("row_no = 0").select(*on, header_index(F.col("cells"), lx.SIGN_NAME_HEADERS).alias("_at"), F.coalesce(is_signature_table(F.col("cells")), F.lit(False)).alias("_is"))
    heads = heads.where("_is").drop("_is")
    name = signer_candidate(T.squash(F.coalesce(F.get("cells", F.col("_at")), F.lit(""))))
    below = cells.where("row_no > 0").join(heads, on).select(*keys, name.alias("_n")).where((F.col("_n") != "") & (is_person(F.col("_n")) | is_entity(F.col("_n")))).distinct()
    signers = below.groupBy(*keys).agg(F.array_sort(F.collect_list("_n")).alias("table_signers"))
    marked = heads.select(*keys).distinct().withColumn("has_signature_table", F.lit(True))
    return marked.join(signers, keys, "left")


def _first(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


def with_signature_analysis(pages: DataFrame, text: str = "page_text", tables: DataFrame | None = None) -> DataFrame:
    """Add signers (sorted), method, cue_score, cue_hits, needs_review, is_signature_page.

    ``tables`` has the table rows of the pages (deal_id, doc_id, page_num, table_no, row_no, cells): names in signature tables count as persons, and
    such a table is a cue of its own. Without it only the text counts."""
    keys = ["deal_id", "doc_id", "page_num"]
    if tables is not None:
        pages = pages.join(page_tables(tables, keys), keys, "left")
    else:
        pages = pages.withColumns({"has_signature_table": F.lit(None).cast("boolean"), "table_signers": F.lit(None).cast(EMPTY)})
    return once_per_content(pages, [text, "has_signature_table", "table_signers"], lambda p: _analysed(p, text)).drop("has_signature_table", "table_signers")


def _analysed(pages: DataFrame, text: str) -> DataFrame:
    label = lx.NAME_LABEL + r"\s*(.+)"
    body = F.coalesce(F.col(text), F.lit(""))
    # Prose pages stop here: without a label, a BY block, a rule or a trigger phrase no detector fires.
    cue = F.upper(body).rlike(r"\bBY\s*:|\b(?:NAME|SIGNATORY|SIGNER|TITLE|DATE)\s*:|_{6,}|" + "|".join(lx.TRIGGER_PHRASES))
    lines = F.transform(F.split(body, r"\r\n|\n|\r"), lambda x: F.struct(
        T.strip(x).alias("l"), F.regexp_extract(x, r"(?i)\bBY\s*:\s*(.+)$", 1).alias("inline"),
        F.regexp_extract(x, label, 1).alias("lab"), x.rlike(r"(?i)\bBY\s*:").alias("by"), x.rlike(r"(?i)\bTITLE\s*:").alias("title")))
    p = pages.withColumn("_raw", F.when(cue, lines).otherwise(F.slice(lines, 1, 0)))
    has_by = F.exists("_raw", lambda x: x["by"])
    blank = F.lit("")
    p = p.withColumn("_raw", F.transform("_raw", lambda x: F.struct(
        *[x[k].alias(k) for k in ("l", "by", "title")], (x["lab"] != "").alias("haslab"),
        F.when(has_by, signer_candidate(x["l"])).otherwise(blank).alias("c"),
        F.when(x["inline"] != "", signer_candidate(x["inline"])).otherwise(blank).alias("ic"),
        F.when(x["lab"] != "", signer_candidate(x["lab"])).otherwise(blank).alias("lc"))))

    def judged(x):
        def test(fn, c):
            return F.when(c != "", fn(c)).otherwise(False)

        return F.struct(
            *[x[k].alias(k) for k in ("l", "by", "title", "haslab", "c", "ic", "lc")],
            test(is_person, x["c"]).alias("cp"), test(is_entity, x["c"]).alias("ce"), n_words(x["c"]).alias("cw"),
            test(is_person, x["ic"]).alias("ip"), test(is_person, x["lc"]).alias("lp"), test(is_entity, x["lc"]).alias("le"))

    p = computed_once(p.withColumn("_raw", F.transform("_raw", judged)), "_raw")
    p = p.withColumn("_lines", F.filter("_raw", lambda x: x["l"] != ""))

    def by_block(x, i):
        nxt = F.slice("_lines", i + 2, F.lit(6))
        lab = _first(F.filter(nxt, lambda y: y["haslab"]))
        # the loose search only applies when six more lines exist
        near = F.when(F.size(nxt) == 6, _first(F.filter(nxt, lambda y: y["cp"]))["c"])
        return F.when(x["by"], F.when(x["ip"], x["ic"]).when(lab.isNotNull(), F.when(lab["lp"], lab["lc"])).otherwise(near))

    def above(x, i):
        prior = F.reverse(F.slice("_lines", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))))
        hit = _first(F.filter(prior, lambda y: (y["c"] != "") & ~y["c"].isin("AND", "ITS", "BY") & (y["ce"] | (y["cw"] > 6))))
        return F.when(x["by"] & hit["ce"], hit["c"])

    def near_trigger(phrase):
        at = F.array_position(F.transform("_raw", lambda x: F.contains(F.upper(x["l"]), F.lit(phrase))), True)
        ok = F.filter(F.slice("_raw", (at + 1).cast("int"), F.lit(14)), lambda x: x["tp"])
        return F.when(at > 0, F.transform(ok, lambda x: x["tc"])).otherwise(F.array().cast(EMPTY))

    def trigger_line(x):
        ok = (F.length(x["l"]) >= 3) & ~x["l"].rlike(r"^[_\-\s]+$") & ~T.any_contains(F.upper(x["l"]), lx.TRIGGER_LINE_SKIP) & n_words(x["l"]).between(1, 5)
        name = F.when(triggered & ok, signer_candidate(F.regexp_replace(T.squash(x["l"]), "[_:]+$", ""))).otherwise(blank)
        return F.struct(
            *[x[k].alias(k) for k in ("l", "lp", "title")], name.alias("tc"),
            x["l"].rlike(r"(?i)\bNAME\s*:\s*.+").alias("nm"))

    triggered = T.any_contains(F.upper(F.col(text)), lx.TRIGGER_PHRASES)
    p = p.withColumn("_raw", F.transform("_raw", trigger_line))
    p = p.withColumn("_raw", F.transform("_raw", lambda x: x.withField("tp", F.when(x["tc"] != "", is_person(x["tc"])).otherwise(False))))
    empty = F.array().cast(EMPTY)
    p = p.withColumns({
        "_by": F.array_compact(F.transform("_lines", by_block)),
        "_lab": F.transform(F.filter("_lines", lambda x: x["lp"]), lambda x: x["lc"]),
        "_ent": F.transform(F.filter("_lines", lambda x: ~x["lp"] & x["le"]), lambda x: x["lc"]),
        "_nt": F.exists(F.transform("_raw", lambda x, i: x["nm"] & x["lp"] & F.exists(F.slice("_raw", i + 2, F.lit(3)), lambda y: y["title"])), lambda b: b),
        "_trig": F.when(triggered, F.flatten(F.array(*[near_trigger(w) for w in lx.TRIGGER_PHRASES]))).otherwise(empty),
        "cue_hits": F.concat(cue_hits(F.col(text)), F.when(F.col("has_signature_table"), F.array(F.lit("SIGNATURE_TABLE"))).otherwise(empty)),
        "_tab": F.coalesce("table_signers", empty),
    })
    p = p.withColumn("_persons", F.array_union(F.array_union(F.array_union("_by", "_lab"), "_trig"), "_tab"))
    none = F.size("_persons") == 0
    p = p.withColumn("_ents", F.when(none, F.array_union("_ent", F.array_compact(F.transform("_lines", above)))).otherwise(F.col("_ent")))
    p = p.withColumns({
        "signers": F.array_sort(F.when(none, F.array_distinct("_ents")).otherwise(F.array_distinct("_persons"))),
        "cue_score": cue_score(F.col("cue_hits")),
    })
    found = F.size("signers") > 0
    cued = ~found & (F.col("cue_score") >= lx.CUE_PAGE_SCORE)
    method = F.concat_ws(
        ",", F.when(F.size("_by") > 0, "BY_BLOCK"), F.when(F.size("_lab") > 0, "LABEL"), F.when(F.size("_ent") > 0, "LABEL_ENTITY"),
        F.when(F.col("_nt"), "NAME_TITLE"), F.when(F.size("_trig") > 0, "TRIGGER"), F.when(F.size("_tab") > 0, "TABLE"),
        F.when(none & (F.size("_ents") > 0), "ENTITY_FALLBACK"), F.when(cued, "SIGNATURE_CUE_REVIEW"))
    p = p.withColumns({
        "method": method, "is_signature_page": found | cued, "needs_review": (found & none) | cued,
    }).drop("_raw", "_lines", "_by", "_lab", "_ent", "_nt", "_trig", "_tab", "_persons", "_ents", "has_signature_table", "table_signers")
    return computed_once(p, *RESULT)


# ---------------------------------------------------------------- tables of signers
def header_index(headers: Column, words) -> Column:
    """0-based index of the first header containing any word, -1 when none."""
    up = F.transform(headers, lambda h: F.upper(T.strip(F.coalesce(h, F.lit("")))))
    return (F.array_position(F.transform(up, lambda h: T.any_contains(h, words)), True) - 1).cast("int")


def is_signature_table(headers: Column) -> Column:
    return (header_index(headers, lx.SIGN_NAME_HEADERS) >= 0) & (header_index(headers, lx.SIGN_HEADERS) >= 0)


def is_incumbency_table(headers: Column) -> Column:
    return (header_index(headers, lx.INCUMBENCY_NAME_HEADERS) >= 0) & (header_index(headers, lx.INCUMBENCY_TITLE_HEADERS) >= 0)


def is_valid_name(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    return (F.length(t) >= 3) & n_words(t).between(2, 5) & ~T.any_contains(F.upper(t), lx.INCUMBENCY_ENTITY_TERMS) & t.rlike("^[A-Z]")


def looks_like_title(c: Column) -> Column:
    t = F.upper(T.squash(c))
    return (F.length(t) >= 2) & T.any_contains(t, lx.OFFICER_TITLES)


def name_and_title(c: Column) -> Column:
    """struct(name, title) of a combined cell such as ``Rosa Lind - President``; null otherwise."""
    t = T.squash(c)
    name, title = F.regexp_extract(t, lx.NAME_AND_TITLE, 1), T.strip(F.regexp_extract(t, lx.NAME_AND_TITLE, 2))
    return F.when(is_valid_name(name) & looks_like_title(title), F.struct(T.strip(name).alias("name"), title.alias("title")))


def row_signer(cells: Column) -> Column:
    """struct(name, title) of one headerless table row: a combined cell first, else a name cell
    with a title next to it (right first, then left)."""
    cells = F.transform(cells, T.squash)
    combined = _first(F.array_compact(F.transform(cells, name_and_title)))
    at = F.array_position(F.transform(cells, is_valid_name), True).cast("int")
    right, left = F.get(cells, at), F.get(cells, at - 2)
    title = F.when(F.coalesce(looks_like_title(right), F.lit(False)), right).when(
        (at > 1) & F.coalesce(looks_like_title(left), F.lit(False)), left).otherwise("")
    alone = F.when(at > 0, F.struct(F.get(cells, at - 1).alias("name"), title.alias("title")))
    return F.coalesce(combined, alone)


def entity_from_certificate(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    a, b = (T.strip(F.regexp_extract(t, p, 1)) for p in lx.ENTITY_PATTERNS[:2])
    d = F.regexp_replace(T.strip(F.regexp_extract(t, lx.ENTITY_PATTERNS[2], 1)), r"(?i)\s+I\s+hereby.*$", "")
    return F.coalesce(T.null_if_blank(a), T.null_if_blank(b), F.when(F.length(d) > 3, d))


def document_id(c: Column) -> Column:
    """Id in a bottom-left footer text: labelled id, plain code, else the short text itself."""
    t = T.strip(F.coalesce(c, F.lit("")))
    labelled = F.regexp_extract(t, lx.DOC_ID_PREFIXED, 1)
    return (
        F.when(labelled != "", labelled).when(t.rlike(lx.DOC_ID_CODE) & ~t.rlike(r"^\d{1,3}$"), t)
        .when((t != "") & (F.length(t) <= 30) & ~t.rlike(r"(?i)^Page\s"), t).otherwise("N/A")
    )


def footer_choice(lines: Column) -> Column:
    """A signature-page line first, else the first line longer than three characters that is no page number."""
    marked = F.filter(lines, lambda x: F.contains(F.upper(x), F.lit("SIGNATURE PAGE")))
    plain = F.filter(lines, lambda x: (F.length(x) > 3) & ~x.rlike(r"^[\d\s\-\.]+$"))
    return T.strip(F.coalesce(_first(marked), _first(plain), F.lit("N/A")))


def signature_block(entity: Column, role: Column, name: Column, title: Column) -> Column:
    rule = F.lit("________________________")
    return F.concat_ws(
        "\n", F.concat(F.upper(entity), F.lit(",")), F.concat(F.lit("as "), role), F.lit(""), F.lit(""),
        F.concat(F.lit("By: "), rule), F.concat(F.lit("Name: "), F.coalesce(name, rule)), F.concat(F.lit("Title: "), F.coalesce(title, rule)))
