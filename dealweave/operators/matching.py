"""Checklist rows against mails and threads through a word index instead of a nested loop.

A row can only score against a mail that shows one of the row's words (as a substring of one of
its own words), whose title contains the row's name, or whose title is contained in it. These
candidates come from equi-joins on words (see :mod:`substring` for the exact word-in-word step).
Rows with the same text are scored once (a *profile*). What scores without any shared word (file
names made of noise words only, deal anchors) is the same for every row of a deal, so the deal's
best few of those are enough to complete each top-k exactly.

Mails are scored once per *class*: mails of a deal in which the same words of its rows stand in the same fields score alike with
every row, so are threads made of the same classes. Pairs of rows and mails are only formed where they are the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave import lexicon as lx
from dealweave.functions import mail as M
from dealweave.functions import text as T
from dealweave.operators import hot, threads
from dealweave.operators.substring import containing
from dealweave.session import computed_once, cut_lineage

TOP_MAILS, TOP_THREADS, EVENTS, CONFIDENT = 8, 3, 4, 8.5  # fixed values
ROW_MAIL_SCORE, THREAD_MAIL_SCORE, ROW_THREAD_SCORE = 1.2, 0.9, 2.0  # fixed values


def has(text, part) -> Column:
    return F.contains(text, part)


def longest_word(c: Column) -> Column:
    words = F.split(c, " ")
    return F.element_at(F.array_sort(words, lambda a, b: F.length(b) - F.length(a)), 1)


# ---------------------------------------------------------------- both sides, prepared once
def mail_features(mail: DataFrame) -> DataFrame:
    """Lookup forms of everything the score reads. Input: thread members with ``deal_id``.

    The result feeds the word index, the pair scores and the thread sums, so it is written once
    instead of being derived again from the mail text in each of them.
    """
    m = mail.select(
        "deal_id", "email_idx", "thread_key", "sort_ts", "has_attachments", "searchable", "subject", "clean_subject",
        "priority", "direction", "issues", "event_text",
        F.transform(T.split_attachments(F.col("attachments")),
                    lambda t: F.struct(t.alias("t"), T.lookup_form(t).alias("lk"))).alias("titles"),
        T.search_form(F.col("subject")).alias("n_subject"),
        T.search_form(T.first_filled(F.col("body_current"), F.col("body"))).alias("n_body"),
        T.search_form(F.col("searchable")).alias("n_all"),
        T.search_form(F.concat_ws(" ", "sender", "recipients", "cc")).alias("n_people"),
    )
    return cut_lineage(m.withColumns({
        "n_titles": F.array_join(F.transform("titles", lambda x: x["lk"]), " "),
        "noise_titles": F.size(F.filter("titles", lambda x: x["lk"] == "")),
    }))


def profile_id() -> Column:
    """128-bit digest: profiles are joined by it, so two texts must never share one."""
    return F.md5(F.concat_ws("\u0001", "match_document_name", "row_context"))


def row_profiles(items: DataFrame) -> DataFrame:
    """Distinct (deal, matched name, context) with tokens; ``pid`` is a content hash, ``qid`` one of the tokens alone."""
    profiles = items.select("deal_id", "match_document_name", "row_context").distinct().select(
        "deal_id", "match_document_name", "row_context",
        profile_id().alias("pid"),
        T.lookup_form(F.col("match_document_name")).alias("doc_lookup"),
        T.document_tokens(F.col("match_document_name")).alias("doc_tokens"),
        F.slice(T.search_tokens(F.col("row_context")), 1, 8).alias("context_tokens"),
    )
    shape = F.concat_ws("\u0001", "doc_lookup", F.array_join("doc_tokens", " "), F.array_join("context_tokens", " "))
    return cut_lineage(profiles.withColumn("qid", F.md5(shape)))


# ---------------------------------------------------------------- equal mails once
@dataclass(frozen=True)
class Sides:
    """Both sides of the match, each with what scores alike as one row.

    ``shapes`` are profiles with ``qid`` as ``pid``; ``classes`` have the columns of the features that the score reads, the class in
    the place of ``email_idx``, its size ``n`` and its first mail; ``members`` are the mails with their class ``cid``;
    ``relevant`` are the words (deal_id, haystack) that contain a word of the deal's rows."""

    profiles: DataFrame
    shapes: DataFrame
    classes: DataFrame
    members: DataFrame
    relevant: DataFrame


def _words(rows: DataFrame, key, *texts) -> DataFrame:
    return rows.select(*key, F.explode(F.array_distinct(F.split(F.concat_ws(" ", *texts), " "))).alias("haystack"))


def _with_kept(rows: DataFrame, key, relevant: DataFrame, *texts) -> DataFrame:
    """Adds the relevant words of each row as ``_kept``."""
    kept = _words(rows, key, *texts).join(relevant, ["deal_id", "haystack"]).groupBy(*key).agg(F.collect_list("haystack").alias("_kept"))
    return rows.join(kept, list(key), "left").withColumn("_kept", F.coalesce("_kept", F.array().cast("array<string>")))


def canonical(text: str) -> Column:
    """Runs of the words in ``_kept``, each once, sorted. What consists of words of the rows occurs in the runs exactly where it
    occurs in the text: every word of the text that covers a part of it is kept, and its neighbours stay neighbours."""
    words = F.transform(F.split(text, " "), lambda w: F.when(F.array_contains("_kept", w), w).otherwise("_"))
    runs = F.filter(F.split(F.array_join(words, " "), " ?_[_ ]*"), lambda r: r != "")
    return F.array_join(F.array_sort(F.array_distinct(runs)), " _ ")


def equal_once(profiles: DataFrame, features: DataFrame) -> Sides:
    shapes = cut_lineage(profiles.select("deal_id", F.col("qid").alias("pid"), "doc_lookup", "doc_tokens", "context_tokens").distinct())
    words = F.concat("doc_tokens", "context_tokens", F.split("doc_lookup", " "))
    needs = shapes.select("deal_id", F.explode(words).alias("needle")).where("needle <> ''").distinct()
    texts = ("n_subject", "n_body", "n_all", "n_people")
    key = ("deal_id", "email_idx")
    f = features.select(*key, "thread_key", "sort_ts", "has_attachments", "noise_titles", *texts, T.search_form(F.col("clean_subject")).alias("_clean"),
                        F.transform("titles", lambda x: x["lk"]).alias("lookups"))
    seen = _words(f, ("deal_id",), *texts, "_clean").distinct()
    relevant = cut_lineage(needs.join(containing(needs.select("needle"), seen.select("haystack")), "needle").join(
        seen, ["deal_id", "haystack"]).select("deal_id", "haystack").distinct())
    f = _with_kept(f, key, relevant, *texts).select(*key, "thread_key", "sort_ts", "has_attachments", "noise_titles", "lookups", *[
        canonical(c).alias(c) for c in texts])
    # no field holds a bar, a title can't hold a line break after the lookup form
    content = F.concat_ws("|", *texts, F.array_join("lookups", "\n"), F.size("lookups").cast("string"), F.col("has_attachments").cast("string"))
    members = cut_lineage(f.withColumn("cid", F.md5(content)))
    classes = members.groupBy("deal_id", F.col("cid").alias("email_idx")).agg(
        F.count(F.lit(1)).alias("n"), F.min("email_idx").alias("first_mail"),
        *[F.any_value(c).alias(c) for c in ("has_attachments", "noise_titles", "lookups", *texts)])
    classes = cut_lineage(classes.select(
        "*", F.transform("lookups", lambda x: F.struct(x.alias("t"), x.alias("lk"))).alias("titles"), F.array_join("lookups", " ").alias("n_titles")))
    return Sides(profiles.select("deal_id", "pid", "qid", "match_document_name", "row_context"), shapes, classes,
                 members.select(*key, "thread_key", "sort_ts", "has_attachments", "noise_titles", "cid"), relevant)


def of_profiles(per_shape: DataFrame, sides: Sides, *more: str) -> DataFrame:
    """Back from shapes to profiles."""
    return per_shape.withColumnRenamed("pid", "qid").join(sides.profiles.select("deal_id", "pid", "qid", *more), ["deal_id", "qid"])


# ---------------------------------------------------------------- candidates
def word_candidates(profiles: DataFrame, features: DataFrame) -> DataFrame:
    """(deal_id, pid, email_idx) pairs that share a word or contain one another's title."""
    needs = profiles.select("deal_id", "pid", F.explode(F.array_distinct(F.filter(
        F.concat("doc_tokens", "context_tokens", F.array(longest_word(F.col("doc_lookup")))),
        lambda w: w != ""))).alias("needle"))
    shown = features.select("deal_id", "email_idx", F.explode(F.array_distinct(F.split("n_all", " "))).alias("haystack"))
    pairs = containing(needs.select("needle"), shown.select("haystack"))
    forward = needs.join(pairs, "needle").join(shown, ["deal_id", "haystack"]).select("deal_id", "pid", "email_idx")

    named = profiles.select("deal_id", "pid", F.explode(F.split("doc_lookup", " ")).alias("haystack"))
    titled = features.select("deal_id", "email_idx", F.explode("titles").alias("t")).where("t.lk <> ''").select(
        "deal_id", "email_idx", longest_word(F.col("t.lk")).alias("needle"))
    pairs = containing(titled.select("needle"), named.select("haystack"))
    backward = titled.join(pairs, "needle").join(named, ["deal_id", "haystack"]).select("deal_id", "pid", "email_idx")
    return forward.unionAll(backward).distinct()


def noise_only_score() -> Column:
    """Score of a mail whose file names are all noise, for any row with a name."""
    n = F.least(F.col("noise_titles"), F.lit(4))
    return F.when(F.col("noise_titles") > 0,
                  F.lit(10.5) + F.when(F.col("has_attachments"), 0.2).otherwise(0.0) + F.least(F.lit(0.8), n * 0.25))


# ---------------------------------------------------------------- scores
def title_scores() -> Column:
    """Score of every title of a mail against the row, as array of struct(s, t)."""
    dl, toks = F.col("doc_lookup"), F.col("doc_tokens")

    def one(title: Column) -> Column:
        tl = title["lk"]
        hits = F.size(F.filter(toks, lambda k: has(tl, k)))
        whole = F.when((dl != "") & (has(tl, dl) | has(dl, tl)), 10.5).otherwise(0.0)
        best = F.greatest(whole, F.least(F.lit(8.8), hits * 2.2))
        return F.struct((best + F.when(hits >= 2, 0.9).otherwise(0.0)).alias("s"), title["t"].alias("t"))

    return F.transform("titles", one)


def _sum(arr: Column, value) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, k: a + value(k))


def _count(arr: Column, test) -> Column:
    return F.size(F.filter(arr, test))


def scored_pairs(candidates: DataFrame, profiles: DataFrame, features: DataFrame) -> DataFrame:
    """Score of each candidate (profile or shape, mail or class), plus what the thread score needs."""
    cols = ["deal_id", "email_idx", "titles", "n_subject", "n_body", "n_all", "n_people", "n_titles", "has_attachments"]
    p = (
        candidates.join(profiles.select("deal_id", "pid", "doc_lookup", "doc_tokens", "context_tokens"), ["deal_id", "pid"])
        .join(features.select(*cols), ["deal_id", "email_idx"])
        .withColumn("_t", F.filter(title_scores(), lambda x: x["s"] > 0))
    )
    subj, body, every, people, names = (F.col(c) for c in ("n_subject", "n_body", "n_all", "n_people", "n_titles"))
    dl, toks, ctx = F.col("doc_lookup"), F.col("doc_tokens"), F.col("context_tokens")
    p = p.withColumn("title_score", F.round(F.coalesce(F.array_max(F.transform("_t", lambda x: x["s"])), F.lit(0.0)), 4))
    lead = (
        F.when(F.col("title_score") > 0, F.col("title_score"))
        .when((dl != "") & has(subj, dl), 6.5)
        .when((dl != "") & (has(body, dl) | has(every, dl)), 3.2).otherwise(0.0)
    )
    doc = _sum(toks, lambda k: F.when(has(names, k), 2.4).when(has(subj, k), 1.8).when(has(body, k), 1.0)
               .when(has(every, k), 0.9).otherwise(0.0))
    doc_hits = _count(toks, lambda k: has(names, k) | has(subj, k) | has(body, k) | has(every, k))
    con = _sum(ctx, lambda k: F.when(has(subj, k) | has(names, k), 0.9).when(has(people, k), 0.6)
               .when(has(body, k) | has(every, k), 0.35).otherwise(0.0))
    con_hits = _count(ctx, lambda k: has(subj, k) | has(names, k) | has(people, k) | has(body, k) | has(every, k))
    score = (
        lead + doc + F.when(doc_hits >= 2, 1.6).otherwise(0.0) + con + F.when(con_hits >= 2, 0.7).otherwise(0.0)
        + F.when(F.col("has_attachments"), 0.2).otherwise(0.0)
        + F.least(F.lit(0.8), F.least(F.size("_t"), F.lit(4)) * 0.25)
    )
    first8 = F.slice(toks, 1, 8)

    def mask(text):
        """Bit i set when the i-th of the first eight tokens occurs in ``text``."""
        bits = F.transform(first8, lambda k, i: F.when(has(text, k), F.pow(F.lit(2), i).cast("int")).otherwise(0))
        return F.aggregate(bits, F.lit(0), lambda a, b: a + b)

    out = p.select(
        "deal_id", "pid", "email_idx", F.round(score, 4).alias("score"), "title_score",
        mask(names).alias("title_bits"), mask(every).alias("text_bits"),
        ((dl != "") & (has(names, dl) | has(every, dl))).alias("name_hit"),
    )
    return computed_once(out, "score", "title_score", "title_bits", "text_bits", "name_hit")


def class_pairs(sides: Sides) -> DataFrame:
    """Scored (shape, class) pairs of at least ``THREAD_MAIL_SCORE``: those with a shared word, and every named shape with every class
    that has a file name of noise words."""
    noisy = sides.classes.where("noise_titles > 0").select("deal_id", "email_idx")
    extra = sides.shapes.where("doc_lookup <> ''").select("deal_id", "pid").join(noisy, "deal_id")
    both = word_candidates(sides.shapes, sides.classes).unionByName(extra).distinct()
    return cut_lineage(scored_pairs(both, sides.shapes, sides.classes).where(F.col("score") >= THREAD_MAIL_SCORE))


def mail_scores(sides: Sides) -> DataFrame:
    """Every profile and mail that score ``THREAD_MAIL_SCORE`` together."""
    pairs = class_pairs(sides).select("deal_id", "pid", F.col("email_idx").alias("cid"), "score", "title_score")
    per = of_profiles(pairs, sides, "match_document_name", "row_context").drop("qid")
    return per.join(sides.members.select("deal_id", "cid", "email_idx"), ["deal_id", "cid"]).drop("cid")


def candidate_counts(profiles: DataFrame, features: DataFrame) -> DataFrame:
    """(deal_id, pid, for_row, for_thread, best): how many mails of the deal score at least the row and the thread
    threshold, and the best score.

    A mail whose file names are all noise scores with every named row, whatever its words. Such mails are counted once
    per deal; from that a row takes off those it already meets through a word."""
    noisy = F.col("noise_titles") > 0
    sides = equal_once(profiles, features)
    met = scored_pairs(word_candidates(sides.shapes, sides.classes), sides.shapes, sides.classes).join(
        sides.classes.select("deal_id", "email_idx", "n", "noise_titles"), ["deal_id", "email_idx"])

    def mails(test: Column) -> Column:
        return F.sum(F.when(test, F.col("n")).otherwise(0))

    by_word = met.groupBy("deal_id", "pid").agg(
        mails(F.col("score") >= ROW_MAIL_SCORE).alias("wr"), mails(F.col("score") >= THREAD_MAIL_SCORE).alias("wt"),
        F.max("score").alias("wb"), mails(noisy).alias("met_noise"))
    noise = features.where(noisy).groupBy("deal_id").agg(F.count(F.lit(1)).alias("noise"), F.max(F.round(noise_only_score(), 4)).alias("nb"))
    j = sides.shapes.select("deal_id", "pid", "doc_lookup").join(by_word, ["deal_id", "pid"], "left").join(noise, "deal_id", "left")
    zero = F.lit(0)
    more = F.when(F.col("doc_lookup") != "", F.coalesce("noise", zero) - F.coalesce("met_noise", zero)).otherwise(zero)
    out = j.select("deal_id", "pid", (F.coalesce("wr", zero) + more).alias("for_row"), (F.coalesce("wt", zero) + more).alias("for_thread"),
                   F.greatest(F.when(F.col("wt") > 0, F.col("wb")), F.when(F.col("doc_lookup") != "", F.col("nb"))).alias("best"))
    return of_profiles(out.where("for_thread > 0"), sides).drop("qid")


def top_mails(sides: Sides) -> DataFrame:
    """The best mails of each profile. They stand in the best classes, by score and first mail, and among the first mails of each."""
    filler = hot.top_k(
        sides.classes.where("noise_titles > 0").withColumn("_s", noise_only_score()),
        ["deal_id"], [F.desc("_s"), F.asc("first_mail")], TOP_MAILS)
    extra = filler.select("deal_id", "email_idx").join(sides.shapes.select("deal_id", "pid"), "deal_id")
    both = word_candidates(sides.shapes, sides.classes).unionByName(extra).distinct()
    pairs = scored_pairs(both, sides.shapes, sides.classes).where(F.col("score") >= ROW_MAIL_SCORE).join(
        sides.classes.select("deal_id", "email_idx", "first_mail"), ["deal_id", "email_idx"])
    best = hot.top_k(pairs, ["deal_id", "pid"], [F.desc("score"), F.asc("first_mail")], TOP_MAILS).select(
        "deal_id", "pid", F.col("email_idx").alias("cid"), "score")
    heads = hot.top_k(sides.members, ["deal_id", "cid"], ["email_idx"], TOP_MAILS).select("deal_id", "cid", "email_idx")
    top = hot.top_k(best.join(heads, ["deal_id", "cid"]), ["deal_id", "pid"], [F.desc("score"), F.asc("email_idx")], TOP_MAILS)
    return of_profiles(top, sides)


def to_rows(per_profile: DataFrame, items: DataFrame) -> DataFrame:
    """Back from profiles to checklist rows."""
    return items.select("deal_id", "row_id", profile_id().alias("pid")).join(per_profile, ["deal_id", "pid"])


# ---------------------------------------------------------------- threads
def _popcount(c: Column) -> Column:
    return F.bit_count(c)


def thread_bases(features: DataFrame, anchors: DataFrame) -> DataFrame:
    """Row-independent part of each thread's score in its deal."""
    at = F.struct("sort_ts", "email_idx")
    words = anchors.groupBy("deal_id").agg(F.array_sort(F.collect_list(F.struct("anchor_pos", "token"))).alias("_a"))
    f = features.join(words, "deal_id", "left").withColumn("anchors", F.coalesce(
        F.transform("_a", lambda s: s["token"]), F.array().cast("array<string>")))
    bits = F.transform("anchors", lambda k, i: F.when(has(F.col("n_all"), k), F.pow(F.lit(2), i).cast("int")).otherwise(0))
    core = f.withColumn("_bits", F.aggregate(bits, F.lit(0), lambda a, b: a + b)).groupBy("deal_id", "thread_key").agg(
        F.count(F.lit(1)).alias("message_count"), F.max("sort_ts").alias("last_ts"),
        F.bit_or("_bits").alias("anchor_bits"), F.max("priority").alias("status_priority"),
        F.max(F.size("anchors")).alias("n_anchors"), F.min("email_idx").alias("first_idx"),
        F.max_by("subject", F.when(T.squash(F.col("subject")) != "", at)).alias("_s"),
        F.max_by("clean_subject", at).alias("_fb"),
    )
    issues = threads.thread_items(features, "issues", ["deal_id"], 3).groupBy("deal_id", "thread_key").agg(
        F.count(F.lit(1)).alias("n_issues"))
    noise = hot.top_k(features.where("noise_titles > 0").withColumn("_s", F.round(noise_only_score(), 4)),
                      ["deal_id", "thread_key"], [F.desc("_s"), F.asc("email_idx")], 3)
    lifted = noise.groupBy("deal_id", "thread_key").agg(
        F.sum(F.when(F.col("rank") == 1, F.col("_s")).otherwise((F.col("_s") - 0.75) * 0.35)).alias("_lift"),
        F.count(F.lit(1)).alias("_n"))
    out = core.join(issues, ["deal_id", "thread_key"], "left").join(lifted, ["deal_id", "thread_key"], "left")
    lift = F.coalesce(F.col("_lift") + F.when(F.col("_n") >= 2, 1.2).otherwise(0.0) + 10.5, F.lit(0.0))
    out = out.withColumns({
        "subject": T.first_filled(T.squash(F.col("_s")), F.col("_fb")),
        "n_issues": F.coalesce("n_issues", F.lit(0)),
        "anchor_hits": _popcount(F.col("anchor_bits")),
    })
    return cut_lineage(out.withColumns({
        "n_thread_subject": T.search_form(F.col("subject")),
        "late": F.least(F.lit(1.0), 0.2 * (F.col("message_count") - 1)) + F.least(F.lit(0.6), 0.2 * F.col("n_issues"))
        + F.least(F.lit(0.8), 0.2 * F.col("status_priority")),
        "lift": lift,
    }).drop("_s", "_fb", "_lift", "_n"))


def anchored(score: Column) -> Column:
    """Deal anchors raise a thread; a thread without any loses unless it already scores 6."""
    return (
        F.when(F.col("anchor_hits") > 0, score + F.least(F.lit(2.5), 0.8 * F.col("anchor_hits")))
        .when((F.col("n_anchors") > 0) & (score < 6.0), score - 1.8).otherwise(score)
    )


def thread_rank() -> list[Column]:
    return [F.desc("score"), F.desc(F.to_date("last_ts")), F.asc("first_idx")]


@dataclass(frozen=True)
class ThreadMatch:
    """``scores`` of (shape, group of threads that score alike), ``groups`` (threads with their group), scored (shape, class) ``pairs``."""

    sides: Sides
    scores: DataFrame
    groups: DataFrame
    pairs: DataFrame


def thread_classes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deal, thread, class, copies up to three) and a digest ``sig`` of them for each thread; only three mails of a thread are summed."""
    parts = members.groupBy("deal_id", "thread_key", "cid").agg(F.least(F.count(F.lit(1)), F.lit(3)).cast("int").alias("copies"))

    def total(seed: int) -> Column:  # does not depend on the order, needs no list of a thread's classes
        return F.sum(F.xxhash64(F.lit(seed), "cid", "copies").cast("decimal(38,0)")).cast("string")

    sig = parts.groupBy("deal_id", "thread_key").agg(F.concat_ws(" ", total(1), total(2), F.count(F.lit(1)).cast("string")).alias("sig"))
    return parts, sig


def of_groups(parts: DataFrame, threads_in: DataFrame) -> DataFrame:
    """Classes of each group, read from its first thread."""
    lead = threads_in.groupBy("deal_id", "group").agg(F.min("thread_key").alias("thread_key"))
    return lead.join(parts, ["deal_id", "thread_key"]).select("deal_id", "group", F.col("cid").alias("email_idx"), "copies")


def best_sums(scored: DataFrame) -> DataFrame:
    """``best`` of (shape, group): the best mail whole, the next two in part, a bonus from two on."""
    key = ["deal_id", "pid", "group"]
    three = hot.top_k(scored.where(F.col("score") >= THREAD_MAIL_SCORE), key, [F.desc("score"), F.asc("email_idx")], 3)
    mails = F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score", "copies"))),
                                          lambda c: F.array_repeat(c["score"], c["copies"]))), 1, 3)
    part = F.transform("_m", lambda s, i: F.when(i == 0, s).otherwise(F.greatest(s - 0.75, F.lit(0.0)) * 0.35))
    return three.groupBy(*key).agg(mails.alias("_m")).select(
        *key, (F.aggregate(part, F.lit(0.0), lambda a, x: a + x) + F.when(F.size("_m") >= 2, 1.2).otherwise(0.0)).alias("best"))


def thread_bests(sides: Sides) -> DataFrame:
    """``best`` of every profile and thread with a mail of at least ``THREAD_MAIL_SCORE``."""
    parts, sig = thread_classes(sides.members)
    sig = cut_lineage(sig.withColumnRenamed("sig", "group"))
    scored = class_pairs(sides).join(of_groups(parts, sig), ["deal_id", "email_idx"])
    per = of_profiles(best_sums(scored), sides, "match_document_name", "row_context").drop("qid")
    return per.join(sig, ["deal_id", "group"]).drop("group")


def thread_pairs(profiles: DataFrame, features: DataFrame, bases: DataFrame, every: bool = False) -> tuple[ThreadMatch, ThreadMatch]:
    """Scores of shapes and groups of threads, twice: for :func:`top_threads` and for :func:`thread_summaries`.

    Of the groups that share no word with a shape a deal's best few are scored, which completes each top-k; for :func:`all_threads`
    ``every`` one of them that reaches the least score."""
    sides = equal_once(profiles, features)
    shapes, classes = sides.shapes, sides.classes
    parts, sig = thread_classes(sides.members)
    words = bases.select("deal_id", "thread_key", "n_thread_subject")
    subject = _with_kept(words, ("deal_id", "thread_key"), sides.relevant, "n_thread_subject").select(
        "deal_id", "thread_key", canonical("n_thread_subject").alias("n_thread_subject"))
    alike = F.md5(F.concat_ws("|", "sig", "n_thread_subject", F.col("late").cast("string"), F.col("anchor_hits").cast("string"), F.col("n_anchors").cast("string")))
    groups = cut_lineage(bases.drop("n_thread_subject").join(subject, ["deal_id", "thread_key"]).join(sig, ["deal_id", "thread_key"])
                         .withColumn("group", alike).drop("sig"))
    parts = cut_lineage(of_groups(parts, groups))
    group_bases = groups.groupBy("deal_id", "group").agg(*[F.any_value(c).alias(c) for c in ("n_thread_subject", "late", "anchor_hits", "n_anchors")])

    hits = cut_lineage(word_candidates(shapes, classes))
    bare = groups.withColumn("score", F.round(anchored(F.col("lift")) + F.col("late"), 4))
    filler = bare.where(F.col("score") >= ROW_THREAD_SCORE) if every else hot.top_k(bare, ["deal_id"], thread_rank(), TOP_THREADS)
    wanted = hits.join(parts, ["deal_id", "email_idx"]).select("deal_id", "pid", "group").unionByName(
        filler.select("deal_id", "group").distinct().join(shapes.select("deal_id", "pid"), "deal_id")).distinct()
    wanted = cut_lineage(wanted)
    noise = hot.top_k(parts.join(classes.where("noise_titles > 0").withColumn("_s", noise_only_score()), ["deal_id", "email_idx"]),
                      ["deal_id", "group"], [F.desc("_s"), F.asc("email_idx")], TOP_MAILS)
    extra = noise.select("deal_id", "group", "email_idx").join(wanted, ["deal_id", "group"]).select("deal_id", "pid", "email_idx")
    pairs = cut_lineage(scored_pairs(hits.unionByName(extra).distinct(), shapes, classes))
    match = ThreadMatch(sides, cut_lineage(thread_scores(wanted, pairs.join(parts, ["deal_id", "email_idx"]), shapes, group_bases)), groups, pairs)
    return match, match


def thread_scores(wanted: DataFrame, scored: DataFrame, shapes: DataFrame, bases: DataFrame) -> DataFrame:
    """Score of each wanted (shape, group) from its scored classes; ``best`` is null without a mail of at least ``THREAD_MAIL_SCORE``."""
    key = ["deal_id", "pid", "group"]
    bits = scored.groupBy(*key).agg(
        F.max("title_score").alias("title_score"), F.bit_or("title_bits").alias("title_bits"),
        F.bit_or("text_bits").alias("text_bits"), F.max("name_hit").alias("name_hit"))
    j = (
        wanted.join(best_sums(scored), key, "left").join(bits, key, "left")
        .join(shapes.select("deal_id", "pid", "doc_lookup", "doc_tokens"), ["deal_id", "pid"])
        .join(bases, ["deal_id", "group"])
    )
    subject_hits = _count(F.slice("doc_tokens", 1, 8), lambda k: has(F.col("n_thread_subject"), k))
    in_subject = (F.col("doc_lookup") != "") & has(F.col("n_thread_subject"), F.col("doc_lookup"))
    exact = F.coalesce("name_hit", F.lit(False)) | in_subject
    score = (
        F.coalesce("best", F.when(exact, 4.5).otherwise(0.0)) + F.coalesce("title_score", F.lit(0.0))
        + _popcount(F.coalesce("title_bits", F.lit(0))) * 0.9 + subject_hits * 0.6
        + _popcount(F.coalesce("text_bits", F.lit(0))) * 0.25
    )
    out = j.withColumns({"exact_name": exact, "_s": score}).withColumn("score", F.round(anchored(F.col("_s")) + F.col("late"), 4))
    return out.where(F.col("score") >= ROW_THREAD_SCORE).select(*key, "score", "exact_name", "best")


def _threads(match: ThreadMatch) -> DataFrame:
    return match.groups.select("deal_id", "group", "thread_key", "anchor_hits", "subject", "message_count", "last_ts", "first_idx", "status_priority")


def all_threads(match: ThreadMatch) -> DataFrame:
    """Every profile and thread of the least score, if ``match`` was made with ``every``."""
    per = of_profiles(match.scores, match.sides, "match_document_name", "row_context")
    return per.join(match.groups.select("deal_id", "group", "thread_key"), ["deal_id", "group"])


def top_threads(match: ThreadMatch, k: int = TOP_THREADS) -> DataFrame:
    """The best threads of each profile. They stand in the best groups, by score and first thread, and among the first threads of each."""
    newest = [F.desc(F.to_date("last_ts")), F.asc("first_idx")]
    heads = cut_lineage(hot.top_k(_threads(match), ["deal_id", "group"], newest, k, "_nth"))
    lead = match.scores.join(heads.where("_nth = 1").select("deal_id", "group", "last_ts", "first_idx"), ["deal_id", "group"])
    best = hot.top_k(lead, ["deal_id", "pid"], thread_rank(), k).select("deal_id", "pid", "group", "score", "exact_name")
    ranked = hot.top_k(best.join(heads.drop("_nth"), ["deal_id", "group"]), ["deal_id", "pid"], thread_rank(), k)
    return of_profiles(ranked.drop("group"), match.sides)


def thread_summaries(best: DataFrame, match: ThreadMatch, members: DataFrame) -> DataFrame:
    """Status, comment and subjects of the few relevant mails of each chosen thread; profiles of one shape have them in common."""
    key = ["deal_id", "qid", "thread_key"]
    best = cut_lineage(best)
    chosen = best.select(*key, "exact_name").distinct()
    spots = chosen.select("deal_id", "thread_key").distinct()
    inside = match.sides.members.join(spots, ["deal_id", "thread_key"], "left_semi")
    heads = cut_lineage(hot.top_k(inside, ["deal_id", "thread_key", "cid"], ["sort_ts", "email_idx"], TOP_MAILS).drop("rank"))
    noise = hot.top_k(heads.where("noise_titles > 0").withColumn("_s", noise_only_score()),
                      ["deal_id", "thread_key"], [F.desc("_s"), F.asc("sort_ts"), F.asc("email_idx")], TOP_MAILS)
    pair = ["deal_id", "pid", "email_idx"]
    more = noise.select("deal_id", "thread_key", F.col("cid").alias("email_idx")).join(
        chosen.withColumnRenamed("qid", "pid"), ["deal_id", "thread_key"]).select(*pair).distinct().join(match.pairs, pair, "left_anti")
    scored = match.pairs.unionByName(scored_pairs(more, match.sides.shapes, match.sides.classes)).where(F.col("score") >= THREAD_MAIL_SCORE).select(
        "deal_id", F.col("pid").alias("qid"), F.col("email_idx").alias("cid"), "score")
    met = chosen.join(scored, ["deal_id", "qid"]).join(heads.select("deal_id", "thread_key", "cid", "email_idx", "sort_ts"), ["deal_id", "thread_key", "cid"])
    relevant = hot.top_k(met, key, [F.desc("score"), F.asc("sort_ts"), F.asc("email_idx")], TOP_MAILS)
    relevant = cut_lineage(hot.top_k(relevant.drop("rank"), key, ["sort_ts", "email_idx"], EVENTS).select(*key, "email_idx"))
    bare = chosen.where("exact_name").select(*key).join(relevant, key, "left_anti")
    first = hot.top_k(heads, ["deal_id", "thread_key"], ["sort_ts", "email_idx"], EVENTS).select("deal_id", "thread_key", "email_idx")
    relevant = relevant.unionByName(bare.join(first, ["deal_id", "thread_key"]).select(*key, "email_idx"))
    seen = relevant.join(members.select("deal_id", "email_idx", "sort_ts", "priority", "direction", "issues", "event_text", "subject"), ["deal_id", "email_idx"])
    # At most four mails per group, so the lists below are bounded.
    item = F.array_sort(F.collect_list(F.struct("sort_ts", "email_idx", "event_text", "issues", "subject")))
    agg = seen.groupBy(*key).agg(
        F.max("priority").alias("top_priority"), F.count_if(F.col("direction") == "sent").alias("sent_count"),
        F.count_if(F.col("direction") != "sent").alias("received_count"), F.sum(F.size("issues")).alias("issue_count"), item.alias("_m"))
    subjects = T.unique_cased(F.transform("_m", lambda m: T.first_filled(T.squash(m["subject"]), F.lit("No subject"))))
    agg = agg.withColumns({
        "events": F.array_distinct(F.transform("_m", lambda m: m["event_text"])),
        "issue_list": F.slice(T.unique_cased(F.flatten(F.transform("_m", lambda m: m["issues"]))), 1, 3),
        "matching_subjects": F.slice(subjects, 1, 3),
    }).drop("_m")
    out = best.join(agg, key, "left")
    zero = F.lit(0)
    return out.withColumns({
        "status_signal": candidate_status(
            F.coalesce("top_priority", zero), F.coalesce("sent_count", zero), F.coalesce("received_count", zero),
            F.coalesce("issue_count", zero), F.col("status_priority")),
        "suggested_comment": candidate_comment(F.coalesce("events", F.array().cast("array<string>")), F.coalesce("issue_list", F.array().cast("array<string>"))),
    })


def candidate_status(priority, sent, received, issues, thread_priority) -> Column:
    both = (sent > 0) & ((received > 0) | (issues > 0))
    return (
        F.when((priority <= 1) & both, "With Opposing Counsel").when(priority > 0, M.status_name(priority))
        .when(sent > 0, "With Opposing Counsel").when(received > 0, "Draft Circulated")
        .otherwise(M.status_name(thread_priority))
    )


def candidate_comment(events: Column, issues: Column) -> Column:
    said = F.array_join(F.slice(events, 1, 2), " ")
    flagged = F.concat(F.lit("Issues flagged: "), F.array_join(F.slice(issues, 1, 2), "; "), F.lit("."))
    return F.when(F.size(issues) > 0, F.trim(F.concat_ws(" ", said, flagged))).otherwise(said)


# ---------------------------------------------------------------- status from any mention
def mentions(items: DataFrame, members: DataFrame) -> DataFrame:
    """(deal_id, doc_key, email_idx): mails that show two long words of a name, or the name itself."""
    names = items.select("deal_id", F.lower("document_name").alias("doc_key")).distinct()
    words = F.filter(F.regexp_extract_all("doc_key", F.lit(r"(\w+)"), F.lit(1)), lambda w: w != "")
    names = names.withColumn("_w", words)
    needs = names.select("deal_id", "doc_key", F.posexplode(F.filter("_w", lambda w: F.length(w) > 3)).alias("n", "needle"))
    keyword = names.select("deal_id", "doc_key", F.get(F.array_sort("_w", lambda a, b: F.length(b) - F.length(a)), F.lit(0)).alias("needle")).where("needle IS NOT NULL")
    shown = members.select("deal_id", "email_idx", F.explode(F.array_distinct(F.regexp_extract_all("searchable", F.lit(r"(\w+)"), F.lit(1)))).alias("haystack"))
    pairs = containing(needs.select("needle").unionAll(keyword.select("needle")), shown.select("haystack"))

    def found(side, *extra):
        return side.join(pairs, "needle").join(shown, ["deal_id", "haystack"]).select("deal_id", "doc_key", "email_idx", *extra).distinct()

    two = found(needs, "n").groupBy("deal_id", "doc_key", "email_idx").agg(F.count(F.lit(1)).alias("c")).where("c >= 2")
    whole = found(keyword).join(members.select("deal_id", "email_idx", "searchable"), ["deal_id", "email_idx"]).where(
        has(F.col("searchable"), F.col("doc_key")))
    key = ["deal_id", "doc_key", "email_idx"]
    return two.select(*key).unionAll(whole.select(*key)).distinct()


def mention_status(items: DataFrame, members: DataFrame) -> DataFrame:
    """Highest status among a name's mails, and the mails that raised it, in mail order.

    A mail raises the running maximum exactly when it is the first with its priority or more, so
    five ``min_by`` aggregates replace a running window over all mails of a name.
    """
    m = mentions(items, members).join(members.select("deal_id", "email_idx", "priority", "subject"), ["deal_id", "email_idx"]).where("priority > 0")
    levels = range(1, 6)
    firsts = m.groupBy("deal_id", "doc_key").agg(
        F.max("priority").alias("priority"),
        *[F.min(F.when(F.col("priority") >= p, F.struct("email_idx", "subject"))).alias(f"_{p}") for p in levels])
    raised = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.col(f"_{p}") for p in levels]))))
    return firsts.withColumns({
        "status": M.status_name(F.col("priority")),
        "evidence": F.transform(raised, lambda s: s["subject"]),
        "evidence_idx": F.transform(raised, lambda s: s["email_idx"]),
    }).drop(*[f"_{p}" for p in levels])


# ---------------------------------------------------------------- whole update
def checklist_update(items: DataFrame, mail: DataFrame, anchors: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Changed rows only: new status and merged comment, from a decision, a strong thread, or mentions."""
    members = mail.join(items.select("deal_id").distinct(), "deal_id", "left_semi")
    profiles, features = row_profiles(items), mail_features(members)
    match, _ = thread_pairs(profiles, features, thread_bases(features, anchors))
    strong = to_rows(thread_summaries(top_threads(match, 1), match, features), items).select(
        "deal_id", "row_id", F.col("score").alias("t_score"), F.col("status_signal").alias("t_status"),
        F.col("suggested_comment").alias("t_comment"))
    seen = mention_status(items, features).select("deal_id", "doc_key", F.col("status").alias("m_status"), "evidence")
    j = (
        items.join(strong, ["deal_id", "row_id"], "left")
        .withColumn("doc_key", F.lower("document_name")).join(seen, ["deal_id", "doc_key"], "left").drop("doc_key")
    )
    confident = F.coalesce(F.col("t_score") >= CONFIDENT, F.lit(False))
    note = F.concat(F.lit("Email activity indicates "), F.col("m_status"), F.lit(". Example emails: "), F.array_join(F.slice("evidence", 1, 2), "; "))
    status = F.when(confident, F.coalesce(M.model_status(F.col("t_status")), F.lit("Draft Circulated"))).otherwise(F.col("m_status"))
    comment = F.when(confident, F.col("t_comment")).otherwise(F.trim(F.coalesce(note, F.lit(""))))
    if decisions is not None:
        from dealweave.operators.checklist import overlay

        j = overlay(j, decisions, ["status", "has_activity", "comment"])
        active = F.coalesce(F.col("decision.has_activity"), F.lit(False))
        status = F.when(active, F.col("decision.status")).otherwise(status)
        comment = F.when(active, F.col("decision.comment")).otherwise(comment)
    from dealweave.operators.checklist import merged_comment

    j = j.withColumns({"new_status": status, "comment": merged_comment(F.col("existing_notes"), comment)})
    changed = F.coalesce((F.col("new_status") != F.col("current_status")) & (F.col("new_status") != ""), F.lit(False))
    noted = (F.col("comment") != "") & (F.col("comment") != F.col("existing_notes"))
    return j.where(changed | noted).select(
        "deal_id", "row_id", "document_name", "current_status",
        F.coalesce("new_status", "current_status").alias("new_status"), "comment")
