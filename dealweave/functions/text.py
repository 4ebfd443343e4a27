"""String building blocks: every function maps Columns to a Column and stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealweave import lexicon as lx


def words_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def any_contains(text: Column, words) -> Column:
    """Any of the words as a substring. One literal alternation, so ``text`` is evaluated once."""
    return text.rlike("|".join(re.escape(w) for w in words))


def any_rlike(text: Column, patterns) -> Column:
    """One alternation instead of one scan per pattern."""
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def strip(c: Column) -> Column:
    """Without white space of any alphabet at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """Null-safe whitespace collapse and trim."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def null_if_blank(c: Column) -> Column:
    return F.when(c != "", c)


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[null_if_blank(c) for c in cols], F.lit(""))


def search_form(c: Column) -> Column:
    """Lower case, every non-alphanumeric run becomes one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def file_stem(c: Column) -> Column:
    """Base name without its last extension; leading dots do not start an extension."""
    base = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)^.*/", "")
    return F.regexp_replace(base, r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")


def lookup_form(c: Column) -> Column:
    """Document name reduced to its lookup words: no extension, no version or status noise."""
    spaced = search_form(F.translate(file_stem(c), "_-", "  "))
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, lx.NAME_NOISE, " "), r"\s+", " "))


def _tokens(c: Column, min_len: int) -> Column:
    return F.filter(F.split(search_form(c), " "), lambda t: F.length(t) >= min_len)


def query_tokens(c: Column) -> Column:
    stop = words_array(lx.QUERY_STOPWORDS)
    return F.filter(_tokens(c, 3), lambda t: ~F.array_contains(stop, t))


def search_tokens(c: Column) -> Column:
    return F.array_except(_tokens(c, 3), words_array(lx.SEARCH_STOPWORDS))


def deal_tokens(c: Column) -> Column:
    return F.array_except(_tokens(c, 4), words_array(lx.DEAL_STOPWORDS))


def document_tokens(name: Column) -> Column:
    """Search tokens of the lookup form, or of the name itself when the lookup is empty."""
    return search_tokens(first_filled(lookup_form(name), squash(name)))


def unique_cased(arr: Column) -> Column:
    """Clean entries, drop blanks, keep the first spelling of each case-insensitive value."""
    clean = F.filter(F.transform(arr, squash), lambda x: x != "")
    return F.aggregate(
        clean,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(
            F.array_append(acc, x)
        ),
    )


def split_titles(c: Column) -> Column:
    """Attachment list: semicolons win, then line breaks, then commas."""
    text = strip(F.coalesce(c, F.lit("")))
    sep = (
        F.when(F.contains(text, F.lit(";")), F.split(text, ";"))
        .when(F.contains(text, F.lit("\n")), F.split(text, r"\r?\n"))
        .otherwise(F.split(text, ","))
    )
    return F.filter(F.transform(sep, strip), lambda x: x != "")


def split_attachments(c: Column) -> Column:
    return unique_cased(F.split(F.coalesce(c, F.lit("")), "[;,]"))


def split_people(c: Column) -> Column:
    return unique_cased(F.split(F.coalesce(c, F.lit("")), ";"))


def clean_body(c: Column, lines: int | None = None) -> Column:
    """Current message only: quoted lines, reply history, mail headers and notices removed.

    Works on the whole text with anchored multi-line patterns, so it stays inside codegen:
    tidy lines, drop quotes, cut at the first hard stop, cut at the second header line,
    drop the remaining header line, join with spaces. ``lines`` keeps the first so many (a prompt of
    the usual size takes 80); by default the whole message counts.
    """
    header = r"(?:from|sent|to|cc|subject):"
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\S\r\n]*[\r\n\x0B\x0C]\s*", "\n")
    t = strip(t)
    t = F.regexp_replace(t, r"(?m)^>.*(?:\n|$)", "")
    t = F.regexp_replace(
        t,
        r"(?im)^(?:-----original message-----|on .+ wrote:$|"
        rf"(?!{header}).*?(?:privileged and confidential|confidentiality notice))[\s\S]*",
        "",
    )
    t = F.regexp_replace(t, rf"(?im)(^{header}.*\n[\s\S]*?)^{header}[\s\S]*", "$1")
    t = F.regexp_replace(t, rf"(?im)^{header}.*(?:\n|$)", "")
    if lines:
        t = F.substring_index(t, "\n", lines)
    return F.trim(F.regexp_replace(t, r"\n", " "))


def issue_snippets(body: Column, limit: int = 3) -> Column:
    """Sentences of 25 to 240 characters that carry an issue word, distinct, at most ``limit``."""
    marked = F.regexp_replace(clean_body(body), r"([.!?])\s+", "$1\n")
    keep = F.filter(
        F.transform(F.split(marked, r"\n+"), squash),
        lambda s: F.length(s).between(25, 240)
        & ~F.lower(s).rlike(r"^(from|sent|to|cc|subject):")
        & any_rlike(F.lower(s), lx.ISSUE_KEYWORDS),
    )
    return F.slice(unique_cased(keep), 1, limit)


def truncated(c: Column, n: int) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def head_and_tail(c: Column, max_chars: int) -> Column:
    """Keep the first and last part of a long text around a marker."""
    t = F.coalesce(c, F.lit(""))
    head = max_chars // 2
    tail = max_chars - head
    cut = F.concat(F.substring(t, 1, head), F.lit("\n\n...[truncated]...\n\n"), F.right(t, F.lit(tail)))
    return F.when(F.length(t) > max_chars, cut).otherwise(t)


def party_label(c: Column, fallback: str = "someone") -> Column:
    primary = F.substring(squash(F.get(F.split(squash(c), ";"), F.lit(0))), 1, 80)
    return F.when(primary != "", primary).otherwise(F.lit(fallback))


def thread_subject(c: Column) -> Column:
    """Subject without reply prefixes and bracketed tags, peeled to a fixed point."""
    return squash(F.regexp_replace(squash(c), lx.THREAD_MARKER, ""))


def file_names_in(c: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?U)" + lx.FILENAME_PATTERN), F.lit(0))
    return F.filter(F.transform(found, strip), lambda x: F.length(x) > 4)


def address_of(c: Column) -> Column:
    """Address inside the first angle brackets, otherwise the whole field; lower case."""
    text = F.coalesce(c, F.lit(""))
    inner = F.regexp_extract(text, "<([^>]+)>", 1)
    return strip(F.lower(F.when(inner != "", inner).otherwise(text)))


def domain_of(c: Column) -> Column:
    return F.coalesce(F.get(F.split(address_of(c), "@"), F.lit(1)), F.lit(""))


def matter_key(c: Column, known=()) -> Column:
    """Lower-case matter: first pattern whose first match has 4 to 49 characters, else general."""
    low = F.lower(F.coalesce(c, F.lit("")))
    tries = []
    for p in lx.MATTER_PATTERNS:
        m = strip(F.regexp_extract(low, p, 1))
        tries.append(F.when(F.length(m).between(4, 49), m))
    tries += [F.when(F.contains(low, F.lit(k.lower())), F.lit(k.lower())) for k in known]
    return F.coalesce(*tries, F.lit("general"))


def role_names(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[,;]|\band\b"), strip)
    return F.filter(parts, lambda r: F.length(r) > 1)


def clean_cell(c: Column) -> Column:
    """Cell text with straight quotes, plain dashes and single spaces."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\xA0\t\r]+", " ")
    t = F.translate(t, "‘’“”–—", "''\"\"--")
    return strip(F.regexp_replace(t, " +", " "))


def cell_print(c: Column) -> Column:
    return F.substring(F.md5(F.lower(clean_cell(c))), 1, 8)


def row_print(cells: Column) -> Column:
    joined = F.array_join(F.transform(cells, cell_print), "|")
    return F.substring(F.md5(joined), 1, 16)


def page_hash(c: Column) -> Column:
    return F.md5(F.regexp_replace(strip(F.lower(F.coalesce(c, F.lit("")))), r"\s+", " "))


def stamp_date(text: Column, slash: Column, dash: Column, long: Column) -> Column:
    """Replace the first date of the first date shape present, keeping that shape."""
    t = F.coalesce(text, F.lit(""))
    out = t
    for pattern, value in reversed(list(zip(lx.INLINE_DATES, (slash, dash, long)))):
        flags, body = ("(?is)", pattern[4:]) if pattern.startswith("(?i)") else ("(?s)", pattern)
        first = F.regexp_replace(t, F.lit(rf"{flags}^(.*?){body}(.*)$"), F.concat(F.lit("$1"), value, F.lit("$2")))
        out = F.when(t.rlike(pattern), first).otherwise(out)
    return out


def replace_all(text: Column, edits) -> tuple[Column, list[Column]]:
    """Apply (find, replace) pairs in order; returns the new text and a count per pair."""
    counts = []
    for find, new in edits:
        cut = F.replace(text, F.lit(find), F.lit(""))
        counts.append(((F.length(text) - F.length(cut)) / len(find)).cast("long"))
        text = F.replace(text, F.lit(find), F.lit(new))
    return text, counts


def transaction_name(lines: Column, path: Column) -> Column:
    """First of five title lines that is not a header, else the cleaned file name."""
    titles = F.filter(
        F.transform(F.slice(lines, 1, 5), strip),
        lambda x: F.length(x).between(6, 99)
        & ~any_contains(F.lower(x), ("document", "status", "party", "item")),
    )
    name = file_stem(path)
    for suffix in ("_checklist", "_closing", "_documents", "checklist", "closing"):
        name = F.regexp_replace(name, rf"(?i){suffix}$", "")
    return F.coalesce(F.get(titles, F.lit(0)), strip(F.translate(name, "_-", "  ")))


def as_flag(c: Column, true_words, false_words, default: bool) -> Column:
    v = strip(F.lower(F.coalesce(c.cast("string"), F.lit(""))))
    return (
        F.when(v.isin(*true_words), True).when(v.isin(*false_words), False).otherwise(F.lit(default))
    )


def truthy(c: Column) -> Column:
    """Any text except blank, 0, false, no, none, nan."""
    return ~strip(F.lower(F.coalesce(c.cast("string"), F.lit("")))).isin(*lx.FLAG_FALSE)


def policy_entries(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[,\n;]+"), lambda x: F.lower(strip(x)))
    return F.filter(parts, lambda x: x != "")
