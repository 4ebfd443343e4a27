"""DuckDB snippets for the reference SQL, written independently of the Spark expressions:
list functions over lines where Spark uses whole-text patterns."""

from __future__ import annotations

from dealweave import lexicon as lx


SPACE = r"[\s\x{0B}\x{85}\p{Z}]"  # white space of any alphabet


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strs(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def alt(patterns) -> str:
    return lit("|".join(f"(?:{p})" for p in patterns))


def squash(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def stem(x: str) -> str:
    base = f"regexp_replace(coalesce({x}, ''), '(?s)^.*/', '')"
    return rf"regexp_replace({base}, '(?s)^(\.*[^.].*)\.[^.]*$', '\1')"


def lookup(x: str) -> str:
    n = norm(f"translate({stem(x)}, '_-', '  ')")
    return rf"trim(regexp_replace(regexp_replace({n}, {lit(lx.NAME_NOISE)}, ' ', 'g'), '\s+', ' ', 'g'))"


def uniq(lst: str) -> str:
    """Distinct list in first-seen order; ``lst`` must be a plain column name."""
    return f"list_filter({lst}, lambda t_, i_: list_position({lst}, t_) = i_)"


def tokens(x: str, n: int, stop) -> str:
    return (f"list_filter(string_split({norm(x)}, ' '), "
            f"lambda t_: length(t_) >= {n} AND NOT list_contains({strs(stop)}, t_))")


def ordered_distinct(lst: str) -> str:
    """Distinct in first-seen order for any list expression."""
    return f"list_reduce(list_prepend([]::VARCHAR[], list_transform({lst}, lambda t_: [t_])), lambda a_, b_: CASE WHEN list_contains(a_, b_[1]) THEN a_ ELSE list_concat(a_, b_) END)"


def cased_distinct(lst: str) -> str:
    clean = f"list_filter(list_transform({lst}, lambda t_: {squash('t_')}), lambda t_: t_ <> '')"
    return (f"list_reduce(list_prepend([]::VARCHAR[], list_transform({clean}, lambda t_: [t_])), lambda a_, b_: "
            f"CASE WHEN list_contains(list_transform(a_, lambda q_: lower(q_)), lower(b_[1])) THEN a_ ELSE list_concat(a_, b_) END)")


def body_lines(x: str) -> str:
    """Trimmed non-blank lines without quoted ones."""
    return (rf"list_filter(list_transform(string_split_regex(coalesce({x}, ''), '\r\n|\n|\r'), lambda l_: {strip('l_')}), "
            "lambda l_: l_ <> '' AND l_[1] <> '>')")


HDR = "'^(from|sent|to|cc|subject):'"


def clean_body_cte(src: str, key: str, body: str, name: str = "cb") -> str:
    """CTEs ending in ``name(key, clean)``: current message text of each row."""
    return f"""
{name}_l AS (SELECT {key}, {body_lines(body)} AS ls FROM {src}),
{name}_x AS (SELECT {key}, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM {name}_l),
{name}_f AS (SELECT {key}, l, i, regexp_matches(lower(l), {HDR}) AS h,
  lower(l) LIKE '-----original message-----%' OR regexp_matches(lower(l), '^on .+ wrote:$')
  OR (NOT regexp_matches(lower(l), {HDR}) AND (contains(lower(l), 'privileged and confidential') OR contains(lower(l), 'confidentiality notice'))) AS stop FROM {name}_x),
{name}_s AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER w AS hn, sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER w AS sn
  FROM {name}_f WINDOW w AS (PARTITION BY {key} ORDER BY i)),
{name}_k AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY i) AS rn FROM {name}_s WHERE sn = 0 AND hn < 2 AND NOT h),
{name} AS (SELECT s.{key}, coalesce(string_agg(k.l, ' ' ORDER BY k.i), '') AS clean
  FROM (SELECT DISTINCT {key} FROM {src}) s LEFT JOIN {name}_k k USING ({key}) GROUP BY s.{key})"""


def priority(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, {alt(p)}) THEN {n}" for _, n, p in lx.STATUS_TIERS)
    return f"CASE {whens} ELSE 0 END"


def status_name(p: str) -> str:
    whens = " ".join(f"WHEN {n} THEN {lit(s)}" for s, n, _ in lx.STATUS_TIERS)
    return f"CASE {p} {whens} END"


def category(x: str) -> str:
    low = f"trim(lower({x}))"
    whens = " ".join(f"WHEN regexp_matches({low}, {alt(p)}) THEN {lit(c)}" for c, _, p in lx.STATUS_CATEGORIES)
    return f"CASE {whens} ELSE 'pending' END"


def matter(x: str) -> str:
    parts = []
    for p in lx.MATTER_PATTERNS:
        m = f"trim(regexp_extract(lower({x}), {lit(p)}, 1))"
        parts.append(f"CASE WHEN length({m}) BETWEEN 4 AND 49 THEN {m} END")
    return f"coalesce({', '.join(parts)}, 'general')"


def thread_subject(x: str) -> str:
    return squash(f"regexp_replace({squash(x)}, {lit(lx.THREAD_MARKER)}, '')")


def address(x: str) -> str:
    m = f"regexp_extract({x}, '<([^>]+)>', 1)"
    return f"trim(lower(CASE WHEN {m} <> '' THEN {m} ELSE {x} END))"


def any_of(x: str, words) -> str:
    return f"regexp_matches({x}, {alt(words)})"
