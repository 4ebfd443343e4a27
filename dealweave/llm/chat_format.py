r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its
reply is trainable. A conversation that does not end with a reply (or has none) has one more example
that holds all its turns and no target, so that no turn is lost.

Template: ``<turn>role``, newline, text, newline, ``</turn>``, newline. Inside texts and roles a
backslash is put before every backslash and before every ``<turn>`` or ``</turn>``, and a newline
in a role is written ``\n``; a marker of the template is never preceded by a backslash, so
reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.llm.registry import query, read

ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\|</?turn>", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|</?turn>)", "$1")


def _role(role: Column) -> Column:
    return F.regexp_replace(escape(role), "\n", r"\\n")


def _read_role(role: Column) -> Column:
    # a written newline is \n after an even number of backslashes; reading in pairs keeps them apart
    return unescape(F.regexp_replace(role, r"\G((?:[^\\]|\\\\|\\<)*?)\\n", "$1\n"))


def chat_examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, target, formatted, loss_start, loss_length``: one row per example.

    ``target`` is the place of the reply in its conversation (from 1); ``loss_start`` (from 1) and
    ``loss_length`` are the code points of ``formatted`` under the loss mask. For an example without
    target, ``target`` is null, ``loss_start`` and ``loss_length`` are 0. Turns are ordered by turn number,
    then role, then text; repeated rows stay. Null text or role is empty, a null turn number
    comes first, a null conversation id is a conversation. An empty table gives no example.
    One conversation must fit a row, as its last example holds all of it; the size of conversations
    is never summed over, and a table-wide common first turn is of no importance.
    """
    empty = F.lit("")
    rows = turns.select(F.col(conv).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text")).alias("_t"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_ts"))

    def head(t):
        return F.concat(F.lit("<turn>"), _role(t["role"]), F.lit("\n"))

    shown = talks.select(
        "conv_id",
        F.transform("_ts", lambda t: F.struct(
            (t["role"] == ASSISTANT).alias("reply"), F.char_length(head(t)).alias("head"), F.char_length(escape(t["text"])).alias("size"),
            F.concat(head(t), escape(t["text"]), F.lit("\n</turn>\n")).alias("shown"))).alias("_ts"))
    places = F.filter(F.sequence(F.lit(1), F.size("_ts")), lambda i: F.col("_ts")[i - 1]["reply"])
    rest = F.when(~F.element_at("_ts", -1)["reply"], F.array(-F.size("_ts"))).otherwise(F.array().cast("array<int>"))
    examples = shown.select("conv_id", "_ts", F.explode(F.concat(places, rest)).alias("_i"))

    before = F.slice("_ts", 1, F.abs("_i") - 1)
    context = F.array_join(F.transform(before, lambda t: t["shown"]), "")
    last = F.col("_ts")[F.abs("_i") - 1]
    aimed = F.col("_i") > 0
    parts = examples.select("conv_id", "_i", context.alias("_context"), last.alias("_last"))
    return parts.select(
        "conv_id", F.when(aimed, F.col("_i")).alias("target"), F.concat("_context", "_last.shown").alias("formatted"),
        F.when(aimed, F.char_length("_context") + F.col("_last.head") + 1).otherwise(0).alias("loss_start"),
        F.when(aimed, F.col("_last.size")).otherwise(0).alias("loss_length"))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted examples alone: ``turns`` (array of role and text), ``loss`` (all
    trainable text, each reply once and in order) and ``formatted_chars``."""
    loss = unescape(F.expr("substring(formatted, loss_start, loss_length)"))
    place = F.coalesce(F.col("target"), F.lit(2**31 - 1))
    got = examples.groupBy("conv_id").agg(
        F.max_by("formatted", place).alias("_all"),
        F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", loss.alias("text"))))).alias("_loss"),
        F.sum(F.char_length("formatted").cast("long")).alias("formatted_chars"))
    blocks = F.filter(F.split("_all", r"(?<!\\)</turn>\n"), lambda b: b != "")

    def turn(b):
        body = F.substring(b, F.lit(7), F.char_length(b))  # after <turn>
        cut = F.instr(body, "\n")
        return F.struct(_read_role(F.substring(body, F.lit(1), cut - 1)).alias("role"),
                        unescape(F.substring(body, cut + 1, F.char_length(body) - cut - 1)).alias("text"))

    return got.select("conv_id", F.transform(blocks, turn).alias("turns"),
                      F.array_join(F.transform("_loss", lambda x: x["text"]), "").alias("loss"), "formatted_chars")


TRICKY = r"\### Assistant: </turn> ok"

_ESC = r"regexp_replace({x}, '\\|</?turn>', '\\\0', 'g')"
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS m,
  sum(16 + length(ROLE_) + length(TEXT_)) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR i = m)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
""".replace("ROLE_", _ESC.format(x="role")).replace("TEXT_", _ESC.format(x="text"))


@query("op8_chat_format", SQL)
def op8(spark, sf_dir):
    talks = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(TRICKY).alias("text"))
    back = read_back(chat_examples(talks.unionByName(tricky)))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spelled, 256).alias("turns_sha256"),
                       F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
