from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from dealweave.llm.chat_format import TRICKY, chat_examples, read_back

SHAPE = "conv_id long, turn long, role string, text string, target string, _t int"
pieces = st.lists(st.sampled_from(["\\", "<turn>", "</turn>", "\n", "n", "é😀", "a", "<", "/turn>", "$1"]), max_size=8).map("".join)


def turns(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SHAPE)


def back(spark, rows):
    return {r.conv_id: r for r in read_back(chat_examples(turns(spark, rows))).collect()}


def test_each_reply_is_one_example_with_all_before_it(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "A"), (1, 3, "user", "v"), (1, 4, "assistant", "BB"), (1, 5, "user", "w"), (2, 0, "user", "alone")]
    got = sorted((r.conv_id, r.target or 0, r.formatted, r.loss_start, r.loss_length) for r in chat_examples(turns(spark, rows)).collect())
    assert [(c, t, n) for c, t, _, _, n in got] == [(1, 0, 0), (1, 3, 1), (1, 5, 2), (2, 0, 0)]
    for _, t, formatted, start, n in got:
        if t:
            assert formatted[start - 1:start - 1 + n] in ("A", "BB") and formatted.endswith(formatted[start - 1:start - 1 + n] + "\n</turn>\n")
    assert got[1][2] in got[2][2] and "w" not in got[2][2]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "odd\nrole\\n"]), pieces), min_size=1, max_size=40))
def test_round_trip(spark, talk):
    got = back(spark, [(9, i, role, text) for i, (role, text) in enumerate(talk)])[9]
    assert [(t.role, t.text) for t in got.turns] == talk
    assert got.loss == "".join(text for role, text in talk if role == "assistant")


def test_nulls_ties_and_empty(spark):
    got = back(spark, [(None, None, None, None), (3, 1, "assistant", None), (3, 1, "assistant", TRICKY), (3, 1, "assistant", TRICKY)])
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")]
    assert got[3].loss == TRICKY * 2 and len(got[3].turns) == 3
    assert read_back(chat_examples(turns(spark, []))).count() == 0
