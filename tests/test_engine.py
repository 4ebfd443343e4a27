"""Ordered, substring and assignment operators against brute force."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealweave.operators import hot, redline
from dealweave.operators.assign import first_come, greedy_rounds, to_units
from dealweave.operators.substring import containing


def test_block_windows_equal_plain_windows(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [("big" if i % 3 else "small", i, rnd.choice([None, "a", "b"]), rnd.randint(1, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, v string, n int")
    block = hot.index_block(F.col("i"), 16)
    w = W.partitionBy("k").orderBy("i")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    got = hot.numbered(df, ["k"], block, ["i"], "pos")
    got = hot.last_before(got, ["k"], block, ["i"], F.col("v"), "last")
    got = hot.max_before(got, ["k"], block, ["i"], F.col("n"), "top")
    want = df.select("*", F.row_number().over(w).cast("long").alias("pos"), F.last("v", True).over(before).alias("last"), F.max("n").over(before).alias("top"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_substring_join(spark):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abc ") for _ in range(n))
    needles = {word(rnd.randint(0, 5)) for _ in range(60)}
    hay = {word(rnd.randint(0, 14)) for _ in range(60)}
    got = {(r.needle, r.haystack) for r in containing(spark.createDataFrame([(x,) for x in needles], "a string"), spark.createDataFrame([(x,) for x in hay], "b string")).collect()}
    assert got == {(n, h) for n in needles for h in hay if n and n in h}


def test_greedy_rounds_equal_sorted_greedy(spark):
    rnd = random.Random(7)
    caps_l, caps_r = {i: rnd.randint(1, 3) for i in range(12)}, {i: rnd.randint(1, 3) for i in range(12)}
    pairs = [(i, j, caps_l[i], caps_r[j], rnd.randint(1, 5)) for i in range(12) for j in range(12) if rnd.random() < 0.5]
    got = greedy_rounds(spark.createDataFrame(pairs, "left long, right long, cap_left int, cap_right int, s int"), [(-F.col("s")).alias("o")])
    left, right, want = dict(caps_l), dict(caps_r), {}
    for i, j, _, _, s in sorted(pairs, key=lambda p: (-p[4], p[0], p[1])):
        n = min(left[i], right[j])
        if n:
            want[i, j] = n
            left[i] -= n
            right[j] -= n
    assert {(r.left, r.right): r.qty for r in got.collect()} == want
    units = to_units(got).collect()
    assert len(units) == sum(want.values()) and len({(u.left, u.left_unit) for u in units}) == len(units) == len({(u.right, u.right_unit) for u in units})


def tables(spark, *rows):
    return spark.createDataFrame([(1, i, list(r)) for i, r in enumerate(rows, 1)], "table_id long, row_idx long, cells array<string>")


def test_redline_passes(spark):
    o = tables(spark, ("1", "alpha", "x", "10"), ("2", "beta", "y", "20"), ("2", "beta", "y", "20"), ("3", "gamma delta epsilon", "z", "30"), ("4", "gone", "q", "1"))
    m = tables(spark, ("2", "beta", "y", "20"), ("1", "alpha", "x", "11"), ("2", "beta", "y", "20"), ("3b", "gamma delta epsilon", "z", "31"), ("9", "brand new row here", "", ""))
    got = {(r.orig_idx, r.mod_idx, round(r.confidence, 1)) for r in redline.match_rows(o, m).collect()}
    assert {(2, 1, 1.0), (3, 3, 1.0), (1, 2, 0.8)} <= got and any(a == 4 and b == 4 for a, b, _ in got) and len(got) == 4
    st = redline.change_stats(redline.row_changes(o, m, redline.match_rows(o, m)), header_rows=1).first()
    assert st.unchanged + st.modified + st.moved + st.deleted == 5 + 1
    assert (st.added, st.deleted, st.is_resorted) == (1, 1, True)


def test_column_map(spark):
    h = lambda *c: spark.createDataFrame([(1, list(c))], "table_id long, cells array<string>")
    r = redline.column_mappings(h("Part", "Name", "Size"), h("Name", "Parts", "Weight", "New")).first()
    assert {(p.o, p.m) for p in r.map} == {(0, 1), (1, 0), (2, 2)} and r.added_columns == [3] and r.deleted_columns == []


def test_first_come_equals_walking_left_in_order(spark):
    rnd = random.Random(8)
    rows = {(g, a, b): rnd.randint(0, 3) for g in "xy" for a in range(14) for b in range(14) if rnd.random() < 0.4}
    want, used = set(), set()
    for g, a in sorted({k[:2] for k in rows}):
        free = [(-s, b) for (h, c, b), s in rows.items() if (h, c) == (g, a) and (g, b) not in used]
        if free:
            b = min(free)[1]
            used.add((g, b))
            want.add((g, a, b))
    df = spark.createDataFrame([(*k, s) for k, s in rows.items()], "g string, left long, right long, s int")
    got = {(r.g, r.left, r.right) for r in first_come(df, [(-F.col("s")).alias("s")], ["g"]).collect()}
    assert got == want
    assert first_come(df.limit(0), [F.col("s")], ["g"]).count() == 0


def test_first_come_takes_few_rounds_where_best_partners_differ(spark):
    n = 5000
    df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("left"), F.explode(F.array(*[F.pmod(F.col("id") + k, F.lit(n)) for k in range(4)])).alias("right"))
    df = df.withColumn("s", F.when(F.col("left") == F.col("right"), 9).otherwise(8))
    got = first_come(df, [(-F.col("s")).alias("s")], ["g"]).collect()
    assert len(got) == n and all(r.left == r.right for r in got) and got[0].round < 20


def made_rows(seed, n, tables, blank=True):
    rnd = random.Random(seed)
    return [(1 + i % tables, i, rnd.choice(["", "cold gizmo lamp " * 6, *[f"{rnd.randint(1, 999)} | {a} | Brand#{rnd.randint(1, 30)}" for a in ("cold gizmo", "new bolt", "inserted row")]][0 if blank else 1:]))
            for i in range(n)]


def test_left_over_rows_are_chosen_as_by_one_walk_in_row_order(spark, monkeypatch):
    monkeypatch.setattr(redline, "ORDERED", 7)
    o, m = made_rows(3, 80, 3), made_rows(4, 50, 4)
    want, used = set(), set()
    for t, i, a in o:
        best = min(((-redline.ratio(a, b), j) for u, j, b in m if u == t and j not in used and a and b), default=(0, 0))
        if -best[0] > 0.6:
            used.add(best[1])
            want.add((t, i, best[1], -best[0]))
    schema = "table_id long, row_idx long, row_text string"
    got = redline.fuzzy_rows(*(spark.createDataFrame(x, schema) for x in (o, m)))
    assert len(want) > 20 and {tuple(r) for r in got.collect()} == want
    assert redline.fuzzy_rows(spark.createDataFrame([], schema), spark.createDataFrame(m, schema)).count() == 0


def test_rows_that_want_the_same_partner_ask_few_ratios(monkeypatch):
    asked = []
    plain = redline.ratio
    monkeypatch.setattr(redline, "ratio", lambda a, b: asked.append(1) or plain(a, b))
    left, right = [f"{7 * i} | cold gizmo | Brand#{i % 25} | 7" for i in range(300)], [f"NEW{9 * i} | inserted row | Brand#{i % 25} | 0" for i in range(200)]
    assert len(redline._closest(left, right)) == 200 and len(asked) < 10 * len(left)


def test_greedy_choice_among_ties_takes_few_rounds(spark, monkeypatch):
    from dealweave.operators import assign

    n, asked = 40, []
    pairs = [(g, i, j, 1 + (i % 3 == 0), 1, s) for g in (1, 2) for i in range(n) for j in range(n) for s in [(i * 7 + j * 3) % 2] if g == 1 or i < 20]
    df = spark.createDataFrame(pairs, "g long, left long, right long, cap_left long, cap_right long, s int")
    cut, want = assign.cut_lineage, set()
    monkeypatch.setattr(assign, "cut_lineage", lambda d: asked.append(1) or cut(d))
    for g in (1, 2):
        left, right = {i: 1 + (i % 3 == 0) for i in range(n)}, dict.fromkeys(range(n), 1)
        for _, i, j, _, _, s in sorted((p for p in pairs if p[0] == g), key=lambda p: (-p[5], p[1], p[2])):
            if q := min(left[i], right[j]):
                want.add((g, i, j, q))
                left[i], right[j] = left[i] - q, right[j] - q
    for walked, most in ((1 << 17, 8), (250, 60)):  # the second cuts groups into several walks
        asked.clear()
        monkeypatch.setattr(assign, "WALKED", walked)
        got = greedy_rounds(df, [(-F.col("s")).alias("o")], ["g"])
        assert {(r.g, r.left, r.right, r.qty) for r in got.collect()} == want and len(asked) <= most
    assert len({(r.g, r.left, r.round) for r in got.collect()}) == len(want)
