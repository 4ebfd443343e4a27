import random

from dealweave.llm import components as module
from dealweave.llm.components import connected
from dealweave.llm.simhash import FEW, _signed, fingerprint, near_groups, near_links
from dealweave.llm.similar import similar_groups
from dealweave.session import cut_lineage
from tests.llm.helpers import AWKWARD, documents, empty, prose, rows


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def bits(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(5)
    found = set()
    for size in (1, 4, 3 * FEW):  # the last group fills its keys
        base = rng.getrandbits(64)
        for _ in range(size):
            found.add(_signed(base ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4)))))
    found |= {_signed(rng.getrandbits(64)) for _ in range(50)} | {0, _signed(3), _signed(7), -1}
    found = sorted(found)
    links = near_links(spark.createDataFrame([(f, f) for f in found], "id long, fp long"))
    assert all(bits(r.a, r.b) <= 2 for r in links.collect())
    want = components(found, lambda a, b: bits(a, b) <= 2)
    got = dict(rows(connected(links), "node", "component"))
    assert {f: got.get(f, f) for f in found} == want
    assert len(set(want.values())) < len(want)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 201), (201, 201), (300, 200)] + [(500, 501 + i) for i in range(40)]
    got = dict(rows(connected(spark.createDataFrame(chain, "a long, b long")), "node", "component"))
    assert set(got[i] for i in range(61)) == {0} and got[300] == 200 and got[540] == 500
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stars_need_no_round(spark, monkeypatch):
    made = []
    monkeypatch.setattr(module, "cut_lineage", lambda df: made.append(1) or cut_lineage(df))
    stars = spark.createDataFrame([(1, i) for i in range(2, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = dict(rows(connected(stars), "node", "component"))
    assert got == {**{i: 1 for i in range(1, 60)}, 100: 100, 101: 100} and len(made) == 1
    for near in ([(1, 3), (2, 3)], [(1, 2), (2, 3)]):  # a second smaller end, an end that is both
        assert set(dict(rows(connected(spark.createDataFrame(near, "a long, b long")), "node", "component")).values()) == {1}


def test_groups_of_documents(spark):
    base = prose(1, 400)
    texts = AWKWARD + [(20, base), (21, base.upper()), (22, "  " + base), (30, prose(2, 80)), (None, base), (20, base)]
    got = near_groups(documents(spark, texts)).collect()
    prints = {(r.doc_id, r.fp) for r in got}
    assert all(_signed(fingerprint(t or "", 3)) in {f for i, f in prints if i == d} for d, t in texts)
    by = {r.doc_id: r.component_id for r in got}
    assert len(got) == len(texts) and by[1] == by[2] == by[3] == 1 and by[20] == by[21] == by[22] == by[None] == 20 and by[30] == 30
    assert near_groups(empty(spark)).count() == 0
    assert fingerprint("", 3) == 0 and fingerprint("one two", 3) == fingerprint(" ONE\ttwo\n", 3) != 0


def test_near_copies_at_five_words(spark):
    texts = []
    for g in range(20):
        words = prose(100 + g, 400).split()
        for k in range(3):
            copy = list(words)
            for at in random.Random(1000 * g + k).sample(range(400), 2 if k else 0):
                copy[at] = f"new{at}"
            texts.append((10 * g + k, " ".join(copy)))
    got = dict(rows(similar_groups(documents(spark, texts + [(900, ""), (901, None), (902, " ")])), "doc_id", "component_id"))
    caught = sum(got.get(i) == i - i % 10 for i, _ in texts if i % 10)
    assert caught >= 0.9 * 40 and not any(got.get(i, i) != i - i % 10 and i in got for i, _ in texts) and 901 not in got
    assert similar_groups(empty(spark)).count() == 0
