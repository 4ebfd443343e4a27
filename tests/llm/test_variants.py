import random
import re
import zlib
from collections import Counter

import pytest

import __spark_entry__ as entry_module
from dealweave.llm import variants
from tests.compare import DATA, compare, duck
from tests.llm.helpers import AWKWARD, documents, empty, rows


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_force(texts, min_length=7, min_count=2, drop=31, ratio=10):
    n = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % drop == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= min_length:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= min_count}
    form, out = {}, []
    around = {w: [v for v in n if near(w, v)] for w in n}
    for w, others in around.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w] or "", root, n[w], len(around[w]), n[form[w]] if form[w] else -1))
    return sorted(out)


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or -1) for r in df.collect())


def corpus(seed, letters="abÀé", size=500, length=(2, 6)):
    rng = random.Random(seed)
    texts = [(i, " ".join("".join(rng.choice(letters) for _ in range(min(rng.randint(*length), rng.randint(*length)))) for _ in range(rng.randint(0, 30)))) for i in range(size)]
    return [*texts, (None, "abab baba Aba"), (7, texts[7][1]), (7, "abab abab"), (9999, None)]


@pytest.mark.parametrize("letters,drop,ratio", [("abÀé", 3, 2), ("aA", 31, 10), ("abcdefgh", 2, 3)])
def test_same_as_brute_force(spark, letters, drop, ratio):
    texts = corpus(len(letters), letters)
    got = variants.spelling_variants(documents(spark, texts), min_length=2, drop=drop, ratio=ratio)
    assert found(got) == brute_force(texts, 2, 2, drop, ratio)


def test_chains_of_forms_and_ties(spark):
    words = {"aaaaaaa": 400, "aaaaaaab": 40, "aaaaaaac": 40, "aaaaaabb": 4, "aaaaaaacc": 4, "aaaaaaaca": 4, "ccccccc": 3, "ccccccd": 3, "zzzzzzzz": 5}
    texts = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    want = brute_force(texts, drop=10**9)
    assert found(variants.spelling_variants(documents(spark, texts), drop=10**9)) == want
    assert dict((r[0], r[2]) for r in want)["aaaaaabb"] == "aaaaaaa"


def test_awkward_texts_and_long_words(spark):
    long = "ab" * 3_000
    texts = AWKWARD + [(50, f"{long} {long} {long}a {long}a {long[1:]} {long[1:]}"), (51, "é×÷é×÷éé é×÷é×÷éé ÉÉÉÉÉÉÉÉ ééééééééé x7seven77 seventhx"), (52, "Seventhx SEVENTHY seventhy sevenths")]
    assert found(variants.spelling_variants(documents(spark, texts))) == brute_force(texts)
    assert variants.spelling_variants(empty(spark)).count() == 0


def test_numbers_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    vocabulary = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(800)})
    nodes = {}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = variants.numbered(spark.createDataFrame([(w,) for w in vocabulary], "word string").repartition(5), variants.F.col("word"), "word").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for r in got:
        assert len(r.nodes) == len(r.word) + 1
        for d, node in enumerate(r.nodes):
            assert nodes.setdefault(r.word[:d], node) == node
    assert len(set(nodes.values())) == len(nodes) and len(got) == len(vocabulary)
    assert [r.word for r in sorted(got, key=lambda r: r.nodes[-1])] == vocabulary


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(8)
    stock = ["".join(rng.choice("abc") for _ in range(rng.randint(6, 9))) for _ in range(120)]
    texts = [(i, " ".join(rng.choices(stock, weights=[1 + 60 * (k % 17 == 0) for k in range(120)], k=40))) for i in range(120)]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = found(entry_module.queries()["op12_spelling_variants"](spark, str(tmp_path)))
    assert got == brute_force(texts) and any(r[1] for r in got)


def test_same_rows_as_sql(spark):
    sf = f"{DATA}/sf0.001"
    key = "op12_spelling_variants"
    *_, problems = compare(spark, duck(sf), key, entry_module.queries()[key], entry_module.oracle_sql()[key], sf)
    assert not problems, problems
    assert rows(entry_module.queries()[key](spark, sf).limit(1), "n")
