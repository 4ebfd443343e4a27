import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from dealweave.llm import middle
from tests.compare import DATA, compare, duck
from tests.llm.helpers import AWKWARD, documents, empty, prose, rows

LINES = [(100, "a\nb\nc"), (101, "\n"), (102, "\n\n\n"), (103, "<P>x\ny\n"), (104, "x<S"), (105, "<\nS>\n<M\n>"), (106, "é\n😀\r\nß"), (107, "one line\n"), (108, "tail<P\n<S\n<M\n"), (None, "no\nid\n")]


def plain_version(i, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return i, len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    made = [(1000 + i, "".join(rng.choice(["\n", "a", "é", "😀", "\n\n", "xyz ", "<P", "S>"]) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    return AWKWARD + LINES + made + [(2000, prose(1, 4000)), (2000, "same id\nother text"), (2001, "long\n" * 50_000)]


def by_id(found):
    return sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[5]))


@pytest.mark.parametrize("rate,spm,size", [(100, 50, middle.BYTES), (60, 0, 64)])
def test_same_as_plain_version(spark, monkeypatch, rate, spm, size):
    monkeypatch.setattr(middle, "BYTES", size)
    got = middle.fill_in_middle(documents(spark, texts()), rate=rate, spm_rate=spm).collect()
    assert by_id(map(tuple, got)) == by_id(plain_version(i, t, rate, spm) for i, t in texts())


def test_outputs_are_reversible(spark):
    made = middle.fill_in_middle(documents(spark, texts()))
    back = made.select("doc_id", middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in texts())
    assert {"psm", "spm", "plain"} == {r.form for r in made.collect()}


def test_rank_and_select_match_positions():
    rng = np.random.default_rng(1)
    data = rng.choice(np.array([0x0A, 0x0B, 0x8A, 0x00, 0x09, 0xFF, 0x61], np.uint8), 800)
    marks = middle.Marks(middle._equal(data.view("<u8"), 0x0A))
    where = np.flatnonzero(data == 0x0A)
    assert marks.select(np.arange(len(where))).tolist() == where.tolist()
    at = np.arange(800)
    assert marks.rank(at).tolist() == [int((where < i).sum()) for i in at]


def test_empty_table_and_bad_sentinels(spark):
    assert middle.fill_in_middle(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        middle.fill_in_middle(empty(spark), sentinels=("a", "b", "c"))


def test_same_rows_as_sql(spark):
    sf = f"{DATA}/sf0.001"
    key = "op11_fill_in_middle"
    *_, problems = compare(spark, duck(sf), key, entry_module.queries()[key], entry_module.oracle_sql()[key], sf)
    assert not problems, problems


def test_query_on_awkward_texts(spark, tmp_path):
    documents(spark, texts()).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(entry_module.queries()["op11_fill_in_middle"](spark, str(tmp_path)).where("doc_id IS NOT NULL"), "doc_id", "output_sha256", "restored_sha256")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted((i, sha(plain_version(i, t)[5]), sha(t or "")) for i, t in texts() if i is not None)
