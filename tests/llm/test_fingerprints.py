import hashlib

import numpy as np

import __spark_entry__ as entry_module
import dealweave.llm.fingerprints as fp
from tests.compare import DATA, duck
from tests.llm.helpers import AWKWARD, documents, empty, prose


def likeness(a, b):
    a, b = set(fp.digests(a).tolist()), set(fp.digests(b).tolist())
    return 1 - len(a ^ b) / (len(a) + len(b)) if a ^ b else 1.0


def test_peeling_recovers_exactly_the_difference():
    rng = np.random.default_rng(1)
    common = rng.integers(1, 1 << 63, 500).astype(np.uint64)
    left = [np.concatenate([common, rng.integers(1, 1 << 63, n).astype(np.uint64)]) for n in (0, 1, 5, 40, 300)]
    right = [np.concatenate([common[n // 9:], rng.integers(1, 1 << 63, n // 2).astype(np.uint64)]) for n in (0, 1, 5, 40, 300)]
    for a, b, d in zip(left, right, fp.differences(left, right)):
        assert sorted(d.tolist()) == sorted(set(a.tolist()) ^ set(b.tolist()))


def test_edits_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET", 3)
    texts = AWKWARD + [(20 + i, prose(i, 150)) for i in range(11)] + [(40, prose(3, 150)), (None, "last"), (41, "y" * 1000)]
    got = {r.doc_id: r for r in fp.edited_fingerprints(documents(spark, texts)).collect()}
    order = sorted(texts, key=lambda x: -(1 << 63) if x[0] is None else x[0], reverse=True)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n, r = t or "", n or "", got[i]
        edited = t[:len(t) - len(t) // 3] + n[:len(t) // 3]
        assert (r.n_chars, r.edited) == (len(t), edited), i
        assert abs(r.near_edited - likeness(t, edited)) < 1e-9 and abs(r.near_next - likeness(t, n)) < 1e-9
    assert got[40].fingerprint == got[23].fingerprint != got[24].fingerprint


def test_the_query_against_brute_force(spark):
    sf = f"{DATA}/sf0.001"
    texts = [(r[0], r[1] or "") for r in duck(sf).sql("SELECT doc_id, text FROM documents ORDER BY doc_id DESC").fetchall()]
    got = {r.doc_id: r for r in entry_module.queries()["op9_fingerprint"](spark, sf).collect()}
    assert len(got) == len(texts)
    for (i, t), (_, n) in zip(texts, texts[1:] + texts[:1]):
        edited = t[:len(t) - len(t) // 3] + n[:len(t) // 3]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest()), i
        assert abs(got[i].near_edited - likeness(t, edited)) < 1e-9 and abs(got[i].near_next - likeness(t, n)) < 1e-9, i


def test_one_row_and_none(spark):
    one = fp.edited_fingerprints(documents(spark, [(5, "abcdef")])).first()
    assert one.edited == "abcdab" and one.near_next == 1.0
    assert fp.edited_fingerprints(empty(spark)).count() == 0
    assert fp.edited_fingerprints(documents(spark, [(1, "a"), (1, "a")])).count() == 2
