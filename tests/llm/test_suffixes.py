import numpy as np
import pytest

from dealweave.llm.suffixes import SPAN, suffix_ranks, window_classes, without_repeats
from tests.llm.helpers import AWKWARD, documents, empty, prose


@pytest.mark.parametrize("symbols,size,period", [(1, 90, 0), (2, 200, 0), (3, 301, 7), (4, 400, 0), (4, 350, 3)])
def test_difference_cover_sorts_suffixes(symbols, size, period):
    x = np.random.default_rng(size).integers(1, 1 + symbols, size)
    x = np.tile(x[:period], size)[:size] if period else x
    y = x.tolist()
    for depth in (2, 3, 9, 30):
        rank = suffix_ranks(x, depth)
        order = np.argsort(rank, kind="stable").tolist()
        assert all(y[a:a + depth] <= y[b:b + depth] for a, b in zip(order, order[1:]))
        for a, b in zip(order, order[1:]):
            assert rank[a] != rank[b] or y[a:a + depth] == y[b:b + depth]


def test_classes_are_equal_windows():
    text = np.frombuffer((b"abcab" * 30 + prose(1, 60).encode()) * 2, np.uint8)
    starts = np.arange(len(text) - SPAN + 1)
    order, classes = window_classes(text, starts)
    raw = text.tobytes()
    windows = [raw[s:s + SPAN] for s in starts]
    assert [windows[i] for i in order] == sorted(windows) and classes[-1] == len(set(windows))


def brute(texts):
    seen, out = set(), {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        gone, own = bytearray(len(b)), []
        for k in range(len(b) - SPAN + 1):
            if b[k:k + SPAN] in seen:
                gone[k:k + SPAN] = b"\1" * SPAN
            own.append(b[k:k + SPAN])
        seen.update(own)
        out[i] = (len(b), bytes(c for c, g in zip(b, gone) if not g), len([x for x in bytes(gone).split(b"\0") if x]))
    return out


def texts():
    shared = prose(5, 40)
    made = AWKWARD + [(20, prose(1, 100) + shared), (15, shared + prose(2, 60)), (30, prose(3, 20) + shared[10:150] + "é" * 40 + shared[100:]), (31, "é" * 300), (32, "ab" * 200)]
    made += [(40 + i, prose(9, 120)) for i in range(6)] + [(50 + i, prose(9, 120)[i * 30:] + f" tail {i}") for i in range(8)]
    return made


@pytest.mark.parametrize("heavy", [4096, 0])
def test_removed_bytes_match_brute_force(spark, monkeypatch, heavy):
    import dealweave.llm.suffixes as s

    monkeypatch.setattr(s, "PART", 4000)
    monkeypatch.setattr(s, "CONTEXTS", 2000)
    got = {r.doc_id: (r.n_bytes, bytes(r.kept), len(r.removed)) for r in without_repeats(documents(spark, texts()), heavy=heavy).collect()}
    assert got == brute(texts())


def test_nulls_repeats_and_empty(spark):
    passage = prose(7, 60)
    got = sorted(((r.doc_id or -1), len(r.kept)) for r in without_repeats(documents(spark, [(None, passage), (3, passage), (4, passage), (4, passage), (-9, "short")])).collect())
    assert got == [(-9, 5), (-1, len(passage)), (3, len(passage)), (4, 0), (4, 0)]
    assert without_repeats(empty(spark)).count() == 0
