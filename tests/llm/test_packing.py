import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from dealweave.llm.packing import Evolution, best_fit, lower_bound, packed, token_pieces
from tests.llm.helpers import AWKWARD, documents, empty, prose


def test_ids_are_those_of_the_tokenizers_library(spark):
    texts = AWKWARD + [(20, prose(3, 2000)), (21, "It's 12 o'clock  naïve\r\n\r\n  x")]
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in token_pieces(documents(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in texts:
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for n, r in enumerate(sorted(got[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (n, at, zlib.crc32(ids[at:at + r.length].tobytes())) and (n == 0 or r.length == 1024)
            at += r.length
        assert at == len(ids)


def test_added_tokens_inside_texts_are_those_of_the_tokenizers_library(spark):
    texts = [(1, "<|endoftext|>"), (2, "one<|endoftext|>two <|endoftext|>\n<|endoftext|><|endoftext|> x"), (3, "<|endoftext|"), (4, prose(3, 1500) + "<|endoftext|>" + prose(4, 10))]
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {(r.doc_id, r.piece): r for r in token_pieces(documents(spark, texts)).collect()}
    for i, text in texts:
        ids = np.array([*coder.encode(text, add_special_tokens=False).ids, 2], "<u4")
        mine = [got[k] for k in sorted(got) if k[0] == i]
        assert [r.ids_crc32 for r in mine] == [zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in mine] and sum(r.length for r in mine) == len(ids)


def sound(rows, cap=1024):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for members in by.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= cap
    return len(by)


def test_packing_is_sound_and_close_to_the_bound(spark):
    rng = random.Random(2)
    sizes = [1024] * 30 + [rng.randint(1, 1023) for _ in range(900)]
    table = spark.createDataFrame([(i % 400 or None, n, "x", 5) for i, n in enumerate(sizes)] + [(7, 50, "x", 5)] * 2, "doc_id long, length long, offset string, kind int")
    rows = packed(table, block=500).collect()
    assert len(rows) == 932
    assert sound(rows) <= 30 + lower_bound(np.array([*sizes[30:], 50, 50]), 1024) * 1.01 + 2
    again = packed(table.repartition(5), block=500).collect()
    assert sorted((r.sequence_id, r.offset, r.length) for r in rows) == sorted((r.sequence_id, r.offset, r.length) for r in again)


def test_evolution_never_loses_or_worsens():
    sizes = np.array([random.Random(4).randint(200, 700) for _ in range(1)] + [random.Random(i).randint(150, 700) for i in range(300)])
    start = best_fit([], list(range(len(sizes))), sizes.tolist(), 1024)
    got = Evolution(sizes, 1024, [1]).run([])
    assert sorted(i for b in got for i in b) == list(range(len(sizes))) and all(sizes[b].sum() <= 1024 for b in got)
    assert lower_bound(sizes, 1024) <= len(got) <= len(start)
    e = Evolution(sizes, 1024, [2])
    child = e.crossover(e.start(), start)
    assert sorted(i for b in child for i in b) == list(range(len(sizes)))


def test_lower_bound_never_exceeds_a_packing():
    for seed in range(30):
        rng = random.Random(seed)
        sizes = np.array([rng.randint(1, 1023) for _ in range(60)])
        assert lower_bound(sizes, 1024) <= len(best_fit([], list(range(60)), sizes.tolist(), 1024))


def test_empty(spark):
    assert packed(token_pieces(empty(spark))).count() == 0
