import public_tokenizers
import pytest
import sentencepiece

from dealweave.llm.pieces import AgendaEncoder, encoded
from tests.llm.helpers import AWKWARD, documents, empty, prose

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["  lead", "trail  ", "a\n\n b", "\t tab\r\n", "<0x41><s></s><unk>", "\x00a", "日本語のテキスト", "▁▁ab▁", "x" * 500, "ab " * 400, prose(4, 300), "ﬁ Å ½"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_encodes_as_the_library(library):
    coder = AgendaEncoder(PATH)
    texts = HARD + [t or "" for _, t in AWKWARD]
    assert [i.tolist() for i in coder.encode(texts)] == library.encode(texts)


def test_heap_and_rounds_agree():
    coder = AgendaEncoder(PATH)
    for word in ("▁international", "▁aaaaaaaaaaaa", "▁", "étéété", "▁▁▁▁▁▁▁"):
        sym, size = coder._side_by_side([word])
        assert sym.tolist() == coder._heap(word) and size.tolist() == [len(sym)]


def test_table(spark, library):
    got = {r.doc_id: r for r in encoded(documents(spark, AWKWARD)).collect()}
    for i, text in AWKWARD:
        want = library.encode(text or "")
        assert list(got[i].ids) == want and got[i].decoded == library.decode(want)
    assert encoded(empty(spark)).count() == 0
    assert encoded(documents(spark, [(None, "a"), (1, "b"), (1, "b")])).count() == 3
