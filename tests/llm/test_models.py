import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import dealweave.llm.language as language
import dealweave.llm.toxicity as toxicity
from tests.compare import DATA, duck
from tests.llm.helpers import AWKWARD, documents, empty, prose, rows

SF = f"{DATA}/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_accuracy_on_held_out_rows(spark):
    truth = dict(duck(SF).sql("SELECT doc_id, lang FROM documents").fetchall())
    got = entry_module.queries()["op2_language_id"](spark, SF).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got) and len(got) == len(truth)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out)


def test_language_of_awkward_rows(spark):
    texts = AWKWARD + [(20 + i, prose(1, 40)) for i in range(30)] + [(60 + i, prose(2, 40).upper().replace("A", "ü")) for i in range(30)] + [(None, "word"), (99, "12 !?")]
    docs = documents(spark, texts, {i: "aa" if i < 60 else "bb" for i in range(20, 90)})
    got = {r.doc_id: r for r in language.identified(docs, language.train(docs)).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {1, 2, 3, 99} and all(got[i].rejected for i in (1, 2, 3, 99))
    assert got[25].lang_pred == "aa" and got[65].lang_pred == "bb" and len(got) == len(texts)
    assert language.train(empty(spark)) is None and language.identified(empty(spark), None).count() == 0
    assert rows(language.identified(documents(spark, [(1, "x")]), None), "lang_pred", "score") == [("und", 0.0)]


@pytest.mark.parametrize("unlearned", ["fr", "de"])
def test_languages_that_were_not_learned_are_rejected(spark, unlearned):
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").where("lang IS NOT NULL AND size(split(trim(text), '[ \n]+')) >= 20")
    model = language.train(docs.where(F.col("lang") != unlearned))
    fresh = [r.text for r in docs.where(F.col("lang") == unlearned).select("text").limit(150).collect()]
    assert np.mean([model.predict(t)[2] for t in fresh]) >= 0.8
    known = [(r.text, r.lang) for r in docs.where((F.col("lang") != unlearned) & language.held_out()).select("text", "lang").limit(600).collect()]
    got = [model.predict(t) for t, _ in known]
    assert np.mean([g[2] for g in got]) <= 0.01 and np.mean([g[0] == lang for g, (_, lang) in zip(got, known)]) >= 0.97


def test_letter_noise_is_rejected(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    model = language.train(docs)
    rng = np.random.default_rng(1)
    noise = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(n)) for n in (8, 20, 60) for _ in range(30)]
    assert np.mean([model.predict(t)[2] for t in noise]) >= 0.9


def test_prediction_equals_a_plain_forward_pass(spark):
    docs = documents(spark, [(i, prose(1 + (i >= 30), 40)) for i in range(60)], {i: "aa" if i < 30 else "bb" for i in range(60)})
    model = language.train(docs)
    got = {r.doc_id: r for r in language.identified(docs, model).collect()}
    for row in docs.collect():
        raw, mean = f" {row.text.lower()} ".encode(), np.zeros(3)
        grams = [raw[i:i + n] for n in language.GRAMS for i in range(len(raw) - n + 1)]
        for gram in grams:
            h = 0
            for byte in gram:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ (byte + 1)
            mean += model.table[((h ^ len(gram)) * 0x9E3779B1 & 0xFFFFFFFF) >> 17] / len(grams)
        p = np.exp(mean / model.temperature)
        p = (p / p.sum())[:2]
        assert got[row.doc_id].lang_pred == model.languages[int(p.argmax())] and abs(got[row.doc_id].score - p.max()) < 1e-6


def test_toxic_words_are_found_and_located(spark):
    bad = ("nasty", "vile")
    texts, marks = [], []
    for i in range(400):
        text = prose(i % 50, 60)
        if i % 4 == 0:
            at = text.index("\n") + 1
            text = text[:at] + f"so {bad[i % 8 // 4]} this is. " + text[at:]
        texts.append((i, text))
        marks.append((i, int(i % 4 == 0), None))
    docs = documents(spark, texts + [(1000, None), (1001, ""), (None, "so vile this is")])
    labels = spark.createDataFrame(marks + [(5000, 1, 1), (None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect()}
    for i, text in texts:
        assert (got[i].score >= 0.5) == (i % 4 == 0), i
        if i % 4 == 0:
            assert any(w in text[s.start:s.end] for s in got[i].offending for w in bad)
    assert got[None].score >= 0.5 and got[1000].score < 0.5 and got[1001].offending == []
    assert str(got[1001].score) == "0.0"
    assert toxicity.scored(empty(spark), toxicity.train(empty(spark), labels)).count() == 0


def test_sentences_cover_the_text():
    for text in ("", "a", "One. Two! 3.5 is\n\n. ", "x" * 5000 + "?", "....\n"):
        cuts = list(toxicity.sentences(text))
        assert "".join(text[a:b] for a, b in cuts) == text and all(a < b for a, b in cuts)


def test_toxicity_ranks_held_out_rows(spark):
    got = entry_module.queries()["op10_toxicity"](spark, f"{DATA}/sf0.1").select("doc_id", "held_out", "score").collect()
    truth = dict(duck(f"{DATA}/sf0.1").sql("SELECT doc_id, toxic FROM labels").fetchall())
    out = sorted((r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth)
    pos = sum(y for _, y in out)
    below, wins = 0, 0
    for _, y in out:
        wins += below if y else 0
        below += 1 - y
    assert wins / (pos * (len(out) - pos)) > 0.9
