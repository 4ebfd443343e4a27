import corpus_pipeline as pipeline
from dealweave.llm.simhash import near_groups
from dealweave.llm.similar import similar_groups
from tests.llm.helpers import AWKWARD, documents, empty, prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stages(spark, docs, folder):
    out = []
    for n, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        out.append((name, docs))
    return out


def test_decisions_take_effect(spark, tmp_path):
    long, passage = prose(1, 300), prose(2, 60)
    near = long.replace(long.split()[50], "changedword", 1)
    texts = AWKWARD + [(20, long), (21, long.replace(" ", "  ")), (22, near), (30, prose(3, 100) + "\n" + passage), (31, prose(4, 100) + "\n" + passage), (None, prose(5, 50)), (40, prose(6, 90)), (40, prose(6, 90))]
    got = stages(spark, documents(spark, texts), tmp_path)
    ids = [{r.doc_id for r in df.select("doc_id").distinct().collect()} for _, df in got]
    assert [df.columns for _, df in got[:4]] == [COLUMNS] * 4
    assert ids[0] == {i for i, _ in texts} - {1, 2, 3, None} and 21 not in ids[1] and got[1][1].where("doc_id = 40").count() == 1
    assert ids[2] == ids[1] - {22} and ids[4] == ids[3]
    cut = got[3][1].where("doc_id = 31").first()
    assert passage not in cut.text and cut.n_chars == len(cut.text) and got[3][1].where("doc_id = 30").first().text == texts[11][1]


def test_empty_table(spark, tmp_path):
    assert [df.count() for _, df in stages(spark, empty(spark), tmp_path)] == [0] * 5


def test_near_copies_are_linked_by_fingerprint_and_by_similarity(spark):
    refrain, base = "one line that is sung over again\n" * 200, prose(1, 300)
    texts = [(1, refrain + prose(7, 20)), (2, refrain + prose(8, 20)), (3, base), (4, base.replace(base.split()[50], "changedword", 1)), (5, prose(9, 300))]
    docs = documents(spark, texts)
    prints = {r.doc_id: r.component_id for r in near_groups(docs).collect()}
    assert prints == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}  # the operator links 1 and 2 only, similarity 3 and 4 only
    assert similar_groups(docs).where("doc_id IN (1, 2)").isEmpty()
    assert {r.doc_id for r in pipeline.no_near_copies(spark, docs, "").collect()} == {1, 3, 5}
