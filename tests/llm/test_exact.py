import hashlib
import re
from collections import defaultdict

import pytest

import __spark_entry__ as entry_module
from dealweave.llm.exact_dedup import exact_groups
from tests.compare import DATA, compare, duck
from tests.llm.helpers import AWKWARD, documents, empty, prose, rows


@pytest.mark.parametrize("key", ["op7_exact_dedup", "op8_chat_format"])
def test_same_rows_as_sql(spark, key):
    sf = f"{DATA}/sf0.001"
    *_, problems = compare(spark, duck(sf), key, entry_module.queries()[key], entry_module.oracle_sql()[key], sf)
    assert not problems, problems


@pytest.mark.parametrize("bits", [32_768, 1 << 27])
def test_groups_match_brute_force(spark, bits):
    texts = AWKWARD + [(10 + i, prose(i % 7, 30).replace(" ", " " * (1 + i % 3))) for i in range(40)] + [(60, " "), (61, "word"), (61, "word"), (70, "same length a"), (71, "same length b")]
    groups = defaultdict(list)
    norm = {}
    for i, t in texts:
        norm[i] = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        groups[norm[i]].append(i)
    want = sorted((i, min(groups[norm[i]]), len(groups[norm[i]]), i == min(groups[norm[i]])) for i, _ in texts)
    got = exact_groups(documents(spark, texts), sieve_bits=bits, prefix_chars=12)
    assert rows(got, "doc_id", "keep_id", "group_size", "kept") == want


def test_null_ids_and_empty_table(spark):
    got = exact_groups(documents(spark, [(None, "a"), (5, "a"), (None, "only")])).collect()
    assert sorted((r.keep_id is None, r.group_size, r.kept) for r in got) == [(False, 2, False), (False, 2, True), (True, 1, True)]
    assert exact_groups(empty(spark)).count() == 0


def test_digest_column(spark, tmp_path):
    documents(spark, AWKWARD).write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(rows(entry_module.queries()["op7_exact_dedup"](spark, str(tmp_path)), "doc_id", "text_sha256"))
    assert got[3] == hashlib.sha256(b" ").hexdigest() and got[1] == got[2] == hashlib.sha256(b"").hexdigest()
