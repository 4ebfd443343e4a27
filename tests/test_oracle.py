"""Registered queries against their reference SQL, on the smallest data folder.

By default the quick families run; ``ALL_QUERIES=1`` adds every key (several minutes)."""

import os

import pytest

import __spark_entry__ as entry_module
from tests.compare import DATA, compare, duck

SF = f"{DATA}/sf0.001"
# Keys that materialise the word index or the page features; they have fixture tests as well.
HEAVY = {"jon_04", "jon_05", "top_02", "top_03", "sco_02", "sco_03", "agg_09", "agg_10", "str_24", "pip_04", "win_07", "flt_10"}
QUICK = [
    k for k in entry_module.oracle_sql()
    if k not in HEAVY and (os.environ.get("ALL_QUERIES") or k.startswith(("flt_0", "agg_0", "win_0", "dat", "arr", "set", "jon_0", "jon_1", "src", "cls_1", "pip_1", "stm")))
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", QUICK + (sorted(HEAVY) if os.environ.get("ALL_QUERIES") else []))
def test_same_rows(spark, con, key):
    *_, problems = compare(spark, con, key, entry_module.queries()[key], entry_module.oracle_sql()[key], SF)
    assert not problems, problems


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "hours" in df.columns
