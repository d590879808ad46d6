from __future__ import annotations

import pytest

from keyweave.queries import ORACLES, QUERIES
from tests.oracle import assert_same, views

#: These learn programs and take long; each has a test of its own kind elsewhere.
SLOW = {"aj_composite", "aj_without_recovery"}


@pytest.fixture(scope="module")
def tables(sf_dir):
    return views(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES.keys() - SLOW))
def test_query_equals_its_sql(spark, sf_dir, tables, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLES[name], tables)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_other_queries_give_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_imports_without_the_corpus_operators(spark):
    import importlib
    import sys

    import __spark_entry__ as entry

    hidden = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("keyweave.llm") or k == "corpus_pipeline"}
    sys.modules["corpus_pipeline"] = None
    try:
        importlib.reload(entry)
        assert entry.queries().keys() == QUERIES.keys() and entry.oracle_sql().keys() == ORACLES.keys()
    finally:
        del sys.modules["corpus_pipeline"]
        sys.modules.update(hidden)
        importlib.reload(entry)


def test_distances_cover_every_type(spark, tmp_path):
    spark.range(1100).selectExpr("'lace' AS p_name", "concat('TYPE ', id) AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    assert QUERIES["dist_jaccard"](spark, str(tmp_path)).count() == 1100
