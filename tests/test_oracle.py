"""Every registered query against its DuckDB oracle.

Single-template lineage queries are checked together, per distinct text, in
test_templates; a few run here end to end.
"""

import pytest
from oracle import compare

from __spark_entry__ import entry, oracle_sql, queries
from colflow.workload.registry import ORACLES, QUERIES

END_TO_END = {"lineage_join_multiway", "lineage_insert_select", "lineage_view_stop", "lineage_fn_udf"}
KEYS = [k for k in QUERIES if not k.startswith("lineage_") or k in END_TO_END or k == "lineage_diff"]


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, duck, sf_dir, key):
    df = QUERIES[key](spark, sf_dir)
    assert compare(df, duck, ORACLES[key]) is None


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1


def test_running_twice_gives_the_same(spark, sf_dir):
    for key in ("column_origins", "source_columns"):
        first = {tuple(r) for r in QUERIES[key](spark, sf_dir).collect()}
        assert first == {tuple(r) for r in QUERIES[key](spark, sf_dir).collect()}
