"""The registered closures ask about every node of their graph."""

import pytest

from colflow.workload.registry import QUERIES


@pytest.mark.parametrize("key", ["column_origins_graph", "upstream_closure"])
def test_every_part_is_a_root(spark, sf_dir, key):
    asked = QUERIES[key](spark, sf_dir).select("root").distinct()
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as root")
    assert parts.exceptAll(asked).isEmpty() and asked.exceptAll(parts).isEmpty()


def test_every_part_that_feeds_another_has_its_impact(spark, sf_dir):
    from colflow.workload.registry import _g

    asked = QUERIES["downstream_impact"](spark, sf_dir).select("root").distinct()
    feeding = _g(spark, sf_dir).selectExpr("from_id as root").distinct()
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as root")
    want = feeding.intersect(parts)
    assert want.exceptAll(asked).isEmpty() and asked.exceptAll(want).isEmpty()
