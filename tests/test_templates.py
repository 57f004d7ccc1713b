"""Lineage of each construct against the edges derived by hand."""

import pytest
from pyspark.sql import functions as F

from colflow.sources.lineage import analyze_statements
from colflow.workload import corpora
from colflow.workload.templates import TEMPLATES


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    corpora.prepare_catalog(spark, sf_dir)
    rows = {}
    for setting in {(t.stop_at_views, t.lenient) for t in TEMPLATES.values()}:
        keys = [k for k, t in TEMPLATES.items() if (t.stop_at_views, t.lenient) == setting]
        data = [(i, TEMPLATES[k].text().replace("{n}", "3"), "sample") for i, k in enumerate(keys)]
        statements = spark.createDataFrame(data, "statement_id long, sql string, default_schema string")
        result = analyze_statements(spark, statements, stop_at_views=setting[0], lenient=setting[1])
        assert result.failures.collect() == []
        joined = result.targets.join(
            result.origins.drop("target_column", "data_type"), ["statement_id", "target_ordinal"], "left"
        ).select("statement_id", "target_ordinal", "target_column", "status", "source_table", "source_column", "is_derived")
        for k in keys:
            rows[k] = set()
        for r in joined.collect():
            rows[keys[r.statement_id]].add(tuple(r)[1:])
    return rows


@pytest.mark.parametrize("key", list(TEMPLATES))
def test_template(found, key):
    assert found[key] == set(TEMPLATES[key].edges())


def test_origins_are_catalog_columns(spark, sf_dir):
    """Every origin names a real column, at its real place and type."""
    from colflow.sources.catalog import catalog_of_tables
    from colflow.workload.templates import TABLES

    catalog = catalog_of_tables(spark, "sample", {t: corpora.load(spark, sf_dir, t) for t in TABLES})
    origins = corpora.analysis(spark, sf_dir).origins
    keys = ["source_schema", "source_table", "source_column", "source_ordinal"]
    found = origins.join(catalog.toDF(*keys, "catalog_type"), keys, "left")
    assert found.filter("catalog_type is null").count() == 0
    # scalar types are spelled alike; nested ones are only compared by presence
    assert found.filter(~F.col("source_type").contains("{") & (F.col("source_type") != F.col("catalog_type"))).count() == 0


def test_status_agrees_with_origins(spark, sf_dir):
    a = corpora.analysis(spark, sf_dir)
    counts = a.targets.join(
        a.origins.groupBy("fingerprint", "target_ordinal").count(), ["fingerprint", "target_ordinal"], "left"
    )
    assert counts.filter("(status = 'mapped') <> (count is not null)").count() == 0
