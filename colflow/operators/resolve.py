"""Name resolution against the catalog.

No join here is forced to broadcast: the catalog is usually small, and then
adaptive execution broadcasts it from its measured size; a large one is
hash-joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_default_schema(refs: DataFrame) -> DataFrame:
    """An unqualified table belongs to its statement's default schema."""
    return refs.withColumn("ref_schema", F.coalesce("ref_schema", "default_schema"))


def missing_schema_report(statements: DataFrame, catalog: DataFrame) -> DataFrame:
    """Statements whose default schema the catalog does not have, with the text
    that says so. The list of schemas is a single value."""
    schemas = catalog.select("schema").distinct()
    available = schemas.agg(F.array_join(F.sort_array(F.collect_set("schema")), ", ")).scalar()
    return (
        statements.join(schemas, F.lower("default_schema") == F.lower("schema"), "left_anti")
        .select(
            "statement_id",
            F.concat(
                F.lit("schema not found: "), F.coalesce("default_schema", F.lit("")),
                F.lit(" (available: ["), available, F.lit("])"),
            ).alias("message"),
        )
    )


def _catalog_keys(catalog: DataFrame) -> DataFrame:
    return catalog.select(
        F.lower("schema").alias("k_schema"), F.lower("table").alias("k_table"), F.lower("column").alias("k_column"),
        F.col("schema").alias("source_schema"), F.col("table").alias("source_table"),
        F.col("column").alias("source_column"), F.col("ordinal").alias("source_ordinal"),
        F.col("data_type").alias("source_type"),
    )


def _matches():
    return (
        (F.lower("ref_schema") == F.col("k_schema"))
        & (F.lower("ref_table") == F.col("k_table"))
        & (F.lower("ref_column") == F.col("k_column"))
    )


def resolve_columns_ci(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Match names without regard to case; the catalog's spelling is returned."""
    return refs.join(_catalog_keys(catalog), _matches()).drop("k_schema", "k_table", "k_column")


def unresolved_refs(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    return refs.join(_catalog_keys(catalog), _matches(), "left_anti")


def ambiguous_refs(refs: DataFrame, scope: DataFrame) -> DataFrame:
    """Unqualified ``refs(statement_id, ref_column)`` that several of the
    statement's ``scope(statement_id, table, column)`` columns answer to.

    The scope is counted per name before the join, so the join is one to one.
    """
    answers = (
        scope.select("statement_id", "table", F.lower("column").alias("k_column"))
        .distinct()
        .groupBy("statement_id", "k_column")
        .agg(F.count("*").alias("matches"))
        .filter("matches > 1")
    )
    return (
        refs.select("statement_id", "ref_column", F.lower("ref_column").alias("k_column"))
        .distinct()
        .join(answers, ["statement_id", "k_column"])
        .drop("k_column")
    )
