"""Origins of every output column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colflow.plans.closure import path_ends
from colflow.plans.edges import PlanGraph
from colflow.session import materialize, partitioned_by_plan


def column_origins(
    attr_edges: DataFrame, attr_bases: DataFrame, targets: DataFrame, key: str = "plan_id"
) -> tuple[DataFrame, DataFrame]:
    """``(origins, unknown)``: source columns per output column, and the output
    columns some part of which could not be traced."""
    reached = (
        path_ends(attr_edges, attr_bases, key)
        .withColumnsRenamed({"to_id": "attr_id", "from_id": "at"})
        .join(targets.select(key, "target_ordinal", "attr_id"), [key, "attr_id"])
        .drop("attr_id")
    )
    unknown = reached.filter("at is null").select(key, "target_ordinal").distinct()
    found = reached.join(attr_bases.withColumnRenamed("attr_id", "at"), [key, "at"]).join(
        targets.select(key, "target_ordinal", "target_column", "data_type"), [key, "target_ordinal"]
    )
    origins = dedupe_origins(
        found.select(
            key, "target_ordinal", "target_column", "source_schema", "source_table", "source_column",
            "data_type", "source_ordinal", "source_type", "is_derived",
        )
    )
    return origins, unknown


def origin_status(targets: DataFrame, origins: DataFrame, unknown: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``status``: unknown, constant (no source column) or mapped."""
    has_origin = origins.select(*keys).distinct().withColumn("has_origin", F.lit(True))
    is_unknown = unknown.select(*keys).distinct().withColumn("is_unknown", F.lit(True))
    return (
        targets.join(has_origin, keys, "left")
        .join(is_unknown, keys, "left")
        .withColumn(
            "status",
            F.when(F.col("is_unknown"), "unknown").when(F.col("has_origin"), "mapped").otherwise("constant"),
        )
        .drop("has_origin", "is_unknown")
    )


def dedupe_origins(origins: DataFrame) -> DataFrame:
    """Set semantics; a column both passed through and computed keeps two rows."""
    return origins.distinct()


def lineage_of_plans(plans: DataFrame, stop_at_views: bool = False) -> tuple[DataFrame, DataFrame]:
    """``plans(plan_id, plan_json, output_json)`` to ``(targets, origins)``.

    An output column that is unknown has no origins: a partial list would
    look complete.
    """
    graph = PlanGraph(plans, stop_at_views)
    keys = ["plan_id", "target_ordinal"]
    with partitioned_by_plan(plans.sparkSession, graph.partitions):
        origins, unknown = column_origins(graph.edges, graph.bases, graph.targets)
        # small per-text tables: written, so that later joins know their size
        targets = materialize(origin_status(graph.targets, origins, unknown, keys).drop("attr_id"), "targets")
        origins = materialize(origins.join(unknown, keys, "left_anti"), "origins")
    return targets, origins


def collapse_duplicate_targets(targets: DataFrame, key: str = "statement_id") -> DataFrame:
    """Repeated output names as an insertion-ordered map keeps them: the first
    position, the last column's origins, then renumbered from 1."""
    kept = targets.groupBy(key, "target_column").agg(
        F.min("target_ordinal").alias("first_ordinal"), F.max("target_ordinal").alias("origin_ordinal")
    )
    position = F.row_number().over(Window.partitionBy(key).orderBy("first_ordinal")).cast("int")
    return kept.select(key, position.alias("target_ordinal"), "target_column", "origin_ordinal")


def uniquify_targets(targets: DataFrame, key: str = "statement_id") -> DataFrame:
    """Repeated names get a numeric suffix (from 0, in output order), so that
    no output column is lost.

    A suffixed name may meet another column's name; it is then renamed again.
    A column that has its name to itself keeps it for good, so every round
    settles at least one column of each clashing name. Only what still clashes
    goes through another round.
    """
    clash = Window.partitionBy(key, "target_column").orderBy("renamed", "target_ordinal")
    copy = F.row_number().over(clash) - 2
    named, settled = targets.withColumn("renamed", F.lit(0)), []
    while True:
        repeated = named.groupBy(key, "target_column").count().filter("count > 1").select(key).distinct()
        repeated = materialize(repeated, "repeated-names")
        if repeated.isEmpty():
            return reduce(DataFrame.unionByName, [*settled, named]).drop("renamed")
        settled.append(named.join(repeated, key, "left_anti"))
        named = (
            named.join(repeated, key, "left_semi")
            .withColumn("copy", copy)
            .withColumn("renamed", F.when(F.col("copy") >= 0, F.col("renamed") + 1).otherwise(F.lit(0)))
            .withColumn(
                "target_column",
                F.when(F.col("copy") >= 0, F.concat("target_column", F.col("copy").cast("string")))
                .otherwise(F.col("target_column")),
            )
            .drop("copy")
        )
        named = materialize(named, "unique-names")
