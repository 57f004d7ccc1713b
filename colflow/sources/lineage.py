"""Statements in, lineage out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from colflow.plans.origins import lineage_of_plans, uniquify_targets
from colflow.session import materialize
from colflow.sources.harvest import PlanStore, harvest_plans
from colflow.sources.statements import distinct_fingerprints, fan_out, hot_texts, statement_fingerprint


@dataclass
class Lineage:
    """Results per statement; each frame is lazy over written tables."""

    targets: DataFrame
    origins: DataFrame
    failures: DataFrame


@dataclass
class Analysis:
    """Results per distinct text."""

    plans: DataFrame
    targets: DataFrame
    origins: DataFrame
    failures: DataFrame
    texts: DataFrame

    def of(self, statements: DataFrame) -> Lineage:
        """Results for ``statements(statement_id, text_key)``."""

        hot = hot_texts(self.texts)

        def spread(df: DataFrame) -> DataFrame:
            return fan_out(statements, self.texts, df, hot=hot)

        return Lineage(spread(self.targets), spread(self.origins), spread(self.failures))

    def rows_of(self, statements: DataFrame) -> DataFrame:
        """Output columns with their origins, one row per origin (one without
        for unknown and constant outputs). The two are joined per text, before
        the fan-out, where they are small."""
        rows = self.targets.join(
            self.origins.drop("target_column", "data_type"), ["fingerprint", "target_ordinal"], "left"
        ).join(self.plans.select("fingerprint", "written_table"), "fingerprint")
        return fan_out(statements, self.texts, rows)


def analyze_texts(
    spark: SparkSession,
    texts: DataFrame,
    lenient: bool = False,
    stop_at_views: bool = False,
    unique_names: bool = True,
    store: PlanStore | None = None,
) -> Analysis:
    """Analyze ``texts(text_key, fingerprint, sql, default_schema, statements)``.

    With ``unique_names`` repeated output names get a suffix, so that none is
    lost where names are keys. Plans come from the ``store``, if given, where it
    has them."""
    texts = materialize(texts, "texts")
    plans, failures = harvest_plans(spark, distinct_fingerprints(texts), lenient, store=store)
    targets, origins = lineage_of_plans(plans.withColumnRenamed("fingerprint", "plan_id"), stop_at_views)
    if unique_names:
        targets = materialize(uniquify_targets(targets, "plan_id"), "targets")
        names = targets.select("plan_id", "target_ordinal", "target_column")
        origins = origins.drop("target_column").join(names, ["plan_id", "target_ordinal"])
    return Analysis(
        plans,
        targets.withColumnRenamed("plan_id", "fingerprint"),
        origins.withColumnRenamed("plan_id", "fingerprint"),
        failures,
        texts,
    )


def analyze_statements(
    spark: SparkSession,
    statements: DataFrame,
    lenient: bool = False,
    stop_at_views: bool = False,
    unique_names: bool = True,
    store: PlanStore | None = None,
) -> Lineage:
    """``statements(statement_id, sql, default_schema)`` to their lineage."""
    marked, texts = statement_fingerprint(statements)
    return analyze_texts(spark, texts, lenient, stop_at_views, unique_names, store).of(marked)
