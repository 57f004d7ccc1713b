"""Shaping the answer: numbering, nested documents, text.

Documents and lines are one per statement or output column. What they collect
is a set of (source column, derived) pairs, so its size is bounded by the
catalog, and repeats are dropped before collecting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORIGIN_FIELDS = ["source_schema", "source_table", "source_column", "data_type", "is_derived"]

UNKNOWN_TEXT = "<unknown>"
CONSTANT_TEXT = "<no source column (literal/constant)>"
NAME_WIDTH = 24


def number_targets(targets: DataFrame, position: str = "pos") -> DataFrame:
    """1-based ordinal of each output column in output order."""
    order = Window.partitionBy("statement_id").orderBy(position)
    return targets.withColumn("target_ordinal", F.row_number().over(order).cast("int"))


def _origin_struct() -> Column:
    # the ordinal and type of the *output* column sit in the origin record
    return F.struct(
        F.array("source_schema", "source_table").alias("qualifiedNames"),
        (F.col("target_ordinal") - 1).alias("ordinalPosition"),
        F.col("source_column").alias("column"),
        F.col("data_type").alias("dataType"),
        F.col("is_derived").alias("isDerived"),
    )


def nest_response(targets: DataFrame, origins: DataFrame) -> DataFrame:
    """One document per statement. An unknown output has a null list of
    origins, a constant an empty one."""
    keys = ["statement_id", "target_ordinal"]
    listed = (
        origins.select(*keys, *ORIGIN_FIELDS)
        .distinct()
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(_origin_struct())).alias("listed"))
    )
    empty = F.array().cast(listed.schema["listed"].dataType)
    columns = targets.join(listed, keys, "left").select(
        "statement_id",
        F.struct(
            F.col("target_ordinal").alias("targetColumnOrdinalPosition"),
            F.col("target_column").alias("targetColumn"),
            F.when(F.col("status") != "unknown", F.coalesce("listed", empty)).alias("columnOrigins"),
        ).alias("lineage"),
    )
    return columns.groupBy("statement_id").agg(F.sort_array(F.collect_list("lineage")).alias("columnLineages"))


def response_json(nested: DataFrame) -> DataFrame:
    document = F.to_json(F.struct("columnLineages"), {"ignoreNullFields": "false"})
    return nested.select("statement_id", document.alias("response"))


def flatten_response(nested: DataFrame) -> DataFrame:
    """Documents back to rows; outputs without origins keep one row."""
    outputs = nested.select("statement_id", F.explode("columnLineages").alias("l"))
    return outputs.select(
        "statement_id",
        F.col("l.targetColumnOrdinalPosition").alias("target_ordinal"),
        F.col("l.targetColumn").alias("target_column"),
        F.when(F.col("l.columnOrigins").isNull(), "unknown")
        .when(F.size("l.columnOrigins") == 0, "constant")
        .otherwise("mapped")
        .alias("status"),
        F.explode_outer("l.columnOrigins").alias("o"),
    ).select(
        "statement_id", "target_ordinal", "target_column", "status",
        F.get("o.qualifiedNames", F.lit(0)).alias("source_schema"),
        F.get("o.qualifiedNames", F.lit(1)).alias("source_table"),
        F.col("o.column").alias("source_column"), F.col("o.dataType").alias("data_type"),
        F.col("o.isDerived").alias("is_derived"),
    )


def render_text(targets: DataFrame, origins: DataFrame) -> DataFrame:
    """``name <- [schema.table.column (derived), ...]``, one line per output."""
    keys = ["statement_id", "target_ordinal"]
    name = F.concat_ws(".", "source_schema", "source_table", "source_column")
    text = F.concat(name, F.when(F.col("is_derived"), " (derived)").otherwise(""))
    listed = (
        origins.select(*keys, text.alias("text"))
        .distinct()
        .groupBy(*keys)
        .agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("text")), ", "), F.lit("]")).alias("listed"))
    )
    padded = F.when(
        F.length("target_column") < NAME_WIDTH, F.rpad("target_column", NAME_WIDTH, " ")
    ).otherwise(F.col("target_column"))
    right = (
        F.when(F.col("status") == "unknown", UNKNOWN_TEXT)
        .when(F.col("status") == "constant", CONSTANT_TEXT)
        .otherwise(F.col("listed"))
    )
    return targets.join(listed, keys, "left").select(*keys, F.concat(padded, F.lit(" <- "), right).alias("line"))


def render_origin(origins: DataFrame) -> DataFrame:
    """``schema.table.column #ordinal type  (derived)``; the blanks are part
    of the format."""
    text = F.format_string(
        "%s.%s.%s #%d %s %s",
        "source_schema", "source_table", "source_column", F.col("target_ordinal") - 1, "data_type",
        F.when(F.col("is_derived"), " (derived)").otherwise(""),
    )
    return origins.withColumn("text", text)
