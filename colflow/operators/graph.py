"""The source-to-target graph of each statement.

Every operator keys by ``statement_id``: target names repeat across
statements. Joins are on the whole row id, so they shuffle by a fine key; a caller
who knows the number of rows gives the ``partitions`` of these joins, so that a task's
rows do not grow with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colflow.functions.text import source_row_id, target_row_id
from colflow.session import deal


def row_ids(origins: DataFrame) -> DataFrame:
    return origins.withColumn(
        "source_id", source_row_id(F.col("source_schema"), F.col("source_table"), F.col("source_column"))
    ).withColumn("target_id", target_row_id(F.col("target_ordinal"), F.col("target_column")))


def mappings(origins: DataFrame) -> DataFrame:
    """One edge per (source column, output column); derived ones are dashed.
    Unknown and constant outputs have no origin row, hence no edge."""
    return row_ids(origins).select(
        "statement_id",
        F.col("source_id").alias("from"),
        F.col("target_id").alias("to"),
        F.when(F.col("is_derived"), "derived").otherwise("direct").alias("label"),
        F.col("is_derived").alias("dashed"),
    )


def source_columns(origins: DataFrame) -> DataFrame:
    """Each source column once, with its lowest output ordinal (0-based) and
    the type it has there; by name where several types share that ordinal."""
    ordinal = F.col("target_ordinal") - 1
    return origins.groupBy("statement_id", "source_schema", "source_table", "source_column").agg(
        F.min(ordinal).alias("ordinal"),
        F.min_by("data_type", F.struct(ordinal, F.col("data_type"))).alias("data_type"),
    )


def order_source_columns(columns: DataFrame) -> DataFrame:
    """Position of each column in its table's card."""
    card = Window.partitionBy("statement_id", "source_schema", "source_table").orderBy("ordinal", "source_column")
    return columns.withColumn("position", F.row_number().over(card).cast("int"))


def order_source_tables(columns: DataFrame) -> DataFrame:
    """Position of each table by its lowest column ordinal."""
    tables = columns.groupBy("statement_id", "source_schema", "source_table").agg(F.min("ordinal").alias("ordinal"))
    place = Window.partitionBy("statement_id").orderBy("ordinal", "source_schema", "source_table")
    return tables.withColumn("position", F.row_number().over(place).cast("int"))


def split_qualified_name(paths: DataFrame, path: str = "path") -> DataFrame:
    """A table path (list of names) to schema prefix, table and card title."""
    p = F.col(path)
    schema = F.array_join(F.slice(p, 1, F.size(p) - 1), ".")
    return (
        paths.withColumn("schema", schema)
        .withColumn("table", F.element_at(p, -1))
        .withColumn("kind", F.when(schema != "", F.concat(F.lit("source: "), schema)).otherwise("source"))
    )


def target_rows(targets: DataFrame) -> DataFrame:
    """Rows of the target card, tagged ``#ordinal``."""
    return targets.select(
        "statement_id", "target_ordinal", target_row_id(F.col("target_ordinal"), F.col("target_column")).alias("row_id"), "target_column",
        F.concat(F.lit("#"), F.col("target_ordinal").cast("string")).alias("tag"),
    )


def graph_rows(targets: DataFrame, columns: DataFrame) -> DataFrame:
    """All rows of the picture: ``(statement_id, row_id, table_id)``."""
    sources = columns.select(
        "statement_id",
        source_row_id(F.col("source_schema"), F.col("source_table"), F.col("source_column")).alias("row_id"),
        F.concat_ws(".", "source_schema", "source_table").alias("table_id"),
    )
    outputs = target_rows(targets).select("statement_id", "row_id", F.lit("target-id").alias("table_id")).distinct()
    return sources.unionByName(outputs)


def _both_ends(edges: DataFrame, rows: DataFrame, partitions: int | None) -> DataFrame:
    ends = deal(rows.select("statement_id", "row_id"), partitions, "statement_id", "row_id").distinct()
    for end in ("from", "to"):
        keys = ["statement_id", end]
        edges = deal(edges, partitions, *keys).join(ends.withColumnRenamed("row_id", end), keys, "left_semi")
    return edges


def drop_dangling_edges(edges: DataFrame, rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """An edge is drawn only if both its rows exist."""
    return _both_ends(edges, rows, partitions)


def focus_column(
    edges: DataFrame, is_focus: Column | None = None, focus: DataFrame | None = None, partitions: int | None = None
) -> DataFrame:
    """Rows to keep when one column per statement is in focus: the column and
    its neighbours, either way.

    ``focus(statement_id, row_id)`` names the columns; without it the same row
    id is in focus everywhere, given as a condition on ``row_id``.
    """
    ends = edges.select("statement_id", F.col("from").alias("row_id"), F.col("to").alias("other")).unionByName(
        edges.select("statement_id", F.col("to").alias("row_id"), F.col("from").alias("other"))
    )
    if focus is None:
        hit = ends.filter(is_focus)
        itself = hit.select("statement_id", "row_id")
    else:
        keys = ["statement_id", "row_id"]
        hit = deal(ends, partitions, *keys).join(deal(focus, partitions, *keys), keys, "left_semi")
        # a column without edges stays in view too
        itself = focus.select("statement_id", "row_id")
    both = itself.unionByName(hit.select("statement_id", F.col("other").alias("row_id")))
    return deal(both, partitions, "statement_id", "row_id").distinct()


def visible_tables(rows: DataFrame, keep: DataFrame, partitions: int | None = None) -> DataFrame:
    """Tables with at least one kept row."""
    keys = ["statement_id", "row_id"]
    kept = deal(rows, partitions, *keys).join(deal(keep, partitions, *keys), keys, "left_semi")
    return deal(kept.select("statement_id", "table_id"), partitions, "statement_id").distinct()


def visible_edges(edges: DataFrame, keep: DataFrame, partitions: int | None = None) -> DataFrame:
    return _both_ends(edges, keep, partitions)


def highlight_pairs(edges: DataFrame) -> DataFrame:
    """For each row, the rows one edge away."""
    there = edges.select("statement_id", F.col("from").alias("row_id"), F.col("to").alias("linked_id"))
    back = edges.select("statement_id", F.col("to").alias("row_id"), F.col("from").alias("linked_id"))
    return there.unionByName(back).distinct()


def qualified_name(rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``schema.table.column`` of a source row; null for a target row."""
    name = F.when(F.col(row_id).startswith("src-"), F.expr(f"substring({row_id}, 5)"))
    return rows.withColumn("qualified_name", name)
