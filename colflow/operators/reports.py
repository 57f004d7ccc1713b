"""Reports over a whole corpus of statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colflow.plans.closure import closure
from colflow.session import materialize

SOURCE = ["source_schema", "source_table", "source_column"]


def column_usage(origins: DataFrame) -> DataFrame:
    """Statements using each source column, and its direct and derived uses.

    Collapsed to one row per (column, statement) first: counting statements is
    then a plain sum that combines map-side, however hot the column.
    """
    per_statement = origins.groupBy(*SOURCE, "statement_id").agg(
        F.count_if(~F.col("is_derived")).alias("direct"), F.count_if("is_derived").alias("derived")
    )
    return per_statement.groupBy(*SOURCE).agg(
        F.count("*").alias("statements"), F.sum("direct").alias("direct_uses"), F.sum("derived").alias("derived_uses")
    )


def table_lineage(origins: DataFrame) -> DataFrame:
    """Tables each statement reads; direct if nothing of the table is computed."""
    return origins.groupBy("statement_id", "source_schema", "source_table").agg(
        F.count_distinct("source_column").alias("columns_used"),
        F.bool_and(~F.col("is_derived")).alias("all_direct"),
    )


def unused_columns(catalog: DataFrame, origins: DataFrame) -> DataFrame:
    used = origins.select(
        F.col("source_schema").alias("schema"), F.col("source_table").alias("table"),
        F.col("source_column").alias("column"),
    ).distinct()
    return catalog.join(used, ["schema", "table", "column"], "left_anti")


def top_columns(origins: DataFrame, k: int) -> DataFrame:
    """The ``k`` most used columns of each table, ties included.

    The window sorts one row per catalog column, not per use."""
    usage = column_usage(origins).select(*SOURCE, "statements")
    place = F.rank().over(Window.partitionBy("source_schema", "source_table").orderBy(F.desc("statements")))
    return usage.withColumn("place", place).filter(F.col("place") <= k)


def upstream_closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Base columns (nothing further up) behind each root, over any number of
    statements: ``edges(to_id, from_id, is_derived)``, ``roots(root)``."""
    edges = materialize(edges, "edges")  # read once per round
    starts = roots.select("root", F.col("root").alias("at"), F.lit(False).alias("is_derived"))
    reached = closure(starts, edges)
    return reached.join(edges.select(F.col("to_id").alias("at")).distinct(), "at", "left_anti").select(
        "root", F.col("at").alias("base"), "is_derived"
    )


def downstream_impact(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Every column a change of the root reaches."""
    reverse = materialize(
        edges.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("from_id"), "is_derived"), "edges"
    )
    starts = roots.select("root", F.col("root").alias("at"), F.lit(False).alias("is_derived"))
    return (
        closure(starts, reverse)
        .filter(F.col("at") != F.col("root"))
        .select("root", F.col("at").alias("affected"), "is_derived")
    )


def lineage_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges added or removed between two runs: one aggregation over both."""
    key = ["statement_id", "target_column", *SOURCE, "is_derived"]
    both = before.select(*key, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        after.select(*key, F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    return (
        both.groupBy(*key)
        .agg(F.max("b").alias("b"), F.max("a").alias("a"))
        .filter("a <> b")
        .select(*key, F.when(F.col("a") == 1, "added").otherwise("removed").alias("change"))
    )


def co_used_tables(origins: DataFrame, table: str) -> DataFrame:
    """Tables read by the statements that read ``table``, with how many do.

    For one table at a time: listing all pairs of a statement's tables would
    grow with the square of their number.
    """
    reads = origins.select("statement_id", "source_schema", "source_table").distinct()
    with_table = reads.filter(F.concat_ws(".", "source_schema", "source_table") == table).select("statement_id")
    return (
        reads.join(with_table, "statement_id", "left_semi")
        .filter(F.concat_ws(".", "source_schema", "source_table") != table)
        .groupBy("source_schema", "source_table")
        .agg(F.count("*").alias("statements"))
    )


def co_used_pairs(origins: DataFrame, support: int) -> DataFrame:
    """Pairs of tables that at least ``support`` statements read together.

    A table of a frequent pair is read by as many statements itself: the others go
    first, and with them most of what a statement's pairs would be. Few tables pass
    a support worth the name, and a statement's pairs are of those only; the counts
    combine map-side.
    """
    name = F.concat_ws(".", "source_schema", "source_table")
    reads = origins.select("statement_id", name.alias("table")).distinct()
    often = reads.groupBy("table").agg(F.count("*").alias("n")).filter(F.col("n") >= support).select("table")
    reads = materialize(reads.join(often, "table", "left_semi"), "frequent-reads")
    other = reads.select("statement_id", F.col("table").alias("other"))
    return (
        reads.join(other, "statement_id")
        .filter("table < other")
        .groupBy("table", "other")
        .agg(F.count("*").alias("statements"))
        .filter(F.col("statements") >= support)
    )


def verify_direct(result: DataFrame, targets: DataFrame, origins: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Check lineage against data: per output column whose origins are all
    direct, how many distinct non-null values are not found in any of its
    source columns (none should be).

    ``tables`` are named with their schema, or without where that is clear. All
    columns are checked in one pass: values become (column, text) rows, and one
    aggregation, which combines before its shuffle, says of each where it was seen. Without an
    output to check the result is empty.
    """
    eligible = (
        origins.groupBy("target_ordinal", "target_column")
        .agg(
            F.bool_or("is_derived").alias("any_derived"),
            F.sort_array(F.collect_set(F.struct("source_schema", "source_table", "source_column"))).alias("sources"),
        )
        .filter("not any_derived")
        .join(targets.filter("status = 'mapped'").select("target_ordinal"), "target_ordinal")
        .orderBy("target_ordinal")
        .collect()  # one row per output column of the statement
    )

    def rows(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
        """(target_column, value as text) of the named columns."""
        cells = [F.struct(F.lit(t).alias("target_column"), F.col(c).cast("string").alias("v")) for t, c in pairs]
        return df.select(F.inline(F.array(*cells))).filter("v is not null")

    if not eligible:
        return result.sparkSession.createDataFrame([], "target_column string, missing_values long")
    by_table: dict[str, list[tuple[str, str]]] = {}
    for row in eligible:
        for source in row.sources:
            full = f"{source.source_schema}.{source.source_table}"
            name = full if full in tables else source.source_table
            by_table.setdefault(name, []).append((row.target_column, source.source_column))
    known = reduce(DataFrame.unionByName, [rows(tables[t], pairs) for t, pairs in by_table.items()])
    shown = rows(result, [(r.target_column, r.target_column) for r in eligible])
    return (
        shown.withColumn("known", F.lit(False))
        .unionByName(known.withColumn("known", F.lit(True)))
        .groupBy("target_column", "v")
        .agg(F.bool_or("known").alias("known"), F.bool_or(~F.col("known")).alias("shown"))
        .filter("shown")
        .groupBy("target_column")
        .agg(F.count_if(~F.col("known")).alias("missing_values"))
    )
