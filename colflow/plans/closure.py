"""Transitive closure over derivation edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colflow.session import BucketedRounds, cut


def path_ends(edges: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """Where the paths from each node end: ``(key, to_id, from_id, is_derived)``, with
    ``from_id`` among ``ends(key, attr_id)``, or null for a path that could not be
    traced further. A path is derived if any edge on it is.

    Paths double: a row is a path of exactly ``n`` edges that goes on, or one of up to
    ``n`` that has ended; joining those that go on with all rows gives the same for
    ``2n``. So the rounds grow with the logarithm of the depth. If a round ends no new
    path there is none: the last half of a shortest one would have ended in that
    round. So cycles end as well. All joins are inside ``key``
    (``partitioned_by_plan``), and each round is a checkpoint.
    """
    goes_on = edges.select(key, F.col("to_id").alias("from_id")).distinct()
    base = ends.select(key, F.col("attr_id").alias("from_id")).distinct()
    ended = edges.join(base, [key, "from_id"], "left_semi").unionByName(edges.filter("from_id is null"))
    columns = [key, "to_id", "from_id", "is_derived", "open"]
    paths = cut(
        edges.join(goes_on, [key, "from_id"], "left_semi").withColumn("open", F.lit(True))
        .unionByName(ended.withColumn("open", F.lit(False))).select(columns).distinct()
    )
    known = -1
    while True:
        count = {r.open: r.n for r in paths.groupBy("open").agg(F.count("*").alias("n")).collect()}
        if True not in count or count.get(False, 0) == known:
            return paths.filter(~F.col("open")).drop("open")
        known = count.get(False, 0)
        step = paths.select(
            key, F.col("to_id").alias("from_id"), F.col("from_id").alias("next"), F.col("is_derived").alias("step_derived"),
            F.col("open").alias("step_open"),
        )
        longer = paths.filter("open").join(step, [key, "from_id"]).select(
            key, "to_id", F.col("next").alias("from_id"), (F.col("is_derived") | F.col("step_derived")).alias("is_derived"),
            F.col("step_open").alias("open"),
        )
        paths = cut(paths.filter(~F.col("open")).unionByName(longer).distinct())


def closure(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """Everything reachable from ``starts(*keys, at, is_derived)``, starts included.

    ``edges(to_id, from_id, is_derived)``; a path is derived if any edge on it is. Each
    round joins only the rows the round before found and keeps what is new, so a cycle
    ends. Rows whose ``at`` is null (a step that could not be traced) lead nowhere
    and may repeat.

    What has been seen is one table (``BucketedRounds``), bucketed by the whole row: a
    round shuffles what it found, never the table, and no vertex or root is hot in it.
    The edges are joined by a shuffle of the last round, which adaptive execution
    splits at a hot vertex.
    """
    columns = starts.columns
    step = edges.select(
        F.col("to_id").alias("at"), F.col("from_id").alias("next"), F.col("is_derived").alias("step_derived")
    )
    seen = BucketedRounds(starts.distinct(), "closure")
    while seen.last_rows:
        found = (
            seen.last()
            .join(step, "at")
            .withColumn("is_derived", F.col("is_derived") | F.col("step_derived"))
            .withColumn("at", F.col("next"))
            .select(columns)
        )
        seen.add(new_rows(found, seen.all()))
    return seen.all()


def new_rows(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct rows of ``found`` that are not in ``seen``, a table bucketed by all its
    columns: one exchange, of ``found``, serves both. A row with a null is always new."""
    # a broadcast of ``seen`` would grow with the result
    return found.distinct().join(seen.hint("merge"), seen.columns, "left_anti")
