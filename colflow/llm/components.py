"""Connected components of a table of edges by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from colflow.session import materialize


def _low(edges: DataFrame) -> DataFrame:
    """Every node with the smallest of itself and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.selectExpr("v as u", "u as v"))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``low``, the smallest node it is connected with, for each node
    of ``edges`` (``u``, ``v``, in any direction, loops and repeats allowed).

    Alternating large and small stars (Kiveris et al., 2014): rounds grow with the
    logarithm of the number of nodes. A node's neighbours are never collected; each
    round is an aggregation and a join, stored before the next. The rounds end once
    the smaller end of every edge is the smallest that either end is next to.
    """
    oriented = edges.filter("u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v")
    now = materialize(oriented.distinct(), "edges")
    while True:
        both = _both(now)
        state = Observation()
        beside = both.join(materialize(_low(both), "low"), "u").observe(state, F.count_if(F.expr("m <> least(u, v)")).alias("n"))
        large = beside.filter("v > u").selectExpr("v as u", "m as v")
        large = materialize(large.filter("u <> v").distinct(), "edges")
        if not state.get["n"]:
            break
        down = large.selectExpr("greatest(u, v) as u", "least(u, v) as v")
        low = materialize(_low(down), "low")
        small = down.join(low, "u").selectExpr("v as u", "m as v").unionByName(low.selectExpr("u", "m as v"))
        now = materialize(small.filter("u <> v").distinct(), "edges")
    # every edge now leads from a node to the smallest of its component
    return now.selectExpr("u as node", "v as low").unionByName(now.selectExpr("v as node", "v as low").distinct())
