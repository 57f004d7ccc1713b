"""Skew, normalisation and plan shape."""

import random
import re

from pyspark.sql import functions as F

from colflow import session
from colflow.functions.text import normalize_statement
from colflow.operators import reports
from colflow.plans.closure import closure, new_rows
from colflow.session import BucketedRounds
from colflow.sources.statements import fan_out, statement_fingerprint
from colflow.workload import corpora, star
from colflow.workload.registry import QUERIES


def test_fan_out_of_a_hot_text_is_whole(spark):
    n = 3000
    # a third of all statements are one text
    statements = spark.range(n).select(
        F.col("id").alias("statement_id"),
        F.when(F.col("id") % 3 == 0, "select 1").otherwise(F.concat(F.lit("select "), F.col("id") % 50)).alias("sql"),
        F.lit("s").alias("default_schema"),
    )
    marked, texts = statement_fingerprint(statements)
    results = texts.select("fingerprint").distinct().withColumn("edge", F.explode(F.array(F.lit("x"), F.lit("y"))))
    plain = fan_out(marked, texts, results)
    salted = fan_out(marked, texts, results, rows_per_salt=40)
    key = ["statement_id", "edge"]
    assert plain.count() == salted.count() == 2 * n
    assert salted.select(key).exceptAll(plain.select(key)).count() == 0
    assert salted.select(key).distinct().count() == 2 * n


def _normalize(sql):
    """The rule in plain Python."""
    part = re.compile(
        r"""('[^'\\]*(?:\\.[^'\\]*)*'|"[^"\\]*(?:\\.[^"\\]*)*"|`[^`]*`)|((?:\s|--[^\n]*|/\*.*?\*/)+)|(.)""", re.S
    )
    spaced = part.sub(lambda m: " " if m.group(2) else m.group(0), sql)
    return re.sub(r"[\s;]+$", "", spaced.strip(" "))


def test_normalisation_matches_plain_python(spark):
    rng = random.Random(7)
    pieces = [
        "select", "a", "'x  y'", '"Q  q"', "`b  b`", " ", "  ", "\n", "\t", "-- note\n", "/* c */", "/* * / ** */", "-",
        "/", "*", "'it\\'s'", ";", "''", "1", ",", "--", "'", "\"", "a/b",
    ]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "sql string")
    got = df.select("sql", normalize_statement(F.col("sql")).alias("n")).collect()
    wrong = [(r.sql, r.n, _normalize(r.sql)) for r in got if r.n != _normalize(r.sql)]
    assert wrong == []


def test_long_texts_are_normalised_whole(spark):
    text = "select '" + "x " * 50_000 + "' as t" + " " * 50_000 + "from y -- " + "z" * 50_000
    (row,) = spark.createDataFrame([(text,)], "sql string").select(normalize_statement(F.col("sql")).alias("n")).collect()
    assert row.n == "select '" + "x " * 50_000 + "' as t from y"


def test_scans_read_only_needed_columns(spark, sf_dir):
    plan = star.data_order_lines(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan
    assert "o_totalprice" not in plan


def test_texts_are_counted_by_hash_with_map_side_combine(spark):
    statements = spark.range(10).selectExpr("id as statement_id", "'select 1' as sql", "if(id > 5, '', null) as default_schema")
    marked, texts = statement_fingerprint(statements)
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2
    # no schema and an empty one are the same
    assert texts.count() == 1 and marked.select("text_key").distinct().count() == 1


def test_a_closure_does_not_shuffle_what_it_has_seen(spark):
    rows = spark.range(100).selectExpr("id as root", "id as at", "id % 2 = 0 as is_derived")
    seen = BucketedRounds(rows, "seen")
    seen.add(rows.selectExpr("root", "at + 1 as at", "is_derived"))
    assert seen.last_rows == 100 and seen.all().count() == 200 and seen.last().filter("at = 0").isEmpty()
    new = new_rows(rows.unionAll(rows), seen.all())
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "Broadcast" not in plan
    assert new.isEmpty()
    again = new_rows(rows.selectExpr("root", "at + 2 as at", "is_derived").union(rows), seen.all())
    assert again.count() == 100


def test_a_closure_over_a_hot_vertex_and_a_cycle_is_whole(spark):
    # every root leads to vertex 0, which leads on to a ring of three
    n = 400
    spokes = spark.range(1, n).selectExpr("id + 100 as to_id", "0L as from_id", "id % 3 = 0 as is_derived")
    ring = spark.createDataFrame([(0, 1, False), (1, 2, True), (2, 3, False), (3, 1, False)], spokes.schema)
    starts = spark.range(1, n).selectExpr("id as root", "id + 100 as at", "false as is_derived")
    got = {tuple(r) for r in closure(starts, spokes.unionAll(ring)).collect()}
    want = set()
    for root in range(1, n):
        todo = [(root + 100, False)]
        while todo:
            at, derived = todo.pop()
            if (root, at, derived) in want:
                continue
            want.add((root, at, derived))
            if at > 100:
                todo.append((0, derived or root % 3 == 0))
            for to_id, from_id, step in [(0, 1, False), (1, 2, True), (2, 3, False), (3, 1, False)]:
                if to_id == at:
                    todo.append((from_id, derived or step))
    assert got == want


def test_a_closure_of_nothing_and_over_nothing(spark):
    starts = spark.createDataFrame([("a", 1, False), ("a", 1, False), ("b", None, False)], "_round string, at long, is_derived boolean")
    edges = spark.createDataFrame([(1, None, True), (1, 2, False), (1, 2, False)], "to_id long, from_id long, is_derived boolean")
    same = {("a", 1, False), ("b", None, False)}
    for step in (edges.limit(0), edges.filter("to_id > 5")):
        assert {tuple(r) for r in closure(starts, step).collect()} == same
    assert closure(starts.filter("at > 5"), edges).isEmpty() and closure(starts.limit(0), edges).isEmpty()
    assert {tuple(r) for r in closure(starts, edges).collect()} == same | {("a", None, True), ("a", 2, False)}


def _lines(spark, folder, n):
    spark.range(n).selectExpr(
        "id div 4 as l_orderkey", "id % 50 as l_partkey", "cast(id % 4 as int) + 1 as l_linenumber",
        "if(id % 5 = 0, 'R', 'N') as l_returnflag",
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(50).selectExpr(
        "id as p_partkey", "concat('Brand#', id % 7) as p_brand", "cast(id % 9 as int) as p_size", "concat('T', id % 3) as p_type"
    ).write.parquet(f"{folder}/part.parquet")


def test_a_task_holds_a_bounded_number_of_lineage_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100, raising=False)
    _lines(spark, tmp_path, 4000)
    origins = corpora.from_sql(spark, str(tmp_path), corpora.O_SQL)
    for key, most in [("mappings", 250), ("source_columns", 250), ("visible_edges", 250)]:
        rows = QUERIES[key](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("part")).count()
        assert rows.agg(F.max("count")).first()[0] <= most, key
    assert QUERIES["row_ids"](spark, str(tmp_path)).select(origins.columns).exceptAll(origins).isEmpty()
    assert QUERIES["row_ids"](spark, str(tmp_path)).count() == origins.count() > 2000


def test_the_quarantine_broadcasts_no_failures(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100, raising=False)
    kinds = "array('error', 'view', 'signup', 'click', 'buy')"
    spark.range(1500).selectExpr("id as event_id", f"{kinds}[id % 5] as event_type").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(500).selectExpr("id as o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    split = QUERIES["quarantine_split"](spark, str(tmp_path))
    assert "Broadcast" not in split._jdf.queryExecution().executedPlan().toString()
    parts = split.groupBy("part", F.spark_partition_id().alias("at")).count()
    assert parts.agg(F.max("count")).first()[0] <= 250
    assert {tuple(r) for r in split.groupBy("part").count().collect()} == {("failed", 1500), ("good", 500)}


def test_direct_outputs_are_verified_by_one_aggregation(spark):
    table = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "a long, b string")
    result = spark.createDataFrame([(1, "x"), (3, "z"), (3, "z"), (None, None), (4, "x")], "p long, q string")
    targets = spark.createDataFrame([(1, "p", "mapped"), (2, "q", "mapped")], "target_ordinal int, target_column string, status string")
    origins = spark.createDataFrame(
        [(1, "p", "s", "t", "a", False), (2, "q", "s", "t", "b", False)],
        "target_ordinal int, target_column string, source_schema string, source_table string, source_column string, is_derived boolean",
    )
    got = reports.verify_direct(result, targets, origins, {"t": table})
    assert {tuple(r) for r in got.collect()} == {("p", 2), ("q", 1)}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
