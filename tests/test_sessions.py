"""What a run leaves behind or keeps: sessions, plans, checkpoints, failures."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from colflow.operators import failures as fail
from colflow.operators import graph, reports
from colflow.plans.closure import closure
from colflow.session import cut, materialize, new_path, release, work_dir
from colflow.sources import harvest
from colflow.sources.catalog import CATALOG_SCHEMA, catalog_columns, register_catalog, spark_type
from colflow.sources.harvest import PlanStore, _failure, harvest_plans
from colflow.sources.lineage import analyze_statements
from colflow.sources.statements import read_lineage, write_lineage
from colflow.streaming.submissions import stream_lineage
from colflow.workload.corpora import lineage

TEXTS = "fingerprint string, sql string, default_schema string"
STATEMENTS = "statement_id long, sql string, default_schema string"


@pytest.fixture(scope="module")
def store_catalog(spark):
    rows = [("depot", "goods", c, i, "text") for i, c in enumerate(["a", "b"])] + [("depot", "odd", "u", 0, "uuid")]
    catalog = spark.createDataFrame(rows, CATALOG_SCHEMA)
    register_catalog(spark, catalog, work_dir(spark))
    return catalog


def test_lenient_runs_leave_no_function_and_no_setting(spark, store_catalog):
    before = (spark.catalog.currentDatabase(), spark.conf.get("spark.sql.ansi.enabled"))
    texts = spark.createDataFrame(
        [("1", "select guess_zz(a) as x from goods", "depot"), ("2", "select tools.guess_yy(a, b) as x from goods", "depot")], TEXTS
    )
    plans, failed = harvest_plans(spark, texts, lenient=True)
    assert plans.count() == 2 and failed.count() == 0
    plans, failed = harvest_plans(spark, texts)
    assert plans.count() == 0 and failed.count() == 2
    for call in ("guess_zz('a')", "tools_guess_yy('a')"):
        with pytest.raises(Exception, match="UNRESOLVED_ROUTINE"):
            spark.sql(f"select {call}")
    assert (spark.catalog.currentDatabase(), spark.conf.get("spark.sql.ansi.enabled")) == before


def test_plans_are_kept_and_shared(spark, store_catalog, monkeypatch):
    texts = spark.createDataFrame([(str(i), f"select a, {i} as n from goods", "depot") for i in range(20)] + [("bad", "selec", "depot")], TEXTS)
    path = new_path(spark, "plan-store")
    store = PlanStore(spark, path, store_catalog)
    whole = harvest_plans(spark, texts)[0].select("fingerprint").collect()
    parts = [{r.fingerprint for r in harvest_plans(spark, texts, store=store, shard=(i, 2))[0].collect()} for i in range(2)]
    assert parts[0] and parts[1] and not parts[0] & parts[1]
    assert parts[0] | parts[1] == {r.fingerprint for r in whole}

    def analyzed(*_):
        raise AssertionError("analyzed again")

    monkeypatch.setattr(harvest, "_analyze_group", analyzed)
    plans, failed = harvest_plans(spark, texts, store=PlanStore(spark, path, store_catalog))
    assert plans.count() == 20 and failed.count() == 1
    other = store_catalog.unionByName(spark.createDataFrame([("depot", "goods", "c", 2, "text")], CATALOG_SCHEMA))
    with pytest.raises(AssertionError, match="again"):
        harvest_plans(spark, texts, store=PlanStore(spark, path, other))


def test_a_changed_view_is_seen(spark, store_catalog):
    spark.sql("create or replace view depot.vv as select a as x from depot.goods")
    texts = spark.createDataFrame([(1, "select x from vv", "depot")], STATEMENTS)
    store = PlanStore(spark, new_path(spark, "plan-store"), store_catalog)

    def origin():
        return [r.source_column for r in analyze_statements(spark, texts, store=store).origins.collect()]

    try:
        assert origin() == ["a"] == origin()
        spark.sql("create or replace view depot.vv as select b as x from depot.goods")
        assert origin() == ["b"] == origin()
        assert store.known(False).count() == 1
    finally:
        spark.sql("drop view depot.vv")


def test_plan_store_reads_its_buckets_and_compacts(spark, store_catalog):
    path = new_path(spark, "plan-store")
    store = PlanStore(spark, path, store_catalog)
    for i in range(4):
        texts = spark.createDataFrame([(str(j), f"select a, {j} as n from goods", "depot") for j in range(i, i + 3)], TEXTS)
        harvest_plans(spark, texts, store=store)
    one = spark.createDataFrame([("3",)], "fingerprint string")
    files = lambda df: len(df.inputFiles())
    whole = spark.read.parquet(f"{path}/plans-0")
    read = store.known(False, one)
    assert [r.fingerprint for r in read.collect()] == ["3"]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(setting" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    # the same text added twice, as by two drivers
    store.add(store.known(False), False)
    before = files(whole)
    store.compact()
    assert files(spark.read.parquet(f"{path}/plans-1")) < files(spark.read.parquet(f"{path}/plans-0")) and before > 0
    assert store.known(False).count() == spark.read.parquet(f"{path}/plans-1").count() == 6
    store.compact()
    assert store._generations() == [1, 2] and store.known(False, one).count() == 1


def test_a_run_written_twice_or_killed_counts_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lineage")
    edges = spark.range(20).selectExpr("id as statement_id", "concat('s', id % 2) as source_schema")
    for _ in range(2):
        write_lineage(edges, path, "r1")
    write_lineage(edges.limit(5), path, "r2")
    rows = lambda: {r.run: r.n for r in read_lineage(spark, path, edges.schema).groupBy("run").agg(F.count("*").alias("n")).collect()}
    assert rows() == {"r1": 20, "r2": 5}
    broken = edges.withColumn("source_schema", F.expr("if(statement_id = 19, raise_error('killed'), source_schema)")).repartition(4)
    with pytest.raises(Exception, match="killed"):
        write_lineage(broken, path, "r1")
    assert rows() == {"r2": 5}
    write_lineage(edges, path, "r1")
    assert rows() == {"r1": 20, "r2": 5}
    with pytest.raises(ValueError, match="name"):
        write_lineage(edges, path, "../r3")


def test_stream_of_texts(spark, store_catalog, tmp_path):
    store = PlanStore(spark, new_path(spark, "plan-store"), store_catalog)
    incoming, out, failed = (str(tmp_path / n) for n in ("in", "out", "failed"))
    (tmp_path / "in").mkdir()

    def run(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(["statement_id", "sql", "default_schema"], r, strict=True))) for r in rows))
        stream = spark.readStream.schema(STATEMENTS).json(incoming)
        stream_lineage(stream, out, failed, str(tmp_path / "check"), store).awaitTermination()

    run("1.json", [(1, "select a as x from goods", "depot"), (2, "select nothing from goods", "depot")])
    run("2.json", [(3, "select a  as x from goods;", "depot"), (4, "select upper(b) as y from goods", "depot")])
    edges = {(r.statement_id, r.target_column, r.source_column, r.is_derived) for r in spark.read.parquet(out).collect()}
    assert edges == {(1, "x", "a", False), (3, "x", "a", False), (4, "y", "b", True)}
    assert [r.statement_id for r in spark.read.parquet(failed).collect()] == [2]
    assert store.known(False).count() == 3


def test_release_removes_checkpoints(spark):
    kept = spark.range(5)
    cut(kept)
    materialize(kept, "kept")
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert glob.glob(f"{folder}/rdd-*")
    release(spark)
    assert not glob.glob(f"{folder}/rdd-*") and not glob.glob(f"{work_dir(spark)}/kept-*")
    cut(spark.range(3)).count()


def test_types_of_the_catalog(spark):
    assert spark_type("numeric(18,2)") == "DECIMAL(18,2)" and spark_type("character(2)") == "CHAR(2)"
    assert spark_type("numeric") == "DECIMAL(38,18)" and spark_type("jsonb") == spark_type("USER-DEFINED") == "STRING"
    assert spark_type("array<int>") == "array<int>"
    rows = [("s", "t", "a", 1, "numeric", None, 5, 2), ("s", "t", "b", 2, "character varying", 7, None, None), ("s", "t", "c", 3, "integer", None, 32, 0)]
    schema = "table_schema string, table_name string, column_name string, ordinal_position int, data_type string"
    sized = spark.createDataFrame(rows, schema + ", character_maximum_length int, numeric_precision int, numeric_scale int")
    assert [r.data_type for r in catalog_columns(sized).orderBy("ordinal").collect()] == ["numeric(5,2)", "character varying(7)", "integer"]


def test_a_table_registered_again_has_its_new_columns(spark, tmp_path):
    place = f"{tmp_path}/it's"
    for kind in ("integer", "text"):
        register_catalog(spark, spark.createDataFrame([("again", "t", f"c_{kind}", 0, kind)], CATALOG_SCHEMA), place)
        assert spark.table("again.t").columns == [f"c_{kind}"]


class _Cause:
    """A Java exception as the bridge shows it."""

    def __init__(self, message, cause=None):
        self.message, self.cause = message, cause

    def getMessage(self):  # noqa: N802
        return self.message

    def getCause(self):  # noqa: N802
        return self.cause

    def equals(self, other):
        return self is other

    def getClass(self):  # noqa: N802
        return self

    def getName(self):  # noqa: N802
        return "org.x.Wrapper"

    def getSuperclass(self):  # noqa: N802
        return None


def test_a_message_deep_in_the_chain(spark):
    last = cause = _Cause("the reason")
    for _ in range(30):
        cause = _Cause(" ", cause)
    last.cause = cause  # and the chain leads back
    error = Exception()
    error._origin = cause
    row = _failure("f", error)
    assert len(row[6]) == 31
    df = spark.createDataFrame([("org.x.Wrapper", row[6])], "error_class string, chain array<string>")
    assert fail.root_message(df).first().message == "the reason"


def test_triage(spark):
    rows = [
        (1, "java.sql.SQLException", "42P01", 404, ["java.lang.Exception"]),
        (2, "org.x.PSQLException", "42P01", None, ["java.sql.SQLException"]),
        (3, "java.lang.NumberFormatException", None, None, ["java.lang.IllegalArgumentException"]),
        (4, "org.x.Other", "42601", 415, None),
        (5, "org.x.Outer$ParseException", None, None, []),
        (6, "org.x.Other", None, 415, None),
        (7, "org.x.Other", None, None, None),
    ]
    df = spark.createDataFrame(rows, "statement_id int, error_class string, sqlstate string, own_status int, ancestors array<string>")
    assert [r.status for r in fail.classify_failures(df).orderBy("statement_id").collect()] == [500, 500, 400, 400, 400, 415, 500]
    df = spark.createDataFrame([("a.Outer$Inner", [None, " "])], "error_class string, chain array<string>")
    assert fail.root_message(df).first().message == "Inner"
    bodies = spark.createDataFrame([(1, 404, None, None), (2, 500, "", "named"), (3, 400, "told", "named")], "statement_id int, status int, message string, error string")
    assert [r.text for r in fail.error_text(bodies).orderBy("statement_id").collect()] == ["HTTP 404 Not Found", "HTTP 500: named", "HTTP 400: told"]


def test_repeated_output_names(spark, store_catalog):
    statements = spark.createDataFrame([(1, "select a as x, b as x, a as x0 from goods", "depot")], STATEMENTS)
    result = analyze_statements(spark, statements)
    names = {r.target_ordinal: r.target_column for r in result.targets.collect()}
    assert len(set(names.values())) == 3 and names[1] == "x"
    assert {(r.target_column, r.source_column) for r in result.origins.collect()} == {(names[1], "a"), (names[2], "b"), (names[3], "a")}
    plain = analyze_statements(spark, statements, unique_names=False)
    assert [r.to for r in graph.mappings(plain.origins).orderBy("to").collect()] == ["tgt-1-x", "tgt-2-x", "tgt-3-x0"]


def test_a_column_repeated_in_a_set_operation(spark, store_catalog):
    sql = "select a, a from goods {} select b, a from goods"
    statements = spark.createDataFrame([(i, sql.format(op), "depot") for i, op in enumerate(["intersect", "except", "union all"])], STATEMENTS)
    origins = analyze_statements(spark, statements, unique_names=False).origins
    rows = {(r.statement_id, r.target_ordinal, r.source_column) for r in origins.collect()}
    assert rows == {(i, 1, c) for i in range(3) for c in "ab"} | {(i, 2, "a") for i in range(3)}


def test_nothing_to_verify(spark):
    origins = spark.createDataFrame([], "target_ordinal int, target_column string, source_schema string, source_table string, source_column string, is_derived boolean")
    targets = spark.createDataFrame([], "target_ordinal int, status string")
    assert reports.verify_direct(spark.range(3), targets, origins, {}).collect() == []


def test_values_are_looked_up_in_the_right_schema(spark):
    origins = spark.createDataFrame(
        [(1, "x", "s1", "t", "v", False), (2, "y", "s2", "t", "v", False)],
        "target_ordinal int, target_column string, source_schema string, source_table string, source_column string, is_derived boolean",
    )
    targets = spark.createDataFrame([(1, "mapped"), (2, "mapped")], "target_ordinal int, status string")
    tables = {"s1.t": spark.createDataFrame([(1,)], "v int"), "s2.t": spark.createDataFrame([(2,)], "v int")}
    result = spark.createDataFrame([(1, 2), (1, 1)], "x int, y int")
    assert {(r.target_column, r.missing_values) for r in reports.verify_direct(result, targets, origins, tables).collect()} == {("x", 0), ("y", 1)}


def test_closure_of_a_long_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("to_id"), (F.col("id") + 1).alias("from_id"), (F.col("id") == 7).alias("is_derived"))
    starts = spark.createDataFrame([(0, 0, False)], "root long, at long, is_derived boolean")
    reached = {r.at: r.is_derived for r in closure(starts, edges).collect()}
    assert len(reached) == 41 and not reached[7] and reached[8]


def test_release_forgets_the_analyses(spark, sf_dir):
    def rows():
        return sorted(map(repr, lineage(spark, sf_dir, "join_multiway").collect()))

    before = rows()
    release(spark)
    assert rows() == before != []
