"""Ask Spark's analyzer for the plan of each distinct statement.

Statements are analyzed, never executed. The analyzer lives in the driver, so
texts stream through it in fixed-size batches and each batch is appended to a
table in the shared folder: the driver holds one batch at a time.
"""

from __future__ import annotations

import hashlib
import re
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colflow.session import materialize, new_path

RESULT = T.StructType(
    [
        T.StructField("fingerprint", T.StringType()),
        T.StructField("plan_json", T.StringType()),
        T.StructField("output_json", T.StringType()),
        T.StructField("written_table", T.StringType()),
        T.StructField("error_class", T.StringType()),
        T.StructField("sqlstate", T.StringType()),
        T.StructField("chain", T.ArrayType(T.StringType())),
        T.StructField("ancestors", T.ArrayType(T.StringType())),
    ]
)

STORED = T.StructType([*RESULT.fields, T.StructField("setting", T.StringType()), T.StructField("bucket", T.IntegerType())])


def _bucket() -> Column:
    return F.pmod(F.xxhash64("fingerprint"), F.lit(PlanStore.BUCKETS)).cast("int")


def catalog_mark(spark: SparkSession, catalog: DataFrame) -> str:
    """What an analysis depends on, as one hash: the catalog's columns, the texts of
    all views, the functions that users registered, and Spark's version."""
    columns = ["schema", "table", "column", "ordinal", "data_type"]
    total = F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")
    parts = [spark.version, catalog.select(*columns).distinct().agg(total).first()[0] or ""]
    state = spark._jsparkSession.sessionState().catalog()
    name = spark._jvm.org.apache.spark.sql.catalyst.TableIdentifier
    some = spark._jvm.scala.Option.apply
    for database in sorted(d.name for d in spark.catalog.listDatabases()):
        for view in sorted(r.viewName for r in spark.sql(f"show views in `{database}`").filter("not isTemporary").collect()):
            parts += [database, view, state.getTableMetadata(name(view, some(database))).viewText().get()]
        parts += sorted(r.function for r in spark.sql(f"show user functions in `{database}`").collect())
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


class PlanStore:
    """Plans kept between runs, in a table at ``path``: a text is analyzed once
    for each catalog and setting, by whichever run or driver sees it first.

    The catalog is known by ``catalog_mark`` at the time of each use, so a view that
    changes is seen by the next lookup; plans of an older state stay in the table but
    are not used. The table is laid out by setting and a bucket of the fingerprint: a
    lookup reads the buckets of its texts. Two drivers that analyze the same text at
    the same time store it twice; the readers take it once, and ``compact`` too.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str, catalog: DataFrame):
        self.spark, self.path, self.catalog = spark, path.rstrip("/"), catalog

    def setting(self, lenient: bool) -> str:
        return f"{catalog_mark(self.spark, self.catalog)}-{'lenient' if lenient else 'strict'}"

    def _generations(self) -> list[int]:
        """Numbers of the tables under ``path`` that are complete, ascending."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return []
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        numbers = sorted(int(n.removeprefix("plans-")) for n in names if n.startswith("plans-"))
        success = self.spark._jvm.org.apache.hadoop.fs.Path
        return [n for n in numbers if system.exists(success(f"{self.path}/plans-{n}/_SUCCESS"))]

    def _write(self, rows: DataFrame, generation: int) -> None:
        rows.write.mode("append").partitionBy("setting", "bucket").parquet(f"{self.path}/plans-{generation}")

    def known(self, lenient: bool, texts: DataFrame | None = None) -> DataFrame:
        """The stored plans of the present catalog, for ``texts(fingerprint)`` if given:
        only their buckets are read."""
        found = self._generations()
        if not found:
            return self.spark.createDataFrame([], RESULT)
        # the numbers are fixed, so a compaction by another driver does no harm
        stored = self.spark.read.schema(STORED).parquet(f"{self.path}/plans-{found[-1]}")
        stored = stored.filter(F.col("setting") == self.setting(lenient))
        if texts is not None:
            buckets = [r[0] for r in texts.select(_bucket()).distinct().collect()]  # BUCKETS numbers at most
            stored = stored.filter(F.col("bucket").isin(buckets)).join(texts.select("fingerprint"), "fingerprint", "left_semi")
        return stored.drop("setting", "bucket").dropDuplicates(["fingerprint"])

    def add(self, results: DataFrame, lenient: bool) -> None:
        rows = results.withColumns({"setting": F.lit(self.setting(lenient)), "bucket": _bucket()})
        # one file for each bucket that gets rows
        self._write(rows.repartition("bucket"), (self._generations() or [0])[-1])

    def compact(self) -> None:
        """Writes the plans of the present catalog anew, once each and one file to a
        bucket, as the next generation, and removes those before the last. A plan that
        another driver adds meanwhile may be lost, which costs its analysis."""
        found = self._generations()
        if not found:
            return
        present = [self.setting(lenient) for lenient in (False, True)]
        rows = self.spark.read.schema(STORED).parquet(f"{self.path}/plans-{found[-1]}").filter(F.col("setting").isin(present))
        self._write(rows.dropDuplicates(["setting", "fingerprint"]).repartition("bucket"), found[-1] + 1)
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for number in found[:-1]:
            system.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/plans-{number}"), True)


_UNKNOWN_ROUTINE = re.compile(r"\[UNRESOLVED_ROUTINE\].*?routine ((?:`[A-Za-z_]\w*`\.)*`[A-Za-z_]\w*`)")
# words the parser reports as routines although they belong to unsupported syntax
_NOT_A_ROUTINE = {"on", "distinct", "in", "all", "any", "some", "exists"}


def harvest_plans(
    spark: SparkSession,
    statements: DataFrame,
    lenient: bool = False,
    threads: int = 8,
    batch_size: int = 2000,
    store: PlanStore | None = None,
    shard: tuple[int, int] = (0, 1),
) -> tuple[DataFrame, DataFrame]:
    """``statements(fingerprint, sql, default_schema)`` to ``(plans, failures)``.

    The analysis has a session of its own: current schema, settings and stand-in
    functions stay there. It sees the catalog's tables and views, not the caller's
    temporary views. With a ``store`` only texts that it does not hold are
    analyzed, and added to it. ``shard=(i, n)`` takes the i-th of n shares of the
    texts, by hash, so that n drivers can share the work.
    """
    own = spark.newSession()
    i, n = shard
    statements = statements.filter(F.pmod(F.xxhash64("fingerprint"), F.lit(n)) == i)
    if store is not None:
        known = materialize(store.known(lenient, statements), "known-plans")
        statements = statements.join(known.select("fingerprint"), "fingerprint", "left_anti")
    path = new_path(spark, "harvest")
    # an empty first write fixes the schema, also when no statement arrives
    spark.createDataFrame([], RESULT).write.parquet(path)
    incoming = statements.select("fingerprint", "sql", "default_schema").toLocalIterator(prefetchPartitions=True)
    while batch := list(islice(incoming, batch_size)):
        rows = []
        # statements of one default schema are analyzed together: the current
        # schema is a property of the session
        by_schema: dict[str | None, list] = {}
        for row in batch:
            by_schema.setdefault(row.default_schema, []).append(row)
        for schema, group in by_schema.items():
            rows += _analyze_group(own, schema, group, lenient, threads)
        spark.createDataFrame(rows, RESULT).write.mode("append").parquet(path)
    results = spark.read.schema(RESULT).parquet(path)
    if store is not None:
        store.add(results, lenient)
        results = known.unionByName(results)
    ok = F.col("error_class").isNull()
    return (
        results.filter(ok).select("fingerprint", "plan_json", "output_json", "written_table"),
        results.filter(~ok).select("fingerprint", "error_class", "sqlstate", "chain", "ancestors"),
    )


def _analyze_group(spark, schema, rows, lenient, threads):
    try:
        spark.catalog.setCurrentDatabase(schema or "default")
        # "..." names a column, as in the reference's SQL dialect
        spark.conf.set("spark.sql.ansi.enabled", "true")
        spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
        # each level of nested names takes a pass of the analyzer
        spark.conf.set("spark.sql.analyzer.maxIterations", "10000")
        with ThreadPoolExecutor(threads) as pool:
            return list(pool.map(lambda r: _analyze(spark, r.fingerprint, r.sql, lenient), rows))
    except Exception as error:  # the schema itself does not exist
        return [_failure(r.fingerprint, error) for r in rows]


def _analyze(spark, fingerprint, sql, lenient):
    session = spark._jsparkSession
    skip = spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()
    spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(session)
    registered: set[str] = set()
    while True:
        try:
            state = session.sessionState()
            plan = state.executePlan(state.sqlParser().parsePlan(sql), skip).analyzed()
            written = None
            if plan.schema().isEmpty():
                # INSERT ... SELECT, CREATE TABLE ... AS SELECT: the lineage is
                # the query's; the table written is kept beside it
                written = _written_table(plan)
                try:
                    plan = plan.query()
                except Py4JError:
                    reason = f"statement has no query: {plan.nodeName()}"
                    return (fingerprint, None, None, None, "java.lang.IllegalArgumentException", None, [reason], [])
            return (fingerprint, plan.toJSON(), plan.schema().json(), written, None, None, None, None)
        except Exception as error:
            name = _unknown_routine(error) if lenient else None
            if name is None or name in registered:
                return _failure(fingerprint, error)
            # a lenient lookup lets unknown functions through: a stand-in with
            # any number of arguments; it is analyzed, never called
            registered.add(name)
            if "." in name:
                call = r"(?i)(?<![\w`.])" + r"\s*\.\s*".join(f"`?{part}`?" for part in name.split(".")) + r"\s*\("
                sql = re.sub(call, name.replace(".", "_") + "(", sql)
                name = name.replace(".", "_")
            spark.udf.register(name, lambda *args: None, T.StringType())


def _unknown_routine(error):
    found = _UNKNOWN_ROUTINE.search(str(error))
    name = found and found.group(1).replace("`", "")
    return name if name and name.lower() not in _NOT_A_ROUTINE else None


def _written_table(command):
    for field in ("catalogTable", "table"):
        try:
            table = getattr(command, field)()
            if table.getClass().getSimpleName() == "Some":
                table = table.get()
            identifier = table.identifier()
            return f"{identifier.database().get()}.{identifier.table()}"
        except Exception:
            continue
    return None


def _failure(fingerprint, error):
    java = error.java_exception if isinstance(error, Py4JJavaError) else getattr(error, "_origin", None)
    if java is None:
        above = [c.__name__ for c in type(error).__mro__[1:-1]]
        return (fingerprint, None, None, None, type(error).__name__, None, [str(error)], above)
    seen, cause = [], java
    while cause is not None and not any(cause.equals(c) for c in seen):  # a cause may lead back
        seen.append(cause)
        cause = cause.getCause()
    chain = [c.getMessage() for c in seen]
    ancestors, above = [], java.getClass().getSuperclass()
    while above is not None:
        ancestors.append(above.getName())
        above = above.getSuperclass()
    try:
        state = java.getSqlState()
    except Exception:
        state = None
    return (fingerprint, None, None, None, java.getClass().getName(), state, chain, ancestors)
