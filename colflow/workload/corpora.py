"""Tables the queries run on, derived by Spark from the test tables.

``*_SQL`` strings are the same derivations for the oracle; both read whole
tables. Corpus letters follow the fixtures: T targets, O origins, G column
graph, F failures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colflow.functions.text import text_key
from colflow.session import deal, on_release, row_partitions, work_dir
from colflow.sources.catalog import catalog_of_tables, register_catalog
from colflow.sources.lineage import Analysis, analyze_texts
from colflow.sources.statements import fingerprint_texts, statement_fingerprint
from colflow.workload.templates import TABLES, TEMPLATES, VIEWS

SCHEMA = "sample"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---- statements: one per order and template ------------------------------

# how each order writes its statement: as is, broken over lines, or with a
# comment and a closing semicolon. One text per template and {n} remains
# after normalisation.
_LAYOUT_SQL = """case o_orderstatus
  when 'F' then text
  when 'O' then replace(text, ' from ', chr(10) || '    from' || chr(9))
  else '/* order */  ' || text || ' ;' end"""


# the number an order puts for {n}
_NUMBER_SQL = "o_custkey % 5 + 1"


def _written(picked: DataFrame) -> DataFrame:
    """``picked(..., text)`` to the statement as its order writes it."""
    return (
        picked.withColumn("text", F.replace("text", F.lit("{n}"), F.col("n").cast("string")))
        .withColumn("sql", F.expr(_LAYOUT_SQL))
        .withColumn("default_schema", F.lit(SCHEMA))
    )


def statements(spark: SparkSession, sf_dir: str, keys: list[str], orders: DataFrame | None = None) -> DataFrame:
    """``(statement_id, template, sql, default_schema)``; order k submits
    template k mod n, so one key alone is submitted by every order. ``orders`` may
    be a stream."""
    texts = F.array(*[F.lit(TEMPLATES[k].text()) for k in keys])
    picked = (
        (load(spark, sf_dir, "orders") if orders is None else orders)
        .select(F.col("o_orderkey").alias("statement_id"), "o_orderstatus", F.expr(_NUMBER_SQL).alias("n"))
        .withColumn("template", F.pmod("statement_id", F.lit(len(keys))).cast("int"))
        .withColumn("text", F.get(texts, "template"))
    )
    return _written(picked).select("statement_id", "template", "sql", "default_schema")


def all_texts(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    """The texts when every order submits every template. Orders that write
    alike are counted before the templates multiply them."""
    alike = load(spark, sf_dir, "orders").groupBy("o_orderstatus", F.expr(_NUMBER_SQL).alias("n")).agg(F.count("*").alias("statements"))
    texts = F.array(*[F.lit(TEMPLATES[k].text()) for k in keys])
    raw = (
        _written(alike.select("*", F.explode(texts).alias("text")))
        .withColumn("text_key", text_key(F.col("sql"), F.col("default_schema")))
        .groupBy("text_key", "sql", "default_schema")
        .agg(F.sum("statements").alias("statements"))
    )
    return fingerprint_texts(raw)


def prepare_catalog(spark: SparkSession, sf_dir: str) -> None:
    """Tables and views the statements are about, as empty catalog tables."""
    catalog = catalog_of_tables(spark, SCHEMA, {t: load(spark, sf_dir, t) for t in TABLES})
    register_catalog(spark, catalog, work_dir(spark))
    before = spark.catalog.currentDatabase()
    spark.catalog.setCurrentDatabase(SCHEMA)
    try:
        for name, text in VIEWS.items():
            spark.sql(f"create or replace view {SCHEMA}.{name} as {text}")
    finally:
        spark.catalog.setCurrentDatabase(before)


_analyses: dict[tuple, Analysis] = {}


@on_release
def _forget(spark: SparkSession) -> None:
    """The tables behind the kept analyses of this application are gone."""
    own = spark.sparkContext.applicationId
    for key in [key for key in _analyses if key[0] == own]:
        del _analyses[key]



def _analysis(spark: SparkSession, sf_dir: str, stop_at_views: bool, lenient: bool) -> Analysis:
    """All templates of one setting analyzed together: the number of rounds is
    that of the deepest statement, not the sum. Kept for the session."""
    key = (spark.sparkContext.applicationId, sf_dir, stop_at_views, lenient)
    if key not in _analyses:
        prepare_catalog(spark, sf_dir)
        names = [k for k, t in TEMPLATES.items() if (t.stop_at_views, t.lenient) == (stop_at_views, lenient)]
        _analyses[key] = analyze_texts(spark, all_texts(spark, sf_dir, names), lenient, stop_at_views)
    return _analyses[key]


def lineage(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Every order submits template ``key``: its output columns and origins."""
    template = TEMPLATES[key]
    marked, _ = statement_fingerprint(statements(spark, sf_dir, [key]))
    return _analysis(spark, sf_dir, template.stop_at_views, template.lenient).rows_of(marked)


def mixed_keys() -> list[str]:
    return [k for k, t in TEMPLATES.items() if not t.stop_at_views and not t.lenient]


def mixed_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order k submits template k mod n: all templates in one corpus."""
    marked, _ = statement_fingerprint(statements(spark, sf_dir, mixed_keys()))
    return marked


def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    return _analysis(spark, sf_dir, False, False)


# ---- O, T, G, F -----------------------------------------------------------

_O0_SQL = """
  select l_orderkey as statement_id, cast((l_linenumber - 1) % 3 + 1 as int) as target_ordinal,
         'sample' as source_schema, lower(replace(p_brand, '#', '_')) as source_table,
         concat('col_', cast(p_size as string)) as source_column,
         p_type as data_type, l_returnflag = 'R' as is_derived
  from lineitem join part on l_partkey = p_partkey"""

_T_FROM_O0_SQL = """
  select distinct statement_id, target_ordinal, concat('c', cast(target_ordinal as string)) as target_column,
         case when (statement_id * 7 + target_ordinal) % 11 = 0 then 'unknown'
              when (statement_id * 7 + target_ordinal) % 13 = 0 then 'constant' else 'mapped' end as status
  from o0"""

T_SQL = f"with o0 as ({_O0_SQL}) {_T_FROM_O0_SQL}"

_O_FROM_O0_SQL = """
  select distinct o0.*, t.target_column from o0 join t
    on t.statement_id = o0.statement_id and t.target_ordinal = o0.target_ordinal and t.status = 'mapped'"""

O_SQL = f"""
  with o0 as ({_O0_SQL}), t as ({_T_FROM_O0_SQL}){_O_FROM_O0_SQL}"""

G_SQL = """
  select p_partkey as to_id, cast(floor(p_partkey / 2) as bigint) as from_id, p_size % 2 = 1 as is_derived
  from part where p_partkey > 0
  union
  select p_partkey, cast(floor(p_partkey / 3) as bigint), p_size % 3 = 0 from part where p_partkey > 0"""

F_SQL = """
  select event_id as statement_id,
         case event_type when 'error' then 'org.x.ParseException' when 'view' then 'java.sql.SQLException'
              when 'signup' then 'org.x.Outer$Inner' when 'click' then 'java.lang.NumberFormatException'
              else 'org.x.Other' end as error_class,
         case event_type when 'click' then 'java.lang.IllegalArgumentException'
              when 'view' then 'java.lang.Exception' end as ancestor,
         case when event_id % 4 = 0 then '42P01' when event_id % 4 = 1 then '08006' end as sqlstate,
         cast(case event_id % 7 when 0 then 404 when 1 then 405 when 2 then 415 end as int) as own_status,
         case when event_id % 3 = 0 then cast(null as string) when event_id % 3 = 1 then '  '
              else concat('m', cast(event_id as string)) end as msg0,
         case when event_id % 5 = 0 then cast(null as string)
              else concat('cause', cast(event_id as string)) end as msg1
  from events"""

# catalog as a database would list it, with system schemas among the rest
I_SQL = """
  select distinct case p_size % 6 when 0 then 'pg_catalog' when 1 then 'information_schema'
           when 2 then concat('pg_temp_', cast(p_size as string)) when 3 then 'Sales' else 'sample' end as table_schema,
         lower(replace(p_brand, '#', '_')) as table_name, concat('col_', cast(p_size as string)) as column_name,
         cast(p_size as int) as ordinal_position, lower(p_type) as data_type
  from lineitem join part on l_partkey = p_partkey"""

# the catalog behind O: 25 tables, 50 columns each
C_SQL = """
  select 'sample' as "schema", lower(replace(p_brand, '#', '_')) as "table",
         concat('col_', cast(p_size as string)) as "column", cast(p_size - 1 as int) as "ordinal",
         min(lower(p_type)) as data_type
  from part group by p_brand, p_size"""

# names as statements write them: any case, schema often left out, some wrong
R_SQL = """
  select distinct l_orderkey as statement_id,
         case when l_linenumber % 2 = 0 then null when l_linenumber % 3 = 0 then 'SAMPLE' else 'Sample' end as ref_schema,
         case when l_returnflag = 'R' then upper(replace(p_brand, '#', '_')) else replace(p_brand, '#', '_') end as ref_table,
         case when l_linestatus = 'F' then concat('COL_', cast(p_size as string))
              else concat('Col_', cast(p_size + l_linenumber - 1 as string)) end as ref_column,
         'sample' as default_schema
  from lineitem join part on l_partkey = p_partkey"""


def from_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a corpus derivation over the test tables (ANSI quotes to Spark's)."""
    used = [t for t in TABLES if f" {t}" in sql]
    for t in used:
        sql = sql.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
    return spark.sql(sql.replace('"', "`"), **{t: load(spark, sf_dir, t) for t in used})


def lineage_partitions(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for work on rows of T and O, of which there are as many as lines."""
    return row_partitions(load(spark, sf_dir, "lineitem"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines behind T and O, dealt by output: the ``distinct`` and the join of both
    derivations lie on that partitioning, and a task holds a bounded number of rows."""
    return deal(from_sql(spark, sf_dir, _O0_SQL), lineage_partitions(spark, sf_dir), "statement_id", "target_ordinal")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``T_SQL``, step by step."""
    return spark.sql(_T_FROM_O0_SQL.replace("from o0", "from {o0}"), o0=_lines(spark, sf_dir))


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``O_SQL``, step by step."""
    sql = _O_FROM_O0_SQL.replace("from o0 join t", "from {o0} as o0 join {t} as t")
    # ``t`` is of the size of ``o0``, and both lie together: nothing to broadcast
    return spark.sql(sql, o0=_lines(spark, sf_dir), t=targets(spark, sf_dir).hint("merge"))
