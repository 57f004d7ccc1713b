"""Every query with its oracle.

A query is ``(spark, sf_dir) -> DataFrame``; its oracle is the same answer in
DuckDB SQL over the same tables. The operator's part is written independently of
the Spark code; where an operator runs on a derived table (T, O, G, F, I, R), both
sides share the text of that derivation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colflow.operators import failures as fail
from colflow.operators import graph, reports, resolve, shape
from colflow.plans import origins as org
from colflow.plans.closure import closure
from colflow.plans.edges import PlanGraph, extract_attr_edges, extract_bases, extract_targets
from colflow.plans.flatten import flatten_plans
from colflow.session import deal, materialize, new_path, row_partitions
from colflow.sources import catalog as cat
from colflow.sources.harvest import PlanStore
from colflow.sources.statements import (
    distinct_fingerprints,
    fan_out,
    read_lineage,
    read_statements,
    statement_fingerprint,
    write_lineage,
)
from colflow.streaming.submissions import stream_lineage
from colflow.workload import corpora, star
from colflow.workload.corpora import C_SQL, F_SQL, G_SQL, I_SQL, O_SQL, R_SQL, T_SQL, from_sql, load
from colflow.workload.templates import DUCKDB_TEXT, TABLES, TEMPLATES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def register(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if oracle is not None:
            ORACLES[key] = oracle
        return function

    return register


# ---- corpora as frames ------------------------------------------------------


def _t(spark, sf):
    return corpora.targets(spark, sf)


def _o(spark, sf):
    return corpora.origins(spark, sf)


def _o_by_statement(spark, sf):
    """O for what groups inside statements: dealt once, no group shuffles it again."""
    return deal(_o(spark, sf), corpora.lineage_partitions(spark, sf), "statement_id")


def _g(spark, sf):
    return from_sql(spark, sf, G_SQL)


def _c(spark, sf):
    return from_sql(spark, sf, C_SQL)


def _r(spark, sf):
    return from_sql(spark, sf, R_SQL)


def _f(spark, sf):
    ancestors = F.when(F.col("ancestor").isNotNull(), F.array("ancestor"))
    return from_sql(spark, sf, F_SQL).select(
        "statement_id", "error_class", "sqlstate", "own_status", ancestors.alias("ancestors"), F.array("msg0", "msg1").alias("chain")
    )


def _with(**parts: str) -> str:
    # tables that an oracle names several times are worked out once
    once = {name: "materialized " if name in ("t", "o", "e", "w") else "" for name in parts}
    return "with recursive " + ", ".join(f"{name} as {once[name]}({sql})" for name, sql in parts.items()) + " "


# ---- sources, catalog, sinks ------------------------------------------------


@query(
    _with(i=I_SQL)
    + """select table_schema as "schema", table_name as "table", column_name as "column",
         cast(ordinal_position - 1 as int) as "ordinal", data_type from i where table_schema in ('Sales', 'sample')"""
)
def catalog_columns(spark, sf):
    return cat.catalog_columns(from_sql(spark, sf, I_SQL))


@query(
    """select l_orderkey, l_linenumber, case n % 5 when 0 then 'pg_catalog' when 1 then 'information_schema'
         when 2 then 'pg_temp_' || n else 's' || n end as schema_name
       from (select l_orderkey, l_linenumber, l_suppkey % 20 as n from lineitem) where n % 5 > 2"""
)
def filter_system_schemas(spark, sf):
    n = (F.col("l_suppkey") % 20).alias("n")
    named = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", n).select(
        "l_orderkey", "l_linenumber",
        F.expr("case n % 5 when 0 then 'pg_catalog' when 1 then 'information_schema'"
               " when 2 then 'pg_temp_' || n else 's' || n end").alias("schema_name"),
    )
    return cat.filter_system_schemas(named, "schema_name")


@query(
    _with(i=I_SQL)
    + """select 'named' as run, table_schema, count(*) as columns from i where table_schema = 'Sales' group by all
         union all select 'all', table_schema, count(*) from i group by all"""
)
def restrict_schemas(spark, sf):
    rows = from_sql(spark, sf, I_SQL)
    runs = [("named", ["Sales"]), ("all", [])]
    named, everything = (
        cat.restrict_schemas(rows, names, "table_schema")
        .groupBy("table_schema")
        .agg(F.count("*").alias("columns"))
        .withColumn("run", F.lit(run))
        for run, names in runs
    )
    return named.unionByName(everything)


@query(
    r"""select conv_id * 1000 + turn as statement_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as sql,
          role as default_schema from conversations"""
)
def read_statements_json(spark, sf):
    path = new_path(spark, "requests")
    load(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("statement_id"),
        F.concat(F.lit(" \n "), "text", F.lit("\t ")).alias("sql"),
        F.lit("jdbc:postgresql://db").alias("connectionString"),
        F.lit(" secret ").alias("password"),
        F.concat(F.lit(" "), "role").alias("schema"),
    ).write.json(path)
    return read_statements(spark, path, "json")[0]


@query(
    """select cast(null as bigint) as statement_id, cast(null as varchar) as sql,
           sha256('{"statement_id": ' || (conv_id * 1000 + turn) || ', "sql": "select') as record from conversations where turn % 3 = 0
         union all
         select conv_id * 1000 + turn, 'select ' || turn, null from conversations where turn % 3 <> 0""",
    name="read_statements_unreadable",
)
def _read_statements_unreadable(spark, sf):
    # every third request breaks off
    path = new_path(spark, "requests")
    load(spark, sf, "conversations").select(
        F.concat(
            F.lit('{"statement_id": '), F.expr("cast(conv_id * 1000 + turn as string)"), F.lit(', "sql": "select'),
            F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.col("turn").cast("string"), F.lit('"}'))),
        )
    ).write.text(path)
    good, failed = read_statements(spark, path)
    return good.select("statement_id", "sql", F.lit(None).cast("string").alias("record")).unionByName(
        failed.select(F.lit(None).cast("long").alias("statement_id"), F.lit(None).cast("string").alias("sql"), "record")
    )


QUERIES["read_statements"] = QUERIES.pop("read_statements_json")
ORACLES["read_statements"] = ORACLES.pop("read_statements_json")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _mixed_texts() -> str:
    rows = ", ".join(f"({i}, {_literal(TEMPLATES[k].text())})" for i, k in enumerate(corpora.mixed_keys()))
    return f"(values {rows}) as v(template, text)"


@query(
    f"""select sha256('sample' || chr(10) || replace(text, '{{n}}', cast(o_custkey % 5 + 1 as varchar))) as fingerprint,
          count(*) as statements
        from orders join {_mixed_texts()} on o_orderkey % {len(corpora.mixed_keys())} = template group by 1"""
)
def statement_fingerprint_counts(spark, sf):
    _, texts = statement_fingerprint(corpora.statements(spark, sf, corpora.mixed_keys()))
    return distinct_fingerprints(texts).select("fingerprint", "statements")


QUERIES["statement_fingerprint"] = QUERIES.pop("statement_fingerprint_counts")
ORACLES["statement_fingerprint"] = ORACLES.pop("statement_fingerprint_counts")


@query(O_SQL)
def write_lineage_parquet(spark, sf):
    path = new_path(spark, "lineage")
    origins = _o(spark, sf)
    # the second attempt replaces the first
    for _ in range(2):
        write_lineage(origins, path, "first")
    return read_lineage(spark, path, origins.schema).drop("run")


QUERIES["write_lineage"] = QUERIES.pop("write_lineage_parquet")
ORACLES["write_lineage"] = ORACLES.pop("write_lineage_parquet")


# ---- name resolution --------------------------------------------------------


@query(
    _with(r=R_SQL)
    + """select statement_id, coalesce(ref_schema, default_schema) as ref_schema, ref_table, ref_column, default_schema
         from r"""
)
def resolve_default_schema(spark, sf):
    return resolve.resolve_default_schema(_r(spark, sf))


_SUBMITTED = """select o_orderkey as statement_id, case o_orderstatus when 'F' then 'SAMPLE' when 'O' then 'Sales'
  else lower(o_orderpriority) end as default_schema from orders"""


@query(
    _with(s=_SUBMITTED, i=I_SQL)
    + """, known as (select distinct table_schema as name from i where table_schema in ('Sales', 'sample'))
         select statement_id, 'schema not found: ' || default_schema || ' (available: ['
           || (select string_agg(name, ', ' order by name) from known) || '])' as message
         from s where lower(default_schema) not in (select lower(name) from known)"""
)
def missing_schema_report(spark, sf):
    return resolve.missing_schema_report(from_sql(spark, sf, _SUBMITTED), cat.catalog_columns(from_sql(spark, sf, I_SQL)))


_RESOLVED = """lower(coalesce(r.ref_schema, r.default_schema)) = lower(c."schema") and lower(r.ref_table) = lower(c."table")
  and lower(r.ref_column) = lower(c."column")"""


@query(
    _with(r=R_SQL, c=C_SQL)
    + f"""select r.statement_id, coalesce(r.ref_schema, r.default_schema) as ref_schema, r.ref_table, r.ref_column,
            r.default_schema, c."schema" as source_schema, c."table" as source_table, c."column" as source_column,
            c."ordinal" as source_ordinal, c.data_type as source_type
          from r join c on {_RESOLVED}"""
)
def resolve_columns_ci(spark, sf):
    return resolve.resolve_columns_ci(resolve.resolve_default_schema(_r(spark, sf)), _c(spark, sf))


@query(
    _with(r=R_SQL, c=C_SQL)
    + f"""select r.statement_id, coalesce(r.ref_schema, r.default_schema) as ref_schema, r.ref_table, r.ref_column,
            r.default_schema
          from r where not exists (select 1 from c where {_RESOLVED})"""
)
def unresolved_refs(spark, sf):
    return resolve.unresolved_refs(resolve.resolve_default_schema(_r(spark, sf)), _c(spark, sf))


_SCOPE = """select distinct l_orderkey as statement_id, lower(replace(p_brand, '#', '_')) as "table",
  concat('Col_', cast(p_size % 7 as string)) as "column" from lineitem join part on l_partkey = p_partkey"""
_LOOSE = """select distinct l_orderkey as statement_id, concat('COL_', cast(l_linenumber as string)) as ref_column
  from lineitem"""


@query(
    _with(s=_SCOPE, r=_LOOSE)
    + """select r.statement_id, r.ref_column, count(*) as matches from r join s on s.statement_id = r.statement_id
         and lower(s."column") = lower(r.ref_column) group by r.statement_id, r.ref_column having count(*) > 1"""
)
def ambiguous_refs(spark, sf):
    return resolve.ambiguous_refs(from_sql(spark, sf, _LOOSE), from_sql(spark, sf, _SCOPE))


# ---- plans to edges ---------------------------------------------------------


def _fan(spark, sf, key: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every order submits ``key``; ``make`` turns the distinct plans into rows per plan."""
    marked, texts = statement_fingerprint(corpora.statements(spark, sf, [key]))
    texts = materialize(texts, "texts")
    plans = corpora.analysis(spark, sf).plans.join(texts.select("fingerprint"), "fingerprint", "left_semi")
    rows = make(plans.withColumnRenamed("fingerprint", "plan_id")).withColumnRenamed("plan_id", "fingerprint")
    return fan_out(marked, texts, rows)


def _per_order(columns: str, *rows: str) -> str:
    """The given rows for every order."""
    return f"select o_orderkey as statement_id, v.* from orders cross join (values {', '.join(rows)}) as v({columns})"


@query(
    _per_order(
        "class, nodes",
        "('Project', 1::bigint)", "('Join', 3::bigint)", "('SubqueryAlias', 8::bigint)", "('LogicalRelation', 4::bigint)",
    ),
    name="flatten_plans",
)
def _flatten_plans(spark, sf):
    return _fan(
        spark, sf, "join_multiway",
        lambda plans: flatten_plans(plans).groupBy("plan_id", "class").agg(F.count("*").alias("nodes")),
    )


@query(
    _per_order(
        "source_column, is_derived",
        "('l_discount', false)", "('l_discount', true)", "('l_extendedprice', true)",
    ),
    name="extract_attr_edges",
)
def _extract_attr_edges(spark, sf):
    def edges(plans):
        g = PlanGraph(plans)
        named = extract_bases(g).withColumnRenamed("attr_id", "from_id")
        return extract_attr_edges(g).join(named, ["plan_id", "from_id"]).select("plan_id", "source_column", "is_derived")

    return _fan(spark, sf, "mixed_use", edges)


@query(
    _per_order(
        "source_schema, source_table, source_column, source_ordinal, source_type",
        "('sample', 'orders', 'o_orderkey', 0, 'bigint')", "('sample', 'orders', 'o_custkey', 1, 'bigint')",
        "('sample', 'orders', 'o_orderstatus', 2, 'string')", "('sample', 'orders', 'o_totalprice', 3, 'double')",
        "('sample', 'orders', 'o_orderdate', 4, 'timestamp_ntz')", "('sample', 'orders', 'o_orderpriority', 5, 'string')",
        "('sample', 'customer', 'c_custkey', 0, 'bigint')", "('sample', 'customer', 'c_name', 1, 'string')",
        "('sample', 'customer', 'c_nationkey', 2, 'int')", "('sample', 'customer', 'c_acctbal', 3, 'double')",
        "('sample', 'customer', 'c_mktsegment', 4, 'string')",
    ),
    name="extract_bases",
)
def _extract_bases(spark, sf):
    return _fan(spark, sf, "join_inner", lambda plans: extract_bases(PlanGraph(plans)).drop("attr_id"))


@query(
    _per_order(
        "target_ordinal, target_column, data_type",
        "(1, 'o_orderkey', 'bigint')", "(2, 'customer_name', 'string')", "(3, 'product_name', 'string')",
        "(4, 'l_quantity', 'double')", "(5, 'l_extendedprice', 'double')", "(6, 'l_discount', 'double')",
        "(7, 'line_total', 'double')",
    ),
    name="extract_targets",
)
def _extract_targets(spark, sf):
    return _fan(spark, sf, "join_multiway", lambda plans: extract_targets(PlanGraph(plans)).drop("attr_id"))


LINEAGE_COLUMNS = [
    "statement_id", "target_ordinal", "target_column", "status", "source_schema", "source_table", "source_column",
    "is_derived",
]


def _expected(rows: list[tuple]) -> str:
    """Hand-derived edges as VALUES: (template, ordinal, output, status, table, column, derived)."""

    def lit(x):
        if x is None:
            return "null"
        return str(x).lower() if isinstance(x, (bool, int)) else _literal(x)

    values = ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in rows)
    return f"(values {values}) as v(template, target_ordinal, target_column, status, source_table, source_column, is_derived)"


_EXPECTED_COLUMNS = """o_orderkey as statement_id, cast(target_ordinal as int) as target_ordinal, target_column, status,
  case when source_table is null then null else 'sample' end as source_schema,
  cast(source_table as varchar) as source_table, cast(source_column as varchar) as source_column,
  cast(is_derived as boolean) as is_derived"""


def _lineage_oracle(key: str) -> str:
    rows = [(0, *edge) for edge in TEMPLATES[key].edges()]
    return f"select {_EXPECTED_COLUMNS} from orders cross join {_expected(rows)}"


def _lineage_query(key: str) -> Query:
    return lambda spark, sf: corpora.lineage(spark, sf, key).select(*LINEAGE_COLUMNS)


@query(
    f"""select {_EXPECTED_COLUMNS} from orders join {
        _expected([(i, *edge) for i, k in enumerate(corpora.mixed_keys()) for edge in TEMPLATES[k].edges()])
    } on o_orderkey % {len(corpora.mixed_keys())} = template"""
)
def column_origins(spark, sf):
    return corpora.analysis(spark, sf).rows_of(corpora.mixed_statements(spark, sf)).select(*LINEAGE_COLUMNS)


for _key in TEMPLATES:
    QUERIES[f"lineage_{_key}"] = _lineage_query(_key)
    ORACLES[f"lineage_{_key}"] = _lineage_oracle(_key)


def _written(key: str, table: str) -> None:
    """INSERT and CREATE TABLE AS also name the column written to."""
    name = f"lineage_{key}"
    QUERIES[name] = lambda spark, sf: corpora.lineage(spark, sf, key).select(*LINEAGE_COLUMNS, "written_table")
    ORACLES[name] = f"select *, '{table}' as written_table from ({ORACLES[name]})"


_written("insert_select", "sample.region")
_written("create_select", "sample.region_names")

_ROOTS = "select p_partkey as root from part"


@query(
    _with(
        g=G_SQL,
        up=f"""select root, root as at_id, false as is_derived from ({_ROOTS})
               union select up.root, g.from_id, up.is_derived or g.is_derived from up join g on g.to_id = up.at_id""",
    )
    + "select root, at_id as \"at\", is_derived from up"
)
def column_origins_graph(spark, sf):
    starts = from_sql(spark, sf, _ROOTS).select("root", F.col("root").alias("at"), F.lit(False).alias("is_derived"))
    return closure(starts, _g(spark, sf))


@query(
    _with(t=T_SQL, o=O_SQL)
    + """select t.statement_id, t.target_ordinal, t.target_column,
           case when t.status = 'unknown' then 'unknown'
                when exists (select 1 from o where o.statement_id = t.statement_id
                             and o.target_ordinal = t.target_ordinal) then 'mapped' else 'constant' end as status
         from t"""
)
def origin_status(spark, sf):
    targets = _t(spark, sf)
    unknown = targets.filter("status = 'unknown'")
    keys = ["statement_id", "target_ordinal"]
    return org.origin_status(targets.drop("status"), _o(spark, sf), unknown, keys)


_RAW_ORIGINS = f"""select statement_id, target_ordinal, source_schema, source_table, source_column, is_derived
  from ({corpora._O0_SQL})"""


@query(f"select distinct * from ({_RAW_ORIGINS})")
def dedupe_origins(spark, sf):
    return org.dedupe_origins(from_sql(spark, sf, _RAW_ORIGINS))


# output columns with repeated names: three names for up to seven lines
_REPEATED = """select distinct l_orderkey as statement_id, cast(l_linenumber as int) as target_ordinal,
  concat('c', cast(l_linenumber % 3 as string)) as target_column from lineitem"""


@query(
    _with(t=_REPEATED)
    + """, kept as (select statement_id, target_column, min(target_ordinal) as first_ordinal,
           max(target_ordinal) as origin_ordinal from t group by all)
         select statement_id, cast(row_number() over (partition by statement_id order by first_ordinal) as int)
           as target_ordinal, target_column, origin_ordinal from kept"""
)
def collapse_duplicate_targets(spark, sf):
    return org.collapse_duplicate_targets(from_sql(spark, sf, _REPEATED))


@query(
    _with(t=_REPEATED)
    + """, n as (select *, row_number() over (partition by statement_id, target_column order by target_ordinal) as copy
           from t)
         select statement_id, target_ordinal,
           case when copy = 1 then target_column else target_column || (copy - 2) end as target_column from n"""
)
def uniquify_targets(spark, sf):
    return org.uniquify_targets(from_sql(spark, sf, _REPEATED))


# ---- shaping the answer -----------------------------------------------------


@query(
    _with(t=T_SQL)
    + """select statement_id, target_column, target_ordinal * 10 as pos,
           cast(row_number() over (partition by statement_id order by target_ordinal) as int) as target_ordinal from t"""
)
def number_targets(spark, sf):
    positions = _t(spark, sf).select("statement_id", "target_column", (F.col("target_ordinal") * 10).alias("pos"))
    return shape.number_targets(positions)


_LIST = """, l as (select statement_id, target_ordinal, string_agg({item}, '{sep}' order by source_schema,
  source_table, source_column, data_type, is_derived) as listed from o group by all)"""


@query(
    _with(t=T_SQL, o=O_SQL)
    + _LIST.format(
        item="source_schema || '.' || source_table || '.' || source_column || ' ' || data_type || ' ' || is_derived",
        sep=";",
    )
    + """select t.statement_id, string_agg(t.target_ordinal || ' ' || t.target_column || '='
           || case when t.status = 'unknown' then 'null' else '[' || coalesce(l.listed, '') || ']' end, '|'
           order by t.target_ordinal) as document
         from t left join l on l.statement_id = t.statement_id and l.target_ordinal = t.target_ordinal
         group by t.statement_id"""
)
def nest_response(spark, sf):
    item = "concat(array_join(o.qualifiedNames, '.'), '.', o.column, ' ', o.dataType, ' ', cast(o.isDerived as string))"
    column = f"""concat(l.targetColumnOrdinalPosition, ' ', l.targetColumn, '=', if(l.columnOrigins is null, 'null',
      concat('[', array_join(transform(l.columnOrigins, o -> {item}), ';'), ']')))"""
    document = F.expr(f"array_join(transform(columnLineages, l -> {column}), '|')")
    return shape.nest_response(_t(spark, sf), _o(spark, sf)).select("statement_id", document.alias("document"))


@query(
    _with(t=T_SQL, o=O_SQL)
    + _LIST.format(
        item="""'{"qualifiedNames":["' || source_schema || '","' || source_table || '"],"ordinalPosition":'
          || (target_ordinal - 1) || ',"column":"' || source_column || '","dataType":"' || data_type
          || '","isDerived":' || is_derived || '}'""",
        sep=",",
    )
    + """select t.statement_id, '{"columnLineages":[' || string_agg('{"targetColumnOrdinalPosition":' || t.target_ordinal
           || ',"targetColumn":"' || t.target_column || '","columnOrigins":'
           || case when t.status = 'unknown' then 'null' else '[' || coalesce(l.listed, '') || ']' end || '}', ','
           order by t.target_ordinal) || ']}' as response
         from t left join l on l.statement_id = t.statement_id and l.target_ordinal = t.target_ordinal
         group by t.statement_id"""
)
def response_json(spark, sf):
    return shape.response_json(shape.nest_response(_t(spark, sf), _o(spark, sf)))


@query(
    _with(t=T_SQL, o=O_SQL)
    + """select t.statement_id, t.target_ordinal, t.target_column, t.status, o.source_schema, o.source_table,
           o.source_column, o.data_type, o.is_derived
         from t left join o on o.statement_id = t.statement_id and o.target_ordinal = t.target_ordinal"""
)
def flatten_response(spark, sf):
    return shape.flatten_response(shape.nest_response(_t(spark, sf), _o(spark, sf)))


@query(
    _with(t=T_SQL, o=O_SQL)
    + """, x as (select distinct statement_id, target_ordinal, source_schema || '.' || source_table || '.' || source_column
           || case when is_derived then ' (derived)' else '' end as text from o),
         l as (select statement_id, target_ordinal, '[' || string_agg(text, ', ' order by text) || ']' as listed
           from x group by all)
         select t.statement_id, t.target_ordinal, rpad(t.target_column, 24, ' ') || ' <- ' || case t.status
           when 'unknown' then '<unknown>' when 'constant' then '<no source column (literal/constant)>'
           else l.listed end as line
         from t left join l on l.statement_id = t.statement_id and l.target_ordinal = t.target_ordinal"""
)
def render_text(spark, sf):
    return shape.render_text(_t(spark, sf), _o(spark, sf))


@query(
    _with(o=O_SQL)
    + """select *, source_schema || '.' || source_table || '.' || source_column || ' #' || (target_ordinal - 1) || ' '
           || data_type || ' ' || case when is_derived then ' (derived)' else '' end as text from o"""
)
def render_origin(spark, sf):
    return shape.render_origin(_o(spark, sf))


# ---- graph ------------------------------------------------------------------

_IDS = """'src-' || source_schema || '.' || source_table || '.' || source_column as source_id,
  'tgt-' || target_ordinal || '-' || target_column as target_id"""
_EDGES = f"""select statement_id, source_id as "from", target_id as "to",
  case when is_derived then 'derived' else 'direct' end as label, is_derived as dashed
  from (select *, {_IDS} from ({O_SQL}))"""
_COLUMNS = """select statement_id, source_schema, source_table, source_column, cast(target_ordinal - 1 as int) as "ordinal",
  data_type from (select *, row_number() over (partition by statement_id, source_schema, source_table, source_column
    order by target_ordinal, data_type) as place from o) where place = 1"""
_ROWS = """select statement_id, 'src-' || source_schema || '.' || source_table || '.' || source_column as row_id,
    source_schema || '.' || source_table as table_id from o
  union select statement_id, 'tgt-' || target_ordinal || '-' || target_column, 'target-id' from t"""
# the column in focus: the first output of each statement
_KEEP = """select statement_id, 'tgt-1-c1' as row_id from t where target_column = 'c1'
  union select statement_id, "from" from e where "to" = 'tgt-1-c1'"""


@query(f"select *, {_IDS} from ({O_SQL})")
def row_ids(spark, sf):
    return graph.row_ids(_o(spark, sf))


@query(_EDGES)
def mappings(spark, sf):
    return graph.mappings(_o(spark, sf))


@query(_with(o=O_SQL) + _COLUMNS)
def source_columns(spark, sf):
    return graph.source_columns(_o_by_statement(spark, sf))


@query(
    _with(o=O_SQL, c=_COLUMNS)
    + """select *, cast(row_number() over (partition by statement_id, source_schema, source_table
           order by "ordinal", source_column) as int) as position from c"""
)
def order_source_columns(spark, sf):
    return graph.order_source_columns(graph.source_columns(_o_by_statement(spark, sf)))


@query(
    _with(o=O_SQL)
    + """, m as (select statement_id, source_schema, source_table, cast(min(target_ordinal) - 1 as int) as "ordinal"
           from o group by all)
         select *, cast(row_number() over (partition by statement_id order by "ordinal", source_schema, source_table)
           as int) as position from m"""
)
def order_source_tables(spark, sf):
    return graph.order_source_tables(graph.source_columns(_o_by_statement(spark, sf)))


@query(
    """select p_partkey, lower(p_brand) || case when p_size % 3 = 0 then '.inner' else '' end as "schema",
         p_name as "table", 'source: ' || lower(p_brand) || case when p_size % 3 = 0 then '.inner' else '' end as kind
       from part where p_size % 3 < 2
       union all select p_partkey, '', p_name, 'source' from part where p_size % 3 = 2"""
)
def split_qualified_name(spark, sf):
    path = F.expr(
        "case p_size % 3 when 0 then array(lower(p_brand), 'inner', p_name) when 1 then array(lower(p_brand), p_name)"
        " else array(p_name) end"
    )
    paths = load(spark, sf, "part").select("p_partkey", path.alias("path"))
    return graph.split_qualified_name(paths).drop("path")


@query(
    _with(t=T_SQL)
    + """select statement_id, target_ordinal, 'tgt-' || target_ordinal || '-' || target_column as row_id, target_column, '#' || target_ordinal as tag
         from t"""
)
def target_rows(spark, sf):
    return graph.target_rows(_t(spark, sf))


def _rows(spark, sf):
    return graph.graph_rows(_t(spark, sf), graph.source_columns(_o_by_statement(spark, sf)))


@query(
    f"""with t as ({T_SQL}), o as ({O_SQL}), e as ({_EDGES}),
         kept as (select distinct statement_id, row_id from ({_ROWS}) where row_id like 'tgt-%' or row_id not like '%5')
         select e.statement_id, e."from", e."to", e.label, e.dashed from e
         join kept a on a.statement_id = e.statement_id and a.row_id = e."from"
         join kept b on b.statement_id = e.statement_id and b.row_id = e."to\""""
)
def drop_dangling_edges(spark, sf):
    # stored once: the edges and both kinds of rows come from it
    origins, targets = materialize(_o(spark, sf), "origins"), materialize(_t(spark, sf), "targets")
    n = corpora.lineage_partitions(spark, sf)
    columns = graph.source_columns(deal(origins, n, "statement_id"))
    rows = graph.graph_rows(targets, columns).filter("row_id like 'tgt-%' or row_id not like '%5'")
    return graph.drop_dangling_edges(graph.mappings(origins), rows, n)


def _keep(spark, sf):
    focus = _t(spark, sf).filter("target_column = 'c1'").select("statement_id", F.lit("tgt-1-c1").alias("row_id"))
    return graph.focus_column(graph.mappings(_o(spark, sf)), focus=focus, partitions=corpora.lineage_partitions(spark, sf))


@query(_with(t=T_SQL, o=O_SQL, e=_EDGES) + _KEEP)
def focus_column(spark, sf):
    return _keep(spark, sf)


@query(
    _with(t=T_SQL, o=O_SQL, e=_EDGES, w=_ROWS, k=_KEEP)
    + """select distinct w.statement_id, w.table_id from w join k on k.statement_id = w.statement_id and k.row_id = w.row_id"""
)
def visible_tables(spark, sf):
    return graph.visible_tables(_rows(spark, sf), _keep(spark, sf), corpora.lineage_partitions(spark, sf))


@query(
    _with(t=T_SQL, o=O_SQL, e=_EDGES, k=_KEEP)
    + """select e.* from e where exists (select 1 from k where k.statement_id = e.statement_id and row_id = e."from")
           and exists (select 1 from k where k.statement_id = e.statement_id and row_id = e."to")"""
)
def visible_edges(spark, sf):
    return graph.visible_edges(graph.mappings(_o(spark, sf)), _keep(spark, sf), corpora.lineage_partitions(spark, sf))


@query(
    _with(e=_EDGES)
    + """select statement_id, "from" as row_id, "to" as linked_id from e
         union select statement_id, "to", "from" from e"""
)
def highlight_pairs(spark, sf):
    return graph.highlight_pairs(graph.mappings(_o(spark, sf)))


@query(
    _with(t=T_SQL, o=O_SQL, w=_ROWS)
    + """select *, case when row_id like 'src-%' then replace(row_id, 'src-', '') end as qualified_name from w"""
)
def qualified_name(spark, sf):
    return graph.qualified_name(_rows(spark, sf))


# ---- errors -----------------------------------------------------------------

_STATUS = """case when error_class = 'java.sql.SQLException' then 500 when error_class like '%ParseException'
  or ancestor = 'java.lang.IllegalArgumentException' or sqlstate like '42%' then 400 else coalesce(own_status, 500) end"""
_MESSAGE = """case when trim(coalesce(msg0, '')) <> '' then msg0 when trim(coalesce(msg1, '')) <> '' then msg1
  else split_part(split_part(error_class, '.', -1), '$', -1) end"""


@query(_with(f=F_SQL) + f"select statement_id, error_class, cast({_STATUS} as int) as status from f")
def classify_failures(spark, sf):
    return fail.classify_failures(_f(spark, sf)).select("statement_id", "error_class", "status")


@query(_with(f=F_SQL) + f"select statement_id, error_class, {_MESSAGE} as message from f")
def root_message(spark, sf):
    return fail.root_message(_f(spark, sf)).select("statement_id", "error_class", "message")


_BODIES = f"""select statement_id, cast({_STATUS} as int) as status, {_MESSAGE} as message, error_class as exception
  from f"""


@query(_with(f=F_SQL) + _BODIES)
def error_body(spark, sf):
    return fail.error_body(_f(spark, sf))


@query(
    _with(f=F_SQL, b=_BODIES)
    + """select statement_id, 'HTTP ' || status || case when statement_id % 4 > 0 then ': ' || message
           when statement_id % 8 = 0 then ': named' else case status when 400 then ' Bad Request'
           when 404 then ' Not Found' when 405 then ' Method Not Allowed' when 415 then ' Unsupported Media Type'
           else ' Internal Server Error' end end as text from b"""
)
def error_text(spark, sf):
    # every fourth reply has no message, half of these an error of another name
    bodies = fail.error_body(_f(spark, sf)).withColumn("message", F.expr("if(statement_id % 4 > 0, message, null)"))
    bodies = bodies.withColumn("error", F.expr("if(statement_id % 8 = 0, 'named', '')"))
    return fail.error_text(bodies)


@query(
    _with(f=F_SQL)
    + """select statement_id, error_class, 'failed' as part from f
         union all select -1 - o_orderkey, null, 'good' from orders"""
)
def quarantine_split(spark, sf):
    # the events failed, the orders did not
    submitted = load(spark, sf, "events").select(F.col("event_id").alias("statement_id")).unionAll(
        load(spark, sf, "orders").selectExpr("-1 - o_orderkey")
    )
    # a failure for each event: no side to broadcast, and a task's rows stay bounded
    n = row_partitions(submitted)
    failures = deal(_f(spark, sf), n, "statement_id").hint("merge")
    good, failed = fail.quarantine_split(deal(submitted, n, "statement_id").join(failures, "statement_id", "left"))
    return good.select("statement_id", F.lit(None).cast("string").alias("error_class"), F.lit("good").alias("part")).unionByName(
        failed.select("statement_id", "error_class", F.lit("failed").alias("part"))
    )


# ---- reports ----------------------------------------------------------------

_USAGE = """select source_schema, source_table, source_column, count(distinct statement_id) as statements,
  count(*) filter (where not is_derived) as direct_uses, count(*) filter (where is_derived) as derived_uses
  from o group by all"""


@query(_with(o=O_SQL) + _USAGE)
def column_usage(spark, sf):
    return reports.column_usage(_o_by_statement(spark, sf))


@query(
    _with(o=O_SQL)
    + """select statement_id, source_schema, source_table, count(distinct source_column) as columns_used,
           bool_and(not is_derived) as all_direct from o group by all"""
)
def table_lineage(spark, sf):
    return reports.table_lineage(_o_by_statement(spark, sf))


# a catalog reaching further than what statements read: 25 columns more per table
_WIDE = """select distinct 'sample' as "schema", lower(replace(p_brand, '#', '_')) as "table",
  concat('col_', cast(p_size + 25 as string)) as "column" from part"""


@query(
    _with(o=O_SQL, c=_WIDE)
    + """select c.* from c where not exists (select 1 from o where o.source_schema = c."schema"
           and o.source_table = c."table" and o.source_column = c."column")"""
)
def unused_columns(spark, sf):
    return reports.unused_columns(from_sql(spark, sf, _WIDE), _o(spark, sf))


@query(
    _with(o=O_SQL, u=_USAGE)
    + """select * from (select source_schema, source_table, source_column, statements, cast(rank() over (
           partition by source_schema, source_table order by statements desc) as int) as place from u) where place <= 3"""
)
def top_columns(spark, sf):
    return reports.top_columns(_o_by_statement(spark, sf), 3)


@query(
    _with(
        g=G_SQL,
        up=f"""select root, root as at_id, false as is_derived from ({_ROOTS})
               union select up.root, g.from_id, up.is_derived or g.is_derived from up join g on g.to_id = up.at_id""",
    )
    + "select root, at_id as base, is_derived from up where at_id not in (select to_id from g)"
)
def upstream_closure(spark, sf):
    return reports.upstream_closure(_g(spark, sf), from_sql(spark, sf, _ROOTS))


@query(
    _with(
        g=G_SQL,
        down=f"""select root, root as at_id, false as is_derived from ({_ROOTS})
                 union select down.root, g.to_id, down.is_derived or g.is_derived from down join g on g.from_id = down.at_id""",
    )
    + "select root, at_id as affected, is_derived from down where at_id <> root"
)
def downstream_impact(spark, sf):
    return reports.downstream_impact(_g(spark, sf), from_sql(spark, sf, _ROOTS))


# two runs over the same statements, each without some of the edges
_KEY = "statement_id, target_column, source_schema, source_table, source_column, is_derived"


@query(
    _with(o=O_SQL)
    + f""", b as (select {_KEY} from o where data_type not like 'E%'), a as (select {_KEY} from o where data_type not like 'S%')
          select *, 'removed' as change from (select * from b except select * from a)
          union all select *, 'added' from (select * from a except select * from b)"""
)
def lineage_diff(spark, sf):
    origins = _o(spark, sf)
    return reports.lineage_diff(origins.filter("data_type not like 'E%'"), origins.filter("data_type not like 'S%'"))


@query(
    _with(o=O_SQL)
    + """select b.source_schema, b.source_table, count(distinct b.statement_id) as statements from o b
         where b.source_table <> 'brand_17' and exists (select 1 from o a where a.statement_id = b.statement_id
           and a.source_table = 'brand_17') group by all"""
)
def co_used_tables(spark, sf):
    return reports.co_used_tables(_o(spark, sf), "sample.brand_17")


@query(
    _with(o=O_SQL)
    + """, r as materialized (select distinct statement_id, source_schema || '.' || source_table as tab from o)
         select a.tab as "table", b.tab as "other", count(*) as statements from r a join r b
           on a.statement_id = b.statement_id and a.tab < b.tab group by all having count(*) >= 5"""
)
def co_used_pairs(spark, sf):
    return reports.co_used_pairs(_o(spark, sf), 5)


_ORDER_LINES = """select o_orderkey, c_name as customer_name, p_name as product_name, l_quantity, l_extendedprice, l_discount,
  l_quantity * l_extendedprice * (1 - l_discount / 100) as line_total
  from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join part on p_partkey = l_partkey"""


@query(
    _with(d=_ORDER_LINES)
    + " union all ".join(
        f"""select '{out}' as target_column, count(distinct {out}) as missing_values from d
            where {out} is not null and {out} not in (select {column} from {table} where {column} is not null)"""
        for out, table, column in [
            ("o_orderkey", "orders", "o_orderkey"), ("customer_name", "customer", "c_name"),
            ("product_name", "part", "p_name"), ("l_quantity", "lineitem", "l_quantity"),
            ("l_extendedprice", "lineitem", "l_extendedprice"), ("l_discount", "lineitem", "l_discount"),
        ]
    )
)
def verify_direct(spark, sf):
    _, texts = statement_fingerprint(corpora.statements(spark, sf, ["join_multiway"]))
    a = corpora.analysis(spark, sf)
    targets = a.targets.join(texts, "fingerprint", "left_semi")
    origins = a.origins.join(texts, "fingerprint", "left_semi")
    tables = {t: load(spark, sf, t) for t in TABLES}
    return reports.verify_direct(star.data_order_lines(spark, sf), targets, origins, tables)


# ---- data queries -----------------------------------------------------------

for _key, _sql in {
    "data_customer_orders": """select c_custkey, c_name as customer_name, c_mktsegment, o_orderkey, o_orderstatus,
        o_totalprice, o_orderdate from customer join orders on o_custkey = c_custkey""",
    "data_order_lines": _ORDER_LINES,
    "data_self_join": """select a.p_partkey as part_id, a.p_name as part_name, b.p_partkey as parent_id,
        b.p_name as parent_name from part a join part b on b.p_partkey = a.p_partkey // 2""",
    "data_composite_join": """select k.l_partkey, k.l_suppkey, cast(k.q as double) as kept, cast(b.q as double) as returned
        from (select l_partkey, l_suppkey, sum(cast(l_quantity as decimal(18, 2))) as q from lineitem
              where l_returnflag <> 'R' group by all) k
        join (select l_partkey, l_suppkey, sum(cast(l_quantity as decimal(18, 2))) as q from lineitem
              where l_returnflag = 'R' group by all) b on b.l_partkey = k.l_partkey and b.l_suppkey = k.l_suppkey""",
    "data_two_roles": """select sn.n_name as supplier_nation, cn.n_name as customer_nation,
        cast(sum(cast(l_extendedprice as decimal(18, 2))) as double) as revenue
        from lineitem join supplier on s_suppkey = l_suppkey join nation sn on sn.n_nationkey = s_nationkey
        join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
        join nation cn on cn.n_nationkey = c_nationkey group by all""",
    "data_two_parents": """select l_orderkey, l_linenumber, p_name, s_name, l_quantity from lineitem
        join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey""",
    "data_one_to_one": """select o_orderkey, o_totalprice, line_sum, n_lines from orders join (select l_orderkey,
        cast(sum(cast(l_extendedprice as decimal(18, 2))) as double) as line_sum, count(*) as n_lines
        from lineitem group by l_orderkey) on l_orderkey = o_orderkey""",
    "data_insert_select": """select c_custkey as customer_id, c_name as customer_name, upper(c_mktsegment) as segment,
        n_name as nation, r_name as region from customer join nation on n_nationkey = c_nationkey
        join region on r_regionkey = n_regionkey""",
}.items():
    QUERIES[_key] = getattr(star, _key)
    ORACLES[_key] = _sql


def _data_template(key: str) -> Query:
    def run(spark, sf):
        sql = TEMPLATES[key].sql
        used = {t: load(spark, sf, t) for t in TABLES if "{" + t + "}" in sql}
        return spark.sql(sql, **used)

    return run


for _key, _sql in DUCKDB_TEXT.items():
    QUERIES[f"data_{_key}"] = _data_template(_key)
    ORACLES[f"data_{_key}"] = _sql


# ---- streaming --------------------------------------------------------------

# what the orders submit while they arrive
STREAMED = ["join_multiway", "union", "window_agg", "subquery_scalar", "cte", "intersect_except"]
STREAM_COLUMNS = [
    "statement_id", "target_ordinal", "target_column", "source_schema", "source_table", "source_column", "is_derived",
]


@query(
    f"""select {", ".join(STREAM_COLUMNS)} from (select {_EXPECTED_COLUMNS} from orders join {
        _expected([(i, *edge) for i, k in enumerate(STREAMED) for edge in TEMPLATES[k].edges()])
    } on o_orderkey % {len(STREAMED)} = template) where status = 'mapped'"""
)
def stream_lineage_edges(spark, sf):
    corpora.prepare_catalog(spark, sf)
    catalog = cat.catalog_of_tables(spark, corpora.SCHEMA, {t: load(spark, sf, t) for t in TABLES})
    store = PlanStore(spark, new_path(spark, "plan-store"), catalog)
    arriving = (
        spark.readStream.schema(load(spark, sf, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    )
    path, failures = new_path(spark, "stream-out"), new_path(spark, "stream-failures")
    submitted = corpora.statements(spark, sf, STREAMED, arriving)
    stream_lineage(submitted, path, failures, new_path(spark, "stream-checkpoint"), store).awaitTermination()
    return spark.read.parquet(path).select(*STREAM_COLUMNS)


QUERIES["stream_lineage"] = QUERIES.pop("stream_lineage_edges")
ORACLES["stream_lineage"] = ORACLES.pop("stream_lineage_edges")
