"""The golden listing, and statements at the edges of the rules."""

import pytest
from pyspark.sql import functions as F

from colflow.operators import failures as fail
from colflow.operators.shape import render_text
from colflow.plans import closure as closures
from colflow.plans.closure import closure
from colflow.plans.flatten import flatten_plans
from colflow.plans.origins import lineage_of_plans, uniquify_targets
from colflow.session import cut, new_path
from colflow.sources.catalog import CATALOG_SCHEMA, catalog_columns, register_catalog
from colflow.sources.harvest import harvest_plans
from colflow.sources.lineage import analyze_statements
from colflow.sources.statements import read_statements, statement_fingerprint

# tables of the published example: name, (column, PostgreSQL type) in order
SHOP = {
    "customers": [("customer_id", "bigint"), ("name", "text"), ("email", "text"), ("tier", "text")],
    "products": [("product_id", "bigint"), ("category_id", "bigint"), ("name", "text"), ("price", "numeric")],
    "orders": [("order_id", "bigint"), ("customer_id", "bigint"), ("status", "text"), ("total_amount", "numeric")],
    "order_items": [
        ("order_id", "bigint"), ("product_id", "bigint"), ("quantity", "integer"),
        ("unit_price", "numeric"), ("discount", "numeric"),
    ],
    "warehouses": [("warehouse_id", "bigint"), ("name", "text"), ("country_code", "character")],
}

ORDER_LINES = """
select o.order_id
    , c.name as customer_name
    , p.name as product_name
    , oi.quantity
    , oi.unit_price
    , oi.discount
    , (oi.quantity * oi.unit_price * (1 - oi.discount / 100)) as line_total
from order_items oi
join orders o on o.order_id = oi.order_id
join customers c on c.customer_id = o.customer_id
join products p on p.product_id = oi.product_id
"""

GOLDEN = [
    "order_id                 <- [shop.orders.order_id]",
    "customer_name            <- [shop.customers.name]",
    "product_name             <- [shop.products.name]",
    "quantity                 <- [shop.order_items.quantity]",
    "unit_price               <- [shop.order_items.unit_price]",
    "discount                 <- [shop.order_items.discount]",
    "line_total               <- [shop.order_items.discount (derived), shop.order_items.quantity (derived),"
    " shop.order_items.unit_price (derived)]",
]


@pytest.fixture(scope="module")
def shop(spark):
    rows = [
        ("shop", table, column, i + 1, kind)
        for table, columns in SHOP.items()
        for i, (column, kind) in enumerate(columns)
    ]
    rows.append(("pg_catalog", "pg_class", "relname", 1, "text"))
    listed = spark.createDataFrame(
        rows, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string"
    )
    catalog = catalog_columns(listed)
    register_catalog(spark, catalog, new_path(spark, "shop"))
    return catalog


DEEP = """
  with t as (
    select c.customer_id as id, c.name, o.status
    from customers c left join (select * from orders where total_amount > 1) o on o.customer_id = c.customer_id)
  select t.id, t.status,
    (select max(p.price) + (select max(oi.discount) from order_items oi) from products p
       where p.product_id = t.id) as nested
  from t full join warehouses w on w.warehouse_id = t.id
  union all
  select product_id, name, null from products
"""

STATEMENTS = {
    "golden": ORDER_LINES,
    "char": "select country_code, null as nothing from warehouses",
    "good": "select name from customers",
    "bad_syntax": "selec name from customers",
    "bad_table": "select name from nowhere",
    "bad_column": "select nothing from customers",
    "bad_dialect": "select distinct on (name) name from customers",
    "bad_function": "select frobnicate(name) from customers",
    "layout_1": "select name from customers where tier = 'a  b'",
    "layout_2": "select name\n  from customers -- a comment\n where tier = 'a  b' ;",
    "layout_3": "/* first */ select name from customers where tier = 'a b'",
    "insert": "insert into warehouses select customer_id, name, tier from customers",
    "qualified": "select s.NAME, shop.orders.status from shop.customers s, shop.orders",
    "deep": DEEP,
    "no_schema": "select 1 as one",
    "bad_kind": "drop table customers",
    "bare_table": "table warehouses",
    "unpivot": "select * from (select customer_id, order_id from orders) unpivot (v for k in (customer_id, order_id))",
    "select_generate": "select explode(split(name, ' ')) as word, tier from customers",
}


@pytest.fixture(scope="module")
def results(spark, shop):
    """All statements analyzed together, as a corpus is."""
    schemas = {"no_schema": "no_such_schema", "qualified": None}
    data = [(i, sql, schemas.get(name, "shop")) for i, (name, sql) in enumerate(STATEMENTS.items())]
    statements = spark.createDataFrame(data, "statement_id long, sql string, default_schema string")
    result = analyze_statements(spark, statements)
    names = list(STATEMENTS)
    text = {}
    for r in render_text(result.targets, result.origins).orderBy("target_ordinal").collect():
        text.setdefault(names[r.statement_id], []).append(r.line)
    failed = {names[r.statement_id]: r for r in fail.error_body(result.failures).collect()}
    return text, failed


def test_golden(spark, shop, results):
    assert shop.schema.simpleString() == spark.createDataFrame([], CATALOG_SCHEMA).schema.simpleString()
    assert shop.filter("schema = 'pg_catalog'").count() == 0
    assert results[0]["golden"] == GOLDEN


def test_fixed_length_text_is_direct(results):
    assert results[0]["char"] == [
        "country_code             <- [shop.warehouses.country_code]",
        "nothing                  <- <no source column (literal/constant)>",
    ]


def test_bad_statements_do_not_stop_the_others(results):
    text, failed = results
    bad = {name for name in STATEMENTS if name.startswith("bad_")}
    assert set(failed) == bad | {"no_schema"}
    assert set(text) == set(STATEMENTS) - set(failed)
    assert {failed[name].status for name in bad} == {400}
    assert "nowhere" in failed["bad_table"].message and "nothing" in failed["bad_column"].message
    assert failed["bad_syntax"].exception.endswith("ParseException")


def test_missing_schema_fails_the_statement(results):
    assert "no_such_schema" in results[1]["no_schema"].message


def test_unknown_functions_pass_when_lenient(spark, shop):
    sql = "select tumble_up(name, tier) as f from customers"
    statements = spark.createDataFrame([(0, sql, "shop")], "statement_id long, sql string, default_schema string")
    result = analyze_statements(spark, statements, lenient=True)
    origins = {(r.source_column, r.is_derived) for r in result.origins.collect()}
    assert origins == {("name", True), ("tier", True)}


def test_layout_does_not_matter(spark, results):
    expected = ["name                     <- [shop.customers.name]"]
    assert [results[0][f"layout_{i}"] for i in (1, 2, 3)] == [expected] * 3
    data = [(i, STATEMENTS[f"layout_{i}"], "shop") for i in (1, 2, 3)]
    _, texts = statement_fingerprint(spark.createDataFrame(data, "statement_id long, sql string, default_schema string"))
    # the third differs inside the quotes
    assert texts.count() == 3 and texts.select("fingerprint").distinct().count() == 2


def test_insert_is_not_executed(spark, results):
    assert results[0]["insert"][2] == "country_code             <- [shop.customers.tier]"
    assert spark.table("shop.warehouses").count() == 0


def test_qualified_names_need_no_default_schema(results):
    assert results[0]["qualified"] == [
        "NAME                     <- [shop.customers.name]",
        "status                   <- [shop.orders.status]",
    ]


def test_deep_scopes(results):
    """Outer joins on several levels, nested subqueries, a union on top."""
    assert results[0]["deep"] == [
        "id                       <- [shop.customers.customer_id (derived), shop.products.product_id]",
        "status                   <- [shop.orders.status (derived), shop.products.name]",
        "nested                   <- [shop.order_items.discount (derived), shop.products.price (derived)]",
    ]


def test_other_shapes(results):
    text = results[0]
    assert text["bare_table"][2] == "country_code             <- [shop.warehouses.country_code]"
    assert text["unpivot"] == [
        "k                        <- <no source column (literal/constant)>",
        "v                        <- [shop.orders.customer_id, shop.orders.order_id]",
    ]
    assert text["select_generate"][0] == "word                     <- [shop.customers.name (derived)]"


def test_relation_named_by_its_alias(spark, shop):
    """Sources that do not name their table take the catalog alias above them."""
    data = [("f", "select c.name from customers c", "shop")]
    texts = spark.createDataFrame(data, "fingerprint string, sql string, default_schema string")
    plans, _ = harvest_plans(spark, texts)
    renamed = plans.withColumn(
        "plan_json",
        F.replace(
            F.replace("plan_json", F.lit("datasources.LogicalRelation"), F.lit("datasources.v2.DataSourceV2Relation")),
            F.lit('"catalogTable"'), F.lit('"other"'),
        ),
    ).withColumnRenamed("fingerprint", "plan_id")
    _, origins = lineage_of_plans(renamed)
    assert [(r.source_schema, r.source_table) for r in origins.collect()] == [("shop", "customers")]


def test_unknown_node_class_gives_unknown(spark, shop):
    data = [("f", "select name, 1 as one from (select name from customers) x", "shop")]
    texts = spark.createDataFrame(data, "fingerprint string, sql string, default_schema string")
    plans, _ = harvest_plans(spark, texts)
    renamed = plans.withColumn(
        "plan_json", F.replace("plan_json", F.lit("logical.SubqueryAlias"), F.lit("logical.SomethingNew"))
    ).withColumnRenamed("fingerprint", "plan_id")
    targets, origins = lineage_of_plans(renamed)
    assert [r.status for r in targets.orderBy("target_ordinal").collect()] == ["unknown", "constant"]
    assert origins.count() == 0


def test_tree_shape_matches_a_plain_walk(spark, shop):
    sql = "select a.name from customers a left join (select * from orders union select * from orders) b on true"
    texts = spark.createDataFrame([("f", sql, "shop")], "fingerprint string, sql string, default_schema string")
    plans, _ = harvest_plans(spark, texts)
    import json

    counts = [n["num-children"] for n in json.loads(plans.first().plan_json)]

    def stop(i):
        last = i
        for _ in range(counts[i]):
            last = stop(last + 1)
        return last

    parents = {}
    for i in range(len(counts)):
        child = i + 1
        for branch in range(counts[i]):
            parents[child] = (i, branch)
            child = stop(child) + 1

    nodes = flatten_plans(plans.withColumnRenamed("fingerprint", "plan_id")).orderBy("node").collect()
    assert [n.stop for n in nodes] == [stop(i) for i in range(len(counts))]
    assert {n.node: (n.owner, n.branch) for n in nodes if n.owner is not None} == parents


def test_closure_ends_on_a_cycle(spark):
    edges = spark.createDataFrame(
        [(1, 2, False), (2, 3, True), (3, 1, False), (3, 4, False)], "to_id long, from_id long, is_derived boolean"
    )
    starts = spark.createDataFrame([(1, 1, False)], "root long, at long, is_derived boolean")
    reached = {(r.at, r.is_derived) for r in closure(starts, edges).collect()}
    assert reached == {(1, False), (2, False), (3, True), (4, True), (1, True), (2, True)}


def test_unique_names_survive_clashes(spark):
    names = ["a", "a", "a0", "a", "a0", "b"]
    df = spark.createDataFrame(
        [(1, i + 1, n) for i, n in enumerate(names)], "statement_id long, target_ordinal int, target_column string"
    )
    renamed = [r.target_column for r in uniquify_targets(df).orderBy("target_ordinal").collect()]
    assert len(set(renamed)) == len(names)
    assert renamed[0] == "a" and renamed[2] == "a0" and renamed[5] == "b"


def test_no_credential_is_read(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"statement_id": 1, "sql": "  select 1\\n", "password": "secret", "username": "u", "schema": " shop "}'
    )
    good, failed = read_statements(spark, str(tmp_path))
    (row,) = good.collect()
    assert failed.collect() == []
    assert row.asDict() == {"statement_id": 1, "sql": "select 1", "default_schema": "shop"}


def test_unreadable_requests_are_failures(spark, tmp_path):
    lines = ['{"statement_id": 1, "sql": "select 1"}', '{"statement_id": 2, "password": "secret", "sql', "", "no record", "[1, 2]"]
    (tmp_path / "r.json").write_text("\n".join(lines))
    good, failed = read_statements(spark, str(tmp_path))
    assert [r.statement_id for r in good.collect()] == [1]
    rows = failed.collect()
    assert len(rows) == 3 and all("secret" not in str(r) for r in rows)
    assert {r.status for r in fail.classify_failures(failed).collect()} == {400}


def test_paths_double(spark, monkeypatch):
    """A chain of 200 steps with a derived one, a cycle with a way out, a path that
    stops at an unknown, and a dead end, which gives nothing."""
    rounds = []
    monkeypatch.setattr(closures, "cut", lambda df: rounds.append(1) or cut(df))
    chain = [("p", f"n{i}", f"n{i + 1}", i == 100) for i in range(200)]
    odd = [("q", "out", "a", False), ("q", "a", "b", True), ("q", "b", "a", False), ("q", "b", "base", False), ("q", "out", None, False), ("q", "out", "dead", False)]
    edges = spark.createDataFrame(chain + odd, "plan_id string, to_id string, from_id string, is_derived boolean")
    ends = spark.createDataFrame([("p", "n200"), ("q", "base")], "plan_id string, attr_id string")
    found = {tuple(r) for r in closures.path_ends(edges, ends, "plan_id").filter("to_id in ('n0', 'n150', 'out')").collect()}
    assert found == {("p", "n0", "n200", True), ("p", "n150", "n200", False), ("q", "out", "base", True), ("q", "out", None, False)}
    assert len(rounds) <= 10


def test_nested_unions(spark, shop, monkeypatch):
    rounds = []
    monkeypatch.setattr(closures, "cut", lambda df: rounds.append(1) or cut(df))
    # nested by name: the parser does not take so many brackets
    steps = ["q0 as (select name as x from customers)"]
    steps += [f"q{i + 1} as (select x from q{i} union all select {'upper(name)' if i == 7 else 'name'} from customers)" for i in range(60)]
    sql = f"with {', '.join(steps)} select x from q60"
    texts = spark.createDataFrame([("f", sql, "shop")], "fingerprint string, sql string, default_schema string")
    plans, _ = harvest_plans(spark, texts)
    _, origins = lineage_of_plans(plans.withColumnRenamed("fingerprint", "plan_id"))
    assert {(r.source_column, r.is_derived) for r in origins.collect()} == {("name", False), ("name", True)}
    assert len(rounds) <= 10
