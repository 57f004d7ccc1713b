"""Plan nodes to dependency edges between column definitions.

A *definition* is a column as made by one node, named ``tree|node|attribute``.
Attribute ids alone would not do: a union keeps its first branch's ids, and
statements share ids. Every expression *reads* attributes; a read is resolved
to the topmost definition of that attribute visible below the reader.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colflow.functions.text import sql_type
from colflow.plans.flatten import (
    BY_POSITION,
    CONSTANT_LEAVES,
    EMBEDDED_TREE,
    REFERENCES,
    RELATIONS,
    SCOPES,
    _quoted,
    flatten_plans,
    subtree_stops,
)
from colflow.session import cut, partitioned_by_plan, plan_partitions

# Subquery expressions by what their plan gives to the outer expression.
FIRST_OUTPUT = ["ScalarSubquery"]
ALL_OUTPUTS = ["ListQuery"]
NO_OUTPUT = ["Exists"]


def _id(tree: str = "tree", node: str = "node", attr: str = "attr") -> Column:
    return F.concat_ws("|", tree, F.col(node), F.col(attr))


def _scope(tree: str, lo: str, hi: str) -> Column:
    return F.expr(f"cast(array(named_struct('tree', {tree}, 'lo', {lo}, 'hi', {hi})) as {SCOPES})")


# what every later step needs of a node; plan text and tokens stay behind
NODE_COLUMNS = [
    "plan_id", "tree", "node", "stop", "class", "link", "outer_join", "under_view", "schema", "table", "view",
    "barrier", "region", "nulls_at", "opaque_at", "scopes",
]


def _places(nodes: DataFrame) -> DataFrame:
    inner = f"transform(lateral, (t, x) -> if(t.plan is not null, {EMBEDDED_TREE}, null))".replace("ord", "-1")
    return nodes.select(
        *NODE_COLUMNS, "branch", "owner", "owner_class", "owner_link",
        F.expr(f"get(filter({inner}, t -> t is not null), 0)").alias("inner_tree"),
    )


def _definitions(nodes: DataFrame) -> DataFrame:
    """One row per column a node makes from its own expressions, with the
    attributes and embedded plans the expression uses."""
    bare = "filter(tokens, t -> t.class not like '%.Alias')"
    is_attribute = "(t.class like '%.AttributeReference' or t.class like '%.OuterReference')"
    return (
        nodes.select(*NODE_COLUMNS, F.inline("items"))
        .filter("attr is not null")
        # an attribute listed again is a column of its own: users by position (set
        # operations, outputs) get that column, readers by attribute the first
        .withColumn("again", F.row_number().over(Window.partitionBy("plan_id", "tree", "node", "alt", "attr").orderBy("ord")))
        .withColumn("attr", F.when(F.col("again") == 1, F.col("attr")).otherwise(-(F.col("attr") * 65536 + F.col("again"))))
        .drop("again")
        .withColumn("bare", F.expr(bare))
        .withColumn(
            "is_derived",
            F.expr(
                f"not (size(bare) = 1 and exists(bare, t -> {is_attribute}))"
                # a view casts each column to its declared type: direct if the type is kept
                " and not (under_view and size(bare) = 2 and get(bare, 0).class like '%.Cast'"
                "          and get(bare, 1).class like '%.AttributeReference'"
                "          and get(bare, 0).dataType = get(bare, 1).dataType)"
            ),
        )
        # the correlated columns listed under a subquery are not values it returns
        .withColumn("ends", F.expr(
            "if(exists(tokens, t -> t.plan is not null),"
            f" {subtree_stops('transform(tokens, t -> t.`num-children`)')}, cast(array() as array<int>))"
        ))
        .withColumn("inside", F.expr(
            "flatten(transform(tokens, (t, i) -> if(t.plan is not null and get(ends, i) > i,"
            " sequence(i + 1, get(ends, i)), cast(array() as array<int>))))"
        ))
        .withColumn("reads", F.expr(
            f"array_distinct(transform(filter(tokens, (t, x) -> {is_attribute} and not array_contains(inside, x)),"
            " t -> coalesce(t.exprId.id, get(t.e, 0).exprId.id)))"
        ))
        .withColumn("embedded", F.expr(
            "filter(transform(tokens, (t, x) -> if(t.plan is not null and not array_contains(inside, x),"
            " struct(regexp_extract(t.class, '([A-Za-z]+)$', 1) as kind,"
            f" {EMBEDDED_TREE} as tree), null)), e -> e is not null)"
        ))
        .withColumn("plain", F.size("tokens") == 0)
        .drop("tokens", "bare", "ends", "inside")
    )


def _outputs(consumers: DataFrame, definitions: DataFrame) -> DataFrame:
    """Ordered output columns of the subtree ``[lo, hi]`` of each consumer.

    A definition is seen from ``lo`` if no barrier lies between, that is, if the same
    barrier's subtree (``region``) is the innermost around both: an equi-join, after
    which the interval leaves little to drop."""
    d = definitions.filter("alt = 0").select(
        "plan_id", "tree", F.col("node").alias("at"), F.col("stop").alias("at_stop"), "region", "ord", "attr"
    )
    order = Window.partitionBy("plan_id", "tree", "lo").orderBy("at_stop", F.desc("at"), "ord")
    return (
        consumers.join(d, ["plan_id", "tree", "region"])
        .filter("at between lo and hi")
        .withColumn("k", F.row_number().over(order) - 1)
        .select(*(c for c in consumers.columns if c != "region"), "k", "attr")
    )


def _roots(nodes: DataFrame) -> DataFrame:
    return nodes.filter("node = 0").selectExpr(
        "plan_id", "tree", "0 as lo", "stop as hi", "'root' as use", "-1 as owner", "0 as branch",
        "cast(null as bigint) as link", "region",
    )


def _consumers(nodes: DataFrame) -> DataFrame:
    """Subtrees whose columns are used by position."""
    kids = nodes.filter(F.col("owner_class").isin(*BY_POSITION, "UnionLoop", "CTERelationDef")).selectExpr(
        "plan_id", "tree", "node as lo", "stop as hi",
        "case owner_class when 'CTERelationDef' then 'cte' when 'UnionLoop' then 'loop' else 'branch' end as use",
        "owner", "branch", "owner_link as link", "region",
    )
    return _roots(nodes).unionByName(kids)


def _lateral_definitions(places: DataFrame, definitions: DataFrame) -> DataFrame:
    """Columns a lateral join adds: the outputs of its embedded plan."""
    joins = places.filter("inner_tree is not null").drop("branch", "owner", "owner_class", "owner_link")
    inner = _outputs(_roots(places).filter("tree <> '0'"), definitions).select(
        "plan_id", F.col("tree").alias("inner_tree"), F.col("hi").alias("inner_hi"), F.col("k").alias("ord"), "attr"
    )
    return joins.join(inner, ["plan_id", "inner_tree"]).withColumn("alt", F.lit(0))


def _expression_reads(definitions: DataFrame, outputs: DataFrame) -> list[DataFrame]:
    """Attributes and subquery outputs used by each definition."""
    attributes = definitions.select(
        "plan_id", _id().alias("to_id"), F.explode("reads").alias("read"), "is_derived", "scopes"
    ).withColumnRenamed("read", "attr")
    embedded = definitions.select("plan_id", _id().alias("to_id"), F.inline("embedded"))
    roots = outputs.filter("use = 'root'").select("plan_id", "tree", "lo", "hi", "k", "attr")
    subquery_outputs = (
        embedded.filter(F.col("kind").isin(*FIRST_OUTPUT, *ALL_OUTPUTS))
        .join(roots, ["plan_id", "tree"], "left")
        .filter(F.col("kind").isin(*ALL_OUTPUTS) | F.col("k").isNull() | (F.col("k") == 0))
        .select("plan_id", "to_id", "attr", F.lit(True).alias("is_derived"), _scope("tree", "lo", "hi").alias("scopes"))
    )
    # a kind of subquery we have no rule for: its contribution is unknown
    other = embedded.filter(~F.col("kind").isin(*FIRST_OUTPUT, *ALL_OUTPUTS, *NO_OUTPUT)).select(
        "plan_id", "to_id", F.lit(None).cast("bigint").alias("attr"), F.lit(True).alias("is_derived"),
        F.expr(f"cast(array() as {SCOPES})").alias("scopes"),
    )
    return [attributes, subquery_outputs, other]


def _positional_reads(definitions: DataFrame, outputs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Set operations, CTEs and recursion match columns by position."""
    branch = outputs.filter("use = 'branch'").withColumn(
        "own_attr",
        F.first("attr").over(Window.partitionBy("plan_id", "tree", "owner", "k").orderBy("branch")),
    )
    set_definitions = branch.filter("branch = 0").selectExpr("plan_id", "tree", "owner as node", "attr", "k as ord")
    set_reads = branch.select(
        "plan_id", _id("tree", "owner", "own_attr").alias("to_id"), "attr", F.lit(False).alias("is_derived"),
        _scope("tree", "lo", "hi").alias("scopes"),
    )

    loops = definitions.filter("class = 'UnionLoop'").select(
        "plan_id", "tree", "node", "stop", F.col("ord").alias("k"), F.col("attr").alias("own_attr"), "link"
    )
    loop_reads = (
        outputs.filter("use = 'loop'")
        .withColumnRenamed("owner", "node")
        .join(loops.drop("link", "stop"), ["plan_id", "tree", "node", "k"])
        .select(
            "plan_id", _id("tree", "node", "own_attr").alias("to_id"), "attr", F.lit(False).alias("is_derived"),
            _scope("tree", "lo", "hi").alias("scopes"),
        )
    )
    refs = definitions.filter(F.col("class").isin(REFERENCES)).select(
        "plan_id", "class", _id().alias("to_id"), F.col("ord").alias("k"), "link"
    )
    # left joins: a reference whose definition is missing stays, as unknown
    cte_reads = (
        refs.filter("class = 'CTERelationRef'")
        .join(outputs.filter("use = 'cte'").drop("use", "owner", "branch"), ["plan_id", "link", "k"], "left")
        .select(
            "plan_id", "to_id", "attr", F.lit(False).alias("is_derived"), _scope("tree", "lo", "hi").alias("scopes")
        )
    )
    loop_ref_reads = (
        refs.filter("class = 'UnionLoopRef'")
        .join(loops, ["plan_id", "link", "k"], "left")
        .select(
            "plan_id", "to_id", F.col("own_attr").alias("attr"), F.lit(False).alias("is_derived"),
            _scope("tree", "node", "stop").alias("scopes"),
        )
    )
    return set_definitions, [set_reads, loop_reads, cte_reads, loop_ref_reads]


def _resolve(reads: DataFrame, visible: DataFrame) -> DataFrame:
    """Each read to the topmost definition in its innermost scope that has one."""
    keyed = reads.withColumn(
        "scopes", F.expr(f"if(size(scopes) > 0, scopes, cast(array(null) as {SCOPES}))")
    ).select("plan_id", "to_id", "attr", "is_derived", F.posexplode("scopes").alias("level", "scope"))
    tried = keyed.select("*", "scope.tree", "scope.lo", "scope.hi").drop("scope")
    found = tried.join(visible, ["plan_id", "tree", "attr"], "left").withColumn(
        "hit",
        F.when(
            F.expr("at between lo and hi and barrier < lo"),
            F.struct(
                "level", "at", F.expr("nulls_at >= lo").alias("nulls"), F.expr("opaque_at >= lo").alias("opaque"),
                _id("tree", "at", "attr").alias("from_id"),
            ),
        ),
    )
    return (
        found.groupBy("plan_id", "to_id", "attr", "is_derived")
        .agg(F.min("hit").alias("hit"))
        .select(
            "plan_id",
            "to_id",
            F.when(~F.col("hit.opaque"), F.col("hit.from_id")).alias("from_id"),
            (F.col("is_derived") | F.coalesce("hit.nulls", F.lit(False))).alias("is_derived"),
        )
        .distinct()
    )


class PlanGraph:
    """The lineage tables of a set of plans: built with one shuffle of the
    plans, everything after it joins inside plans."""

    def __init__(self, plans: DataFrame, stop_at_views: bool = False):
        self.partitions = plan_partitions(plans)
        with partitioned_by_plan(plans.sparkSession, self.partitions):
            self._build(plans, stop_at_views)

    def _build(self, plans: DataFrame, stop_at_views: bool) -> None:
        self.plans = plans
        nodes = flatten_plans(plans)
        places, own = cut(_places(nodes)), cut(_definitions(nodes))
        if stop_at_views:
            for column in ("reads", "embedded"):
                own = own.withColumn(column, F.expr(f"if(under_view, filter({column}, r -> false), {column})"))
        lateral = _lateral_definitions(places, own)
        definitions = own.unionByName(lateral, allowMissingColumns=True).drop("inner_tree", "inner_hi")
        outputs = cut(_outputs(_consumers(places), definitions))

        lateral_reads = lateral.select(
            "plan_id", _id().alias("to_id"), "attr", F.col("outer_join").alias("is_derived"),
            _scope("inner_tree", "0", "inner_hi").alias("scopes"),
        )
        set_definitions, positional = _positional_reads(own, outputs)
        reads = reduce(DataFrame.unionByName, [*_expression_reads(own, outputs), *positional, lateral_reads])
        visible = (
            definitions.select("plan_id", "tree", "node", "attr")
            .unionByName(set_definitions.drop("ord"))
            .distinct()
            .join(places.select("plan_id", "tree", "node", "barrier", "nulls_at", "opaque_at"), ["plan_id", "tree", "node"])
            .withColumnRenamed("node", "at")
        )
        targets = cut(
            plans.select(
                "plan_id",
                F.posexplode(F.from_json("output_json", "STRUCT<fields: ARRAY<STRUCT<name: STRING, type: STRING>>>").fields)
                .alias("k", "field"),
            )
            .join(outputs.filter("use = 'root' and tree = '0'").select("plan_id", "k", "attr", "hi"), ["plan_id", "k"], "left")
        )
        target_reads = targets.select(
            "plan_id", F.concat(F.lit("out|"), "k").alias("to_id"), "attr", F.lit(False).alias("is_derived"),
            _scope("'0'", "0", "coalesce(hi, -1)").alias("scopes"),
        )
        opaque_leaves = own.filter(
            F.col("class").isin(RELATIONS) & F.col("table").isNull()
            | ~F.col("class").isin(*RELATIONS, *CONSTANT_LEAVES, *REFERENCES) & F.col("plain")
            & (F.col("class") != "UnionLoop")
        ).select("plan_id", _id().alias("to_id"), F.lit(None).cast("string").alias("from_id"), F.lit(True).alias("is_derived"))

        self.edges = cut(_resolve(reads.unionByName(target_reads), visible).unionByName(opaque_leaves))
        self.targets = targets.select(
            "plan_id",
            (F.col("k") + 1).cast("int").alias("target_ordinal"),
            F.col("field.name").alias("target_column"),
            sql_type(F.col("field.type")).alias("data_type"),
            F.concat(F.lit("out|"), "k").alias("attr_id"),
        )
        base = F.col("class").isin(RELATIONS) & F.col("table").isNotNull()
        schema, table = F.col("schema"), F.col("table")
        if stop_at_views:
            base = base | F.col("under_view")
            schema = F.when(F.col("under_view"), F.col("view.database")).otherwise(schema)
            table = F.when(F.col("under_view"), F.col("view.table")).otherwise(table)
        self.bases = own.filter(base).select(
            "plan_id", _id().alias("attr_id"), schema.alias("source_schema"), table.alias("source_table"),
            F.col("name").alias("source_column"), F.col("ord").alias("source_ordinal"),
            sql_type(F.col("data_type")).alias("source_type"),
        )


def extract_attr_edges(graph: PlanGraph) -> DataFrame:
    return graph.edges


def extract_bases(graph: PlanGraph) -> DataFrame:
    return graph.bases


def extract_targets(graph: PlanGraph) -> DataFrame:
    return graph.targets
