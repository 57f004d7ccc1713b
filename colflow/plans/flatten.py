"""Analyzed-plan JSON to one row per plan node.

A plan arrives as the pre-order list of its nodes, each with its number of
children; an expression is itself such a list of tokens. Subquery expressions
embed whole plans. Every plan, outer or embedded, is a *tree*; a node is named
by (plan, tree, position) and owns the positions up to ``stop``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colflow.session import cut

TOKEN = (
    "STRUCT<class: STRING, `num-children`: INT, name: STRING, exprId: STRUCT<id: BIGINT>,"
    # an outer reference holds its attribute in a field, not as a child
    " dataType: STRING, plan: STRING, e: ARRAY<STRUCT<exprId: STRUCT<id: BIGINT>>>>"
)
EXPRESSION = f"ARRAY<{TOKEN}>"
NAMED_TABLE = "STRUCT<identifier: STRUCT<table: STRING, database: STRING>>"
NODE = (
    "STRUCT<class: STRING, `num-children`: INT,"
    f" projectList: ARRAY<{EXPRESSION}>, aggregateExpressions: ARRAY<{EXPRESSION}>,"
    f" windowExpressions: ARRAY<{EXPRESSION}>, generator: {EXPRESSION},"
    f" generatorOutput: ARRAY<{EXPRESSION}>, projections: ARRAY<ARRAY<{EXPRESSION}>>,"
    f" output: ARRAY<{EXPRESSION}>, outputAttrIds: ARRAY<STRUCT<id: BIGINT>>,"
    " id: BIGINT, cteId: BIGINT, loopId: BIGINT, joinType: STRING, `right`: STRING,"
    f" catalogTable: {NAMED_TABLE}, tableMeta: {NAMED_TABLE}, `desc`: {NAMED_TABLE},"
    " identifier: STRUCT<name: STRING, qualifier: STRING>>"
)

# Node classes by what they do to columns. Any class not named here makes
# everything read through it "unknown".
RELATIONS = [
    "LogicalRelation", "HiveTableRelation", "DataSourceV2Relation", "StreamingRelationV2", "StreamingRelation", "LogicalRDD",
]
CONSTANT_LEAVES = ["LocalRelation", "Range", "OneRowRelation"]
REFERENCES = ["CTERelationRef", "UnionLoopRef"]
REPLACE_COLUMNS = ["Project", "Aggregate", "Expand", "UnionLoop"]
BY_POSITION = ["Union", "Intersect", "Except"]
PASS_COLUMNS = [
    "Filter", "Sort", "SubqueryAlias", "GlobalLimit", "LocalLimit", "Offset", "Tail", "Distinct",
    "Deduplicate", "Sample", "Repartition", "RepartitionByExpression", "ResolvedHint", "View",
    "WithCTE", "CTERelationDef", "Join", "Window", "Generate", "LateralJoin",
]
KNOWN = RELATIONS + CONSTANT_LEAVES + REFERENCES + REPLACE_COLUMNS + BY_POSITION + PASS_COLUMNS


# short name of a node's class
CLASS = "regexp_extract(n.class, '([A-Za-z0-9_]+)[$]?$', 1)"


def _quoted(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def subtree_stops(counts: str) -> str:
    """SQL for the last position of each subtree, given pre-order child counts.

    Read from the right: a node's first child starts just after it and each
    next child just after the previous child's last position.
    """
    return f"""
      aggregate(
        reverse(transform({counts}, (n, i) -> struct(n, i))),
        cast(array() as array<int>),
        (done, x) -> concat(
          array(if(x.n = 0, x.i, aggregate(sequence(1, greatest(x.n, 1)), x.i, (last, _) -> done[last - x.i]))),
          done))"""


# Output items of a node: the columns it makes, with the tokens they are made
# from. Expand makes each column several times, once per projection ("alt").
_ITEM = (
    "struct({ord} as ord, {alt} as alt, {attr} as attr, {name} as name, {type} as data_type, {tokens} as tokens)"
)


def _columns(array: str, tokens: str = "e") -> str:
    item = _ITEM.format(
        ord="i", alt="0", attr="get(e, 0).exprId.id", name="get(e, 0).name", type="get(e, 0).dataType", tokens=tokens
    )
    return f"transform({array}, (e, i) -> {item})"


def _items() -> str:
    no_tokens = f"cast(array() as {EXPRESSION})"
    expand_item = _ITEM.format(
        ord="k", alt="p", attr="get(get(n.output, k), 0).exprId.id", name="get(get(n.output, k), 0).name",
        type="get(get(n.output, k), 0).dataType", tokens="e",
    )
    loop_item = _ITEM.format(
        ord="i", alt="0", attr="a.id", name="cast(null as string)", type="cast(null as string)", tokens=no_tokens
    )
    return f"""
      case class
        when 'Project' then {_columns("n.projectList")}
        when 'Aggregate' then {_columns("n.aggregateExpressions")}
        when 'Window' then {_columns("n.windowExpressions")}
        when 'Generate' then {_columns("n.generatorOutput", "n.generator")}
        when 'Expand' then flatten(transform(n.projections, (es, p) -> transform(es, (e, k) -> {expand_item})))
        when 'UnionLoop' then transform(n.outputAttrIds, (a, i) -> {loop_item})
        else {_columns("n.output", no_tokens)}
      end"""


# what the shape of a tree takes of a node; read apart from the expressions, so
# that the sorts below move short rows
SHAPE = (
    "STRUCT<class: STRING, `num-children`: INT, joinType: STRING, id: BIGINT, cteId: BIGINT, loopId: BIGINT,"
    f" `desc`: {NAMED_TABLE}, identifier: STRUCT<name: STRING, qualifier: STRING>>"
)
TREE = ["plan_id", "tree"]


def _mark(at: str = "null", region: str = "null", name: str = "null") -> str:
    return (
        f"named_struct('at', cast({at} as int), 'region', cast({region} as int),"
        f" 'name', cast({name} as struct<`table`: string, database: string>))"
    )


# Subtrees that change what is seen through the node above or at their top:
# barrier - columns of the subtree are not visible from ``at`` or above
# nulls   - columns of the subtree may be filled with nulls by the outer join ``at``
# opaque  - the node on top is of an unknown class
# view, alias - the name that a relation without one of its own has from the view,
#           or the catalog table's alias, just above it
MARKS = {
    "barrier": (
        f"parent.class in ({_quoted(REPLACE_COLUMNS)})"
        f" or parent.class in ({_quoted(BY_POSITION)}) and branch > 0"
        " or parent.class = 'WithCTE' and branch < parent.kids - 1"
        " or parent.class = 'Join' and branch = 1 and parent.joinType rlike 'Left(Semi|Anti)'",
        _mark(at="parent.node", region="node"),
    ),
    "nulls": (
        "parent.class = 'Join' and (branch = 1 and parent.joinType rlike 'LeftOuter|FullOuter'"
        " or branch = 0 and parent.joinType rlike 'RightOuter|FullOuter')",
        _mark(at="parent.node"),
    ),
    "opaque": (f"class not in ({_quoted(KNOWN)})", _mark(at="node")),
    "view": ("parent.class = 'View'", _mark(name="parent.view_name")),
    "alias": (
        "parent.class = 'SubqueryAlias' and parent.view_name.`table` is not null",
        _mark(name="parent.view_name"),
    ),
}


def _so_far(order: str, *keys: str) -> str:
    return f"over (partition by {', '.join([*TREE, *keys])} order by {order} rows unbounded preceding)"


def _shape_sql() -> str:
    """Where each node of ``trees(plan_id, tree, json)`` lies, and what covers it.

    Sorted passes over node rows, all keyed by the tree: the cost grows with the nodes,
    and a long plan spills instead of being held as one value. A pass in which nodes
    ask and others answer has each node as two rows.

    * ``open`` is the number of children still to come after a node, less one for each
      tree that is complete. A subtree ends at the first position that takes it below
      its value before the subtree.
    * Subtrees are nested or apart, so over their sorted ends the number of those open
      is the depth of a stack. The last one opened at a depth is the top there: the
      parent, among all nodes; the innermost mark of a kind, among its marks.
    """
    kinds = ", ".join(f"'{kind}'" for kind in MARKS)
    marks = ", ".join(f"if({applies}, {mark}, null)" for applies, mark in MARKS.values())
    tops = ", ".join(f"max(if(kind = '{kind}', top, null)) as {kind}" for kind in MARKS)
    passed = "node, kids, class, joinType, link, view_name"
    return f"""
      with nodes as (
        select plan_id, tree, node, {CLASS} as class, n.`num-children` as kids, n.joinType as joinType,
          coalesce(n.cteId, n.loopId, n.id) as link,
          -- the name a view or a catalog table's alias gives to what lies below
          case when {CLASS} = 'View'
               then named_struct('table', n.desc.identifier.table, 'database', n.desc.identifier.database)
               when {CLASS} = 'SubqueryAlias' and n.identifier.qualifier like '[%,%]'
               then named_struct('table', n.identifier.name,
                                 'database', regexp_extract(n.identifier.qualifier, '([^, ]+)]$', 1)) end as view_name
        from (select plan_id, tree, posexplode(from_json(json, 'ARRAY<{SHAPE}>')) as (node, n) from {{trees}})),
      opened as (
        select *, explode(array(false, true)) as asks
        from (select *, sum(kids - 1) {_so_far("node")} as open from nodes)),
      stopped as (
        select plan_id, tree, {passed}, open, asks,
          last(if(asks, null, node), true) {_so_far("node desc, asks", "open - if(asks, kids, 0)")} as stop
        from opened),
      ends as (
        select *, explode(array(false, true)) as closing from stopped where asks),
      deep as (
        select *, sum(if(closing, -1, 1)) {_so_far("if(closing, stop + 1, node), closing desc")} as depth from ends),
      asking as (
        select *, explode(array(false, true)) as above from deep where not closing),
      below as (
        select plan_id, tree, {passed}, open, stop, above,
          last(if(above, struct({passed}, open), null), true) {_so_far("node", "depth + if(above, 1, 0)")} as parent
        from asking),
      placed as (
        select *, cast(parent.open - (open - kids + 1) as int) as branch from below where not above),
      marked as (
        select *, inline(arrays_zip(array({kinds}), array({marks}))) as (kind, mark) from placed),
      mark_ends as (
        select *, explode(if(mark is null, array(false), array(false, true))) as closing from marked),
      mark_depths as (
        select *, sum(if(mark is null, 0, if(closing, -1, 1)))
            {_so_far("if(closing, stop + 1, node), closing desc", "kind")} as mark_depth
        from mark_ends),
      tops as (
        select *, if(mark_depth > 0, last(mark, true) {_so_far("node", "kind", "mark_depth")}, null) as top
        from mark_depths where not closing),
      covered as (
        select plan_id, tree, node, first(stop) as stop, first(class) as class, first(branch) as branch,
          first(parent) as parent, first(link) as link, first(joinType) as joinType, {tops}
        from tops group by plan_id, tree, node)
      select plan_id, tree, node, stop, class, branch, parent.node as owner, parent.class as owner_class,
        parent.link as owner_link, link, joinType rlike 'Outer' as outer_join,
        coalesce(branch = 0 and parent.class = 'View', false) as under_view,
        view.name as view_name, alias.name as alias_name,
        coalesce(barrier.at, -1) as barrier, coalesce(barrier.region, -1) as region,
        coalesce(nulls.at, -1) as nulls_at, coalesce(opaque.at, -1) as opaque_at
      from covered"""


def _shape(trees: DataFrame) -> DataFrame:
    # one text: it is analyzed once, not once for each step
    return trees.sparkSession.sql(_shape_sql(), trees=trees)


def _parse(trees: DataFrame) -> DataFrame:
    """One row per node of ``trees(plan_id, tree, scopes, json)``."""
    table = "coalesce(n.catalogTable, n.tableMeta).identifier"
    nodes = trees.select(*TREE, "scopes", F.posexplode(F.from_json("json", f"ARRAY<{NODE}>")).alias("node", "n"))
    return nodes.join(_shape(trees), [*TREE, "node"]).select(
        *TREE, "node", "stop", "class", "branch", "owner", "owner_class", "owner_link", "link", "outer_join", "under_view",
        F.expr(f"coalesce({table}.database, view_name.database, alias_name.database)").alias("schema"),
        F.expr(f"coalesce({table}.table, view_name.table, alias_name.table)").alias("table"),
        F.expr("if(under_view, view_name, null)").alias("view"),
        "barrier", "region", "nulls_at", "opaque_at",
        F.expr(_items()).alias("items"),
        F.when(F.col("class") == "LateralJoin", F.from_json("n.right", EXPRESSION)).alias("lateral"),
        # what an embedded plan may read besides its own columns
        F.expr("concat(array(named_struct('tree', tree, 'lo', node + 1, 'hi', stop)), scopes)").alias("scopes"),
    )


SCOPES = "ARRAY<STRUCT<tree: STRING, lo: INT, hi: INT>>"
# name of the tree embedded in token ``x`` of item ``ord`` (-1: a lateral join's subquery)
EMBEDDED_TREE = "concat_ws('/', tree, node, ord, x)"


def flatten_plans(plans: DataFrame) -> DataFrame:
    """``plans(plan_id, plan_json)`` to ``plan_nodes``; embedded plans included.

    One pass per nesting depth of subqueries, over all plans at once.
    """
    trees = plans.repartition("plan_id").select(
        "plan_id", F.lit("0").alias("tree"), F.expr(f"cast(array() as {SCOPES})").alias("scopes"),
        F.col("plan_json").alias("json"),
    )
    levels = []
    while True:
        nodes = cut(_parse(trees))
        levels.append(nodes)
        items = nodes.select(
            "plan_id", "tree", "node", "scopes",
            F.explode(F.expr(
                "concat(coalesce(transform(filter(items, i -> i.alt = 0), i -> struct(i.ord, i.tokens)), array()),"
                " if(lateral is null, array(), array(struct(-1 as ord, lateral as tokens))))"
            )).alias("item"),
        )
        trees = (
            items.select("plan_id", "tree", "node", "scopes", "item.ord", F.posexplode("item.tokens").alias("x", "t"))
            .filter(F.col("t.plan").isNotNull())
            .select("plan_id", F.expr(EMBEDDED_TREE).alias("tree"), "scopes", F.col("t.plan").alias("json"))
        )
        if trees.isEmpty():
            return reduce(DataFrame.unionByName, levels)
