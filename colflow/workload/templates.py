"""One statement per relational construct, with its lineage derived by hand.

In ``expect`` each line reads ``output <- source columns``; ``*`` marks a
derived origin, ``constant`` an output without source column, ``unknown`` one
that cannot be traced. ``{n}`` stands for a number taken from the data row
that submits the statement; ``{table}`` for a test table.
"""

from __future__ import annotations

from dataclasses import dataclass

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Views over the test tables, and the two functions a statement may call.
VIEWS = {
    "customer_view": "select c_custkey, c_name as name, upper(c_mktsegment) as segment, c_nationkey from customer",
    "customer_nation_view": (
        "select v.c_custkey, v.name, v.segment, n.n_name as nation"
        " from customer_view v join nation n on n.n_nationkey = v.c_nationkey"
    ),
}


@dataclass(frozen=True)
class Template:
    sql: str
    expect: str
    stop_at_views: bool = False
    lenient: bool = False

    def text(self) -> str:
        """The statement with plain table names; ``{n}`` stays."""
        sql = self.sql
        for table in TABLES:
            sql = sql.replace("{" + table + "}", table)
        return sql

    def edges(self) -> list[tuple]:
        """(ordinal, output, status, table, column, derived) rows."""
        rows = []
        for i, line in enumerate(line for line in self.expect.strip().splitlines() if line.strip()):
            target, sources = (part.strip() for part in line.split("<-"))
            if sources in ("constant", "unknown"):
                rows.append((i + 1, target, sources, None, None, None))
                continue
            for source in sources.split(","):
                table, column = source.strip().rstrip("*").split(".")
                rows.append((i + 1, target, "mapped", table, column, source.strip().endswith("*")))
        return rows


TEMPLATES: dict[str, Template] = {
    "scan": Template(
        "select o_orderkey, o_custkey, o_totalprice, o_orderdate from orders",
        """
        o_orderkey <- orders.o_orderkey
        o_custkey <- orders.o_custkey
        o_totalprice <- orders.o_totalprice
        o_orderdate <- orders.o_orderdate
        """,
    ),
    "project": Template(
        "select n_name as nation_name, N_REGIONKEY region, nation.n_nationkey from NATION",
        """
        nation_name <- nation.n_name
        region <- nation.n_regionkey
        n_nationkey <- nation.n_nationkey
        """,
    ),
    "expression": Template(
        "select (l_quantity * l_extendedprice * (1 - l_discount / 100)) as line_total, l_orderkey"
        " from lineitem where l_linenumber > {n}",
        """
        line_total <- lineitem.l_quantity*, lineitem.l_extendedprice*, lineitem.l_discount*
        l_orderkey <- lineitem.l_orderkey
        """,
    ),
    "literal": Template(
        "select 1 as one, 'a  -- text' as words, null as nothing, {n} + 1 as counted, o_orderkey from orders",
        """
        one <- constant
        words <- constant
        nothing <- constant
        counted <- constant
        o_orderkey <- orders.o_orderkey
        """,
    ),
    "mixed_use": Template(
        "select l_discount, l_extendedprice * (1 - l_discount / 100) as net from lineitem",
        """
        l_discount <- lineitem.l_discount
        net <- lineitem.l_extendedprice*, lineitem.l_discount*
        """,
    ),
    "filter": Template(
        "select c_name from customer where c_acctbal > {n} and c_mktsegment = 'BUILDING'"
        " and c_nationkey between 1 and 9",
        "c_name <- customer.c_name",
    ),
    "join_inner": Template(
        "select o.o_orderkey, c.c_name as customer_name, c.c_custkey"
        " from orders o join customer c on c.c_custkey = o.o_custkey",
        """
        o_orderkey <- orders.o_orderkey
        customer_name <- customer.c_name
        c_custkey <- customer.c_custkey
        """,
    ),
    "join_multiway": Template(
        "select o.o_orderkey, c.c_name as customer_name, p.p_name as product_name, l.l_quantity,"
        " l.l_extendedprice, l.l_discount,"
        " (l.l_quantity * l.l_extendedprice * (1 - l.l_discount / 100)) as line_total"
        " from lineitem l join orders o on o.o_orderkey = l.l_orderkey"
        " join customer c on c.c_custkey = o.o_custkey join part p on p.p_partkey = l.l_partkey",
        """
        o_orderkey <- orders.o_orderkey
        customer_name <- customer.c_name
        product_name <- part.p_name
        l_quantity <- lineitem.l_quantity
        l_extendedprice <- lineitem.l_extendedprice
        l_discount <- lineitem.l_discount
        line_total <- lineitem.l_quantity*, lineitem.l_extendedprice*, lineitem.l_discount*
        """,
    ),
    "join_theta": Template(
        "select a.n_name, b.r_name from nation a join region b on a.n_regionkey < b.r_regionkey + {n}",
        """
        n_name <- nation.n_name
        r_name <- region.r_name
        """,
    ),
    "join_cross": Template(
        "select s.s_name, r.r_name from supplier s cross join region r",
        """
        s_name <- supplier.s_name
        r_name <- region.r_name
        """,
    ),
    "join_outer": Template(
        "select c.c_name, o.o_totalprice, o.o_orderkey + {n} as next_key"
        " from customer c left join orders o on o.o_custkey = c.c_custkey",
        """
        c_name <- customer.c_name
        o_totalprice <- orders.o_totalprice*
        next_key <- orders.o_orderkey*
        """,
    ),
    "join_outer_right": Template(
        "select x.c_name, x.o_orderkey, n.n_name from (select c.c_name, c.c_nationkey, o.o_orderkey from customer c"
        " join orders o on o.o_custkey = c.c_custkey) x right join nation n on n.n_nationkey = x.c_nationkey",
        """
        c_name <- customer.c_name*
        o_orderkey <- orders.o_orderkey*
        n_name <- nation.n_name
        """,
    ),
    "join_outer_full": Template(
        "select n.n_name, s.s_name, r.r_name from nation n full join supplier s on s.s_nationkey = n.n_nationkey"
        " cross join region r",
        """
        n_name <- nation.n_name*
        s_name <- supplier.s_name*
        r_name <- region.r_name
        """,
    ),
    "join_outer_nested": Template(
        # filtered and re-projected above the join: still derived; the scan below
        # the join's preserved side is not
        "select y.c_name, y.price from (select c.c_name, o.o_totalprice as price from customer c"
        " left join orders o on o.o_custkey = c.c_custkey) y where y.price > {n}",
        """
        c_name <- customer.c_name
        price <- orders.o_totalprice*
        """,
    ),
    "join_semi_anti": Template(
        "select c_name, c_nationkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey)"
        " and c.c_nationkey in (select n_nationkey from nation)"
        " and not exists (select 1 from supplier s where s.s_nationkey = c.c_nationkey and s.s_acctbal > {n})",
        """
        c_name <- customer.c_name
        c_nationkey <- customer.c_nationkey
        """,
    ),
    "join_left_semi": Template(
        "select n.n_name from nation n left semi join supplier s on s.s_nationkey = n.n_nationkey"
        " left anti join customer c on c.c_nationkey = n.n_nationkey",
        "n_name <- nation.n_name",
    ),
    "join_using": Template(
        "select k, a, b from (select n_regionkey as k, n_name as a from nation) x"
        " join (select r_regionkey as k, r_name as b from region) y using (k)",
        """
        k <- nation.n_regionkey
        a <- nation.n_name
        b <- region.r_name
        """,
    ),
    "join_using_full": Template(
        "select k, a, b from (select n_regionkey as k, n_name as a from nation) x"
        " full outer join (select r_regionkey as k, r_name as b from region) y using (k)",
        """
        k <- nation.n_regionkey*, region.r_regionkey*
        a <- nation.n_name*
        b <- region.r_name*
        """,
    ),
    "join_natural": Template(
        "select * from (select n_regionkey as k, n_name as a from nation) x"
        " natural join (select r_regionkey as k, r_name as b from region) y",
        """
        k <- nation.n_regionkey
        a <- nation.n_name
        b <- region.r_name
        """,
    ),
    "join_self": Template(
        "select a.n_name, b.n_name as neighbour, b.n_nationkey + a.n_nationkey as both_keys"
        " from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
        """
        n_name <- nation.n_name
        neighbour <- nation.n_name
        both_keys <- nation.n_nationkey*
        """,
    ),
    "join_composite": Template(
        "select l.l_partkey, l.l_suppkey, l.l_quantity, t.total from lineitem l join"
        " (select l_partkey, l_suppkey, sum(l_quantity) as total from lineitem group by l_partkey, l_suppkey) t"
        " on t.l_partkey = l.l_partkey and t.l_suppkey = l.l_suppkey",
        """
        l_partkey <- lineitem.l_partkey
        l_suppkey <- lineitem.l_suppkey
        l_quantity <- lineitem.l_quantity
        total <- lineitem.l_quantity*
        """,
    ),
    "join_two_roles": Template(
        "select s.s_name, sn.n_name as supplier_nation, c.c_name, cn.n_name as customer_nation"
        " from supplier s join nation sn on sn.n_nationkey = s.s_nationkey"
        " join nation cn on cn.n_regionkey = sn.n_regionkey join customer c on c.c_nationkey = cn.n_nationkey",
        """
        s_name <- supplier.s_name
        supplier_nation <- nation.n_name
        c_name <- customer.c_name
        customer_nation <- nation.n_name
        """,
    ),
    "join_two_parents": Template(
        "select l.l_orderkey, p.p_name, s.s_name from lineitem l join part p on p.p_partkey = l.l_partkey"
        " join supplier s on s.s_suppkey = l.l_suppkey where l.l_quantity > {n}",
        """
        l_orderkey <- lineitem.l_orderkey
        p_name <- part.p_name
        s_name <- supplier.s_name
        """,
    ),
    "join_one_to_one": Template(
        "select o.o_orderkey, o.o_totalprice, t.line_sum from orders o join"
        " (select l_orderkey, sum(l_extendedprice) as line_sum from lineitem group by l_orderkey) t"
        " on t.l_orderkey = o.o_orderkey",
        """
        o_orderkey <- orders.o_orderkey
        o_totalprice <- orders.o_totalprice
        line_sum <- lineitem.l_extendedprice*
        """,
    ),
    "group_key": Template(
        "select o_custkey, upper(o_orderstatus) as status from orders group by o_custkey, upper(o_orderstatus)",
        """
        o_custkey <- orders.o_custkey
        status <- orders.o_orderstatus*
        """,
    ),
    "aggregate": Template(
        "select o_custkey, sum(o_totalprice) as total, count(*) as orders_made, max(o_orderdate) as latest,"
        " sum(o_totalprice) / count(o_orderkey) as mean from orders group by o_custkey",
        """
        o_custkey <- orders.o_custkey
        total <- orders.o_totalprice*
        orders_made <- constant
        latest <- orders.o_orderdate*
        mean <- orders.o_totalprice*, orders.o_orderkey*
        """,
    ),
    "aggregate_distinct": Template(
        "select count(distinct o_custkey) as buyers, sum(o_totalprice) filter (where o_orderstatus = 'F') as closed"
        " from orders",
        """
        buyers <- orders.o_custkey*
        closed <- orders.o_totalprice*, orders.o_orderstatus*
        """,
    ),
    "distinct": Template(
        "select distinct c_mktsegment, c_nationkey from customer",
        """
        c_mktsegment <- customer.c_mktsegment
        c_nationkey <- customer.c_nationkey
        """,
    ),
    "grouping_sets": Template(
        "select o_orderstatus, o_orderpriority, sum(o_totalprice) as total, grouping(o_orderstatus) as level"
        " from orders group by grouping sets ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
        """
        o_orderstatus <- orders.o_orderstatus
        o_orderpriority <- orders.o_orderpriority
        total <- orders.o_totalprice*
        level <- constant
        """,
    ),
    "cube_rollup": Template(
        "select o_orderstatus, count(o_orderkey) as n from orders group by cube (o_orderstatus, o_custkey)",
        """
        o_orderstatus <- orders.o_orderstatus
        n <- orders.o_orderkey*
        """,
    ),
    "having": Template(
        "select o_custkey from orders group by o_custkey having sum(o_totalprice) > {n} and max(o_orderdate) is not null",
        "o_custkey <- orders.o_custkey",
    ),
    "window_rank": Template(
        "select o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc) as place from orders",
        """
        o_orderkey <- orders.o_orderkey
        place <- orders.o_custkey*, orders.o_totalprice*
        """,
    ),
    "window_agg": Template(
        "select o_orderkey, sum(o_totalprice) over (partition by o_custkey order by o_orderdate"
        " rows between {n} preceding and current row) as running,"
        " lag(o_orderdate) over (partition by o_custkey order by o_orderkey) as previous from orders",
        """
        o_orderkey <- orders.o_orderkey
        running <- orders.o_totalprice*, orders.o_custkey*, orders.o_orderdate*
        previous <- orders.o_orderdate*, orders.o_custkey*, orders.o_orderkey*
        """,
    ),
    "sort_limit": Template(
        "select c_name from customer order by c_acctbal desc, c_custkey limit 10 offset {n}",
        "c_name <- customer.c_name",
    ),
    "union": Template(
        "select n_name as name, n_regionkey as k from nation"
        " union all select r_name, r_regionkey from region"
        " union select upper(s_name), s_nationkey from supplier",
        """
        name <- nation.n_name, region.r_name, supplier.s_name*
        k <- nation.n_regionkey, region.r_regionkey, supplier.s_nationkey
        """,
    ),
    "union_scope": Template(
        # the union reuses its first branch's column ids; the scalar subquery
        # reads the same table and must not see the other branch
        "select x.n_name, (select max(n_name) from nation) as last_name"
        " from (select n_name from nation union all select r_name from region) x",
        """
        n_name <- nation.n_name, region.r_name
        last_name <- nation.n_name*
        """,
    ),
    "intersect_except": Template(
        "(select c_nationkey as k from customer intersect select s_nationkey from supplier)"
        " except select n_nationkey from nation where n_regionkey = {n}",
        "k <- customer.c_nationkey, supplier.s_nationkey, nation.n_nationkey",
    ),
    "intersect_except_repeated": Template(
        # a column repeated in the first branch is two output positions
        "(select n_name, n_name from nation intersect select c_name, c_mktsegment from customer)"
        " except select r_name, r_name from region where r_regionkey > {n}",
        """
        n_name <- nation.n_name, customer.c_name, region.r_name
        n_name0 <- nation.n_name, customer.c_mktsegment, region.r_name
        """,
    ),
    "values": Template(
        "select x, y from (values (1, 'a'), ({n}, 'b')) as t(x, y)",
        """
        x <- constant
        y <- constant
        """,
    ),
    "subquery_from": Template(
        "select z.k, z.doubled from (select y.k, y.price * 2 as doubled from"
        " (select o_orderkey as k, o_totalprice as price from orders) y) z",
        """
        k <- orders.o_orderkey
        doubled <- orders.o_totalprice*
        """,
    ),
    "subquery_scalar": Template(
        "select c.c_name, (select max(o.o_totalprice) from orders o where o.o_custkey = c.c_custkey) as largest,"
        " c.c_nationkey in (select s_nationkey from supplier) as served from customer c",
        """
        c_name <- customer.c_name
        largest <- orders.o_totalprice*
        served <- customer.c_nationkey*, supplier.s_nationkey*
        """,
    ),
    "subquery_nested": Template(
        "select n_name, (select max(c_acctbal) + (select min(s_acctbal) from supplier) from customer"
        " where c_nationkey = n_nationkey) as spread from nation",
        """
        n_name <- nation.n_name
        spread <- customer.c_acctbal*, supplier.s_acctbal*
        """,
    ),
    "cte": Template(
        "with big as (select o_custkey as k, o_totalprice as price from orders where o_totalprice > {n})"
        " select a.k, b.price, a.price - b.price as gap from big a join big b on a.k = b.k",
        """
        k <- orders.o_custkey
        price <- orders.o_totalprice
        gap <- orders.o_totalprice*
        """,
    ),
    "cte_recursive": Template(
        "with recursive up(k, name, depth) as (select n_nationkey, n_name, 1 from nation"
        " union all select k + 1, name, depth + 1 from up where depth < {n})"
        " select k, name, depth from up",
        """
        k <- nation.n_nationkey, nation.n_nationkey*
        name <- nation.n_name
        depth <- constant
        """,
    ),
    "view": Template(
        "select name, segment, nation from customer_nation_view",
        """
        name <- customer.c_name
        segment <- customer.c_mktsegment*
        nation <- nation.n_name
        """,
    ),
    "view_stop": Template(
        "select name, segment || nation as label from customer_nation_view",
        """
        name <- customer_nation_view.name
        label <- customer_nation_view.segment*, customer_nation_view.nation*
        """,
        stop_at_views=True,
    ),
    "lateral": Template(
        "select n_name, x.richest, y.raised from nation, lateral (select max(c_acctbal) as richest"
        " from customer where c_nationkey = n_nationkey) x, lateral (select x.richest + n_regionkey as raised) y",
        """
        n_name <- nation.n_name
        richest <- customer.c_acctbal*
        raised <- customer.c_acctbal*, nation.n_regionkey*
        """,
    ),
    "generate": Template(
        "select vec_id, weight, place from embeddings lateral view posexplode(embedding) e as place, weight",
        """
        vec_id <- embeddings.vec_id
        weight <- embeddings.embedding*
        place <- embeddings.embedding*
        """,
    ),
    "pivot": Template(
        "select * from (select o_orderstatus, o_orderpriority, o_totalprice from orders)"
        " pivot (sum(o_totalprice) for o_orderstatus in ('F' as closed, 'O' as open))",
        """
        o_orderpriority <- orders.o_orderpriority
        closed <- orders.o_totalprice*, orders.o_orderstatus*
        open <- orders.o_totalprice*, orders.o_orderstatus*
        """,
    ),
    "insert_select": Template(
        "insert into region select n_regionkey, concat(n_name, '-', n_nationkey) from nation",
        """
        r_regionkey <- nation.n_regionkey
        r_name <- nation.n_name*, nation.n_nationkey*
        """,
    ),
    "create_select": Template(
        "create table region_names using parquet as select r_regionkey as k, upper(r_name) as name from region",
        """
        k <- region.r_regionkey
        name <- region.r_name*
        """,
    ),
    "star": Template(
        "select * from nation n join region r on r.r_regionkey = n.n_regionkey",
        """
        n_nationkey <- nation.n_nationkey
        n_name <- nation.n_name
        n_regionkey <- nation.n_regionkey
        r_regionkey <- region.r_regionkey
        r_name <- region.r_name
        """,
    ),
    "quoted_names": Template(
        'select "o_orderkey" as "Order Key", O.O_TOTALPRICE from "orders" O',
        """
        Order Key <- orders.o_orderkey
        O_TOTALPRICE <- orders.o_totalprice
        """,
    ),
    "fn_math": Template(
        "select o_orderkey, abs(o_totalprice - 1000) as away, round(o_totalprice, 0) as rounded,"
        " power(o_custkey % 7, 2) as squared, mod(o_orderkey, 10) as last_digit from {orders}",
        """
        o_orderkey <- orders.o_orderkey
        away <- orders.o_totalprice*
        rounded <- orders.o_totalprice*
        squared <- orders.o_custkey*
        last_digit <- orders.o_orderkey*
        """,
    ),
    "fn_string": Template(
        "select c_custkey, upper(c_name) as upper_name, substr(c_name, 1, 5) as head,"
        " concat(c_mktsegment, '/', c_name) as path, c_name || c_mktsegment as joined,"
        " c_name like '%1%' as has_one, regexp_replace(c_name, '[0-9]+', '') as letters from {customer}",
        """
        c_custkey <- customer.c_custkey
        upper_name <- customer.c_name*
        head <- customer.c_name*
        path <- customer.c_mktsegment*, customer.c_name*
        joined <- customer.c_name*, customer.c_mktsegment*
        has_one <- customer.c_name*
        letters <- customer.c_name*
        """,
    ),
    "fn_date": Template(
        "select o_orderkey, cast(date_trunc('month', o_orderdate) as timestamp_ntz) as month_start, extract(year from o_orderdate) as y,"
        " o_orderdate + interval '1' day as next_day from {orders}",
        """
        o_orderkey <- orders.o_orderkey
        month_start <- orders.o_orderdate*
        y <- orders.o_orderdate*
        next_day <- orders.o_orderdate*
        """,
    ),
    "fn_conditional": Template(
        "select o_orderkey, case when o_orderstatus = 'F' then o_totalprice else 0 end as closed,"
        " coalesce(nullif(o_orderpriority, '5-LOW'), o_orderstatus) as label from {orders}",
        """
        o_orderkey <- orders.o_orderkey
        closed <- orders.o_orderstatus*, orders.o_totalprice*
        label <- orders.o_orderpriority*, orders.o_orderstatus*
        """,
    ),
    "fn_cast": Template(
        "select o_orderkey, cast(o_totalprice as decimal(18, 2)) as price, o_custkey::string as buyer from {orders}",
        """
        o_orderkey <- orders.o_orderkey
        price <- orders.o_totalprice*
        buyer <- orders.o_custkey*
        """,
    ),
    "fn_array": Template(
        "select n_nationkey, size(array(n_name, upper(n_name))) as n_names,"
        " array_join(array(n_name, cast(n_regionkey as string)), '/') as path from {nation}",
        """
        n_nationkey <- nation.n_nationkey
        n_names <- nation.n_name*
        path <- nation.n_name*, nation.n_regionkey*
        """,
    ),
    "fn_map": Template(
        "select c_custkey, map(c_name, c_acctbal)[c_name] as balance,"
        " cardinality(map(c_mktsegment, c_nationkey)) as entries from {customer}",
        """
        c_custkey <- customer.c_custkey
        balance <- customer.c_name*, customer.c_acctbal*
        entries <- customer.c_mktsegment*, customer.c_nationkey*
        """,
    ),
    "fn_json": Template(
        "select event_id, cast(get_json_object(props, '$.k') as int) as k from {events}",
        """
        event_id <- events.event_id
        k <- events.props*
        """,
    ),
    "fn_boolean": Template(
        "select o_orderkey, o_totalprice > 1000 as large, o_orderstatus in ('F', 'O') as known,"
        " o_custkey between 10 and 20 as near, o_orderpriority is null as missing from {orders}",
        """
        o_orderkey <- orders.o_orderkey
        large <- orders.o_totalprice*
        known <- orders.o_orderstatus*
        near <- orders.o_custkey*
        missing <- orders.o_orderpriority*
        """,
    ),
    "fn_udf": Template(
        "select o_orderkey, order_score(o_totalprice, o_custkey) as score from orders",
        """
        o_orderkey <- orders.o_orderkey
        score <- orders.o_totalprice*, orders.o_custkey*
        """,
        lenient=True,
    ),
}

# DuckDB spelling of the function templates, where it differs
DUCKDB_TEXT = {
    "fn_math": (
        "select o_orderkey, abs(o_totalprice - 1000) as away, round(o_totalprice, 0) as rounded,"
        " power(o_custkey % 7, 2) as squared, o_orderkey % 10 as last_digit from orders"
    ),
    "fn_string": (
        "select c_custkey, upper(c_name) as upper_name, substr(c_name, 1, 5) as head,"
        " concat(c_mktsegment, '/', c_name) as path, c_name || c_mktsegment as joined,"
        " c_name like '%1%' as has_one, regexp_replace(c_name, '[0-9]+', '', 'g') as letters from customer"
    ),
    "fn_date": (
        "select o_orderkey, cast(date_trunc('month', o_orderdate) as timestamp) as month_start,"
        " cast(extract(year from o_orderdate) as int) as y, o_orderdate + interval 1 day as next_day from orders"
    ),
    "fn_conditional": (
        "select o_orderkey, case when o_orderstatus = 'F' then o_totalprice else 0 end as closed,"
        " coalesce(nullif(o_orderpriority, '5-LOW'), o_orderstatus) as label from orders"
    ),
    "fn_cast": (
        "select o_orderkey, cast(o_totalprice as decimal(18, 2)) as price, o_custkey::varchar as buyer from orders"
    ),
    "fn_array": (
        "select n_nationkey, cast(len([n_name, upper(n_name)]) as int) as n_names,"
        " array_to_string([n_name, cast(n_regionkey as varchar)], '/') as path from nation"
    ),
    "fn_map": (
        "select c_custkey, map([c_name], [c_acctbal])[c_name] as balance,"
        " cast(cardinality(map([c_mktsegment], [c_nationkey])) as int) as entries from customer"
    ),
    "fn_json": "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events",
    "fn_boolean": (
        "select o_orderkey, o_totalprice > 1000 as large, o_orderstatus in ('F', 'O') as known,"
        " o_custkey between 10 and 20 as near, o_orderpriority is null as missing from orders"
    ),
}
