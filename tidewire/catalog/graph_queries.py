"""Topology jobs over suppliers, customers and the lineitems that join them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.catalog.registry import query
from tidewire.operators import graph as G
from tidewire.operators.blocked import Order

c = F.col


def parts(t):
    """Topology nodes from suppliers, inventory from customers, sites from nations, links from lineitems."""
    k = c("s_suppkey")
    nodes = t.supplier.select(F.concat(F.lit("n"), k.cast("string")).alias("id"), c("s_name").alias("label"), F.concat(F.lit("ip"), (k % 37).cast("string")).alias("ip"),
                              F.when(k % 3 == 0, "").otherwise("Switches").alias("family"), F.lit(None).cast("string").alias("role"), F.when(k % 4 > 0, c("s_nationkey").cast("string")).otherwise("none").alias("site_id"))
    u = c("c_custkey")
    devices = t.customer.select(F.lpad(u.cast("string"), 9, "0").alias("id"), F.concat(F.lit("u"), u.cast("string")).alias("uuid"), F.concat(F.lit("ip"), u.cast("string")).alias("ip"), c("c_name").alias("hostname"),
                                F.lit("Routers").alias("family"), F.when(u % 2 == 0, "CORE").otherwise("ACCESS").alias("role"), F.when(u % 3 == 0, "Reachable").when(u % 3 == 1, "Unreachable").otherwise("").alias("reachability"),
                                F.lit("").alias("management_state"), F.lit("").alias("collection_status"), F.concat(F.lit("room"), (u % 5).cast("string")).alias("location"))
    sites = t.nation.select(c("n_nationkey").cast("string").alias("id"), c("n_name").alias("name"))
    p = c("l_partkey")
    links = t.lineitem.select(F.lit("").alias("id"), F.concat(F.lit("n"), c("l_suppkey").cast("string")).alias("source"), F.when(p % 50 > 0, F.concat(F.lit("n"), (p % 150).cast("string"))).otherwise(" ").alias("target"),
                              F.concat(F.lit("Gi"), c("l_linenumber").cast("string")).alias("start_port"), F.lit("").alias("end_port"), F.when(c("l_linenumber") > 3, "unknown").otherwise("10 Gbps").alias("start_speed"),
                              F.lit("1000000").alias("end_speed"), F.lit("").alias("speed"), F.when(c("l_returnflag") == "A", "Up").when(c("l_returnflag") == "R", "down").otherwise("").alias("status"), "l_orderkey", "l_extendedprice", "l_quantity")
    return nodes, links, devices, sites


GRAPH = """
with nd as (select 'n' || s_suppkey as id, s_name as title, case when s_suppkey % 3 = 0 then case when s_suppkey % 37 is not null then 'Routers' end else 'Switches' end as family, s_suppkey % 37 as u,
  case when s_suppkey % 4 > 0 then n_name else 'room' || ((s_suppkey % 37) % 5) end as site_id from supplier join nation on s_nationkey = n_nationkey),
lk as (select l_orderkey, l_extendedprice, l_quantity, l_linenumber, l_returnflag, 'n' || l_suppkey as source, 'n' || (l_partkey % 150) as target, l_partkey % 50 > 0 as ok from lineitem),
nx as (select id, title, family, case u % 3 when 0 then 'high' when 1 then 'low' else 'medium' end as confidence, case u % 3 when 0 then 'reachable' when 1 then 'unreachable' else 'discovered' end as mainstat, site_id from nd
  union all select distinct target, target, 'link-only', 'medium', 'discovered', 'unknown' from lk where ok and target not in (select id from nd))
"""


def nodes_of(t):
    n, l, d, s = parts(t)
    return G.build_nodes(n, l, d, s)


@query("g01_build_nodes", GRAPH + """
select id, title, family, confidence, mainstat, site_id, (confidence = 'high')::int as arc_high, (confidence = 'medium')::int as arc_medium, (confidence = 'low')::int as arc_low,
 confidence as secondarystat, case confidence when 'high' then '#299c46' when 'medium' then '#e0b400' else '#d44a3a' end as color, 'inventory' as source_lineage, '/n/' || url_encode(id) as detail_url from nx""")
def g01(t):
    return G.build_nodes(*parts(t), detail_prefix="/n/").select("id", "title", "family", "confidence", "mainstat", "site_id", "arc_high", "arc_medium", "arc_low", "secondarystat", "color", "source_lineage", "detail_url")


EDGES = GRAPH + """
, b as (select *, source || '|' || target || '|Gi' || l_linenumber as base from lk where ok),
e0 as (select *, row_number() over (partition by base order by l_orderkey, l_extendedprice, l_quantity) as i from b),
ed as (select case when i = 1 then base else base || '-' || i end as id, source, target, case when a.site_id = z.site_id then a.site_id else 'inter-site' end as site_id, 'prod' as environment,
  case when l_linenumber > 3 then '1 Gbps' else '10 Gbps' end as mainstat, case l_returnflag when 'A' then 'high' when 'R' then 'low' else 'medium' end as confidence, case when l_linenumber > 3 then '#ff9830' else '#33b5e5' end as color,
  a.site_id as ss, z.site_id as zs from e0 join nx a on a.id = source join nx z on z.id = target)
"""


def edges_of(t):
    _, l, _, _ = parts(t)
    return G.build_edges(l, nodes_of(t), Order("l_orderkey", ("l_extendedprice", "l_quantity")))


@query("g02_build_edges", EDGES + "select id, source, target, site_id, environment, mainstat, confidence, color, confidence as secondarystat, 'inventory' as source_lineage from ed")
def g02(t):
    return edges_of(t).select("id", "source", "target", "site_id", "environment", "mainstat", "confidence", "color", "secondarystat", "source_lineage")


@query("p15_topology_filter", EDGES + "select id, source, target from ed where (site_id = 'NATION_3' or ss = 'NATION_3' or zs = 'NATION_3') and confidence = 'high'")
def p15(t):
    return G.topology_filter(nodes_of(t), edges_of(t), site="NATION_3", confidence="high").select("id", "source", "target")


@query("g05_visible_subgraph", EDGES + """
, f as (select * from ed where site_id = 'NATION_3' or ss = 'NATION_3' or zs = 'NATION_3')
select 'node' as kind, id from nx where id in (select source from f union select target from f) union all select 'edge', id from f""")
def g05(t):
    n, e = G.visible_subgraph(nodes_of(t), edges_of(t), site="NATION_3")
    return n.select(F.lit("node").alias("kind"), "id").unionByName(e.select(F.lit("edge").alias("kind"), "id"))


@query("g03_assign_layers", """
select c_custkey, case when c_name like '%CORE%' then 1 when c_custkey % 5 = 0 then 1 when c_custkey % 5 = 1 then 3 when c_custkey % 5 = 2 then 2 when c_custkey % 5 = 3 then 0 else 5 end as layer from customer""")
def g03(t):
    k = c("c_custkey") % 5
    role = F.when(k == 0, " core").when(k == 1, "ACCESS").when(k == 2, "Switches and Hubs (x)").when(k == 4, "other").otherwise("nothing")
    host = F.when(k == 3, F.concat(F.lit("fw-"), "c_name")).otherwise(c("c_name"))
    return G.assign_layers(t.customer.select("c_custkey", host.alias("host"), role.alias("role")), "host", "role").select("c_custkey", "layer")


@query("g04_orient_links", """
with y as (select l_orderkey, l_quantity, l_linenumber, 's' || l_suppkey as a, 'p' || (l_partkey % 90) as z, (l_suppkey % 4)::int as la, case when l_partkey % 90 < 80 then (l_partkey % 90 % 6)::int else 5 end as lz from lineitem)
select l_orderkey, l_quantity, case when la > lz or (la = lz and a > z) then z else a end as a_id, case when la > lz or (la = lz and a > z) then a else z end as z_id,
 case when la > lz or (la = lz and a > z) then 'z' || l_linenumber else 'a' || l_linenumber end as a_interface from y""")
def g04(t):
    links = t.lineitem.select("l_orderkey", "l_quantity", F.concat(F.lit("s"), c("l_suppkey").cast("string")).alias("a_id"), F.concat(F.lit("p"), (c("l_partkey") % 90).cast("string")).alias("z_id"),
                              F.concat(F.lit("a"), c("l_linenumber").cast("string")).alias("a_interface"), F.concat(F.lit("z"), c("l_linenumber").cast("string")).alias("z_interface"))
    s = t.supplier.select(F.concat(F.lit("s"), c("s_suppkey").cast("string")).alias("id"), (c("s_suppkey") % 4).cast("int").alias("layer"))
    p = t.part.select((c("p_partkey") % 90).alias("k")).distinct().filter(c("k") < 80).select(F.concat(F.lit("p"), c("k").cast("string")).alias("id"), (c("k") % 6).cast("int").alias("layer"))
    return G.orient_links(links, s.unionByName(p)).select("l_orderkey", "l_quantity", "a_id", "z_id", "a_interface")


def tree(t):
    """Directed edges between customers: each points from its tenth, and some to a neighbour."""
    k = c("c_custkey")
    a = t.customer.filter(k > 0).select(F.floor(k / 10).alias("source"), k.alias("target"))
    b = t.customer.select(k.alias("source"), ((k * 7 + 3) % 1500).alias("target"))
    return a.unionByName(b)


TREE = """
with recursive e as (select c_custkey // 10 as source, c_custkey as target from customer where c_custkey > 0 union select c_custkey, (c_custkey * 7 + 3) % 1500 from customer),
w as (select 5::bigint as id, 0 as depth union select e.target, w.depth + 1 from w join e on e.source = w.id where w.depth < 12),
d as (select id, min(depth)::int as depth from w group by 1)
"""


def depths(t):
    return G.graph_depth(tree(t), t.spark.range(5, 6).select(c("id")))


@query("g06_graph_depth", TREE + "select id, depth from d")
def g06(t):
    return depths(t)


@query("g07_graph_layout", TREE + """
, n as (select c_custkey as id, coalesce(depth, (select max(depth) + 1 from d))::int as depth from customer left join d on d.id = c_custkey)
select id, depth, 220 * (row_number() over (partition by depth order by id) - 1) as fixed_x, depth::bigint * 180 as fixed_y from n""")
def g07(t):
    n = t.customer.select(c("c_custkey").alias("id"))
    return G.graph_layout(n, depths(t), Order("id")).select("id", "depth", "fixed_x", "fixed_y")


@query("g08_graph_checks", """
with n as (select case when s_suppkey % 9 = 0 then 'n' || s_suppkey || ' ' when s_suppkey % 10 = 1 then 'n1' else 'n' || s_suppkey end as id, s_suppkey % 6 > 0 as arc from supplier),
e as (select o_orderkey, 'e' || o_orderkey as id, 'n' || (o_custkey % 120) as source, 'n' || (o_custkey % 97) as target from orders)
select 'orphan_source' as finding, id, 1::bigint as n from e where source not in (select id from n) union all select 'orphan_target', id, 1 from e where target not in (select id from n)
union all select 'untidy_id', id, 1 from n where id <> trim(id) union all select 'repeated_id', id, count(*) from n group by id having count(*) > 1 union all select 'no_arc', id, 1 from n where not arc""")
def g08(t):
    k = c("s_suppkey")
    s = F.concat(F.lit("n"), k.cast("string"))
    n = t.supplier.select(F.when(k % 9 == 0, F.concat(s, F.lit(" "))).when(k % 10 == 1, "n1").otherwise(s).alias("id"), F.when(k % 6 > 0, 1).alias("arc_high"), F.lit(0).alias("arc_medium"), F.lit(None).cast("int").alias("arc_low"))
    e = t.orders.select(F.concat(F.lit("e"), c("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("n"), (c("o_custkey") % 120).cast("string")).alias("source"), F.concat(F.lit("n"), (c("o_custkey") % 97).cast("string")).alias("target"))
    return G.graph_checks(n, e)


@query("g08_filter_counts", "select count(*) as rows___all, count(*) filter (where s_nationkey = 3) as \"rows_3\", 0::bigint as rows_empty from supplier")
def g08b(t):
    return G.filter_counts(t.supplier.select(c("s_nationkey").cast("string").alias("site_id")), ["__all", "3", ""])
