"""Topology tables: nodes, edges, layers, direction, visibility, depth and checks."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.predicates import pass_all
from tidewire.functions.scalars import confidence_arcs, format_speed, layer_for, link_speed_gbps, nullif_trim, speed_color, state_confidence
from tidewire.operators.blocked import Order, scan
from tidewire.operators.joins import multi_key_lookup
from tidewire.operators.windows import uniquify
from tidewire.session import checkpointed, written

c = F.col

# State vocabularies, speed colours (Gbps, high to low), layer rules.
ACTIVE_DEVICE = ["reachable", "managed", "active", "success"]
DOWN_DEVICE = ["unreachable", "down", "inactive", "failed", "partial collection failure"]
ACTIVE_LINK = ["up", "active", "connected"]
DOWN_LINK = ["down", "inactive", "disconnected", "failed"]
UNKNOWN_COLOR = "#8a8f98"
SPEED_COLORS = [(100.0, "#b877d9"), (40.0, "#705da0"), (25.0, "#5794f2"), (10.0, "#33b5e5"), (5.0, "#73bf69"), (2.5, "#f2cc0c"), (1.0, "#ff9830")]
ROLE_LAYERS = {"BORDER ROUTER": 0, "BORDER GATEWAY": 0, "CORE": 1, "DISTRIBUTION": 2, "ACCESS": 3, "UNIFIED AP": 4, "UNKNOWN": 5}
FAMILY_LAYERS = {"ROUTERS": 0, "SWITCHES AND HUBS": 2, "WIRELESS CONTROLLER": 3, "UNIFIED AP": 4, "VOICE AND TELEPHONY": 4}
HOST_LAYERS = [("*CORE*", 1), ("*COR-*", 1), ("*-COR*", 1), ("*DATA*", 1), ("*DIST*", 2), ("*FW*", 0), ("*EDGE*", 0), ("*WAN*", 0)]
DEFAULT_LAYER = 5
# Node colours by confidence; any other confidence has the last one.
CONFIDENCE_COLORS = {"high": "#299c46", "medium": "#e0b400", "low": "#d44a3a"}


def percent_encoded(text: Column) -> Column:
    """Text as one segment of a URL path."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def build_nodes(nodes: DataFrame, links: DataFrame, devices: DataFrame, sites: DataFrame, environment: str = "prod", lineage: str = "inventory", detail_prefix: str = "") -> DataFrame:
    """Topology nodes enriched from the inventory and the sites; endpoints seen only on links are added at
    medium confidence. One row per id, the later duplicate winning by label. A node's detail link is ``detail_prefix`` and its encoded id."""
    take = {"_hostname": "hostname", "_family": "family", "_role": "role", "_reach": "reachability", "_managed": "management_state", "_collected": "collection_status", "_location": "location"}
    n = nodes.filter(nullif_trim(c("id")).isNotNull())
    last = n.groupBy("id").agg(F.max_by(F.struct(*[x for x in n.columns if x != "id"]), F.struct("label", "ip")).alias("_r")).select("id", "_r.*")
    d = multi_key_lookup(last, devices.withColumn("_order", c("id")), ["id", "uuid", "ip", "hostname"], ["id", "ip", "label"], "_order", {**take, "_found": "_order"})
    d = d.join(sites.select(c("id").alias("site_id"), c("name").alias("_site")), "site_id", "left")
    blank = nullif_trim
    found = c("_found").isNotNull()
    family = F.coalesce(blank(c("family")), blank(c("_family")), F.lit("network_device"))
    shaped = d.select(
        "id", F.coalesce(blank(c("label")), blank(c("_hostname")), blank(c("ip")), c("id")).alias("title"), family.alias("family"),
        F.coalesce(blank(c("role")), blank(c("_role")), family).alias("role"),
        F.when(found, state_confidence([c("_reach"), c("_managed"), c("_collected")], ACTIVE_DEVICE, DOWN_DEVICE)).otherwise("medium").alias("confidence"),
        F.when(found, F.lower(F.coalesce(blank(c("_reach")), blank(c("_managed")), F.lit("discovered")))).otherwise("discovered").alias("mainstat"),
        F.coalesce(c("_site"), blank(c("_location")), F.lit("unknown")).alias("site_id"))
    # one count of all ids, as an anti-join would shuffle the ends of every link
    ends = links.select(F.explode(F.array("source", "target")).alias("id"), F.lit(False).alias("_known")).filter(blank(c("id")).isNotNull())
    ids = ends.unionByName(shaped.select("id", F.lit(True).alias("_known"))).groupBy("id").agg(F.bool_or("_known").alias("_known"))
    extra = ids.filter(~c("_known")).select(
        "id", c("id").alias("title"), F.lit("link-only").alias("family"), F.lit("unknown").alias("role"), F.lit("medium").alias("confidence"), F.lit("discovered").alias("mainstat"), F.lit("unknown").alias("site_id"))
    out = shaped.unionByName(extra).withColumn("environment", F.lit(environment))
    color = F.coalesce(F.create_map(*[F.lit(x) for pair in CONFIDENCE_COLORS.items() for x in pair])[c("confidence")], F.lit(CONFIDENCE_COLORS["low"]))
    out = out.withColumns({"secondarystat": c("confidence"), "color": color, "source_lineage": F.lit(lineage), "detail_url": F.concat(F.lit(detail_prefix), percent_encoded(c("id")))})
    return out.withColumns({"subtitle": F.concat("family", F.lit(" | "), "site_id", F.lit(" | confidence="), "confidence"), **confidence_arcs(c("confidence"))})


def build_edges(links: DataFrame, nodes: DataFrame, order: Order, lineage: str = "inventory") -> DataFrame:
    """Edges between named ends, with site, environment, speed, label and a unique id."""
    blank = nullif_trim
    # both ends look nodes up, so the few columns they need are written once
    nodes = written(nodes.select("id", "site_id", "environment"), "edge-ends")
    l = links.filter(blank(c("source")).isNotNull() & blank(c("target")).isNotNull())
    port = lambda x: F.coalesce(blank(c(x)), F.lit(""))
    made = F.trim(F.regexp_replace(F.concat_ws("|", "source", "target", port("start_port"), port("end_port")), r"^\|+|\|+$", ""))
    # ids are numbered over few columns, as all links are sorted for it
    needed = dict.fromkeys(["source", "target", "start_port", "end_port", "status", order.col, *[x.removeprefix("-") for x in order.ties]])
    l = l.select(F.coalesce(blank(c("id")), made).alias("_base"), link_speed_gbps(c("start_speed"), c("end_speed"), c("speed")).alias("_gbps"), *needed)
    l = uniquify(l, "_base", order, out="edge_id")
    side = lambda p: nodes.select(c("id").alias(p), c("site_id").alias(f"_{p}_site"), c("environment").alias(f"_{p}_env"))
    d = l.join(side("source"), "source", "left").join(side("target"), "target", "left")
    or_unknown = lambda x: F.coalesce(c(x), F.lit("unknown"))
    speed = c("_gbps")
    conf = state_confidence([c("status")], ACTIVE_LINK, DOWN_LINK)
    return d.select(
        c("edge_id").alias("id"), "source", "target", F.when(or_unknown("_source_site") == or_unknown("_target_site"), or_unknown("_source_site")).otherwise("inter-site").alias("site_id"),
        F.when(or_unknown("_source_env") == or_unknown("_target_env"), or_unknown("_source_env")).otherwise("mixed").alias("environment"), speed.alias("speed_gbps"), format_speed(speed).alias("mainstat"),
        conf.alias("confidence"), conf.alias("secondarystat"), F.lit(lineage).alias("source_lineage"), speed_color(speed, SPEED_COLORS, UNKNOWN_COLOR).alias("color"),
        F.concat(port("start_port"), F.lit(" -> "), port("end_port"), F.lit(" | bandwidth="), format_speed(speed), F.lit(" | status="), F.coalesce(blank(c("status")), F.lit("unknown")),
                 F.lit(" | confidence="), conf).alias("detail"))


def assign_layers(devices: DataFrame, host: str, role: str) -> DataFrame:
    return devices.withColumn("layer", layer_for(c(host), F.coalesce(c(role), F.lit("")), HOST_LAYERS, ROLE_LAYERS, FAMILY_LAYERS, DEFAULT_LAYER))


def orient_links(links: DataFrame, layers: DataFrame) -> DataFrame:
    """Links from the lower to the higher layer, ties by id; interfaces move with their ends."""
    side = lambda p: layers.select(c("id").alias(p), c("layer").alias(f"_{p}"))
    d = links.join(side("a_id"), "a_id", "left").join(side("z_id"), "z_id", "left")
    la, lz = (F.coalesce(c(f"_{p}"), F.lit(DEFAULT_LAYER)) for p in ("a_id", "z_id"))
    swap = (la > lz) | ((la == lz) & (c("a_id") > c("z_id")))
    pick = lambda x, y: F.when(swap, c(y)).otherwise(c(x))
    out = {"a_id": pick("a_id", "z_id"), "z_id": pick("z_id", "a_id"), "a_interface": pick("a_interface", "z_interface"), "z_interface": pick("z_interface", "a_interface")}
    rest = [x for x in links.columns if x not in out]
    return d.select(*rest, *[v.alias(k) for k, v in out.items()])


def topology_filter(nodes: DataFrame, edges: DataFrame, site: str = "__all", environment: str = "__all", confidence: str = "__all") -> DataFrame:
    """Edges that pass the filters; the site matches the edge or either of its ends."""
    side = lambda p: nodes.select(c("id").alias(p), c("site_id").alias(f"_{p}_site"))
    d = edges.join(side("source"), "source", "left").join(side("target"), "target", "left")
    hit = lambda x: F.coalesce(pass_all(c(x), site), F.lit(False))
    return d.filter((hit("site_id") | hit("_source_site") | hit("_target_site")) & pass_all(c("environment"), environment) & pass_all(c("confidence"), confidence)).select(*edges.columns)


def visible_subgraph(nodes: DataFrame, edges: DataFrame, **spec: str) -> tuple[DataFrame, DataFrame]:
    """Nodes at either end of a filtered edge, and the filtered edges between them."""
    nodes = written(nodes, "nodes")
    kept = written(topology_filter(nodes, edges, **spec), "visible-edges")
    ends = kept.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    vis = nodes.join(ends, "id", "left_semi")
    ids = vis.select("id")
    shown = kept.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return vis, shown.select(*edges.columns)


def graph_depth(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Least number of hops from the roots along directed edges.

    A round joins the frontier, and drops what the frontiers before it have. Nodes that were seen are kept in merged levels: two levels of like
    size become one, so each node is written again about as often as the graph doubles, and a round looks into few tables. Rounds
    end with the first empty frontier, so their number is the depth of the graph.
    """
    hops = checkpointed(edges.select(c("source").alias("id"), c("target").alias("_next")).distinct())
    frontier = checkpointed(roots.select("id").distinct().withColumn("depth", F.lit(0)))
    seen: list[tuple[int, DataFrame]] = []  # sizes at least halve along the list
    for depth in count(1):
        n = frontier.count()
        if not n:
            break
        level = frontier
        merged = False
        while seen and seen[-1][0] < 2 * n:
            size, older = seen.pop()
            level, n, merged = older.unionByName(level), n + size, True
        seen.append((n, checkpointed(level) if merged else level))
        step = frontier.select("id").join(hops, "id").select(c("_next").alias("id")).distinct()
        for _, older in seen:
            step = step.join(older.select("id"), "id", "left_anti")
        frontier = checkpointed(step.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, [level for _, level in seen], frontier)


def graph_layout(nodes: DataFrame, depths: DataFrame, order: Order, gap_x: int = 220, gap_y: int = 180) -> DataFrame:
    """Grid position: row by depth, column by order within the depth; unreached nodes go to the row below."""
    lowest = depths.agg((F.max("depth") + 1).alias("_below"))
    d = nodes.join(depths, "id", "left").join(lowest, F.lit(True), "inner").withColumn("depth", F.coalesce("depth", "_below")).drop("_below")
    d = scan(d, ["depth"], order, number="_i")
    return d.withColumns({"fixed_x": ((c("_i") - 1) * gap_x).cast("bigint"), "fixed_y": (c("depth") * gap_y).cast("bigint")}).drop("_i")


def graph_checks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Orphan edges, untidy or repeated ids, and nodes without a positive arc, as (finding, id, n)."""
    ids = nodes.select("id").distinct()

    def orphans(end: str) -> DataFrame:
        return edges.join(ids, edges[end] == ids["id"], "left_anti").select(F.lit(f"orphan_{end}").alias("finding"), c("id"), F.lit(1).cast("bigint").alias("n"))

    untidy = nodes.filter(c("id").isNull() | (c("id") != F.trim("id"))).select(F.lit("untidy_id").alias("finding"), "id", F.lit(1).cast("bigint").alias("n"))
    repeated = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > 1).select(F.lit("repeated_id").alias("finding"), "id", "n")
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    arc: Column = zero("arc_high") + zero("arc_medium") + zero("arc_low")
    flat = nodes.filter(arc <= 0).select(F.lit("no_arc").alias("finding"), "id", F.lit(1).cast("bigint").alias("n"))
    return orphans("source").unionByName(orphans("target")).unionByName(untidy).unionByName(repeated).unionByName(flat)


def filter_counts(nodes: DataFrame, sites: list[str]) -> DataFrame:
    """Node rows under each value of the site filter, the pass-through and the empty one included."""
    from tidewire.operators.aggregates import count_where
    return nodes.agg(*[count_where(pass_all(c("site_id"), s)).alias(f"rows_{s or 'empty'}") for s in sites])
