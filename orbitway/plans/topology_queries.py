"""A network from map elements in one chain: ways to directed edges, kinds of ramps by links, streets and tags, restrictions, and what the report counts.

All steps are joins over whole tables; the searches along links and over ways are rounds of joins, so
that no task holds the network.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitway.functions import geo
from orbitway.functions.checkpoints import cut
from orbitway.plans.build_queries import VIA_MORE, forbidden_sequences, ramp_kinds, registering
from orbitway.plans.rules import streets_near
from orbitway.plans.sql_queries import NO_VEHICLE, OPERATORS_EXACT, OPERATORS_LOWER, PRIVATE_SERVICE, ROUTE_CODES, SURFACE

QUERIES, ORACLE = {}, {}
rule = registering(QUERIES, ORACLE)
#: Metres from a ramp's end within which a mapped street shows that the end isn't on one, and the degrees of a cell of streets.
STREET_METERS, CELL = 100.0, 0.0005
#: Speeds of the mainline and of links, km/h.
MAINLINE_KMH, LINK_KMH = 60, 40
#: What a restriction may be.
TURNS = [f"{a}_{b}" for a in ("no", "only") for b in ("left_turn", "right_turn", "u_turn", "straight_on")]


@dataclass(frozen=True)
class Topology:
    """whole: all segments. links: ramp_kinds of all links. edges: edge_id, way, source, target, kind, seconds, meters, name. nodes: node, lat, lon, snap (an entry begins there)."""

    whole: DataFrame
    links: DataFrame
    edges: DataFrame
    nodes: DataFrame


# --- tags -----------------------------------------------------------------------------------------


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def expressway() -> Column:
    """Whether a way is a motorway that its operator, network, code or name places in the network."""
    text = lambda *names: F.coalesce(*(F.col(n) for n in names), F.lit(""))
    spelled = [text("operator").contains(x) for x in OPERATORS_EXACT] + [F.lower(text("operator")).contains(x) for x in OPERATORS_LOWER]
    spelled += [text("network").contains(x) for x in OPERATORS_EXACT] + [F.lower(text("network")).contains(OPERATORS_LOWER[0])]
    spelled += [text("ref").contains(OPERATORS_EXACT[1])] + [text("name", "name_ja").contains(x) for x in OPERATORS_EXACT]
    coded = F.exists(F.split(F.upper(text("ref")), ";"), lambda x: F.trim(x).isin(ROUTE_CODES))
    return F.coalesce(F.col("highway") == "motorway", F.lit(False)) & (_any(spelled) | coded)


def vehicle() -> Column:
    """Whether cars may use a way as a street; null where its tags don't say."""
    service = F.when(F.col("service").isin(PRIVATE_SERVICE), False).when(F.col("service") == "alley", True)
    return F.when(F.col("highway").isin(SURFACE), True).when(F.col("highway") == "service", service).when(F.col("highway").isin(NO_VEHICLE), False)


# --- edges ----------------------------------------------------------------------------------------


def segments(ways: DataFrame, places: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge_id, way, source, target, meters, kind ('mainline' or 'link'), name of each two neighbouring nodes of the ways that count, in the directions that they allow.

    Neighbours of which one has no coordinates give no edge.
    """
    kind = F.when(expressway(), "mainline").when(F.col("highway") == "motorway_link", "link")
    tag = F.coalesce("oneway", F.lit(""))
    ends = F.when(tag.isin("yes", "1", "true"), F.array(F.lit("f"))).when(tag.isin("-1", "reverse"), F.array(F.lit("r"))).otherwise(F.array(F.lit("f"), F.lit("r")))
    known = ways.select("way", kind.alias("kind"), F.coalesce("name", "name_ja").alias("name"), ends.alias("ends")).where("kind is not null")
    steps = places.join(known, "way").withColumn("next", F.lead("node").over(Window.partitionBy("way").orderBy("pos"))).where("next is not null")
    at = lambda c, x: nodes.select(F.col("node").alias(c), F.col("lat").alias(f"lat_{x}"), F.col("lon").alias(f"lon_{x}"))
    met = steps.join(at("node", "a"), "node").join(at("next", "b"), "next").withColumn("meters", F.expr(geo.haversine("lat_a", "lon_a", "lat_b", "lon_b")))
    turned = met.withColumn("end", F.explode("ends")).withColumn("forth", F.col("end") == "f")
    return turned.select(
        F.concat_ws(":", F.concat(F.lit("e:w"), F.col("way").cast("string")), F.col("pos").cast("string"), "end").alias("edge_id"), "way",
        F.when(F.col("forth"), F.col("node")).otherwise(F.col("next")).alias("source"), F.when(F.col("forth"), F.col("next")).otherwise(F.col("node")).alias("target"), "meters", "kind", "name",
    )


def street_evidence(ends: DataFrame, ways: DataFrame, places: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, evidence, tag of each of ends (column node): a street has the node, one is mapped near it and has not, or none is mapped near it."""
    of = lambda which: places.join(ways.where(which).select("way"), "way", "left_semi").select("node").distinct()
    surface, motor = of(vehicle()), of(F.col("highway").isin("motorway", "motorway_link"))
    streets = nodes.join(surface.join(motor, "node", "left_anti"), "node", "left_semi").select(F.col("node").alias("id"), "lat", "lon")
    asked = nodes.join(ends, "node", "left_semi").select(F.col("node").alias("id"), "lat", "lon", "tag")
    near = streets_near(asked, streets, STREET_METERS, CELL).select("lat", "lon").distinct().withColumn("near", F.lit(True))
    shared = surface.select(F.col("node").alias("id"), F.lit(True).alias("shared"))
    evidence = F.when(F.col("shared"), "shared_node").when(F.col("near"), "no_shared_node").otherwise("unavailable")
    return asked.join(shared, "id", "left").join(near.hint("merge"), ["lat", "lon"], "left").select(F.col("id").alias("node"), evidence.alias("evidence"), "tag")


# --- restrictions ---------------------------------------------------------------------------------


def outcomes(turns: DataFrame, whole: DataFrame, edges: DataFrame) -> DataFrame:
    """turns with outcome; null where only a search over the ways between can tell. whole: all segments; edges: those that stayed."""
    present = whole.select("way").distinct().join(edges.select("way", F.lit(True).alias("stays")).distinct(), "way", "left").select("way", F.coalesce("stays", F.lit(False)).alias("stays"))
    known = turns
    for way in ("from_way", "to_way", "via_first", "via_last"):
        known = known.join(present.select(F.col("way").alias(way), F.col("stays").alias(f"{way}_stays")), way, "left")
    into = edges.select(F.col("way").alias("from_way"), F.col("target").alias("via_node"), F.lit(True).alias("comes")).distinct()
    out = edges.select(F.col("way").alias("to_way"), F.col("source").alias("via_node"), F.lit(True).alias("leaves")).distinct()
    known = known.join(into, ["from_way", "via_node"], "left").join(out, ["to_way", "via_node"], "left")
    null = lambda *names: _any([F.col(n).isNull() for n in names])
    missing, no = F.lit("skipped_missing_elements"), F.col("value").startswith("no_")
    between = null("via_first_stays", "via_last_stays") | ~(F.col("via_first_stays") | F.col("via_last_stays")) | ~F.col("to_way_stays")
    outcome = (
        F.when(F.col("value").isNull(), F.when(F.col("conditional"), "skipped_conditional").otherwise(missing)).when(~F.col("value").isin(TURNS), "skipped_unrecognized")
        .when(null("from_way", "to_way"), missing).when(F.col("via_node").isNull() & F.col("via_first").isNull(), "skipped_no_via").when(null("from_way_stays", "to_way_stays"), missing)
        .when(F.col("via_node").isNotNull(), F.when(null("comes", "leaves"), missing).when(no, "no_turn_via_node").otherwise("only_turn_via_node"))
        .when(between, missing).when(~no, "skipped_only_via_way").when(~F.col("from_way_stays"), "skipped_disconnected")
    )
    return known.select(*turns.columns, outcome.alias("outcome"))


def forbidden(turns: DataFrame, made: Topology) -> tuple[DataFrame, DataFrame]:
    """(relation, outcome, path of each forbidden sequence; relation and outcome of every relation).

    turns: relation, value, conditional, from_way, via_node, via_first, via_last, to_way.
    """
    edges = made.edges
    judged = cut(outcomes(turns, made.whole, edges))
    into = edges.select(F.col("way").alias("from_way"), F.col("target").alias("via_node"), F.col("edge_id").alias("first"))
    out = edges.select(F.col("way").alias("out_way"), F.col("source").alias("via_node"), F.col("edge_id").alias("second"))
    met = judged.where("outcome in ('no_turn_via_node', 'only_turn_via_node')").join(into, ["from_way", "via_node"]).join(out, "via_node")
    over_node = met.where((F.col("outcome") == "no_turn_via_node") == (F.col("out_way") == F.col("to_way"))).select("relation", "outcome", F.array("first", "second").alias("path"))
    graph = edges.withColumn("net", F.lit(0))
    over_ways = cut(forbidden_sequences(graph, judged.where("outcome is null").withColumn("net", F.lit(0)).drop("outcome")).select("relation", "outcome", "path"))
    known = judged.where("outcome is not null").select("relation", "outcome").unionByName(over_ways.select("relation", "outcome").distinct())
    return over_node.unionByName(over_ways.where("path is not null")), known


# --- the chain ------------------------------------------------------------------------------------


def build(ways: DataFrame, places: DataFrame, nodes: DataFrame) -> Topology:
    """The network of map elements.

    ways: way, highway, service, oneway, operator, network, ref, name, name_ja. places: way, pos, node.
    nodes: node, lat, lon, tag; those without coordinates are absent. Links that have no way to or from
    the mainline go, and so do nodes without an edge.
    """
    whole = cut(segments(ways, places, nodes))
    links = whole.where("kind = 'link'")
    sources, targets = links.select(F.col("source").alias("node")).distinct(), links.select(F.col("target").alias("node")).distinct()
    loose = sources.join(whole.select(F.col("target").alias("node")), "node", "left_anti").unionByName(targets.join(whole.select(F.col("source").alias("node")), "node", "left_anti"))
    sides = cut(ramp_kinds(whole, street_evidence(loose, ways, places, nodes)))
    sorted_ = whole.join(sides.select("edge_id", F.col("kind").alias("ramp")), "edge_id", "left")
    kind = F.coalesce("ramp", F.lit("shutoko"))
    speed = F.when(F.col("kind") == "link", F.lit(float(LINK_KMH))).otherwise(F.lit(float(MAINLINE_KMH)))
    seconds = F.greatest(F.round(F.col("meters") / (speed / 3.6)).cast("long"), F.lit(1).cast("long"))
    edges = cut(sorted_.where(kind != "dropped").select("edge_id", "way", "source", "target", kind.alias("kind"), seconds.alias("seconds"), "meters", "name"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), (F.col("kind") == "entry").alias("snap")), F.struct(F.col("target").alias("node"), F.lit(False).alias("snap")))).alias("end"))
    active = nodes.join(ends.select("end.*").groupBy("node").agg(F.bool_or("snap").alias("snap")), "node").select("node", "lat", "lon", "snap")
    return Topology(whole, sides, edges, active)


def report(turns: DataFrame, made: Topology) -> DataFrame:
    """item, n: relations by outcome, pairs that only-turns were the first to forbid, links by what became of them, sizes."""
    count = lambda df, item: df.agg(F.count("*").alias("n")).select(F.lit(item).alias("item"), "n")
    found, known = forbidden(turns, made)
    first = found.where(F.size("path") == 2).groupBy("path").agg(F.min_by("outcome", "relation").alias("by")).where("by = 'only_turn_via_node'")
    rows = [
        count(known, "total_relations"), known.groupBy(F.col("outcome").alias("item")).agg(F.count("*").alias("n")), count(first, "only_turn_edge_pairs"),
        count(made.links.where("kind = 'dropped'"), "dropped_link_edges"), count(made.links.where("note = 'undecidable'"), "undecidable_ramp_edges"),
        count(made.links.where("unmapped"), "surface_evidence_unavailable_ramp_edges"), count(made.nodes, "nodes"), count(made.edges, "edges"), count(made.nodes.where("snap"), "snap_nodes"),
    ]
    return reduce(DataFrame.unionByName, rows)


def _quoted(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_FLAT = "sqrt(pow(radians(t.lon - n.lon) * cos(radians((t.lat + n.lat) * 0.5)) * 6371000, 2) + pow(radians(t.lat - n.lat) * 6371000, 2))"
_NETWORK = f"""kindway as (select *, case when highway = 'motorway' and (regexp_matches(concat_ws('|', operator, network, coalesce(name, name_ja)), '首都高') or contains(coalesce(ref, ''), '首都高') or regexp_matches(lower(coalesce(operator, '')), 'metropolitan expressway|shuto expressway')
    or contains(lower(coalesce(network, '')), 'metropolitan expressway') or len(list_filter(string_split(upper(coalesce(ref, '')), ';'), lambda x: trim(x) in {_quoted(ROUTE_CODES)})) > 0) then 'mainline' when highway = 'motorway_link' then 'link' end as kind from siteway),
step as (select way, pos, node as a, lead(node) over (partition by way order by pos) as b from siteplace),
measured as (select s.*, k.kind, k.oneway, coalesce(k.name, k.name_ja) as name, {geo.haversine('m.lat', 'm.lon', 'n.lat', 'n.lon')} as meters from step s join kindway k on k.way = s.way and k.kind is not null join sitenode m on m.node = s.a join sitenode n on n.node = s.b),
seg as (select 'e:w' || way || ':' || pos || ':f' as edge_id, way, a as source, b as target, meters, kind, name from measured where coalesce(oneway, '') not in ('-1', 'reverse')
  union all select 'e:w' || way || ':' || pos || ':r', way, b, a, meters, kind, name from measured where coalesce(oneway, '') not in ('yes', '1', 'true')),
main as (select source as node from seg where kind = 'mainline' union select target from seg where kind = 'mainline'),
link as (select * from seg where kind = 'link'),
ahead as (select node from main union select l.source from link l join ahead a on l.target = a.node),
behind as (select node from main union select l.target from link l join behind b on l.source = b.node),
surface as (select distinct node from siteplace join siteway using (way) where highway in {_quoted(SURFACE)} or highway = 'service' and service = 'alley'),
mapped as (select * from sitenode where node in (select node from surface) and node not in (select node from siteplace join siteway using (way) where highway like 'motorway%')),
sided as (select l.*, case when source not in (select target from seg) and target in (select node from ahead) then 'entry' when target not in (select source from seg) and source in (select node from behind) then 'exit'
  when target in (select node from ahead) or source in (select node from behind) then 'shutoko' else 'dropped' end as side from link l),
judged as (select s.*, n.tag, case when n.node in (select node from surface) then true when exists (select 1 from mapped t where abs(t.lat - n.lat) < 0.003 and abs(t.lon - n.lon) < 0.003 and {_FLAT} <= {STREET_METERS}) then false end as street from sided s join sitenode n on n.node = case when side = 'exit' then target else source end),
known as (select edge_id, way, source, target, meters, name, side, street, tag, case when side in ('entry', 'exit') and not coalesce(street, case tag when 'traffic_signals' then true when 'motorway_junction' then false end, false) then 'shutoko' else side end as kind, {LINK_KMH} as kmh from judged
  union all select edge_id, way, source, target, meters, name, null, null, null, 'shutoko', {MAINLINE_KMH} from seg where kind = 'mainline'),
done as (select * from known where kind <> 'dropped')"""
_TURNS = f"""{_NETWORK}, state as (select *, case when value is null then case when conditional then 'skipped_conditional' else 'skipped_missing_elements' end when not regexp_full_match(value, '(no|only)_(left_turn|right_turn|u_turn|straight_on)') then 'skipped_unrecognized'
  when from_way is null or to_way is null then 'skipped_missing_elements' when via_node is null and via_first is null then 'skipped_no_via' when from_way not in (select way from seg) or to_way not in (select way from seg) then 'skipped_missing_elements'
  when via_node is not null then case when not exists (select 1 from done d where d.way = from_way and d.target = via_node) or not exists (select 1 from done d where d.way = to_way and d.source = via_node) then 'skipped_missing_elements' when value like 'no%' then 'no_turn_via_node' else 'only_turn_via_node' end
  when via_first not in (select way from seg) or via_last not in (select way from seg) or via_first not in (select way from done) and via_last not in (select way from done) or to_way not in (select way from done) then 'skipped_missing_elements'
  when value like 'only%' then 'skipped_only_via_way' end as outcome from siteturn),
walk as (select relation, via_first, via_last, to_way, case when via_first = via_last then 1 else 2 end as ways, [edge_id] as path, target as at_node, d.way as last_way from state s join done d on d.way = s.from_way where outcome is null
  union all select relation, via_first, via_last, to_way, ways, list_append(path, d.edge_id), d.target, d.way from walk w join done d on d.source = w.at_node
  where not (last_way = to_way and len(path) >= 3) and len(path) <= ways + {VIA_MORE} and not list_contains(path, d.edge_id) and (d.way in (via_first, via_last) or len(path) > 1 and d.way = to_way)),
line as (select relation, path from walk where last_way = to_way and len(path) >= 3),
pair as (select relation, outcome, [f.edge_id, o.edge_id] as path from state s join done f on f.way = s.from_way and f.target = s.via_node join done o on o.source = s.via_node where outcome = 'no_turn_via_node' and o.way = s.to_way or outcome = 'only_turn_via_node' and o.way <> s.to_way),
final as (select relation, case when outcome is not null then outcome when relation in (select relation from line) then 'via_way' else 'skipped_disconnected' end as outcome from state)"""


@rule("siteway", "siteplace", "sitenode", sql=f"{_NETWORK} select edge_id, source, target, kind, meters, name, greatest(cast(round(meters / (kmh / 3.6)) as bigint), 1) as seconds from done")
def g01_network_edges(siteway, siteplace, sitenode):
    """The edges of the network of all sites, with kind, metres and seconds."""
    return build(siteway, siteplace, sitenode).edges.select("edge_id", "source", "target", "kind", "meters", "name", "seconds")


@rule("siteway", "siteplace", "sitenode", sql=f"{_NETWORK} select node, cast(round(lat * 1000000) as bigint) as lat_e6, cast(round(lon * 1000000) as bigint) as lon_e6, node in (select source from done where kind = 'entry') as snap from sitenode where node in (select source from done union select target from done)")
def g01_network_nodes(siteway, siteplace, sitenode):
    """The nodes that have an edge, and whether requests may snap to them."""
    e6 = lambda c: F.round(F.col(c) * 1000000).cast("long").alias(f"{c}_e6")
    return build(siteway, siteplace, sitenode).nodes.select("node", e6("lat"), e6("lon"), "snap")


@rule("siteway", "siteplace", "sitenode", "siteturn", sql=f"{_TURNS} select distinct array_to_string(path, ',') as path from (select path from pair union all select path from line)")
def g01_network_turns(siteway, siteplace, sitenode, siteturn):
    """The sequences of edges that the network forbids, each once."""
    found, _ = forbidden(siteturn, build(siteway, siteplace, sitenode))
    return found.select(F.array_join("path", ",").alias("path")).distinct()


@rule("siteway", "siteplace", "sitenode", "siteturn", sql=f"""{_TURNS}
select 'total_relations' as item, count(*) as n from siteturn union all select outcome, count(*) from final group by outcome union all select 'only_turn_edge_pairs', count(*) from (select path, arg_min(outcome, relation) as outcome from pair group by path) where outcome like 'only%'
union all select 'dropped_link_edges', count(*) from known where kind = 'dropped' union all select 'undecidable_ramp_edges', count(*) from known where side in ('entry', 'exit') and street is null and coalesce(tag, '') not in ('traffic_signals', 'motorway_junction')
union all select 'surface_evidence_unavailable_ramp_edges', count(*) from known where side in ('entry', 'exit') and street is null union all select 'nodes', count(*) from (select source from done union select target from done) union all select 'edges', count(*) from done
union all select 'snap_nodes', count(distinct source) from done where kind = 'entry'""")
def g01_network_report(siteway, siteplace, sitenode, siteturn):
    """What became of relations and links, and how large the network is; relations add up to their total."""
    return report(siteturn, build(siteway, siteplace, sitenode))
