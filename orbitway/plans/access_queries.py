"""Which pairs and ramps a request or a network gives access to, and the addresses of a route in three legs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitway.functions.checkpoints import cut
from orbitway.functions.dialect import DUCK
from orbitway.operators.frontier import reach
from orbitway.operators.nearest import nearest
from orbitway.operators.paths import MAINLINE, Edge, Network
from orbitway.operators.search import MOST_URL
from orbitway.plans.build_queries import registering
from orbitway.sources.road import with_tables

QUERIES, ORACLE = {}, {}
rule = registering(QUERIES, ORACLE)
#: Metres inside a component from which on its loops count.
LOOP_METERS = 5000
#: Entries that a request looks at.
ENTRIES = 3


# --- access ---------------------------------------------------------------------------------------


def accepted(request: DataFrame, entry: DataFrame, reachcap: DataFrame) -> DataFrame:
    """request_id, entry_id of the nearest entries within the request's distance; a distance of 0 accepts any."""
    found = nearest(request, entry, ENTRIES).select("request_id", "entry_id", "meters")
    return found.join(reachcap.hint("merge"), "request_id").where("cap = 0 or meters <= cap").select("request_id", "entry_id")


_NEAR = "select a.request_id, a.entry_id from access a join reachcap c on c.request_id = a.request_id where c.cap = 0 or a.meters <= c.cap"
ORACLE["j06_access_cap"] = with_tables(("access", "reachcap"), _NEAR, DUCK)
ORACLE["j14_reachable_pairs"] = with_tables(("access", "reachcap", "pairseed"), f"select n.request_id, s.seed as pair from ({_NEAR}) n join pairseed s on s.seed = n.entry_id where s.status = 'verified'", DUCK)


@rule("request", "entry", "reachcap")
def j06_access_cap(request, entry, reachcap):
    """Entries that a request accepts: the nearest ones within its distance, or however far."""
    return accepted(request, entry, reachcap)


@rule("request", "entry", "reachcap", "pairseed")
def j14_reachable_pairs(request, entry, reachcap, pairseed):
    """Verified pairs of each request whose entry is among those that it accepts."""
    pairs = pairseed.where("status = 'verified'").select("seed")
    return accepted(request, entry, reachcap).join(pairs.withColumnRenamed("seed", "entry_id"), "entry_id").select("request_id", F.col("entry_id").alias("pair"))


@rule("pairedge", "pairseed", sql="""select e.edge_id from pairedge e where e.kind in ('entry', 'exit') and not exists (select 1 from pairseed s where s.status = 'verified' and (concat('e:w', s.entry_way, ':0') = e.edge_id or concat('e:w', s.exit_way, ':0') = e.edge_id))""")
def j15_unverified_edges(pairedge, pairseed):
    """Edges of entries and exits that no verified pair uses."""
    edge = lambda c: F.concat(F.lit("e:w"), F.col(c).cast("string"), F.lit(":0"))
    used = pairseed.where("status = 'verified'").select(F.explode(F.array(edge("entry_way"), edge("exit_way"))).alias("edge_id"))
    return pairedge.where("kind in ('entry', 'exit')").join(used, "edge_id", "left_anti").select("edge_id")


# --- tariffs on pairs -----------------------------------------------------------------------------


@rule("paidpair", "paidramp", "paidassign", sql="""one as (select edge, min(ramp) as ramp from paidramp group by edge having count(*) = 1),
entered as (select p.*, coalesce(p.entry_ramp, o.ramp) as way_in from paidpair p left join one o on o.edge = p.entry_edge),
left_ as (select e.*, coalesce(e.exit_ramp, o.ramp, (select case when count(*) = 1 then min(r.ramp) end from paidramp r join paidramp i on i.ramp = e.way_in and i.direction = r.direction where r.edge = e.exit_edge)) as way_out from entered e left join one o on o.edge = e.exit_edge),
found as (select l.*, coalesce(a.assignment, b.assignment) as given, case when a.assignment is not null then a.pair else b.pair end as own, case when a.assignment is not null then a.entry_ramp else b.entry_ramp end as paid_in, case when a.assignment is not null then a.exit_ramp else b.exit_ramp end as paid_out, case when a.assignment is not null then a.meters else b.meters end as meters
  from left_ l left join paidassign a on a.assignment = l.assignment left join paidassign b on b.pair = l.pair)
select pair, way_in as entry_ramp, way_out as exit_ramp, case when f is null then given end as assignment, case when f is null then meters end as meters, f as fault from (select *, case when given is null then 'no_assignment' when own <> pair or way_in <> paid_in or way_out <> paid_out then 'mismatch' end as f from found)""")
def j12_pair_tariffs(paidpair, paidramp, paidassign):
    """The ramps of each pair and the tariff that is assigned to it.

    An edge that one ramp has gives the ramp; of several that share an exit's edge, the one of the entry's
    direction, if it is the only one. The assignment is that which the pair names or else the one that
    names the pair; it must name the pair, and no other ramps than the pair's.
    """
    # Dealt before the sums: a small file that is read by one task would else have all edges in that task's memory.
    paidramp = paidramp.repartition("edge")
    single = paidramp.groupBy("edge").agg(F.count("*").alias("n"), F.min("ramp").alias("one")).where("n = 1").select("edge", "one")
    entered = paidpair.join(single.select(F.col("edge").alias("entry_edge"), F.col("one").alias("only_in")), "entry_edge", "left").withColumn("way_in", F.coalesce("entry_ramp", "only_in"))
    ways = entered.join(paidramp.select(F.col("ramp").alias("way_in"), F.col("direction").alias("heading")), "way_in", "left")
    alike = paidramp.groupBy(F.col("edge").alias("exit_edge"), F.col("direction").alias("heading")).agg(F.count("*").alias("n"), F.min("ramp").alias("like")).where("n = 1").select("exit_edge", "heading", "like")
    only_out = single.select(F.col("edge").alias("exit_edge"), F.col("one").alias("only_out"))
    both = ways.join(only_out, "exit_edge", "left").join(alike, ["exit_edge", "heading"], "left").withColumn("way_out", F.coalesce("exit_ramp", "only_out", "like"))
    given = lambda key, name: paidassign.select(F.col(key).alias(name), F.struct("assignment", "pair", "entry_ramp", "exit_ramp", "meters").alias(f"by_{name}"))
    # Pairs that name no assignment have a key each that none has: nulls would all go to one task.
    named = both.withColumn("named", F.coalesce(F.col("assignment").cast("string"), F.concat(F.lit("pair "), F.col("pair").cast("string"))))
    by_name = given("assignment", "assignment").withColumn("named", F.col("assignment").cast("string")).drop("assignment")
    known = named.join(by_name, "named", "left").join(given("pair", "pair"), "pair", "left").withColumn("x", F.coalesce("by_assignment", "by_pair"))
    other = (F.col("x.pair") != F.col("pair")) | F.coalesce(F.col("way_in") != F.col("x.entry_ramp"), F.lit(False)) | F.coalesce(F.col("way_out") != F.col("x.exit_ramp"), F.lit(False))
    fault = F.when(F.col("x").isNull(), "no_assignment").when(other, "mismatch")
    sound = known.withColumn("fault", fault)
    kept = lambda c: F.when(F.col("fault").isNull(), F.col(c))
    return sound.select("pair", F.col("way_in").alias("entry_ramp"), F.col("way_out").alias("exit_ramp"), kept("x.assignment").alias("assignment"), kept("x.meters").alias("meters"), "fault")


# --- components and what they make usable ---------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """net, node, component, members, inside, cyclic: strongly connected components of each network, named by their least node, with the metres of the edges inside."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        net = Network({x: Edge(x, f"{a:020}", f"{b:020}", MAINLINE, 1, 1) for x, a, b in zip(group["edge_id"], group["source"], group["target"], strict=True)})
        rows = [(group["net"].iloc[0], int(n), int(c), y) for n, (c, y) in net.components().items()]
        return pd.DataFrame(rows, columns=["net", "node", "component", "cyclic"])

    found = cut(edges.groupBy("net").applyInPandas(run, "net string, node long, component long, cyclic boolean"))
    ends = edges.join(found.select("net", F.col("node").alias("source"), "component"), ["net", "source"]).join(found.select("net", F.col("node").alias("target"), F.col("component").alias("other")), ["net", "target"])
    inside = ends.where("component = other").groupBy("net", "component").agg(F.sum("meters").alias("inside"))
    counts = found.groupBy("net", "component", "cyclic").agg(F.count("*").alias("members"))
    whole = counts.join(inside, ["net", "component"], "left").withColumn("inside", F.coalesce("inside", F.lit(0).cast("long")))
    return found.join(whole.drop("cyclic"), ["net", "component"]).select("net", "node", "component", "members", "inside", "cyclic")


_PARTS = """ringed as (select net, slab, block, min(id) as component, count(*) as members, sum(case when place < 63 then case when block % 7 = 6 then 50 else meters end else 200 end) + sum(case when place = 3 then case when block % 7 = 6 then 50 else meters end else 0 end) as inside from slab where whole and place >= 3 group by net, slab, block)"""


@rule("slabedge", "slab", sql=f"{_PARTS} select net, component, members, inside::bigint as inside, true as cyclic from ringed union all select net, id, 1, 0, false from slab where not whole or place < 3")
def a05_components(slabedge, slab):
    """Strongly connected components of the large networks: nodes, metres of the edges inside, and whether there is a cycle."""
    return components(cut(slabedge)).groupBy("net", "component").agg(F.count("*").alias("members"), F.max("inside").alias("inside"), F.bool_or("cyclic").alias("cyclic"))


_CAPABLE = f"""{_PARTS}, good as (select slab, block from ringed where inside >= {LOOP_METERS}), bounds as (select slab, min(block) as low, max(block) as high from good group by slab),
capable as (select r.ramp, case when r.kind = 'entry' and coalesce(r.block <= b.high, false) or r.kind = 'exit' and coalesce(r.block > b.low or r.block = b.low and r.place >= 3, false) then 'routable' else 'structural_no_loop' end as capability
  from slabramp r join slab s on s.id = r.ramp left join bounds b on b.slab = s.slab)"""


def capabilities(slabedge: DataFrame, slabramp: DataFrame) -> DataFrame:
    """ramp, capability: 'routable' where an entry leads to, or an exit is reached from, a component with a cycle and at least LOOP_METERS of edges inside.

    Components are found network by network; what leads to them and from them by rounds of joins over all
    networks, in which a component is one node.
    """
    slabedge = cut(slabedge)
    parts = cut(components(slabedge))
    named = parts.select("net", "node", "component")
    edges = slabedge.join(named.select("net", F.col("node").alias("source"), F.col("component").alias("a")), ["net", "source"]).join(named.select("net", F.col("node").alias("target"), F.col("component").alias("b")), ["net", "target"]).where("a <> b")
    steps = cut(edges.select("net", F.col("a").alias("source"), F.col("b").alias("target")).distinct())
    good = parts.where(F.col("cyclic") & (F.col("inside") >= LOOP_METERS)).select("net", F.col("component").alias("node")).distinct()
    leads, led = reach(steps, good, backward=True, by=["net"]), reach(steps, good, by=["net"])
    known = slabramp.join(named, ["net", "node"])
    marked = known.join(leads.select("net", F.col("node").alias("component"), F.lit(True).alias("leads")), ["net", "component"], "left").join(led.select("net", F.col("node").alias("component"), F.lit(True).alias("led")), ["net", "component"], "left")
    able = F.coalesce(F.when(F.col("kind") == "entry", F.col("leads")).otherwise(F.col("led")), F.lit(False))
    return marked.select("ramp", F.when(able, "routable").otherwise("structural_no_loop").alias("capability"))


@rule("slabedge", "slabramp", "slab", sql=f"{_CAPABLE} select * from capable")
def r13_capability(slabedge, slabramp, slab):
    """Whether each ramp of the large networks can be used."""
    return capabilities(slabedge, slabramp)


@rule("slabedge", "slabramp", "slab", sql=f"""{_CAPABLE} select c.ramp, r.declared, c.capability as actual from capable c join slabramp r on r.ramp = c.ramp where r.declared is distinct from c.capability""")
def v16_capability_contract(slabedge, slabramp, slab):
    """Ramps whose record states another capability than they have, or none."""
    both = capabilities(slabedge, slabramp).join(slabramp.select("ramp", "declared"), "ramp")
    return both.where(~F.col("declared").eqNullSafe(F.col("capability"))).select("ramp", "declared", F.col("capability").alias("actual"))


# --- addresses ------------------------------------------------------------------------------------


def leg_address(origin: tuple[str, str], goal: tuple[str, str], stops: list[tuple[str, str]]) -> Column:
    """A map's address for one leg, from columns of latitudes and longitudes."""
    spot = lambda p: F.format_string("%.6f,%.6f", F.col(p[0]), F.col(p[1]))
    parts = [F.lit("https://www.google.com/maps/dir/?api=1&origin="), spot(origin), F.lit("&destination="), spot(goal), F.lit("&travelmode=driving")]
    for i, p in enumerate(stops):
        parts += [F.lit("%7C" if i else "&waypoints="), spot(p)]
    return F.concat(*parts)


def _at(name: str) -> tuple[str, str]:
    return f"{name}_lat", f"{name}_lon"


@rule("split", "net", "node", sql=f"""driven as (select net, id, pos, coalesce(next_id, anchor) as target, sum(meters) over (partition by net order by pos) as so_far, sum(meters) over (partition by net) as whole from net where next_id is not null or closed),
middle as (select net, target from (select *, row_number() over (partition by net order by abs(so_far - whole // 2), pos) as turn from driven) where turn = 1),
spotted as (select s.*, m.lat as mid_lat, m.lon as mid_lon from split s left join middle x on x.net = s.net left join node m on m.id = x.target),
judged as (select *, case when mid_lat is null then 'EMPTY_LAP' when merge_lat is null then 'MISSING_NODE' when abs(lat) > 90 or abs(lon) > 180 then 'INVALID_COORDINATE' end as fault from spotted),
legs as (select request_id, fault, unnest([1, 2, 3]) as leg, unnest([printf('https://www.google.com/maps/dir/?api=1&origin=%.6f,%.6f&destination=%.6f,%.6f&travelmode=driving', lat, lon, entry_lat, entry_lon),
  printf('https://www.google.com/maps/dir/?api=1&origin=%.6f,%.6f&destination=%.6f,%.6f&travelmode=driving&waypoints=%.6f,%.6f%%7C%.6f,%.6f', entry_lat, entry_lon, branch_lat, branch_lon, merge_lat, merge_lon, mid_lat, mid_lon),
  printf('https://www.google.com/maps/dir/?api=1&origin=%.6f,%.6f&destination=%.6f,%.6f&travelmode=driving&waypoints=%.6f,%.6f', branch_lat, branch_lon, lat, lon, exit_lat, exit_lon)]) as address from judged)
select request_id, leg::int as leg, case leg when 1 then 'surfaceAccess' when 2 then 'loopTransfer' else 'surfaceReturn' end as role, case when fault is null then address end as address, case when fault is null then sha256(address) end as address_sha256, fault from legs""")
def f13_split_handoff(split, net, node):
    """The addresses of a route's three legs with their hashes: to the entry, over merge and midpoint of the lap to the branch, and home over the exit; or why there are none.

    The midpoint is the node at which the whole metres driven come nearest to half of them, rounded down;
    the first of several.
    """
    lap = net.where("next_id is not null or closed").withColumns({"target": F.coalesce("next_id", "anchor"), "so_far": F.sum("meters").over(Window.partitionBy("net").orderBy("pos"))})
    half = lap.groupBy("net").agg(F.floor(F.sum("meters") / 2).alias("half"))
    middle = lap.join(half, "net").groupBy("net").agg(F.min_by("target", F.struct(F.abs(F.col("so_far") - F.col("half")), "pos")).alias("mid"))
    spots = middle.join(node.select(F.col("id").alias("mid"), F.col("lat").alias("mid_lat"), F.col("lon").alias("mid_lon")), "mid").drop("mid")
    placed = split.join(spots, "net", "left").withColumnsRenamed({"lat": "home_lat", "lon": "home_lon"})
    legs = [
        ("surfaceAccess", leg_address(_at("home"), _at("entry"), [])), ("loopTransfer", leg_address(_at("entry"), _at("branch"), [_at("merge"), _at("mid")])), ("surfaceReturn", leg_address(_at("branch"), _at("home"), [_at("exit")])),
    ]
    points = ("home", "entry", "merge", "mid", "branch", "exit")
    outside = [(F.abs(F.col(f"{p}_lat")) > 90) | (F.abs(F.col(f"{p}_lon")) > 180) for p in points]
    odd = F.coalesce(outside[0] | outside[1] | outside[2] | outside[3] | outside[4] | outside[5], F.lit(False))
    long = F.greatest(*(F.length(a) for _, a in legs)) > MOST_URL
    missing = F.col("merge_lat").isNull() | F.col("entry_lat").isNull() | F.col("branch_lat").isNull() | F.col("exit_lat").isNull()
    fault = F.when(F.col("mid_lat").isNull(), "EMPTY_LAP").when(missing, "MISSING_NODE").when(odd, "INVALID_COORDINATE").when(long, "URL_TOO_LONG")
    rows = placed.withColumn("fault", fault).select("request_id", "fault", F.posexplode(F.array(*(F.struct(F.lit(role).alias("role"), a.alias("address")) for role, a in legs))).alias("leg", "x"))
    address = F.when(F.col("fault").isNull(), F.col("x.address"))
    return rows.select("request_id", (F.col("leg") + 1).cast("int").alias("leg"), "x.role", address.alias("address"), F.sha2(address, 256).alias("address_sha256"), "fault")
