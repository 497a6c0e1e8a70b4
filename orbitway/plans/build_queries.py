"""Queries that build a network from its ways: reach along links, kinds of ramps, restrictions over ways, connectors, bindings, labels from ramps.

Each works on all networks at once in rounds of joins; its SQL is a recursive query, written by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitway.functions.checkpoints import cut
from orbitway.functions.dialect import DUCK
from orbitway.operators.frontier import paths, reach, within
from orbitway.sources.networks import road
from orbitway.sources.road import with_tables

QUERIES, ORACLE = {}, {}
#: Metres from a ramp within which it shows the carriageway; edges that a path over ways may have more than ways; edges of a connector and of a binding.
SEED_METERS, VIA_MORE, CONNECTOR_EDGES, BINDING_EDGES = 3000, 10, 10_000, 20_000
#: Edges of a run of labels that is trimmed from an end.
SHORT_RUN = 3


def registering(queries: dict, oracle: dict):  # noqa: ANN202
    """A decorator that registers a query over road tables, with its SQL: steps before a select, or a select."""

    def rule(*tables: str, sql: str | None = None):  # noqa: ANN202
        def add(f):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(*road(spark, sf_dir, *tables))

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            queries[f.__name__] = run
            if sql:
                text = with_tables(tables, "--", DUCK)[:-2].removeprefix("with ").strip()
                oracle[f.__name__] = f"with recursive {text}{' ' if sql.startswith('select') else ', '}{sql}"
            return f

        return add

    return rule


rule = registering(QUERIES, ORACLE)

# --- links and ramps ------------------------------------------------------------------------------

_REACH = """main as (select source as node from segment where kind = 'mainline' and target is not null union select target from segment where kind = 'mainline' and target is not null),
link as (select * from segment where kind = 'link' and target is not null),
ahead as (select node from main union select l.source from link l join ahead a on l.target = a.node),
behind as (select node from main union select l.target from link l join behind b on l.source = b.node),
reached as (select edge_id, source, target, target in (select node from ahead) as ahead, source in (select node from behind) as behind from link)"""


def link_reach(segment: DataFrame) -> DataFrame:
    """The links with ahead (their end leads to the mainline over links) and behind (the mainline leads to their start)."""
    sound = segment.where("target is not null")
    links, main = sound.where("kind = 'link'"), sound.where("kind = 'mainline'")
    # Both searches share their rounds: a node comes once for the search back and once for the one forth.
    both_ways = F.explode(F.array(F.struct(F.lit(True).alias("back"), F.col("target").alias("source"), F.col("source").alias("target")), F.struct(F.lit(False).alias("back"), "source", "target")))
    ends = main.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    starts = ends.select(F.explode(F.array(F.lit(True), F.lit(False))).alias("back"), "node")
    found = cut(reach(links.select(both_ways.alias("step")).select("step.*"), starts, by=["back"]))
    ahead = found.where("back").select(F.col("node").alias("target"), F.lit(True).alias("ahead"))
    behind = found.where("not back").select(F.col("node").alias("source"), F.lit(True).alias("behind"))
    both = links.join(ahead, "target", "left").join(behind, "source", "left")
    return both.select("edge_id", "source", "target", F.coalesce("ahead", F.lit(False)).alias("ahead"), F.coalesce("behind", F.lit(False)).alias("behind"))


@rule("segment", sql=f"{_REACH} select edge_id, ahead, behind from reached")
def g06_link_reach(segment):
    """Which links lead to the mainline, and to which it leads: one search back from all of its nodes and one forth."""
    return link_reach(cut(segment)).select("edge_id", "ahead", "behind")


@rule("segment", "endpoint", sql=f"""{_REACH}, asked as (select r.*, case when not exists (select 1 from segment s where s.target = r.source) and ahead then 'entry' when not exists (select 1 from segment s where s.source = r.target and s.target is not null) and behind then 'exit' when ahead or behind then 'shutoko' else 'dropped' end as side from reached r)
select edge_id, case when side in ('shutoko', 'dropped') then side when evidence = 'shared_node' then side when evidence = 'no_shared_node' then 'shutoko' when tag = 'traffic_signals' then side else 'shutoko' end as kind,
  case when side in ('shutoko', 'dropped') then null when evidence = 'shared_node' and tag = 'motorway_junction' then 'street against junction' when evidence = 'no_shared_node' and tag = 'traffic_signals' then 'no street against signals' when coalesce(evidence, 'unavailable') = 'unavailable' and coalesce(tag, '') not in ('traffic_signals', 'motorway_junction') then 'undecidable' end as note
from asked left join endpoint p on p.node = case when side = 'exit' then target else source end""")
def g08_ramp_kind(segment, endpoint):
    """Entry, exit or part of the expressway, of each link; links that have no way to or from the mainline are dropped.

    A link from which nothing leads back is an entry, one from which nothing leads on an exit, if its end
    is at street level: as a shared street node shows or, where no street is mapped, the node's tag. Where
    the two differ the street decides; where neither says anything the link counts as expressway.
    """
    return ramp_kinds(cut(segment), endpoint).select("edge_id", "kind", "note")


def ramp_kinds(segment: DataFrame, endpoint: DataFrame) -> DataFrame:
    """edge_id, side (what the links around say), kind, note, unmapped (no street shows anything at its end) of every link; endpoint: node, evidence, tag."""
    sound = segment.where("target is not null")
    into = sound.select(F.col("target").alias("source"), F.lit(True).alias("led")).distinct()
    out = sound.select(F.col("source").alias("target"), F.lit(True).alias("leads")).distinct()
    sides = link_reach(segment).join(into, "source", "left").join(out, "target", "left")
    side = F.when(F.col("led").isNull() & F.col("ahead"), "entry").when(F.col("leads").isNull() & F.col("behind"), "exit").when(F.col("ahead") | F.col("behind"), "shutoko").otherwise("dropped")
    asked = sides.withColumn("side", side).withColumn("node", F.when(F.col("side") == "exit", F.col("target")).otherwise(F.col("source")))
    known = asked.join(endpoint, "node", "left")
    street = F.when(F.col("evidence") == "shared_node", True).when(F.col("evidence") == "no_shared_node", False)
    tagged = F.when(F.col("tag") == "traffic_signals", True).when(F.col("tag") == "motorway_junction", False)
    ramp = F.col("side").isin("entry", "exit")
    note = F.when(street & ~tagged, "street against junction").when(~street & tagged, "no street against signals").when(street.isNull() & tagged.isNull(), "undecidable")
    return known.select("edge_id", "side", F.when(ramp & ~F.coalesce(street, tagged, F.lit(False)), "shutoko").otherwise(F.col("side")).alias("kind"), F.when(ramp, note).alias("note"), (ramp & street.isNull()).alias("unmapped"))


# --- restrictions over ways -----------------------------------------------------------------------


@rule("wayedge", "wayturn", sql=f"""state as (select t.*, case when via_first = via_last then 1 else 2 end as ways, case when not exists (select 1 from wayedge e where e.net = t.net and e.way = from_way) or not exists (select 1 from wayedge e where e.net = t.net and e.way = to_way)
    or not exists (select 1 from wayedge e where e.net = t.net and e.way = via_first) or not exists (select 1 from wayedge e where e.net = t.net and e.way = via_last) then 'skipped_missing_elements' when value like 'only%' then 'skipped_only_via_way' end as outcome from wayturn t),
walk as (select s.net, relation, from_way, via_first, via_last, to_way, ways, [edge_id] as path, target as at_node, way as last_way from state s join wayedge e on e.net = s.net and e.way = s.from_way where outcome is null
  union all select w.net, relation, from_way, via_first, via_last, to_way, ways, list_append(path, e.edge_id), e.target, e.way from walk w join wayedge e on e.net = w.net and e.source = w.at_node
  where not (last_way = to_way and len(path) >= 3) and len(path) <= ways + {VIA_MORE} and not list_contains(path, e.edge_id) and (e.way in (via_first, via_last) or len(path) > 1 and e.way = to_way))
select relation, 'via_way' as outcome, array_to_string(path, ',') as path from walk where last_way = to_way and len(path) >= 3
union all select relation, coalesce(outcome, 'skipped_disconnected'), null from state s where outcome is not null or not exists (select 1 from walk w where w.relation = s.relation and last_way = to_way and len(path) >= 3)""")
def g14_via_ways(wayedge, wayturn):
    """The sequences of edges that a restriction over one or more ways forbids, from the way in over the ways between to the way out; or why there is none."""
    found = forbidden_sequences(wayedge, wayturn)
    return found.select("relation", "outcome", F.array_join("path", ",").alias("path"))


def forbidden_sequences(wayedge: DataFrame, wayturn: DataFrame) -> DataFrame:
    """relation, net, outcome, path: a row for each sequence of three edges or more, or one with the outcome that left none.

    A sequence has no edge twice, and at most VIA_MORE edges more than ways between.
    """
    there = wayedge.select("net", "way").distinct()
    known = wayturn
    for way in ("from_way", "to_way", "via_first", "via_last"):
        known = known.join(there.select("net", F.col("way").alias(way), F.lit(True).alias(f"has_{way}")), ["net", way], "left")
    missing = F.col("has_from_way").isNull() | F.col("has_to_way").isNull() | F.col("has_via_first").isNull() | F.col("has_via_last").isNull()
    outcome = F.when(missing, "skipped_missing_elements").when(F.col("value").startswith("only_"), "skipped_only_via_way")
    known = known.select(*wayturn.columns, outcome.alias("outcome"))
    first = wayedge.select("net", F.col("way").alias("from_way"), F.array("edge_id").alias("path"), F.col("target").alias("at"), F.col("way").alias("last_way"))
    starts = known.where("outcome is null").join(first, ["net", "from_way"]).select("net", "relation", "via_first", "via_last", "to_way", "path", "at", "last_way")
    between, last = F.col("way").isin(F.col("via_first"), F.col("via_last")), F.col("way") == F.col("to_way")
    ends = (F.col("last_way") == F.col("to_way")) & (F.size("path") >= 3)
    ways = F.when(F.col("via_first") == F.col("via_last"), 1).otherwise(2)
    found = paths(wayedge.select("net", "edge_id", "source", "target", "way"), starts, ["net"], between | (F.size("path") > 1) & last, ends, ways + VIA_MORE, {"last_way": F.col("way")})
    rest = known.join(found.select("relation").distinct(), "relation", "left_anti")
    none = rest.select("relation", "net", F.coalesce("outcome", F.lit("skipped_disconnected")).alias("outcome"), F.lit(None).cast("array<string>").alias("path"))
    return found.select("relation", "net", F.lit("via_way").alias("outcome"), "path").unionByName(none)


@rule("wayedge", "connector", sql=f"""state as (select c.*, case when from_node = to_node or edge_count = 0 or way <= 0 or meters = 0 then 'invalid_evidence' when from_node <> expected_from or to_node <> expected_to then 'endpoint_mismatch' end as fault from connector c),
walk as (select net, connector, way, to_node, cast([] as varchar[]) as path, [from_node] as nodes, from_node as at_node, cast(0 as bigint) as length from state where fault is null
  union all select w.net, connector, w.way, to_node, list_append(path, e.edge_id), list_append(nodes, e.target), e.target, length + e.meters from walk w join wayedge e on e.net = w.net and e.way = w.way and e.source = w.at_node
  where at_node <> to_node and len(path) <= {CONNECTOR_EDGES} and (e.target = to_node or not list_contains(nodes, e.target))),
found as (select connector, count(*) as n, any_value(array_to_string(path, ',')) as path, any_value(len(path)) as edges, any_value(length) as length from walk where at_node = to_node group by connector)
select s.connector, case when fault is not null then fault when n is null then 'no_path' when n > 1 then 'multiple_paths' when edges <> edge_count or length <> meters then 'evidence_mismatch' else 'ok' end as outcome, case when n = 1 then path end as path from state s left join found f on f.connector = s.connector""")
def r26_connectors(wayedge, connector):
    """The one directed path of a short connection along its way, if the ends, the edges and the metres are those that its record states."""
    bad = (F.col("from_node") == F.col("to_node")) | (F.col("edge_count") == 0) | (F.col("way") <= 0) | (F.col("meters") == 0)
    apart = (F.col("from_node") != F.col("expected_from")) | (F.col("to_node") != F.col("expected_to"))
    known = connector.withColumn("fault", F.when(bad, "invalid_evidence").when(apart, "endpoint_mismatch"))
    starts = known.where("fault is null").select(F.col("connector").alias("key"), "net", "way", "to_node", F.array().cast("array<string>").alias("path"), F.array("from_node").alias("nodes"), F.col("from_node").alias("at"), F.lit(0).cast("long").alias("length"))
    new = (F.col("next_at") == F.col("to_node")) | ~F.array_contains("nodes", F.col("next_at"))
    found = paths(wayedge, starts, ["net", "way"], new, F.col("at") == F.col("to_node"), F.lit(CONNECTOR_EDGES), {"nodes": F.concat("nodes", F.array("next_at")), "length": F.col("length") + F.col("meters")}, enough=2)
    one = found.groupBy(F.col("key").alias("connector")).agg(F.count("*").alias("n"), F.min("path").alias("path"), F.min("length").alias("length"))
    other = (F.size("path") != F.col("edge_count")) | (F.col("length") != F.col("meters"))
    outcome = F.coalesce("fault", F.when(F.col("n").isNull(), "no_path").when(F.col("n") > 1, "multiple_paths").when(other, "evidence_mismatch").otherwise("ok"))
    return known.join(one, "connector", "left").select("connector", outcome.alias("outcome"), F.when(F.col("n") == 1, F.array_join("path", ",")).alias("path"))


@rule("rampedge", "rampbinding", sql="""first as (select b.*, e.target from rampbinding b join rampedge e on e.net = b.net and e.source = b.start and e.kind = b.kind),
on_ as (select ramp, kind, target as node from first union select o.ramp, o.kind, e.target from on_ o join rampedge e on e.source = o.node and e.kind = o.kind)
select b.ramp, coalesce(f.target <> b.goal and exists (select 1 from on_ o where o.ramp = b.ramp and o.node = b.goal), false) as several_ways from rampbinding b left join first f on f.ramp = b.ramp""")
def r30_ramp_bindings(rampedge, rampbinding):
    """Whether a ramp's binding runs on from its first edge, over further edges of its kind, to the ramp's other end."""
    place = lambda c: F.concat_ws("/", "kind", F.col(c).cast("string"))
    edges = rampedge.select(place("source").alias("source"), place("target").alias("target"), F.lit(1).cast("long").alias("meters"))
    first = rampbinding.join(rampedge.select("net", "kind", F.col("source").alias("start"), "target"), ["net", "kind", "start"])
    found = within(edges, first.select(F.col("ramp").alias("key"), place("target").alias("node")), BINDING_EDGES)
    goal = first.select(F.col("ramp").alias("key"), place("goal").alias("node"))
    met = found.where("meters > 0").join(goal, ["key", "node"]).select(F.col("key").alias("ramp"), F.lit(True).alias("met"))
    return rampbinding.join(met, "ramp", "left").select("ramp", F.coalesce("met", F.lit(False)).alias("several_ways"))


# --- labels of carriageways -----------------------------------------------------------------------


def _both_ways(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """within() along the traffic for ramps that enter and against it for ramps that leave. starts: key, node, leaves."""
    on, back = within(edges, starts.where("not leaves"), SEED_METERS), within(edges, starts.where("leaves"), SEED_METERS, backward=True)
    return on.unionByName(back)


@rule("rampway", "seedramp", sql=f"""step as (select false as leaves, source as node, target as next, meters from rampway union all select true, target, source, meters from rampway),
touched as (select source as node from rampway where mainline union select target from rampway where mainline),
up as (select ramp, leaves, start as node, cast(0 as bigint) as meters from seedramp union all select u.ramp, u.leaves, s.next, u.meters + s.meters from up u join step s on s.leaves = u.leaves and s.node = u.node where u.meters + s.meters <= {SEED_METERS} and u.node not in (select node from touched)),
attached as (select ramp, leaves, node from (select *, row_number() over (partition by ramp order by meters, node) as turn from up where node in (select node from touched)) where turn = 1),
along as (select ramp, leaves, node, cast(0 as bigint) as meters from attached union all select a.ramp, a.leaves, s.next, a.meters + s.meters from along a join step s on s.leaves = a.leaves and s.node = a.node where a.meters + s.meters <= {SEED_METERS}),
shown as (select distinct w.edge_id, r.ramp, r.direction from along a join seedramp r on r.ramp = a.ramp join rampway w on w.mainline and (w.source = a.node or w.target = a.node))
select edge_id, arg_min(direction, ramp) as label, count(distinct direction) > 1 as contested, count(*) as ramps from shown group by edge_id""")
def r19_seed_labels(rampway, seedramp):
    """The direction of the mainline edges at most SEED_METERS along from where a ramp meets the mainline; the first ramp in order decides, contested or not."""
    main = rampway.where("mainline")
    touched = main.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    starts = seedramp.select(F.col("ramp").alias("key"), F.col("start").alias("node"), "leaves")
    met = _both_ways(rampway, starts).join(touched, "node", "left_semi").groupBy("key").agg(F.min(F.struct("meters", "node")).alias("best")).select("key", "best.node")
    along = _both_ways(rampway, met.join(seedramp.select(F.col("ramp").alias("key"), "leaves"), "key"))
    ends = main.select("edge_id", F.explode(F.array("source", "target")).alias("node"))
    shown = along.join(ends, "node").select("edge_id", F.col("key").alias("ramp")).distinct().join(seedramp.select("ramp", "direction"), "ramp")
    return shown.groupBy("edge_id").agg(F.min_by("direction", "ramp").alias("label"), (F.count_distinct("direction") > 1).alias("contested"), F.count("*").alias("ramps"))


def trimmed(runs: str, short: int = SHORT_RUN) -> Column:
    """lo and hi: the part [lo, hi) of runs (an array of label and n) that stays.

    A run at an end goes if it has at most `short` edges of the label with the fewest (of equals, the least)
    and another label has more; both ends are looked at, and again while one went and two runs are left.
    """

    def step(state: Column, _: Column) -> Column:
        left = F.slice(F.col(runs), state["lo"] + 1, state["hi"] - state["lo"])
        labels = F.array_distinct(F.array_compact(F.transform(left, lambda r: r["label"])))
        count = lambda label: F.aggregate(F.filter(left, lambda r: r["label"] == label), F.lit(0).cast("long"), lambda a, r: a + r["n"])
        counts = F.transform(labels, lambda label: F.struct(count(label).alias("n"), label.alias("label")))
        least, most = F.array_min(counts), F.array_max(counts)
        goes = lambda r: F.coalesce((r["label"] == least["label"]) & (r["n"] <= short), F.lit(False))
        first, last = goes(F.try_element_at(left, F.lit(1))), goes(F.try_element_at(left, F.lit(-1)))
        able = state["on"] & F.coalesce(least["n"] < most["n"], F.lit(False))
        lo, hi = state["lo"] + F.when(able & first, 1).otherwise(0), state["hi"] - F.when(able & last, 1).otherwise(0)
        return F.struct(lo.alias("lo"), hi.alias("hi"), (able & (first | last) & (hi - lo >= 2)).alias("on"))

    start = F.struct(F.lit(0).alias("lo"), F.size(runs).alias("hi"), (F.size(runs) >= 2).alias("on"))
    return F.aggregate(F.sequence(F.lit(1), F.size(runs)), start, step)


_RUNS = """flagged as (select *, case when pos = 0 or label is distinct from lag(label) over (partition by net order by pos) then 1 else 0 end as fresh from lane),
numbered as (select *, sum(fresh) over (partition by net order by pos) as run from flagged),
run as (select net, run, any_value(label) as label, count(*) as n, string_agg(edge_id, ',' order by pos) as ids from numbered group by net, run)"""


@rule("lane", sql=f"""{_RUNS}, cut as (select net, list({{'label': label, 'n': n}} order by run) as runs, 1 as lo, count(*) as hi, count(*) >= 2 as going from run group by net
  union all select net, runs, lo + case when a then 1 else 0 end, hi - case when b then 1 else 0 end, (a or b) and hi - case when b then 1 else 0 end - lo - case when a then 1 else 0 end + 1 >= 2 from (
    select *, coalesce(able and runs[lo].label = least.label and runs[lo].n <= {SHORT_RUN}, false) as a, coalesce(able and runs[hi].label = least.label and runs[hi].n <= {SHORT_RUN}, false) as b from (
      select *, counts[1] as least, counts[1].n < counts[len(counts)].n as able from (
        select *, list_sort(list_transform(list_distinct(list_transform(runs[lo:hi], lambda r: r.label)), lambda l: {{'n': list_sum(list_transform(list_filter(runs[lo:hi], lambda r: r.label = l), lambda r: r.n)), 'label': l}})) as counts from cut where going)))),
final as (select net, max(lo) as lo, min(hi) as hi, count(*) as rounds from cut group by net)
select r.net, string_agg(ids, ',' order by run) as kept, any_value(hi - lo + 1) as runs from run r join final f on f.net = r.net and r.run between lo and hi group by r.net""")
def w07_trim_ends(lane):
    """The edges of a line that stay when short runs of the rarest label go from its ends, again and again."""
    line = Window.partitionBy("net").orderBy("pos")
    fresh = F.when((F.col("turn") == 1) | ~F.col("label").eqNullSafe(F.col("last")), 1).otherwise(0)
    flagged = lane.withColumns({"turn": F.row_number().over(line), "last": F.lag("label").over(line)}).withColumn("fresh", fresh)
    runs = flagged.withColumn("run", F.sum("fresh").over(line)).groupBy("net", "run").agg(F.first("label").alias("label"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "edge_id"))).alias("edges"))
    whole = runs.groupBy("net").agg(F.array_sort(F.collect_list(F.struct("run", "label", "n", "edges"))).alias("runs"))
    cut_ = whole.withColumn("part", trimmed("runs")).withColumn("left", F.slice("runs", F.col("part.lo") + 1, F.col("part.hi") - F.col("part.lo")))
    ids = F.transform(F.flatten(F.transform("left", lambda r: r["edges"])), lambda e: e["edge_id"])
    return cut_.select("net", F.array_join(ids, ",").alias("kept"), F.size("left").cast("long").alias("runs"))
