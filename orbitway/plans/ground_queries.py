"""Where a ramp meets the first public road: what each way at each node of a chain allows, and the first thing along the chain that decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitway.plans.build_queries import registering
from orbitway.plans.sql_queries import ACCESS, NO_ACCESS, NOT_SURFACE, PRIVATE_SERVICE, SURFACE, _ACCESS, _CONDITIONAL, _HIGHWAY

QUERIES, ORACLE = {}, {}
rule = registering(QUERIES, ORACLE)
#: Reasons why a chain has no ground connection.
CONDITIONAL, UNRECOGNIZED, NO_GROUND, AMBIGUOUS, WAY_MISMATCH = "CONDITIONAL_ACCESS_RESTRICTION", "UNRECOGNIZED_TAG_FAIL_CLOSED", "NO_GROUND_CONNECTION", "AMBIGUOUS_GROUND_ENDPOINT", "GROUND_WAY_MISMATCH"
NO_SUCCESSOR, SEVERAL_SUCCESSORS, SUCCESSOR_MISMATCH, EARLY = "NO_RAMP_SUCCESSOR", "MULTIPLE_RAMP_SUCCESSORS", "RAMP_SUCCESSOR_MISMATCH", "EARLY_SURFACE_CONNECTION"
FORTH, BACK, BOTH, VARIABLE = ["yes", "1", "true"], ["-1", "reverse"], ["", "no", "0", "false"], ["reversible", "alternating"]


def _tag(name: str) -> Column:
    return F.lower(F.trim(F.col(name)))


def conditional() -> Column:
    """'conditional', 'unrecognized' or 'none': whether the way's use depends on the hour."""
    reversible = _tag("reversible")
    hours = (F.col("conditional").endswith(":conditional") & (F.col("conditional") != "hgv:conditional")) | _tag("oneway").isin(VARIABLE) | reversible.isin("yes", "true", "1")
    return F.when(hours, "conditional").when(reversible.isNotNull() & ~reversible.isin("no", "false", "0"), "unrecognized").otherwise("none")


def allowed() -> Column:
    """'allowed', 'denied' or 'unrecognized' by the first access tag that the way has."""
    tag = F.lower(F.trim(F.coalesce("motorcar", "motor_vehicle", "vehicle", "access")))
    return F.when(tag.isin(NO_ACCESS), "denied").when(tag.isNull() | tag.isin(ACCESS), "allowed").otherwise("unrecognized")


def public() -> Column:
    """'allowed', 'denied' or 'unrecognized' by the way's kind."""
    area, kind, service = _tag("area"), _tag("highway"), _tag("service")
    alley = F.when(service.isNull() | service.isin([*PRIVATE_SERVICE, "unspecified", "unknown"]), "denied").when(service == "alley", "allowed").otherwise("unrecognized")
    road = F.when(kind.isNull() | kind.isin(NOT_SURFACE), "denied").when(kind == "service", alley).when(kind.isin(SURFACE), "allowed").otherwise("unrecognized")
    return F.when(area.isin("yes", "1", "true"), "denied").when(area.isNotNull() & ~area.isin("no", "0", "false"), "unrecognized").otherwise(road)


def way_ends(groundway: DataFrame, groundplace: DataFrame) -> DataFrame:
    """way, node, flow, link, state, hours, onward, for each node of a way and either flow.

    onward: the nodes next to it that the flow may come from or go to; state: 'legal', 'rejected' or a
    reason, the first of the tests that the way fails (hours, access, kind, direction); hours: whether a
    ramp's use depends on the hour; turned: whether its direction is known.
    """
    line = Window.partitionBy("way").orderBy("pos")
    placed = groundplace.withColumns({"after": F.lead("node").over(line), "before": F.lag("node").over(line)})
    rows = placed.join(groundway, "way").withColumn("flow", F.explode(F.array(F.lit("exit"), F.lit("entry"))))
    tag = F.coalesce(_tag("oneway"), F.lit(""))
    leaving, after, before = F.col("flow") == "exit", F.col("after"), F.col("before")
    reached = (
        F.when(tag.isin(BOTH), F.array(after, before)).when(tag.isin(FORTH) & leaving, F.array(after)).when(tag.isin(FORTH) & before.isNotNull(), F.array(F.coalesce(after, before)))
        .when(tag.isin(BACK) & leaving, F.array(before)).when(tag.isin(BACK) & after.isNotNull(), F.array(before))
    )
    known = tag.isin([*BOTH, *FORTH, *BACK])
    kinds = {"link": F.coalesce(_tag("highway"), F.lit("")) == "motorway_link", "main": F.coalesce(_tag("highway"), F.lit("")) == "motorway", "hours": conditional(), "use": allowed(), "kind": public(), "known": known, "onward": F.array_compact(F.coalesce(reached, F.array().cast("array<bigint>")))}
    whole = rows.withColumns(kinds).groupBy("way", "node", "flow", "link", "main", "hours", "use", "kind", "known").agg(F.array_distinct(F.flatten(F.collect_list("onward"))).alias("onward"))
    state = (
        F.when(F.col("hours") == "conditional", CONDITIONAL).when((F.col("hours") == "unrecognized") | (F.col("use") == "unrecognized"), UNRECOGNIZED).when(F.col("use") == "denied", "rejected")
        .when(F.col("kind") == "unrecognized", UNRECOGNIZED).when(F.col("kind") == "denied", "rejected").when(~F.col("known"), UNRECOGNIZED).when(F.size("onward") == 0, "rejected").otherwise("legal")
    )
    return whole.select("way", "node", "flow", "link", "main", (F.col("hours") == "conditional").alias("hours"), "known", "onward", state.alias("state"))


_ENDS = f"""placed as (select *, lead(node) over (partition by way order by pos) as after, lag(node) over (partition by way order by pos) as before from groundplace),
tagged as (select p.way, p.node, p.after, p.before, f.flow, coalesce(lower(trim(w.highway)), '') as road, coalesce(lower(trim(w.oneway)), '') as tag, {_CONDITIONAL} as hours, {_ACCESS} as use_, {_HIGHWAY} as kind from placed p join groundway w on w.way = p.way, (values ('exit'), ('entry')) as f(flow)),
stepped as (select *, tag in ('', 'no', '0', 'false', 'yes', '1', 'true', '-1', 'reverse') as known, case when tag in ('', 'no', '0', 'false') then [after, before] when tag in ('yes', '1', 'true') then case when flow = 'exit' then [after] when before is not null then [coalesce(after, before)] end
  when tag in ('-1', 'reverse') then case when flow = 'exit' or after is not null then [before] end end as next from tagged),
ended as (select way, node, flow, road, hours, use_, kind, known, list_distinct(flatten(list(list_filter(coalesce(next, []), lambda x: x is not null)))) as onward from stepped group by all),
judged as (select *, case when hours = 'conditional' then '{CONDITIONAL}' when hours = 'unrecognized' or use_ = 'unrecognized' then '{UNRECOGNIZED}' when use_ = 'denied' then 'rejected' when kind = 'unrecognized' then '{UNRECOGNIZED}' when kind = 'denied' then 'rejected'
  when not known then '{UNRECOGNIZED}' when len(onward) = 0 then 'rejected' else 'legal' end as state from ended)"""


@rule("groundway", "groundplace", sql=f"{_ENDS} select way, node, flow, state from judged")
def p08_surface_way(groundway, groundplace):
    """Whether a way lets a ramp's traffic on or off at a node: by hours, access, kind and direction, in this order."""
    return way_ends(groundway, groundplace).select("way", "node", "flow", "state")


@rule("groundway", "groundplace", "groundchain", sql=f"""{_ENDS},
linked as (select c.chain, c.pos, c.node, c.flow, c.expected_way, c.declared_node, lead(c.node) over (partition by c.chain order by c.pos) as next_node from groundchain c),
streets as (select l.chain, l.pos, list(j.way order by j.way) filter (where j.state = 'legal') as legal, arg_min(j.state, j.way) filter (where j.state not in ('legal', 'rejected')) as fault from linked l join judged j on j.node = l.node and j.flow = l.flow where j.road not in ('motorway', 'motorway_link') group by l.chain, l.pos),
ramps as (select l.chain, l.pos, bool_or(j.flow = l.flow and j.known and j.hours = 'conditional' and list_contains(j.onward, l.next_node)) as hours, bool_or(j.flow = 'exit' and not j.known) as odd from linked l join judged j on j.node = l.node where j.road = 'motorway_link' group by l.chain, l.pos),
follow as (select l.chain, l.pos, count(*) as n, min(o.x) as sole from linked l join judged j on j.node = l.node and j.road = 'motorway_link' and j.flow = 'exit' and j.known, unnest(j.onward) as o(x) where o.x <> l.node group by l.chain, l.pos),
seen as (select l.*, s.legal, s.fault, coalesce(s.fault, case when s.legal is not null then 'later' end) as sign, r.hours, r.odd, f.n, f.sole from linked l left join streets s on s.chain = l.chain and s.pos = l.pos left join ramps r on r.chain = l.chain and r.pos = l.pos left join follow f on f.chain = l.chain and f.pos = l.pos),
looked as (select *, first_value(sign ignore nulls) over (partition by chain order by pos rows between 1 following and unbounded following) as later from seen),
decided as (select *, case when hours then '{CONDITIONAL}' when fault is not null then fault when legal is not null then case when later = 'later' then '{AMBIGUOUS}' when later is not null then later when expected_way is not null and not list_contains(legal, expected_way) then '{WAY_MISMATCH}' else 'ok' end
  when next_node is null then null when odd then '{UNRECOGNIZED}' when n is null then '{NO_SUCCESSOR}' when n > 1 then '{SEVERAL_SUCCESSORS}' when sole <> next_node then '{SUCCESSOR_MISMATCH}' end as outcome from looked),
first as (select chain, arg_min(struct_pack(outcome := outcome, node := node, legal := legal, expected := expected_way, hours := hours, fault := fault), pos) as x from decided where outcome is not null group by chain)
select c.chain, case when x is null then '{NO_GROUND}' when x.outcome = 'ok' and x.node <> c.declared_node then '{EARLY}' else x.outcome end as outcome, x.node as ground_node,
  case when x.outcome in ('ok', '{AMBIGUOUS}', '{WAY_MISMATCH}') then case when x.outcome = 'ok' then coalesce(x.expected, x.legal[1]) else x.legal[1] end end as ground_way from (select distinct chain, declared_node from groundchain) c left join first f on f.chain = c.chain""")
def g16_ground_connection(groundway, groundplace, groundchain):
    """The first public road along each ramp chain, or what keeps it from being known.

    At each node in turn: a ramp on by the hour; a street whose tags can't be trusted; streets that let
    traffic on or off, if no later node has any (and the declared one, if there is one, is among them); or
    else the one ramp way on to the chain's next node. What a node says first decides, and the first node
    that says anything. A connection at another node than the declared one is an early one.
    """
    ends = way_ends(groundway, groundplace)
    line = Window.partitionBy("chain").orderBy("pos")
    linked = groundchain.withColumn("next_node", F.lead("node").over(line))
    at = linked.select("chain", "pos", "node", F.col("flow").alias("own"), "next_node").join(ends, "node")
    same, link = F.col("flow") == F.col("own"), F.col("link")
    street = same & ~link & ~F.col("main")
    fault = street & ~F.col("state").isin("legal", "rejected")
    onward = F.filter("onward", lambda x: x != F.col("node"))
    signs = at.groupBy("chain", "pos").agg(
        F.coalesce(F.bool_or(same & link & F.col("known") & F.col("hours") & F.array_contains("onward", F.col("next_node"))), F.lit(False)).alias("by_hours"),
        F.min(F.when(fault, F.struct("way", "state")))["state"].alias("fault"),
        F.array_sort(F.collect_list(F.when(street & (F.col("state") == "legal"), F.col("way")))).alias("legal"),
        F.bool_or(link & (F.col("flow") == "exit") & ~F.col("known")).alias("odd"),
        F.flatten(F.collect_list(F.when(link & (F.col("flow") == "exit") & F.col("known"), onward))).alias("follow"),
    )
    seen = linked.join(signs, ["chain", "pos"], "left").withColumn("sign", F.coalesce("fault", F.when(F.size("legal") > 0, "later")))
    looked = seen.withColumn("later", F.first("sign", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)))
    declared = F.col("expected_way").isNotNull() & ~F.array_contains("legal", F.col("expected_way"))
    met = F.when(F.col("later") == "later", AMBIGUOUS).when(F.col("later").isNotNull(), F.col("later")).when(declared, WAY_MISMATCH).otherwise("ok")
    follow = F.coalesce(F.size("follow"), F.lit(0))
    on = F.when(F.col("odd"), UNRECOGNIZED).when(follow <= 0, NO_SUCCESSOR).when(follow > 1, SEVERAL_SUCCESSORS).when(F.try_element_at("follow", F.lit(1)) != F.col("next_node"), SUCCESSOR_MISMATCH)
    outcome = F.when(F.col("by_hours"), CONDITIONAL).when(F.col("fault").isNotNull(), F.col("fault")).when(F.size("legal") > 0, met).when(F.col("next_node").isNotNull(), on)
    first = looked.withColumn("outcome", outcome).groupBy("chain", "declared_node").agg(F.min_by(F.when(F.col("outcome").isNotNull(), F.struct("outcome", "node", "legal", "expected_way")), F.when(F.col("outcome").isNotNull(), F.col("pos"))).alias("x"))
    early = (F.col("x.outcome") == "ok") & (F.col("x.node") != F.col("declared_node"))
    least = F.try_element_at("x.legal", F.lit(1))
    way = F.when(F.col("x.outcome") == "ok", F.coalesce("x.expected_way", least)).when(F.col("x.outcome").isin(AMBIGUOUS, WAY_MISMATCH), least)
    return first.select("chain", F.when(early, EARLY).otherwise(F.coalesce("x.outcome", F.lit(NO_GROUND))).alias("outcome"), F.col("x.node").alias("ground_node"), way.alias("ground_way"))
