"""Queries that one SQL text expresses for Spark and for the comparison engine.

Each is a function of the dialect that returns (road tables, SQL); its docstring, if the name doesn't
say it, tells what it computes.
"""

from __future__ import annotations

from orbitway.functions import geo

# Route codes, and tag values of the public map's classification.
ROUTE_CODES = "C1 C2 1 2 3 4 5 6 7 9 10 11 B K1 K2 K3 K5 K6 K7 S1 S2 S5 Y".split()
SURFACE = "trunk trunk_link primary primary_link secondary secondary_link tertiary tertiary_link unclassified residential living_street".split()
NOT_SURFACE = "motorway motorway_link footway path cycleway steps pedestrian track bus_guideway escape raceway road construction proposed abandoned disused".split()
NO_VEHICLE = "footway path pedestrian cycleway steps bridleway motorway motorway_link".split()
PRIVATE_SERVICE = "parking_aisle driveway drive-through emergency_access slipway".split()
NO_ACCESS = "no private customers delivery destination permit agricultural forestry military emergency".split()
ACCESS = "yes public designated permissive".split()
OPERATORS_EXACT, OPERATORS_LOWER = ("首都高速", "首都高"), ("metropolitan expressway", "shuto expressway")

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _norm(x: str) -> str:
    return f"lower(trim({x}))"


# --- tags -----------------------------------------------------------------------------------------

_IS_CODE = f"select distinct id from (select id, {{split}} as code from way where ref is not null) where trim(code) in {_in(ROUTE_CODES)}"


@query
def p01_route_code(d):
    return ("way",), f"select w.id, w.ref, c.id is not null as is_code from way w left join ({_IS_CODE.format(split=d['split']('upper(ref)'))}) c on c.id = w.id where w.ref is not null"


@query
def p02_expressway(d):
    """A motorway that its operator, network, route code or name places in the network, each by its own spellings."""
    has = lambda c, words: [f"contains(coalesce({c}, ''), '{x}')" for x in words]
    low = lambda c, words: [f"contains(lower(coalesce({c}, '')), '{x}')" for x in words]
    tests = " or ".join([
        *has("operator", OPERATORS_EXACT), *low("operator", OPERATORS_LOWER), *has("network", OPERATORS_EXACT), *low("network", OPERATORS_LOWER[:1]),
        *has("ref", OPERATORS_EXACT[1:]), *has("coalesce(name, name_ja)", OPERATORS_EXACT), "c.id is not null",
    ])
    return ("way",), f"select w.id, coalesce(w.highway = 'motorway', false) and ({tests}) as is_expressway from way w left join ({_IS_CODE.format(split=d['split']('upper(ref)'))}) c on c.id = w.id"


@query
def p03_vehicle_highway(d):
    return ("way",), f"select id, highway, service, case when highway in {_in(SURFACE)} then true when highway = 'service' and service in {_in(PRIVATE_SERVICE)} then false when highway = 'service' and service = 'alley' then true when highway in {_in(NO_VEHICLE)} then false end as is_vehicle from way"


@query
def p04_oneway(d):
    return ("way",), "select id, oneway, case when oneway in ('yes', '1', 'true') then 'forward' when oneway in ('-1', 'reverse') then 'reverse' else 'both' end as direction from way"


_CONDITIONAL = f"case when conditional like '%:conditional' and conditional <> 'hgv:conditional' then 'conditional' when {_norm('oneway')} in ('reversible', 'alternating') then 'conditional' when {_norm('reversible')} in ('yes', 'true', '1') then 'conditional' when reversible is not null and {_norm('reversible')} not in ('no', 'false', '0') then 'unrecognized' else 'none' end"
_ACCESS = f"case when {_norm('coalesce(motorcar, motor_vehicle, vehicle, access)')} in {_in(NO_ACCESS)} then 'denied' when coalesce(motorcar, motor_vehicle, vehicle, access) is null or {_norm('coalesce(motorcar, motor_vehicle, vehicle, access)')} in {_in(ACCESS)} then 'allowed' else 'unrecognized' end"
_HIGHWAY = f"case when {_norm('area')} in ('yes', '1', 'true') then 'denied' when area is not null and {_norm('area')} not in ('no', '0', 'false') then 'unrecognized' when highway is null or {_norm('highway')} in {_in(NOT_SURFACE)} then 'denied' when {_norm('highway')} = 'service' then case when service is null then 'denied' when {_norm('service')} = 'alley' then 'allowed' when {_norm('service')} in {_in([*PRIVATE_SERVICE, 'unspecified', 'unknown'])} then 'denied' else 'unrecognized' end when {_norm('highway')} in {_in(SURFACE)} then 'allowed' else 'unrecognized' end"


@query
def p05_conditional(d):
    return ("way",), f"select id, {_CONDITIONAL} as restriction from way"


@query
def p06_access(d):
    return ("way",), f"select id, {_ACCESS} as access_state from way"


@query
def p07_highway_type(d):
    return ("way",), f"select id, {_HIGHWAY} as highway_state from way"


@query
def p11_role_inference(d):
    """A blank role takes the direction of its nearest typed neighbours in the route if both sides agree."""
    side = lambda f, frame: f"{f}(role) ignore nulls over (partition by route order by pos rows between {frame})" if d["div"] == "div" else f"{f}(role ignore nulls) over (partition by route order by pos rows between {frame})"
    return ("edge",), f"""select edge_id, role, case when role is not null then role when before = after then before end as inferred from (
        select edge_id, role, {side('last_value', 'unbounded preceding and 1 preceding')} as before, {side('first_value', '1 following and unbounded following')} as after
        from (select *, case source % 4 when 0 then 'inner' when 1 then case when source % 5 = 0 then 'outer' else 'inner' end end as role from edge))"""


# --- graph ----------------------------------------------------------------------------------------


@query
def s04_decode_deltas(d):
    """Node ids from ascending deltas by a running sum."""
    return ("edge",), "select route, pos, cast(sum(delta) over (partition by route order by pos rows between unbounded preceding and current row) as bigint) as node_id from (select route, pos, source - coalesce(lag(source) over (partition by route order by pos), 0) as delta from edge)"


@query
def s05_decode_edges(d):
    """Edge ends from positions; a position out of range has no node."""
    return ("edge",), "select e.edge_id, a.source as from_node, b.source as to_node from (select edge_id, route, pos, (pos + 1) % count(*) over (partition by route) as next_pos from edge) e join edge a on a.route = e.route and a.pos = e.pos left join edge b on b.route = e.route and b.pos = e.next_pos"


@query
def s06_encode_deltas(d):
    return ("edge",), "select route, pos, source - coalesce(lag(source) over (partition by route order by pos), 0) as delta from edge"


@query
def s15_snap_index(d):
    return ("entry",), "select distinct id, cast(round(lat * 1000000) as bigint) as lat_e6, cast(round(lon * 1000000) as bigint) as lon_e6 from entry"


@query
def g04_directed_segments(d):
    """Forward and reverse edges of each way segment by its oneway tag, with haversine metres."""
    return ("edge", "node", "way"), f"""select concat('e:w', cast(x.id as {{string}}), ':', x.way_dir) as edge_id, x.from_node, x.to_node, x.meters from (
        select w.id, 'f' as way_dir, e.source as from_node, e.target as to_node, {geo.haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} as meters from way w join edge e on e.source = w.id join node a on a.id = e.source join node b on b.id = e.target where coalesce(w.oneway, '') not in ('-1', 'reverse')
        union all
        select w.id, 'r' as way_dir, e.target as from_node, e.source as to_node, {geo.haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} as meters from way w join edge e on e.source = w.id join node a on a.id = e.source join node b on b.id = e.target where coalesce(w.oneway, '') not in ('yes', '1', 'true')) x"""


@query
def g05_degrees(d):
    return ("edge",), "select id, cast(sum(o) as bigint) as out_degree, cast(sum(i) as bigint) as in_degree from (select source as id, 1 as o, 0 as i from edge union all select target, 0, 1 from edge) group by id"


@query
def g09_speed_model(d):
    return ("edge",), "select edge_id, greatest(cast(round(cast(meters as double) / (cast(case when source % 7 = 0 then 40 when source % 7 = 3 then 30 else 60 end as double) / cast(3.6 as double))) as bigint), 1) as secs from edge"


@query
def g10_active_nodes(d):
    return ("node", "edge"), "select id from node where exists (select 1 from edge where source = id or target = id)".replace("source = id or target = id", "source = node.id") + " or exists (select 1 from edge where target = node.id)"


# --- joins ----------------------------------------------------------------------------------------


@query
def j04_within_200m(d):
    """Nearest entry within 200 m of each request by cells of 0.005 degrees and their neighbours."""
    cell = lambda x: f"cast(floor({x} / cast(0.005 as double)) as bigint)"
    return ("request", "entry"), f"""select request_id, entry_id, cast(round(meters) as bigint) as meters from (
        select r.request_id, e.id as entry_id, {geo.equirectangular('r.lat', 'r.lon', 'e.lat', 'e.lon')} as meters, row_number() over (partition by r.request_id order by round({geo.equirectangular('r.lat', 'r.lon', 'e.lat', 'e.lon')}, 3), e.id) as rn
        from (select r0.*, {cell('lat')} + dy as cy, {cell('lon')} + dx as cx from request r0 cross join (values (-1), (0), (1)) as a(dy) cross join (values (-1), (0), (1)) as b(dx)) r
        join (select e0.*, {cell('lat')} as cy, {cell('lon')} as cx from entry e0) e on e.cy = r.cy and e.cx = r.cx
        where {geo.equirectangular('r.lat', 'r.lon', 'e.lat', 'e.lon')} <= 200) where rn = 1"""


@query
def j16_forbidden_pairs(d):
    """Routes whose lap holds no forbidden pair of consecutive edges."""
    return ("ring", "turn"), "select r.route from ring r where not exists (select 1 from turn t where t.route = r.route and t.via % 50 = 0)"


# --- aggregates and windows -----------------------------------------------------------------------


@query
def a01_path_sums(d):
    return ("edge",), "select route, cast(sum(secs) as bigint) as secs, cast(sum(meters) as bigint) as meters from edge group by route"


@query
def a06_coverage(d):
    return ("entry",), f"select route, cast(count(*) as bigint) as entries, {d['joined'](f'cast(id as {{string}})', 'id')} as ids from entry group by route"


@query
def a07_derivation_summary(d):
    return ("ring",), f"select cast(count(*) as bigint) as total, cast({d['count_if']('meters >= 5000')} as bigint) as eligible, cast({d['count_if']('meters < 5000')} as bigint) as held from ring"


@query
def a10_percentiles(d):
    pick = lambda p: f"cast(percentile_disc({p}) within group (order by ms) as bigint)"
    return ("trial",), f"select pattern, {pick(0.5)} as p50, {pick(0.95)} as p95, max(ms) as worst from trial where timeout = 0 group by pattern"


@query
def a12_grouping_sets(d):
    """Trials overall, by cache state and by pattern."""
    return ("trial",), "select cache, pattern, cast(count(*) as bigint) as n, max(ms) as worst, cast(sum(timeout) as bigint) as timeouts from trial group by grouping sets ((), (cache), (pattern))"


@query
def a13_transferred(d):
    return ("trial",), "select pattern, cast(case when sum(transfer) > 0 then sum(transfer) else sum(encoded) end as bigint) as n_bytes from trial group by pattern"


@query
def a16_degree_imbalance(d):
    return ("edge",), "select cast(sum(abs(b)) as bigint) as imbalance from (select id, sum(v) as b from (select source as id, 1 as v from edge union all select target, -1 from edge) group by id)"


@query
def a17_bounds(d):
    return ("node",), "select cast(round(min(lat) * 1000000) as bigint) as south, cast(round(max(lat) * 1000000) as bigint) as north, cast(round(min(lon) * 1000000) as bigint) as west, cast(round(max(lon) * 1000000) as bigint) as east from node where lat between -90 and 90"


@query
def w01_continuity(d):
    """Edges whose start isn't the end of the edge before them on the route; none in a sound graph."""
    return ("edge",), "select edge_id from (select edge_id, source, lag(target) over (partition by route order by pos) as before from edge) where before <> source"


@query
def w02_interval_gaps(d):
    return ("price",), "select pair_id, price_id, case when next_from is null then 'open' when to_at < next_from then 'gap' when to_at > next_from then 'overlap' else 'tight' end as state from (select *, lead(from_at) over (partition by pair_id order by from_at, price_id) as next_from from price)"


@query
def w04_rotation(d):
    """Laps that start at the edge after the route's middle."""
    return ("edge", "ring"), "select e.route, e.edge_id, (e.pos - r.edges {div} 2 + r.edges) % r.edges as lap_pos from edge e join ring r on r.route = e.route"


@query
def w05_midpoint(d):
    """The node where the distance driven is nearest to half of the lap; the first of equals."""
    return ("edge", "ring"), "select route, target as node_id from (select e.route, e.target, row_number() over (partition by e.route order by abs(2 * sum_m - r.meters), e.pos) as rn from (select *, sum(meters) over (partition by route order by pos rows between unbounded preceding and current row) as sum_m from edge) e join ring r on r.route = e.route) where rn = 1"


@query
def w06_label_runs(d):
    """Runs of equal labels along a route."""
    return ("edge",), "select route, label, cast(min(pos) as bigint) as first_pos, cast(count(*) as bigint) as edges from (select *, sum(new_run) over (partition by route order by pos rows between unbounded preceding and current row) as run from (select route, pos, label, case when label = lag(label) over (partition by route order by pos) then 0 else 1 end as new_run from (select route, pos, source % 3 as label from edge))) group by route, label, run"


@query
def w09_anchor_sample(d):
    """At most 32 evenly spaced anchors of each ring: place s * (n - 1) / 31."""
    slots = " union all ".join(f"select cast({s} as bigint) as s" for s in range(32))
    return ("edge", "ring"), f"select distinct e.route, e.source from edge e join ring r on r.route = e.route join ({slots}) k on e.pos = k.s * (r.edges - 1) {{div}} 31 where r.edges > 32 union select e.route, e.source from edge e join ring r on r.route = e.route where r.edges <= 32"


# --- scalar functions -----------------------------------------------------------------------------


@query
def f01_distance(d):
    return ("access",), "select request_id, entry_id, cast(round(meters, 0) as bigint) as meters from access where rank = 1"


@query
def f02_haversine(d):
    return ("edge", "node"), f"select e.edge_id, {geo.haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} as meters from edge e join node a on a.id = e.source join node b on b.id = e.target"


@query
def f03_surface_leg(d):
    return ("access",), f"select request_id, entry_id, {geo.surface_meters('round(meters, 3)')} as leg_meters, {geo.surface_seconds('round(meters, 3)')} as leg_seconds from access"


@query
def f04_plan(d):
    return ("ring",), f"select route, secs + {geo.buffer_seconds('secs', d['div'])} as plan_seconds from ring"


@query
def f07_fare(d):
    return ("request", "rule"), f"select r.request_id, u.rule_id, {geo.fare_yen('(r.billed + case when r.request_id % 17 = 0 then 50 else 0 end)', 'u', d['div'])} as yen from request r join rule u on u.from_at <= r.priced_at and (u.to_at is null or r.priced_at < u.to_at)"


@query
def f08_fare_rounded_up(d):
    return ("request", "rule"), f"select r.request_id, u.rule_id, {geo.fare_yen_up('(r.billed + r.request_id % 100)', 'u', d['div'])} as yen from request r cross join rule u"


@query
def f09_edges_hash(d):
    quote = "'\"'"
    listed = d["joined"](f"concat({quote}, edge_id, {quote})", "pos")
    return ("edge",), f"select route, {d['sha'](f'concat({chr(39)}[{chr(39)}, {listed}, {chr(39)}]{chr(39)})')} as edges_sha256 from edge group by route"


@query
def t07_pair_order(d):
    """Pairs nearest first, ten at most, and whether more were cut."""
    return ("access", "exit_ramp"), "select request_id, exit_id, cut from (select a.request_id, x.id as exit_id, row_number() over (partition by a.request_id order by round(a.meters, 3), a.entry_id, x.id) as rn, count(*) over (partition by a.request_id) > 10 as cut from access a join exit_ramp x on x.route = a.route) where rn <= 10"


# --- loops, search, reports -----------------------------------------------------------------------


@query
def r27_first_exit(d):
    return ("entry", "exit_ramp", "ring"), "select entry_id, exit_id from (select e.id as entry_id, x.id as exit_id, row_number() over (partition by e.id order by (x.pos - e.pos + r.edges) % r.edges, x.id) as rn from entry e join exit_ramp x on x.route = e.route join ring r on r.route = e.route) where rn = 1"


# --- validators: rule, entity, message; no rows where all is well ----------------------------------
