"""Road tables as SQL over the driver's tables: rings of parts, ramps, requests, ways with tags, trials.

Each entry is the body of a common table expression; {name} parts are dialect spellings.
"""

from __future__ import annotations

from orbitway.functions import geo

#: Nodes of a ring at most.
RING = 64

TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "node": ((), """select p_partkey as id, cast(35.5 as double) + cast((p_partkey * 6151) % 10000 as double) / cast(25000 as double) as lat,
        cast(139.5 as double) + cast((p_partkey * 7919) % 10000 as double) / cast(20000 as double) as lon from part"""),
    "placed": ((), f"select p_partkey as id, p_brand, p_size, p_retailprice, (row_number() over (partition by p_brand order by p_partkey) - 1) {{div}} {RING} as slab from part"),
    # A directed ring a route: secs 1 to 50, metres about 900 to 1000.
    "edge": (("placed",), """select concat('e:', cast(id as {string})) as edge_id, concat(p_brand, ':', cast(slab as {string})) as route, id as source,
        coalesce(lead(id) over (partition by p_brand, slab order by id), min(id) over (partition by p_brand, slab)) as target,
        cast(row_number() over (partition by p_brand, slab order by id) - 1 as bigint) as pos,
        cast(p_size as bigint) as secs, cast(round(p_retailprice) as bigint) as meters from placed"""),
    "ring": (("edge",), "select route, cast(count(*) as bigint) as edges, cast(sum(secs) as bigint) as secs, cast(sum(meters) as bigint) as meters from edge group by route"),
    "entry": (("node", "edge"), "select n.id, n.lat, n.lon, e.route, e.pos from node n join edge e on e.source = n.id where n.id % 7 = 0"),
    "exit_ramp": (("edge",), "select source as id, route, pos from edge where source % 7 = 3"),
    "request": ((), """select c_custkey as request_id, cast(35.5 as double) + cast((c_custkey * 4099) % 10000 as double) / cast(25000 as double) as lat,
        cast(139.5 as double) + cast((c_custkey * 5003) % 10000 as double) / cast(20000 as double) as lon,
        cast(10 + c_custkey % 50 as bigint) as min_minutes, cast(60 + c_custkey % 120 as bigint) as max_minutes,
        cast(100 * (1 + c_custkey % 300) as bigint) as billed, case when c_custkey % 2 = 0 then timestamp '2026-09-30 14:59:59' else timestamp '2026-09-30 15:00:00' end as priced_at from customer"""),
    # The two published rules (micro-yen a unit, yen, basis points, metres).
    "rule": ((), """select * from (values
        ('2022-04', timestamp '2022-03-31 15:00:00', timestamp '2026-09-30 15:00:00', cast(100 as bigint), cast(2952000 as bigint), cast(150 as bigint), cast(11000 as bigint), cast(4300 as bigint), cast(300 as bigint), cast(1950 as bigint), cast(10 as bigint)),
        ('2026-10', timestamp '2026-09-30 15:00:00', cast(null as timestamp), cast(100 as bigint), cast(3247200 as bigint), cast(150 as bigint), cast(11000 as bigint), cast(3900 as bigint), cast(300 as bigint), cast(2130 as bigint), cast(10 as bigint))
        ) as r(rule_id, from_at, to_at, unit, rate, terminal, tax, zone, least, most, multiple)"""),
    # Prices whose intervals follow the orders of a customer: one pair a customer.
    "price": ((), """select o_custkey as pair_id, o_orderkey as price_id, o_orderdate as from_at, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as to_at,
        cast(300 + 10 * (o_orderkey % 166) as bigint) as yen from orders"""),
    # Ways with tags that go through all kinds.
    "way": ((), """select p_partkey as id,
        case p_partkey % 13 when 0 then 'motorway' when 1 then 'motorway_link' when 2 then 'trunk' when 3 then 'residential' when 4 then 'service' when 5 then 'road' when 6 then 'footway' when 7 then 'unclassified' when 8 then 'track' when 9 then ' Primary ' when 10 then 'busway' when 11 then 'service' end as highway,
        case p_partkey % 5 when 0 then 'alley' when 1 then 'driveway' when 2 then 'parking_aisle' when 3 then 'depot' end as service,
        case p_partkey % 7 when 0 then 'yes' when 1 then '-1' when 2 then '1' when 3 then 'reversible' when 4 then 'true' when 5 then 'reverse' end as oneway,
        case p_partkey % 11 when 0 then 'no' when 1 then 'yes' when 2 then 'odd' end as motorcar,
        case p_partkey % 17 when 0 then 'private' when 1 then 'designated' when 2 then ' Yes ' end as motor_vehicle,
        case p_partkey % 3 when 0 then 'permissive' when 1 then 'destination' end as access,
        case p_partkey % 19 when 0 then 'yes' when 1 then 'no' when 2 then 'maybe' end as area,
        case p_partkey % 23 when 0 then 'yes' when 1 then 'unsure' end as reversible,
        case p_partkey % 9 when 0 then 'C1' when 1 then 'E1;c2' when 2 then 'K7 ; E83' when 3 then 'E20' when 4 then '首都高速1号' end as ref,
        case p_partkey % 8 when 0 then 'Metropolitan Expressway Co.' when 1 then '首都高速道路' when 2 then 'SHUTO EXPRESSWAY' when 3 then 'Other' end as operator,
        case p_partkey % 29 when 0 then '首都高速都心環状線' end as name,
        case p_partkey % 31 when 0 then '首都高速' when 1 then 'METROPOLITAN EXPRESSWAY' when 2 then 'JP:E' end as network,
        case p_partkey % 37 when 0 then '首都高湾岸線' when 1 then '湾岸道路' end as name_ja,
        case p_partkey % 14 when 0 then 'no' when 1 then ' Yes' end as vehicle,
        case p_partkey % 41 when 0 then 'maxspeed:conditional' when 1 then 'hgv:conditional' when 2 then 'access:conditional' end as conditional from part"""),
    # Nodes of a way, with one that comes twice in some, and members of route relations with roles of all spellings.
    # Turn restrictions: from the way that leads to `via`, to one of those that leave it; some lack a part or name a way that isn't there.
    "restriction": (("net",), """select id as relation, net, case when id % 9 = 0 then null when id % 9 = 1 then 'no_entry' when id % 2 = 0 then 'no_left_turn' else 'only_straight_on' end as value, id % 18 = 0 as conditional,
        case when id % 13 <> 0 then case when id % 17 = 0 then -id else id end end as from_way, case when id % 11 <> 0 then case when id % 19 = 0 then id else next_id end end as via_node, case when id % 23 = 0 then id end as via_way,
        case when id % 5 = 0 then next_id + 1000000 else next_id end as to_way from net where next_id is not null"""),
    # Bindings of ramps to map ways, exits that two directions share, artifacts of a release.
    "binding": ((), """select p_partkey as ramp, p_partkey % 40 as way, case when p_partkey % 2 = 0 then 'entry' else 'exit' end as kind, p_partkey % 7 as from_node, p_partkey % 5 as to_node from part"""),
    "street": ((), """select p_partkey as id, cast(35.5 as double) + cast((p_partkey * 6151) % 10000 as double) / cast(25000 as double) + cast(p_partkey % 40 as double) / cast(40000 as double) as lat,
        cast(139.5 as double) + cast((p_partkey * 7919) % 10000 as double) / cast(20000 as double) as lon from part where p_partkey % 3 <> 0"""),
    "netway": (("net",), """select net, id as way, concat('e:', cast(id as {string})) as edge_id, id as from_node, coalesce(next_id, anchor) as to_node from net where next_id is not null or closed
        union all select net, id + 1000000, concat('c:', cast(id as {string})), id, far_id from net where chord_secs is not null"""),
    "waynode": ((), """select p_partkey as way, i as pos, (p_partkey * 3 + case when p_partkey % 6 = 0 and i = 4 then 1 else i end) as node, p_partkey * 3 + 1 as at_node,
        case p_partkey % 8 when 0 then 'yes' when 1 then '-1' when 2 then ' Reverse' when 3 then 'no' when 4 then 'reversible' when 5 then 'sometimes' when 6 then '1' end as oneway,
        case when p_partkey % 2 = 0 then 'exit' else 'entry' end as flow from part, (values (0), (1), (2), (3), (4)) as v(i)"""),
    "member": ((), """select p_brand as relation, row_number() over (partition by p_brand order by p_partkey) as pos, p_partkey as way, case when p_partkey % 11 = 0 then 'node' else 'way' end as kind,
        case when p_brand like '%1' then 'C1' when p_brand like '%2' then '2' else 'B' end as route_id,
        case p_partkey % 13 when 0 then 'Inner_Loop' when 1 then 'outer' when 2 then 'BACKWARD' when 3 then ' forward ' when 4 then 'east' when 5 then 'stop' when 6 then 'reverse_lane' when 7 then 'northbound' when 8 then 'south' else '' end as role,
        case when p_brand like '%3' or p_brand like '%12' then 'Forward; backward' when p_brand like '%4' then ',' end as declared,
        case p_partkey % 4 when 0 then 'yes' when 1 then '-1' when 2 then 'TRUE' else '1' end as oneway from part"""),
    # Candidates of a search, ramps, records of device checks, tariff assignments.
    "candidate": ((), """select o_orderkey as id, o_custkey as request_id, case o_orderkey % 5 when 0 then 'topologyOnly' when 1 then 'radialReturn' when 2 then 'radialReturn' else 'legacyRing' end as pair_kind,
        case when o_orderkey % 3 = 0 then 'unverified' else 'verified_one_section_ahead' end as eligibility, case when o_orderkey % 7 = 0 then 'unvalidated' else 'declared_route_validated' end as loop_validation,
        cast(600 + 300 * (o_orderkey % 12) as bigint) as secs, case when o_orderkey % 9 = 0 then null else cast(300 + 150 * (o_orderkey % 12) as bigint) end as yen,
        cast(60 * (o_orderkey % 4) as bigint) as access_secs, cast(30 * (o_orderkey % 3) as bigint) as return_secs, cast(o_orderkey % 6 as bigint) as tier, cast(1000 * (o_orderkey % 6) as bigint) as tier_meters from orders"""),
    "ramp": ((), """select p_partkey as id, concat('r:', cast(p_partkey as {string})) as ramp_id, p_partkey {div} 4 as facility, case when p_partkey % 3 = 0 then p_partkey * 1000 else p_partkey {div} 2 end as edge, concat('Ramp ', cast(p_partkey % 50 as {string})) as name,
        case p_partkey % 5 when 0 then 'C1' when 1 then 'B' when 2 then 'K1' when 3 then 'S5' else 'X9' end as route, case p_partkey % 3 when 0 then 'inner' when 1 then 'outer' else 'inbound' end as direction,
        case p_partkey % 4 when 0 then 'general_entry' when 1 then 'general_exit' when 2 then 'general_entry' else case when p_partkey % 8 = 3 then 'boundary_in' else 'general_exit' end end as kind,
        case when p_partkey % 10 = 0 then 'closed' else 'active' end as status, case p_partkey % 6 when 0 then 'structural_no_loop' when 1 then 'unsupported' when 2 then 'unknown' else 'routable' end as capability from part"""),
    "device": ((), """select c_custkey as plan, os, client, case when os = 'ios' and client = 'app' and c_custkey % 10 = 0 then 'missing' when os = 'android' and client = 'web' and c_custkey % 10 = 1 then 'failed' when c_custkey % 10 = 2 and os = 'ios' then 'expired' else 'passed' end as result,
        case when c_custkey % 10 = 3 then timestamp '2026-10-02 00:00:00' else timestamp '2026-09-01 00:00:00' end as verified_at, case when c_custkey % 10 = 4 and client = 'web' then timestamp '2026-10-01 00:00:00' else timestamp '2027-01-01 00:00:00' end as expires_at,
        c_custkey % 10 = 5 and os = 'ios' as extra from customer, (values ('ios', 'app'), ('ios', 'web'), ('android', 'app'), ('android', 'web')) as m(os, client) where not (c_custkey % 10 = 6 and os = 'ios' and client = 'web')"""),
    "assignment": ((), """select o_orderkey as assignment_id, concat('p:', cast(o_custkey as {string})) as pair_id, concat('in:', cast(o_custkey % 50 as {string})) as entry, concat('out:', cast(o_custkey % 40 as {string})) as exit,
        case when o_orderkey % 4 = 0 then 'unpriced' else 'priced' end as status, cast(100 * (35 + o_orderkey % 200) as bigint) as billed, case when o_orderkey % 3 = 0 then '2022-04' else '2026-10' end as rule_id from orders"""),
    "turn": (("edge",), "select a.source as from_node, a.edge_id as in_edge, b.edge_id as out_edge, a.target as via, a.route, a.secs as in_secs, b.secs as out_secs from edge a join edge b on a.target = b.source and a.route = b.route"),
    "trial": ((), """select event_id, concat(event_type, '') as pattern, case when event_id % 2 = 0 then 'cold' else 'warm' end as cache, cast(round(value * 100) as bigint) as ms,
        case when event_id % 40 = 0 then 1 else 0 end as timeout, cast((event_id * 37) % 5000 as bigint) as transfer, cast((event_id * 53) % 7000 as bigint) as encoded from events"""),
    # Networks for search: a ring a route, with chords over three edges, a pair at its first node, and sequences that may not be driven.
    "net": (("edge",), """select r.route as net, r.id, r.pos, r.secs, r.meters, r.n, r.anchor, r.anchor % 4 <> 0 as closed, r.next_id, r.far_id,
        case when r.id % 31 = 0 and r.far_id is not null then 2 * r.secs + 1 end as chord_secs, r.id % 97 = 0 and r.next_id is not null as barred from (
        select route, source as id, pos, secs, meters, count(*) over (partition by route) as n, min(source) over (partition by route) as anchor,
            lead(source) over (partition by route order by pos) as next_id, lead(source, 3) over (partition by route order by pos) as far_id from edge) r"""),
    "question": (("request", "net"), """select r.request_id, r.lat, r.lon, r.min_minutes, r.max_minutes, k.net, k.anchor, r.request_id % 2 = 0 as by_node,
        case when r.request_id % 3 = 0 then '2026-10-01T00:00:00Z' else '2026-09-30T23:59:59Z' end as priced_at from request r
        join (select net, anchor, row_number() over (order by net) - 1 as k, count(*) over () as nets from (select distinct net, anchor from net)) k on r.request_id % k.nets = k.k"""),
    "access": (("request", "entry"), f"""select * from (select r.*, e.id as entry_id, e.route, e.pos, {geo.equirectangular('r.lat', 'r.lon', 'e.lat', 'e.lon')} as meters,
        row_number() over (partition by r.request_id order by round({geo.equirectangular('r.lat', 'r.lon', 'e.lat', 'e.lon')}, 3), e.id) as rank from request r cross join entry e) where rank <= 3"""),
    # One large network of links and mainline: chains of a customer's orders, with branches to another customer's first order. Ends have evidence of streets and tags.
    "segment": ((), """select concat('l:', cast(o_orderkey as {string})) as edge_id, o_orderkey as source, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as target, case when o_orderkey % 4 = 0 then 'mainline' else 'link' end as kind from orders
        union all select concat('b:', cast(o.o_orderkey as {string})), o.o_orderkey, f.first, 'link' from orders o join (select o_custkey, min(o_orderkey) as first from orders group by o_custkey) f on f.o_custkey = o.o_custkey + 3 where o.o_orderkey % 7 = 0"""),
    "endpoint": ((), """select o_orderkey as node, case o_orderkey % 5 when 0 then 'shared_node' when 1 then 'no_shared_node' when 2 then 'shared_node' else 'unavailable' end as evidence, case o_orderkey % 4 when 0 then 'traffic_signals' when 1 then 'motorway_junction' when 2 then 'crossing' end as tag from orders"""),
    # Ways of three edges, some of them with two lanes, and restrictions over one or two ways.
    "wayedge": (("net",), """select net, concat('e:', cast(id as {string})) as edge_id, pos {div} 3 as way, id as source, coalesce(next_id, anchor) as target, meters from net where next_id is not null or closed
        union all select net, concat('p:', cast(id as {string})), pos {div} 3, id, coalesce(next_id, anchor), meters + 7 from net where id % 5 = 0 and (next_id is not null or closed)
        union all select net, concat('c:', cast(id as {string})), 1000 + pos, id, far_id, meters from net where chord_secs is not null"""),
    "wayturn": (("net",), """select net, id as relation, case when id % 7 = 0 then 'only_straight_on' else 'no_left_turn' end as value, pos {div} 3 as from_way, case when id % 17 = 0 then 500 else pos {div} 3 + 1 end as via_first, case when id % 3 = 0 then pos {div} 3 + 2 else pos {div} 3 + 1 end as via_last,
        pos {div} 3 + case when id % 3 = 0 then 3 else 2 end + case when id % 11 = 0 then 2 else 0 end as to_way from net where pos % 3 = 0"""),
    # Short connections along one way, as somebody wrote them down.
    "connector": (("net",), """select net, id as connector, case when id % 23 = 0 then 0 else pos {div} 3 end as way, case when id % 11 = 0 then last_id else id end as from_node, case when id % 11 = 0 then id else last_id end as to_node, case when id % 11 = 0 then last_id else id end as expected_from,
        case when id % 13 = 0 then next_id when id % 11 = 0 then id else last_id end as expected_to, case when id % 19 = 0 then 0 else 3 end as edge_count, length + case when id % 6 = 0 then 1 else 0 end as meters from (
        select net, id, pos, next_id, lead(id, 3) over (partition by net order by pos) as last_id, sum(meters) over (partition by net order by pos rows between current row and 2 following) as length from net) x where pos % 3 = 0 and pos > 0 and last_id is not null"""),
    # Ramps in several ways, and where their bindings begin and should end.
    "rampedge": (("net",), """select net, concat('e:', cast(id as {string})) as edge_id, id as source, coalesce(next_id, anchor) as target, case when pos % 7 < 3 then 'entry' when pos % 7 < 6 then 'exit' else 'shutoko' end as kind from net where next_id is not null or closed"""),
    "rampbinding": (("net",), """select net, id as ramp, case when id % 2 = 0 then 'entry' else 'exit' end as kind, id as start, case id % 4 when 0 then next_id when 1 then lead(id, 2) over (partition by net order by pos) when 2 then lead(id, 3) over (partition by net order by pos) else id end as goal from net"""),
    # Entries and exits in two pieces, whose first piece (ground first, or mainline first) shows the carriageway; some lie too far away.
    "rampway": (("net",), """select net, concat('e:', cast(id as {string})) as edge_id, id as source, coalesce(next_id, anchor) as target, meters, true as mainline from net where next_id is not null or closed
        union all select net, concat('c:', cast(id as {string})), id, far_id, 3 * meters, true from net where chord_secs is not null
        union all select net, concat('in:', cast(id as {string})), -2 * id - 1, id, case when id % 49 = 0 then 3001 else 100 + id % 50 end, false from net where id % 7 = 0
        union all select net, concat('out:', cast(id as {string})), id, -2 * id - 1, 100 + id % 50, false from net where id % 7 = 3"""),
    "seedramp": (("net",), """select net, id as ramp, id % 7 = 3 as leaves, case when id % 3 = 0 then 'outer' else 'inner' end as direction, -2 * id - 1 as start from net where id % 7 = 0 or id % 7 = 3"""),
    # Two carriageways of a ring, which share a node here and there, with some labels, not all of them right.
    "carriage": (("net",), """select net, concat('f:', cast(id as {string})) as edge_id, id as source, coalesce(next_id, anchor) as target, meters, concat('f', cast(pos {div} 16 as {string})) as segment, pos as turn, case when id % 29 = 0 then 'outer' when id % 4 = 0 then 'inner' end as label from net where next_id is not null or closed
        union all select net, concat('b:', cast(id as {string})), case when ahead % 10 = 0 then ahead else -ahead end, case when id % 10 = 0 then id else -id end, meters + 3, concat('b', cast(pos {div} 16 as {string})), -pos, case when id % 31 = 0 then 'inner' when id % 4 = 1 then 'outer' end
        from (select *, coalesce(next_id, anchor) as ahead from net where next_id is not null or closed) b where id % 63 <> 0
        union all select net, concat('s:', cast(id as {string})), id, coalesce(next_id, anchor), meters + 50, 's', pos, cast(null as {string}) from net where id % 33 = 0 and (next_id is not null or closed)"""),
    # Middles and headings of their edges in metres; nodes of the second one lie 15 metres away from the first one's.
    "lanegeo": (("carriage", "node"), """select net, edge_id, source, target, (y1 + y2) / 2 as y, (x1 + x2) / 2 as x, (y2 - y1) / l as dy, (x2 - x1) / l as dx from (select *, sqrt((y2 - y1) * (y2 - y1) + (x2 - x1) * (x2 - x1)) as l from (
        select c.net, c.edge_id, c.source, c.target, a.lat * 111320 + case when c.source < 0 then 15 else 0 end as y1, a.lon * 111320 * cos(radians(a.lat)) as x1, b.lat * 111320 + case when c.target < 0 then 15 else 0 end as y2, b.lon * 111320 * cos(radians(b.lat)) as x2
        from carriage c join node a on a.id = abs(c.source) join node b on b.id = abs(c.target)) p) q where l > 0"""),
    # Ramps at the first carriageway, and where exits leave each one.
    "exitnode": (("carriage",), "select net, target as node, case when target < 0 then 'outer' else 'inner' end as direction from carriage where abs(target) % 13 = 0"),
    "lane": (("net",), """select net, pos, concat('e:', cast(id as {string})) as edge_id, case when id % 23 = 0 then null when pos < anchor % 5 then 'radial' when pos < 2 + anchor % 7 then 'outer' when pos >= n - anchor % 4 then 'outer' when pos >= n - 2 - anchor % 6 then 'radial' when id % 37 = 0 then 'outer' else 'inner' end as label from net"""),
    # Members of route relations with the ends of their ways, in an order of their own.
    "memberedge": (("net",), """select net as relation, row_number() over (partition by net order by id % 3, pos) as member, id as way, source, target, kind, anchor % 3 as style from (
        select net, id, pos, id as source, coalesce(next_id, anchor) as target, 'main' as kind, anchor from net where (next_id is not null or closed) and id % 41 <> 0
        union all select net, id + 1000000, pos, id, far_id, case when id % 2 = 0 then 'link' else 'main' end, anchor from net where chord_secs is not null) m"""),
    "outside": (("net",), "select net as relation, concat('e:', cast(id as {string})) as edge_id, id as source, coalesce(next_id, anchor) as target from net where next_id is not null or closed"),
    # Exits of a ring, and sequences of two or three edges that may not be driven.
    "exitedge": (("net",), """select net, concat('e:', cast(id as {string})) as edge_id, id as source, coalesce(next_id, anchor) as target, meters, 'shutoko' as kind, anchor from net where next_id is not null or closed
        union all select net, concat('c:', cast(id as {string})), id, far_id, 3 * meters - 40, 'shutoko', anchor from net where chord_secs is not null
        union all select net, concat('x:', cast(id as {string})), id, -id, 100 + 10 * (id % 9), 'exit', anchor from net where id % 7 = 3"""),
    "barred": (("net",), """select net, concat('e:', cast(id as {string})) as first, concat('e:', cast(next_id as {string})) as second, cast(null as {string}) as third from net where next_id is not null and id % 19 = 0
        union all select net, concat('e:', cast(id as {string})), concat('e:', cast(next_id as {string})), concat('x:', cast(after as {string})) from (select net, id, next_id, lead(id, 2) over (partition by net order by pos) as after from net) x where after % 7 = 3 and id % 2 = 0"""),
    # Chains of ramp nodes, with the ways that touch them: ramp ways 0 to 2 and 7, streets 5 and 6 (by the last digit); nodes likewise.
    "groundway": ((), """select 10 * p_partkey + v as way, case when v in (5, 6) then case when v = 6 then 'tertiary' when p_partkey % 4 = 0 then 'residential' when p_partkey % 4 = 1 then ' Primary ' when p_partkey % 4 = 2 then 'service' else 'unclassified' end else 'motorway_link' end as highway,
        case when v = 5 and p_partkey % 12 = 2 then 'alley' when v = 5 and p_partkey % 12 = 6 then 'driveway' when v = 5 and p_partkey % 36 = 10 then 'strange' when v = 5 then 'Alley ' end as service,
        case when v in (5, 6) then case p_partkey % 6 when 0 then 'yes' when 1 then 'no' when 2 then '-1' when 3 then case when p_partkey % 21 = 0 then 'reversible' end end when p_partkey % 11 = 5 and v = 1 then 'sideways' when p_partkey % 13 = 0 then ' Reverse' else 'yes' end as oneway,
        cast(null as {string}) as motorcar, case when p_partkey % 11 = 10 and v = 5 then 'odd' end as motor_vehicle, cast(null as {string}) as vehicle, case when p_partkey % 11 = 8 and v = 5 then 'private' when v = 6 then 'yes' end as access,
        case when p_partkey % 19 = 0 and v = 5 then 'no' when p_partkey % 23 = 0 and v = 5 then 'maybe' end as area, case when p_partkey % 17 = 0 and v = 5 then 'unsure' end as reversible,
        case when p_partkey % 11 = 1 and v = 1 or p_partkey % 11 = 9 and v = 5 then 'access:conditional' when p_partkey % 11 = 2 then 'hgv:conditional' end as conditional
        from part, (values (0), (1), (2), (5), (6), (7)) as k(v) where not (p_partkey % 11 = 2 and v = 1 or p_partkey % 11 = 7 and v = 5 or p_partkey % 11 <> 6 and v = 6 or p_partkey % 11 <> 3 and v = 7)"""),
    "groundplace": (("groundway",), """select way, case when way % 10 < 3 and way {div} 10 % 13 = 0 then 1 - i else i end as pos, way - way % 10 + case when i = 0 then case when way % 10 = 5 then 3 when way % 10 in (6, 7) then 1 else way % 10 end
        when way % 10 = 5 then 8 when way % 10 = 6 then 6 when way % 10 = 7 or way % 10 = 1 and way {div} 10 % 11 = 4 then 9 else way % 10 + 1 end as node from groundway, (values (0), (1)) as k(i)"""),
    "groundchain": ((), """select p_partkey as chain, i as pos, 10 * p_partkey + i as node, case when p_partkey % 3 = 0 then 'entry' else 'exit' end as flow, case p_partkey % 5 when 0 then 10 * p_partkey + 5 when 1 then 10 * p_partkey + 4 end as expected_way,
        10 * p_partkey + case when p_partkey % 9 = 0 then 2 else 3 end as declared_node from part, (values (0), (1), (2), (3)) as k(i)"""),
    # Large networks: chains of thousands of orders in which every 64 are a block with loops, an entry, an exit or two, and verified pairs in every other one.
    "slab": ((), """select slab, concat('slab:', cast(slab as {string})) as net, pos, n, pos {div} 64 as block, pos % 64 as place, id, secs, meters, lat, lon, lead(id) over (partition by slab order by pos) as next_id, lag(id, 60) over (partition by slab order by pos) as back_id, lead(id, 10) over (partition by slab order by pos) as skip_id,
        n - n % 64 > pos as whole from (select slab, row_number() over (partition by slab order by id) - 1 as pos, count(*) over (partition by slab) as n, id, secs, meters, lat, lon from (
        select o_orderkey {div} 5600 as slab, o_orderkey as id, cast(1 + o_custkey % 50 as bigint) as secs, cast(900 + o_orderkey % 100 as bigint) as meters, cast(35.5 as double) + cast((o_orderkey * 6151) % 10000 as double) / cast(25000 as double) as lat,
        cast(139.5 as double) + cast((o_orderkey * 7919) % 10000 as double) / cast(20000 as double) as lon from orders) a) b"""),
    # Edges of rings by the ids of their ways, with entries and exits, and seeds of pairs: an entry, an anchor two nodes on, the next exit after it; some of them wrong.
    "pairedge": (("net",), """select net, concat('e:w', cast(id as {string}), ':0') as edge_id, id as source, coalesce(next_id, anchor) as target, 'shutoko' as kind, secs, meters from net where next_id is not null or closed
        union all select net, concat('e:w', cast(id + 1000000 as {string}), ':0'), id, far_id, 'shutoko', chord_secs, 3 * meters from net where chord_secs is not null
        union all select net, concat('e:w', cast(id + 2000000 as {string}), ':0'), -id, id, 'entry', 30, 200 from net where id % 7 = 0
        union all select net, concat('e:w', cast(id + 3000000 as {string}), ':0'), id, -id - 5000000, 'exit', 30, 200 + id % 40 from net where id % 7 = 3"""),
    "pairseed": (("net",), """select s.net, s.id as seed, s.k, s.id + 2000000 + case when s.k % 13 = 5 then 1 else 0 end as entry_way, x.id + 3000000 + case when s.k % 13 = 6 then 1 else 0 end as exit_way, case when s.k % 13 = 7 then 0 else s.anchor_id end as anchor_node, case when s.k % 5 = 0 then 'unverified' else 'verified' end as status, s.k % 13 <> 8 as one_ahead,
        case when s.k % 13 = 9 then 'https://nodots' else 'https://a.example/x' end as address, case when s.k % 13 = 10 then '2026-02-30' else '2026-02-03' end as day, s.k % 13 = 11 as late_price from (
        select net, id, pos, id {div} 7 as k, case when id % 3 = 0 then next_id else id end as anchor_id, case when id % 2 = 0 then min(case when id % 7 = 3 then pos end) over (partition by net order by pos rows between 1 following and unbounded following)
            else max(case when id % 7 = 3 then pos end) over (partition by net order by pos rows between 1 following and unbounded following) end as exit_pos from net) s join net x on x.net = s.net and x.pos = s.exit_pos where s.id % 7 = 0 and s.anchor_id is not null"""),
    "pairbar": (("net",), "select net, concat('e:w', cast(id as {string}), ':0') as first, concat('e:w', cast(next_id as {string}), ':0') as second from net where next_id is not null and id % 97 = 0"),
    # Edges and ramps of the large networks; every seventh block's loop is too short to count.
    "slabedge": (("slab",), """select net, concat('e:', cast(id as {string})) as edge_id, id as source, next_id as target, case when block % 7 = 6 then 50 else meters end as meters from slab where next_id is not null
        union all select net, concat('k:', cast(id as {string})), id, back_id, 200 from slab where whole and place = 63 union all select net, concat('j:', cast(id as {string})), id, skip_id, case when block % 7 = 6 then 50 else meters end from slab where whole and place = 3"""),
    "slabramp": (("slab",), "select net, id as ramp, id as node, block, place, whole, case when place in (3, 50) then 'entry' else 'exit' end as kind, case when id % 37 = 0 then null when id % 29 = 0 then 'structural_no_loop' else 'routable' end as declared from slab where place in (1, 3, 20, 50)"),
    # Distances that requests accept, 0 for any; split routes: a request, the lap of a ring from its anchor, and places that may be missing or odd.
    "reachcap": (("request",), "select request_id, cast(case request_id % 4 when 0 then 0 when 1 then 2000 when 2 then 10000 else 30000 end as bigint) as cap from request"),
    "split": (("question", "node"), """select q.request_id, q.net, q.anchor, q.lat + case when q.request_id % 41 = 0 then 60 else 0 end as lat, q.lon, a.lat as entry_lat, a.lon as entry_lon, case when q.request_id % 31 = 0 then null else a.lat end as merge_lat, a.lon as merge_lon,
        a.lat + 0.01 as branch_lat, a.lon + 0.01 as branch_lon, a.lat + 0.02 as exit_lat, a.lon + 0.02 as exit_lon from question q join node a on a.id = q.anchor"""),
    # Ways of a ring as nodes and as edges, some of which go both ways, in part or twice; and relations whose members are those ways.
    "routeedge": (("wayedge",), """select net, edge_id, way, source, target from wayedge where edge_id not like 'p:%' or source % 140 = 0
        union all select net, concat('r', edge_id), way, target, source from wayedge where edge_id like 'e:%' and (way % 4 = 0 or way % 4 = 1 and source % 2 = 0)"""),
    "routeplace": (("net",), """select net, pos {div} 3 as way, pos % 3 as place, id as node from net union all select net, pos {div} 3 - 1, 3, id from net where pos % 3 = 0 and pos > 0
        union all select net, (n - 1) {div} 3, (n - 1) % 3 + 1, anchor from net where pos = n - 1 and closed union all select net, 1000 + pos, 0, id from net where chord_secs is not null union all select net, 1000 + pos, 1, far_id from net where chord_secs is not null"""),
    "routemember": (("net",), """select net as relation, row_number() over (partition by net order by case when anchor % 2 = 0 then 0 else w % 2 end, w) - 1 as member, w as way, link, case anchor % 5 when 0 then 'inner' when 1 then 'backward' else 'forward' end as direction from (
        select net, anchor, pos {div} 3 as w, false as link from net where pos % 3 = 0 and (id % 43 <> 0) union all select net, anchor, 1000 + pos, id % 2 = 0 from net where chord_secs is not null) m"""),
    # Pairs whose ramps may be unknown, ramps on edges that several may share, and assignments of tariffs to pairs, not all of them right.
    "paidpair": ((), """select o_orderkey as pair, o_custkey as entry_edge, o_custkey + 1000000 as exit_edge, case when o_orderkey % 5 = 0 then concat('i:', cast(o_custkey as {string})) end as entry_ramp, case when o_orderkey % 25 = 0 then 'elsewhere' end as exit_ramp,
        case when o_orderkey % 9 = 0 then o_orderkey + 1 when o_orderkey % 3 = 0 then o_orderkey when o_orderkey % 19 = 0 then -1 end as assignment from orders"""),
    "paidramp": ((), """select concat('i:', cast(c_custkey as {string})) as ramp, c_custkey as edge, case when c_custkey % 3 = 0 then 'outer' else 'inner' end as direction from customer union all select concat('i2:', cast(c_custkey as {string})), c_custkey, 'inner' from customer where c_custkey % 7 = 0
        union all select concat('o:', cast(c_custkey as {string})), c_custkey + 1000000, 'inner' from customer where c_custkey % 23 <> 0 union all select concat('o2:', cast(c_custkey as {string})), c_custkey + 1000000, case when c_custkey % 11 = 0 then 'inner' else 'outer' end from customer where c_custkey % 2 = 0"""),
    "paidassign": ((), """select o_orderkey as assignment, o_orderkey as pair, concat('i:', cast(o_custkey as {string})) as entry_ramp, case when o_custkey % 2 = 0 and o_custkey % 3 = 0 and o_custkey % 11 <> 0 then concat('o2:', cast(o_custkey as {string})) when o_orderkey % 17 = 0 then 'none' else concat('o:', cast(o_custkey as {string})) end as exit_ramp,
        cast(100 * (35 + o_orderkey % 200) as bigint) as meters from orders where o_orderkey % 13 <> 0"""),
    # Sites of a network as map elements: a mainline to the next site, a ramp on and one off, streets that touch them, run by or aren't mapped, links on their own, and restrictions.
    "sitenode": ((), """select 100 * p_partkey + j as node, cast(35.5 as double) + cast((p_partkey * 6151) % 10000 as double) / cast(25000 as double) + cast(dy as double) / cast(10000 as double) as lat,
        cast(139.5 as double) + cast((p_partkey * 7919) % 10000 as double) / cast(20000 as double) as lon, case when j = 2 and p_partkey % 5 = 0 or j = 4 and p_partkey % 3 = 0 then 'traffic_signals' when j = 2 and p_partkey % 5 = 1 or j = 4 and p_partkey % 4 = 1 then 'motorway_junction' when j = 2 and p_partkey % 5 = 2 then 'crossing' end as tag
        from part, (values (0, 0), (1, 10), (2, 20), (3, -10), (4, -20), (6, 100), (7, 110), (8, 24), (9, 26), (10, -24), (11, -300)) as k(j, dy) where not (p_partkey % 37 = 5 and j = 1)"""),
    "siteway": ((), """select 10 * p_partkey + v as way, case v when 0 then 'motorway' when 4 then case p_partkey % 4 when 0 then 'residential' when 1 then 'primary' when 2 then 'service' else 'footway' end when 5 then case p_partkey % 5 when 0 then 'road' else 'tertiary' end when 7 then null else 'motorway_link' end as highway,
        case when v = 4 and p_partkey % 8 = 2 then 'alley' when v = 4 and p_partkey % 16 = 6 then 'driveway' end as service, case when v = 0 then case p_partkey % 6 when 0 then null when 1 then '-1' else 'yes' end when v = 1 and p_partkey % 8 = 0 then 'no' when v = 2 and p_partkey % 13 = 0 then 'reverse' when v in (1, 2) then 'yes' end as oneway,
        case when v = 0 then case p_partkey % 11 when 0 then 'Other' when 1 then '首都高速道路' when 2 then 'Metropolitan Expressway Co.' end end as operator, case when v = 0 and p_partkey % 11 = 3 then 'SHUTO Metropolitan Expressway' when v = 0 and p_partkey % 11 = 0 then 'JP:E' end as network,
        case when v = 0 and p_partkey % 11 = 0 then 'E20; 12' when v = 0 and p_partkey % 11 > 3 then 'E1; c2' end as ref, case when p_partkey % 3 = 0 then concat('Line ', cast(p_partkey % 7 as {string})) end as name, case when p_partkey % 2 = 0 then concat('線', cast(p_partkey % 7 as {string})) end as name_ja
        from part, (values (0), (1), (2), (3), (4), (5), (6), (7)) as k(v) where not (v = 3 and p_partkey % 5 <> 0 or v = 4 and p_partkey % 3 = 2 or v = 5 and p_partkey % 7 > 3 or v = 6 and p_partkey % 10 <> 0 or v = 7 and p_partkey % 12 <> 0)"""),
    "siteplace": (("siteway",), """select way, pos, (way - v) * 10 + case when v = 4 and pos = 1 and way {div} 10 % 3 = 0 then 2 when v = 5 and pos = 1 and way {div} 10 % 7 < 2 then 4 else j end as node from siteway join (values (0, 0, 0), (0, 1, 100), (1, 0, 2), (1, 1, 1), (1, 2, 0), (2, 0, 0), (2, 1, 3), (2, 2, 4),
        (3, 0, 6), (3, 1, 7), (4, 0, 8), (4, 1, 9), (5, 0, 10), (5, 1, 11), (6, 0, 0), (7, 0, 8), (7, 1, 9)) as k(v, pos, j) on way % 10 = v"""),
    "siteturn": ((), """select p_partkey as relation, case p_partkey % 10 when 0 then 'no_left_turn' when 1 then 'only_left_turn' when 2 then null when 3 then 'no_entry' when 4 then 'only_right_turn' when 8 then 'only_straight_on' else 'no_u_turn' end as value, p_partkey % 20 = 2 as conditional,
        case when p_partkey % 17 <> 3 then 10 * (p_partkey - 1) end as from_way, case when p_partkey % 2 = 0 and p_partkey % 19 <> 4 then 100 * p_partkey end as via_node, case when p_partkey % 2 = 1 and p_partkey % 23 <> 7 then 10 * p_partkey end as via_first,
        case when p_partkey % 2 = 1 and p_partkey % 23 <> 7 then 10 * (p_partkey + case when p_partkey % 3 = 0 then 1 else 0 end) end as via_last, case when p_partkey % 29 = 0 then 10 * p_partkey + 3 when p_partkey % 2 = 0 then 10 * p_partkey + case when p_partkey % 5 = 0 then 2 else 0 end
            else 10 * (p_partkey + case when p_partkey % 3 = 0 then 2 else 1 end) + 2 end as to_way from part
        union all select 10000000 + p_partkey, 'only_straight_on', false, 10 * (p_partkey - 1), 100 * p_partkey, null, null, 10 * p_partkey + 2 from part where p_partkey % 8 = 0"""),
    # Relations of the map, their ways, the edges of these, ids that somebody asks for.
    "maprelation": ((), """select o_orderkey as relation, case when o_orderkey % 19 = 4 then 'way' when o_orderkey % 23 = 5 then 'node' else 'relation' end as element, case o_orderkey % 7 when 0 then 'multipolygon' when 1 then null else 'route' end as type,
        case o_orderkey % 6 when 0 then 'C1' when 1 then '2' when 2 then 'B' when 3 then '' end as ref, case o_orderkey % 5 when 0 then 'road' when 1 then '2' when 2 then '' when 3 then 'C1' end as route from orders"""),
    "mapway": ((), """select p_partkey as way, case p_partkey % 5 when 0 then 'motorway' when 4 then case when p_partkey % 2 = 0 then 'primary' end else 'motorway_link' end as highway, case p_partkey % 7 when 0 then 'C1' when 1 then ' c1; b' when 2 then '2,B' when 3 then ' ' when 4 then 'E1' end as ref,
        case p_partkey % 11 when 0 then 'B' when 1 then ';, ' when 2 then 'C1' end as nat_ref, case p_partkey % 6 when 0 then concat('Loop ', cast(p_partkey % 3 as {string})) when 1 then '芝公園入口' when 2 then 'EXIT_ramp' end as name, case when p_partkey % 8 = 0 then 'Entry A' end as name_en, case when p_partkey % 13 = 0 then '霞が関出口' end as destination from part"""),
    "mapwayedge": ((), """select p_partkey as way, case when p_partkey % 4 = 1 then 'entry' else 'shutoko' end as kind from part union all select p_partkey, 'exit' from part where p_partkey % 3 = 0"""),
    "mapmember": ((), "select distinct l_orderkey as relation, l_partkey as way from lineitem"),
    "mapasked": ((), "select c_custkey as request, cast(3 * c_custkey - 5 as bigint) as asked from customer"),
    # Memberships of routes, and the pairs whose plans use them.
    "planmember": ((), """select concat('route:', cast(s_suppkey as {string}), ':inner') as membership, cast(s_suppkey as {string}) as route_id, 'inner' as direction from supplier where s_suppkey % 17 <> 3"""),
    "planrelation": ((), """select concat('route:', cast(s_suppkey as {string}), ':inner') as membership, case when i = 0 then cast(3 * s_suppkey as {string}) when i = 1 then cast(3 * s_suppkey + 1 as {string}) when i = 2 then concat('x', cast(s_suppkey as {string})) when i = 3 and s_suppkey % 2 = 0 then cast(3 * s_suppkey as {string}) end as relation
        from supplier, (values (0), (1), (2), (3)) as k(i)"""),
    "plancandidate": ((), "select concat('route:', cast(l_suppkey as {string}), ':inner') as membership, l_orderkey {div} 2 as pair, l_suppkey % 3 = 0 or l_linenumber % 4 <> 0 as resolved from lineitem where l_suppkey % 11 <> 5"),
    # Files of memberships: a ring is a membership, 16 of its edges a segment; most are sound, the others have a fault each.
    "filering": (("net",), """select split_part(net, ':', 1) as file, cast(row_number() over (partition by split_part(net, ':', 1) order by anchor) as bigint) as turn, net, anchor % 23 as fault, lag(net) over (partition by split_part(net, ':', 1) order by anchor) as before from net where pos = 0"""),
    "filemember": (("filering",), """select file, turn, case fault when 3 then concat('route:', net, ':outer') when 6 then concat('route:', coalesce(before, net), ':inner') else concat('route:', case when fault = 1 then '' else net end, ':', case when fault = 2 then '' else 'inner' end) end as membership,
        case fault when 1 then '' when 6 then coalesce(before, net) else net end as route_id, case when fault = 2 then '' else 'inner' end as direction, case when fault = 4 then 'osm-relation-role/v0' else 'osm-relation-role/v1' end as version from filering"""),
    "filesegment": (("filering", "net"), """select file, turn, seg, case when fault = 7 and seg = 1 then '' when fault = 8 and seg = 1 then concat(net, '/0') else concat(net, '/', cast(seg as {string})) end as segment, case when seg % 3 = 2 then 'boundRamp' else 'relationMainline' end as kind,
        case when seg % 3 = 2 and fault <> 21 or fault = 12 then null else net end as relation, case when fault = 9 then 'ABC' when fault = 11 and turn > 1 then repeat('e', 64) else repeat('d', 64) end as snapshot, case when seg % 3 = 2 or fault = 15 then concat('b:', net) end as evidence, fault = 16 as odd_hash,
        case when seg % 3 = 2 and fault <> 22 then null when fault = 13 then '4,4' else concat(cast(4 * seg as {string}), ',', cast(4 * seg + case when seg % 2 = 0 then 1 else 3 end as {string})) end as indexes, case when seg % 3 = 2 and fault <> 22 then null when fault = 14 then seg % 2 <> 0 else seg % 2 = 0 end as in_order
        from (select distinct f.*, n.pos {div} 16 as seg from filering f join net n on n.net = f.net) s where fault <> 5"""),
    "fileedge": (("filering", "net"), """select file, turn, pos {div} 16 as seg, pos % 16 as place, case when fault = 17 and pos = 3 then concat('m:', cast(anchor as {string})) when fault = 18 and pos = 2 then 'm:none' else concat('m:', cast(id as {string})) end as edge_id,
        case when fault = 18 and pos = 2 then 'm:none' else concat('m:', cast(case when fault = 17 and pos = 3 then anchor when fault = 10 and pos = 1 then 0 - id else id end as {string})) end as hashed_id from (select f.file, f.turn, f.fault, n.* from filering f join net n on n.net = f.net) m where not (fault = 19 and pos = 4)"""),
    "filenetedge": (("filering", "net"), """select concat('m:', cast(id as {string})) as edge_id, id as source, coalesce(next_id, n.anchor) as target, case when fault = 20 and pos = 1 then case when pos {div} 16 % 3 = 2 then 'shutoko' else 'exit' end when pos {div} 16 % 3 = 2 then case when id % 2 = 0 then 'entry' else 'exit' end else 'shutoko' end as kind from filering f join net n on n.net = f.net"""),
}

#: Spark's text of a table that has the same rows. That of question above joins requests to networks by a remainder
#: of both sides, which goes over all pairs of them; here the count comes first, so that they meet by number, and
#: networks are numbered within a beginning of their names.
SPARK_TABLES: dict[str, str] = {
    "question": """select r.request_id, r.lat, r.lon, r.min_minutes, r.max_minutes, k.net, k.anchor, r.request_id % 2 = 0 as by_node,
        case when r.request_id % 3 = 0 then '2026-10-01T00:00:00Z' else '2026-09-30T23:59:59Z' end as priced_at
        from (select q.*, q.request_id % nullif((select count(*) from net where pos = 0), 0) as k from request q) r
        join (select n.net, n.anchor, b.before + row_number() over (partition by n.head order by n.net) - 1 as k from (select substring(net, 1, 10) as head, net, anchor from net where pos = 0) n
        join (select head, sum(size) over (order by head) - size as before from (select substring(net, 1, 10) as head, count(*) as size from net where pos = 0 group by substring(net, 1, 10)) s) b on b.head = n.head) k on k.k = r.k""",
}


def with_tables(names: tuple[str, ...], sql: str, dialect: dict, given: tuple[str, ...] = ()) -> str:
    """sql after the common table expressions that it needs, in order; tables in `given` exist already."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in given or name in order:
            return
        for other in TABLES[name][0]:
            need(other)
        order.append(name)

    for name in names:
        need(name)
    spell = lambda text: text.replace("{div}", dialect["div"]).replace("{string}", "string" if dialect["div"] == "div" else "varchar")
    own = SPARK_TABLES if dialect["div"] == "div" else {}
    head = ", ".join(f"{n} as ({spell(own.get(n, TABLES[n][1]))})" for n in order)
    return (f"with {head} " if head else "") + spell(sql)
