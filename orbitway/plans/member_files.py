"""Route relations of the map and their members, files of route memberships with their hash and faults, and what pairs make of memberships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitway.functions.checkpoints import cut
from orbitway.plans.build_queries import registering

QUERIES, ORACLE = {}, {}
rule = registering(QUERIES, ORACLE)
# The routes that count where none is asked for, words of ramps' names, the version of directions, and the most edges of a segment and bytes of an id.
DEFAULT_ROUTES, RAMP_WORDS, VERSION, MOST_EDGES, MOST_ID = ("C1", "2"), ("入口", "出口", "entry", "exit"), "osm-relation-role/v1", 2000, 256
MAINLINE, BOUND = "relationMainline", "boundRamp"


def _plain(c: Column | str) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-"))


# --- relations ------------------------------------------------------------------------------------


def route_relation() -> Column:
    return F.coalesce((F.col("element") == "relation") & (F.col("type") == "route") & (F.col("route").isNotNull() | F.col("ref").isNotNull()), F.lit(False))


@rule("maprelation", sql="select relation, coalesce(ref, route) in ('C1', '2') as by_default from maprelation where element = 'relation' and type = 'route' and (ref is not null or route is not null)")
def p15_route_relations(maprelation):
    """The map's route relations, and which of them count where none is asked for."""
    return maprelation.where(route_relation()).select("relation", F.coalesce("ref", "route").isin(*DEFAULT_ROUTES).alias("by_default"))


@rule("maprelation", "mapasked", sql="""select a.request, case when asked <= 0 then 'not_positive' when relation is null then 'absent' when element <> 'relation' then 'not_a_relation' when coalesce(type, '') <> 'route' then 'not_a_route' when coalesce(ref, route, '') = '' then 'no_identity' else 'ok' end as outcome
from mapasked a left join maprelation r on r.relation = a.asked""")
def p15_requested_relations(maprelation, mapasked):
    """What keeps a relation that is asked for by its id from being taken."""
    identity = F.coalesce("ref", "route", F.lit(""))
    outcome = (
        F.when(F.col("asked") <= 0, "not_positive").when(F.col("relation").isNull(), "absent").when(F.col("element") != "relation", "not_a_relation")
        .when(~F.col("type").eqNullSafe(F.lit("route")), "not_a_route").when(identity == "", "no_identity").otherwise("ok")
    )
    return mapasked.join(maprelation, mapasked["asked"] == maprelation["relation"], "left").select("request", outcome.alias("outcome"))


_TOKENS = "list_filter(list_transform(string_split(replace(coalesce({c}, ''), ',', ';'), ';'), lambda x: replace(lower(trim(x)), '_', '-')), lambda x: x <> '')"
_CONFLICT = " or ".join(f"(len({_TOKENS.format(c=c)}) > 0 and not list_contains({_TOKENS.format(c=c)}, replace(lower(trim(route_id)), '_', '-')))" for c in ("w.ref", "w.nat_ref"))


@rule("maprelation", "mapmember", "mapway", "mapwayedge", sql=f"""known as (select relation, coalesce(ref, route, '') as route_id from maprelation where element = 'relation' and type = 'route' and (ref is not null or route is not null))
select m.relation, m.way, case when route_id = '' then 'no_route_id' when coalesce(w.highway, '') not in ('motorway', 'motorway_link') then 'other' when {_CONFLICT} then 'other'
  when w.highway = 'motorway_link' and regexp_matches(lower(concat_ws('|', w.name, w.name_en, w.destination)), '入口|出口|entry|exit') then 'other' when w.highway = 'motorway_link' and not exists (select 1 from mapwayedge e where e.way = w.way and e.kind = 'shutoko') then 'no_edge' else 'mainline' end as outcome
from mapmember m join known k on k.relation = m.relation join mapway w on w.way = m.way""")
def p14_mainline_members(maprelation, mapmember, mapway, mapwayedge):
    """Which members of route relations are mainline: motorways, and links that are no ramp by name, whose codes don't name another route; a link needs an edge of the expressway, or it is an error."""
    relations = maprelation.where(route_relation()).select("relation", F.coalesce("ref", "route").alias("route_id"))
    through = mapwayedge.where("kind = 'shutoko'").select("way").distinct().withColumn("through", F.lit(True))
    tokens = lambda c: F.filter(F.transform(F.split(c, "[;,]"), _plain), lambda x: x != "")
    differs = lambda c: F.coalesce((F.size(tokens(c)) > 0) & ~F.array_contains(tokens(c), _plain("route_id")), F.lit(False))
    ramp = F.exists(F.array("name", "name_en", "destination"), lambda x: F.coalesce(_plain(x).rlike("|".join(RAMP_WORDS)), F.lit(False)))
    link = F.col("highway") == "motorway_link"
    outcome = (
        F.when(F.col("route_id") == "", "no_route_id").when(F.col("highway").isNull() | ~F.col("highway").isin("motorway", "motorway_link"), "other").when(differs("ref") | differs("nat_ref"), "other")
        .when(link & ramp, "other").when(link & F.col("through").isNull(), "no_edge").otherwise("mainline")
    )
    return mapmember.join(relations, "relation").join(mapway, "way").join(through, "way", "left").select("relation", "way", outcome.alias("outcome"))


# --- what pairs make of memberships ---------------------------------------------------------------


@rule("planmember", "planrelation", "plancandidate", sql="""pairs as (select membership, pair, resolved from plancandidate group by all)
select membership, m.route_id, direction, (select string_agg(distinct try_cast(relation as bigint)::varchar, ',' order by try_cast(relation as bigint)::varchar) from planrelation r where r.membership = m.membership and try_cast(relation as bigint) is not null) as relations,
  (select count(*) from pairs p where p.membership = m.membership) as candidates, (select count(*) from pairs p where p.membership = m.membership and not resolved) as unresolved, (select min(pair) from pairs p where p.membership = m.membership) as first_pair,
  case when exists (select 1 from pairs p where p.membership = m.membership and not resolved) then 'fail' else 'pass' end as status from planmember m
union all select membership, null, null, null, count(*), count(*) filter (where not resolved), min(pair), 'unknown' from pairs where membership not in (select membership from planmember) group by membership""")
def a08_relation_manifest(planmember, planrelation, plancandidate):
    """For each membership its relations and how many pairs use it, with and without a plan; it passes if none lacks one, and if no pair uses it. Memberships that only pairs name are unknown.

    Pairs are counted and not listed: a membership may have any number of them.
    """
    ids = planrelation.withColumn("id", F.expr("try_cast(relation as bigint)")).where("id is not null").select("membership", "id").distinct()
    relations = ids.groupBy("membership").agg(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ",").alias("relations"))
    pairs = plancandidate.select("membership", "pair", "resolved").distinct()
    counts = pairs.groupBy("membership").agg(F.count("*").alias("candidates"), F.count(F.when(~F.col("resolved"), 1)).alias("unresolved"), F.min("pair").alias("first_pair"))
    status = F.when(F.col("route_id").isNull(), "unknown").when(F.coalesce("unresolved", F.lit(0)) > 0, "fail").otherwise("pass")
    both = planmember.join(counts, "membership", "full").join(relations, "membership", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("membership", "route_id", "direction", F.when(F.col("route_id").isNotNull(), F.col("relations")).alias("relations"), none("candidates"), none("unresolved"), "first_pair", status.alias("status"))


# --- files of memberships -------------------------------------------------------------------------


def _quoted(c: str) -> Column:
    """A text as JSON, null as null."""
    inside = F.to_json(F.array(c))
    return F.when(F.col(c).isNull(), "null").otherwise(inside.substr(F.lit(2), F.length(inside) - 2))


def whole_segments(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """segments with edges (ids in order; none: empty) and hash, that of the ids as they were written."""
    listed = edges.groupBy("file", "turn", "seg").agg(F.array_sort(F.collect_list(F.struct("place", "edge_id", "hashed_id"))).alias("line"))
    ids = lambda c: F.transform("line", lambda x: x[c])
    known = segments.join(listed, ["file", "turn", "seg"], "left")
    return known.select(*segments.columns, F.coalesce(ids("edge_id"), F.array().cast("array<string>")).alias("edges"), F.when(F.col("odd_hash"), F.lit("XYZ")).otherwise(F.sha2(F.to_json(ids("hashed_id")), 256)).alias("hash"))


_SEGMENTS = """line as (select file, turn, seg, '["' || string_agg(edge_id, '","' order by place) || '"]' as ids, sha256('["' || string_agg(hashed_id, '","' order by place) || '"]') as hashed, count(*) as n from fileedge group by file, turn, seg),
seg as (select s.*, coalesce(ids, '[]') as ids, case when odd_hash then 'XYZ' else hashed end as hash, coalesce(n, 0) as n from filesegment s left join line using (file, turn, seg))"""


@rule("filemember", "filesegment", "fileedge", sql=f"""{_SEGMENTS},
one as (select file, turn, seg, '{{"segmentId":"' || segment || '","sourceKind":"' || kind || '","sourceRelationId":' || coalesce('"' || relation || '"', 'null') || ',"sourceSnapshotSha256":"' || snapshot || '","bindingEvidenceId":' || coalesce('"' || evidence || '"', 'null') || ',"orderedEdgeIds":' || ids || ',"orderedEdgeIdsSha256":"' || hash || '"'
  || coalesce(',"memberIndexes":[' || indexes || ']', '') || coalesce(',"memberOrderMatchesRelation":' || in_order::varchar, '') || '}}' as text from seg),
all_ as (select file, turn, string_agg(text, ',' order by seg) as texts from one group by file, turn)
select m.file, sha256('[' || string_agg('{{"membershipId":"' || membership || '","routeId":"' || route_id || '","direction":"' || direction || '","directionMappingVersion":"' || version || '","segments":[' || coalesce(texts, '') || ']}}', ',' order by m.turn) || ']') as sha256 from filemember m left join all_ a on a.file = m.file and a.turn = m.turn group by m.file""")
def f10_membership_hash(filemember, filesegment, fileedge):
    """The hash of a file's memberships: of their canonical JSON, fields in order, parts that don't apply left out. A file is one text."""
    whole = whole_segments(filesegment, fileedge)
    parts = ['{"segmentId":', _quoted("segment"), ',"sourceKind":', _quoted("kind"), ',"sourceRelationId":', _quoted("relation"), ',"sourceSnapshotSha256":', _quoted("snapshot"), ',"bindingEvidenceId":', _quoted("evidence"), ',"orderedEdgeIds":', F.to_json("edges"), ',"orderedEdgeIdsSha256":', _quoted("hash")]
    optional = [F.coalesce(F.concat(F.lit(',"memberIndexes":['), "indexes", F.lit("]")), F.lit("")), F.coalesce(F.concat(F.lit(',"memberOrderMatchesRelation":'), F.col("in_order").cast("string")), F.lit("")), F.lit("}")]
    text = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), *optional)
    joined = lambda by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "text"))), lambda x: x["text"]), ",")
    segments = whole.select("file", "turn", "seg", text.alias("text")).groupBy("file", "turn").agg(joined("seg").alias("texts"))
    head = [F.lit('{"membershipId":'), _quoted("membership"), F.lit(',"routeId":'), _quoted("route_id"), F.lit(',"direction":'), _quoted("direction"), F.lit(',"directionMappingVersion":'), _quoted("version"), F.lit(',"segments":['), F.coalesce("texts", F.lit("")), F.lit("]}")]
    members = filemember.join(segments, ["file", "turn"], "left").select("file", "turn", F.concat(*head).alias("text"))
    return members.groupBy("file").agg(F.sha2(F.concat(F.lit("["), joined("turn"), F.lit("]")), 256).alias("sha256"))


def membership_faults(members: DataFrame, segments: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """file, turn, fault of every membership, by place: its own faults first, then each segment's, then those of each edge of it. Null: none.

    Ids and snapshots are compared over the whole file: the first that has an id keeps it.
    """
    bad = lambda c: F.octet_length(c).eqNullSafe(0) | F.col(c).isNull() | (F.octet_length(c) > MOST_ID)
    hashed = lambda c: F.col(c).rlike("^[0-9a-f]{64}$")
    again = lambda c, *order: F.row_number().over(Window.partitionBy("file", c).orderBy(*order)) > 1
    held = segments.groupBy("file", "turn").agg(F.count("*").alias("segments"))
    wrong = again("membership", "turn") | (F.col("membership") != F.concat_ws(":", F.lit("route"), "route_id", "direction")) | (F.col("version") != VERSION) | F.col("segments").isNull()
    own = F.when(bad("membership"), "membership id").when(bad("route_id"), "route id").when(bad("direction"), "direction").when(wrong, "membership")
    at_member = members.join(held, ["file", "turn"], "left").select("file", "turn", F.lit(-1).alias("seg"), F.lit(-1).alias("place"), own.alias("fault"))
    whole = cut(whole_segments(segments, edges))
    first = whole.groupBy("file").agg(F.min_by("snapshot", F.struct("turn", "seg")).alias("common"))
    places = F.transform(F.split("indexes", ","), lambda x: x.cast("long"))
    steps = F.transform(F.sequence(F.lit(1), F.size(places) - 1), lambda i: F.element_at(places, i + 1) == F.element_at(places, i) + 1)
    ordered = F.when(F.size(places) == 1, True).otherwise(F.forall(steps, lambda x: x))
    listed = F.col("indexes").isNotNull() & (F.size(F.array_distinct(places)) == F.size(places)) & F.col("in_order").eqNullSafe(ordered)
    by_relation = ~bad("relation") & F.col("evidence").isNull() & listed
    by_ramp = F.col("relation").isNull() & ~bad("evidence") & F.col("indexes").isNull() & F.col("in_order").isNull()
    size = F.size("edges")
    segment = (
        F.when(bad("segment"), "segment id").when(again("segment", "turn", "seg") | (size == 0) | (size > MOST_EDGES), "segment").when(~hashed("snapshot"), "snapshot hash").when(~hashed("hash"), "edge hash").when(F.sha2(F.to_json("edges"), 256) != F.col("hash"), "edges")
        .when(F.col("snapshot") != F.col("common"), "snapshot").when(~F.when(F.col("kind") == MAINLINE, by_relation).otherwise(by_ramp), "source")
    )
    at_segment = whole.join(first, "file").select("file", "turn", "seg", F.lit(-1).alias("place"), segment.alias("fault"))
    spread = whole.select("file", "turn", "seg", "kind", F.posexplode("edges").alias("place", "edge_id"))
    met = spread.join(known.select("edge_id", "source", "target", F.col("kind").alias("edge_kind")), "edge_id", "left")
    line = Window.partitionBy("file", "turn", "seg").orderBy("place")
    repeats = F.row_number().over(Window.partitionBy("file", "turn", "seg", "edge_id").orderBy("place")) > 1
    met = met.withColumns({"before": F.lag("target").over(line), "repeats": repeats})
    edge = (
        F.when(bad("edge_id"), "edge id").when(F.col("repeats"), "edge twice").when(F.col("source").isNull(), "edge unknown").when(F.col("before") != F.col("source"), "edges apart")
        .when((F.col("kind") == MAINLINE) & (F.col("edge_kind") != "shutoko"), "edge not mainline").when((F.col("kind") == BOUND) & ~F.col("edge_kind").isin("entry", "exit"), "edge not a ramp")
    )
    at_edge = met.select("file", "turn", "seg", "place", edge.alias("fault"))
    faults = at_member.unionByName(at_segment).unionByName(at_edge).where("fault is not null")
    least = faults.groupBy("file", "turn").agg(F.min_by("fault", F.struct("seg", "place")).alias("fault"))
    return members.select("file", "turn").join(least, ["file", "turn"], "left")


@rule("filemember", "filesegment", "fileedge", "filenetedge", sql=f"""{_SEGMENTS},
own as (select m.file, m.turn, -1 as seg, -1 as place, case when route_id = '' then 'route id' when direction = '' then 'direction' when exists (select 1 from filemember o where o.file = m.file and o.membership = m.membership and o.turn < m.turn) or membership <> 'route:' || route_id || ':' || direction
  or version <> 'osm-relation-role/v1' or not exists (select 1 from filesegment s where s.file = m.file and s.turn = m.turn) then 'membership' end as fault from filemember m),
split_ as (select *, list_transform(string_split(indexes, ','), lambda x: x::bigint) as idx, (select arg_min(snapshot, turn * 100000 + seg) from seg o where o.file = seg.file) as common from seg),
segment_ as (select file, turn, seg, -1 as place, case when segment = '' then 'segment id' when exists (select 1 from seg o where o.file = s.file and o.segment = s.segment and (o.turn < s.turn or o.turn = s.turn and o.seg < s.seg)) or n = 0 then 'segment' when not regexp_full_match(snapshot, '[0-9a-f]{{64}}') then 'snapshot hash'
  when not regexp_full_match(hash, '[0-9a-f]{{64}}') then 'edge hash' when sha256(ids) <> hash then 'edges' when snapshot <> common then 'snapshot'
  when kind = 'relationMainline' and (relation is null or evidence is not null or idx is null or len(list_distinct(idx)) <> len(idx) or in_order is distinct from (len(list_filter(range(2, len(idx) + 1), lambda i: idx[i] <> idx[i - 1] + 1)) = 0)) then 'source'
  when kind = 'boundRamp' and (relation is not null or evidence is null or idx is not null or in_order is not null) then 'source' end as fault from split_ s),
walked as (select e.file, e.turn, e.seg, e.place, e.edge_id, s.kind, k.source, k.kind as edge_kind, lag(k.target) over (partition by e.file, e.turn, e.seg order by e.place) as before, row_number() over (partition by e.file, e.turn, e.seg, e.edge_id order by e.place) > 1 as again
  from fileedge e join filesegment s on s.file = e.file and s.turn = e.turn and s.seg = e.seg left join filenetedge k on k.edge_id = e.edge_id),
edge_ as (select file, turn, seg, place, case when again then 'edge twice' when source is null then 'edge unknown' when before <> source then 'edges apart' when kind = 'relationMainline' and edge_kind <> 'shutoko' then 'edge not mainline' when kind = 'boundRamp' and edge_kind = 'shutoko' then 'edge not a ramp' end as fault from walked),
bad as (select file, turn, arg_min(fault, seg * 1000 + place) as fault from (select * from own union all select * from segment_ union all select * from edge_) where fault is not null group by file, turn)
select m.file, m.turn, fault, fault is not null and not exists (select 1 from bad b where b.file = m.file and b.turn < m.turn) as first from filemember m left join bad using (file, turn)""")
def v10_membership_faults(filemember, filesegment, fileedge, filenetedge):
    """The first fault of each membership of a file, and whether it is the one that the file is rejected for."""
    found = cut(membership_faults(filemember, filesegment, fileedge, filenetedge))
    least = found.where("fault is not null").groupBy("file").agg(F.min("turn").alias("least"))
    return found.join(least, "file", "left").select("file", "turn", "fault", F.coalesce(F.col("turn") == F.col("least"), F.lit(False)).alias("first"))
