"""Relations of ways as routes over a network's edges: edges of each way either way, and what each relation comes to."""

from __future__ import annotations

from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitway.operators import chains
from orbitway.plans.build_queries import registering

QUERIES, ORACLE = {}, {}
rule = registering(QUERIES, ORACLE)
#: Directions that take a way either way, and those that take it backward.
EITHER, BACKWARD = ("inner", "outer", "inbound", "outbound"), ("backward", "reverse")


def way_edges(routeplace: DataFrame, routeedge: DataFrame) -> DataFrame:
    """net, way, reverse, outcome, place, source, target, edges: the edges of each way, along its nodes or against them.

    'mapped' with one edge for each two neighbouring nodes, in the order of the nodes; 'absent' where two
    of them have none; else 'several', with the first place that has more than one.
    """
    line = Window.partitionBy("net", "way").orderBy("place")
    steps = routeplace.withColumn("next", F.lead("node").over(line)).where("next is not null").withColumn("reverse", F.explode(F.array(F.lit(False), F.lit(True))))
    turned = steps.select("net", "way", "reverse", "place", F.when(F.col("reverse"), F.col("next")).otherwise(F.col("node")).alias("source"), F.when(F.col("reverse"), F.col("node")).otherwise(F.col("next")).alias("target"))
    exact = routeedge.groupBy("net", "way", "source", "target").agg(F.count("*").alias("n"), F.min("edge_id").alias("edge_id"))
    met = turned.join(exact, ["net", "way", "source", "target"], "left")
    whole = met.groupBy("net", "way", "reverse").agg(F.bool_and(F.col("n").isNotNull()).alias("there"), F.min(F.when(F.col("n") > 1, F.col("place"))).alias("several"), F.array_sort(F.collect_list(F.struct("place", "edge_id", "source", "target"))).alias("line"))
    outcome = F.when(~F.col("there"), "absent").when(F.col("several").isNotNull(), "several").otherwise("mapped")
    mapped = F.col("outcome") == "mapped"
    out = whole.withColumn("outcome", outcome)
    return out.select(
        "net", "way", "reverse", "outcome", F.when(F.col("outcome") == "several", F.col("several")).alias("place"), F.when(mapped, F.element_at("line", 1)["source"]).alias("source"),
        F.when(mapped, F.element_at("line", -1)["target"]).alias("target"), F.when(mapped, F.transform("line", lambda x: x["edge_id"])).alias("edges"),
    )


@rule("routeplace", "routeedge", sql="""step as (select net, way, place, node, lead(node) over (partition by net, way order by place) as next from routeplace),
turned as (select net, way, false as reverse, place, node as source, next as target from step where next is not null union all select net, way, true, place, next, node from step where next is not null),
counted as (select t.*, (select count(*) from routeedge e where e.net = t.net and e.way = t.way and e.source = t.source and e.target = t.target) as n, (select min(edge_id) from routeedge e where e.net = t.net and e.way = t.way and e.source = t.source and e.target = t.target) as edge_id from turned t),
whole as (select net, way, reverse, case when min(n) = 0 then 'absent' when max(n) > 1 then 'several' else 'mapped' end as outcome, min(case when n > 1 then place end) as bad, arg_min(source, place) as a, arg_max(target, place) as b, string_agg(edge_id, ',' order by place) as edges from counted group by net, way, reverse)
select net, way, reverse, outcome, case when outcome = 'several' then bad end as place, case when outcome = 'mapped' then a end as source, case when outcome = 'mapped' then b end as target, case when outcome = 'mapped' then edges end as edges from whole""")
def r15_way_edges(routeplace, routeedge):
    """The exact edges of each way of a relation, either way along it."""
    return way_edges(routeplace, routeedge).withColumn("edges", F.array_join("edges", ","))


@rule("routemember", "routeplace", "routeedge")
def r16_route_coverage(routemember, routeplace, routeedge):
    """What each relation comes to: a membership with its segments, in order or not; or the first thing that keeps it from one. No relation is left out."""
    found = way_edges(routeplace, routeedge).withColumnRenamed("net", "relation")
    pieces = routemember.join(found, ["relation", "way"], "left").select("relation", "direction", "member", "way", "link", "reverse", "outcome", "source", "target", "edges")
    ends = routeedge.select(F.col("net").alias("relation"), "edge_id", F.col("source").alias("edge_source"), F.col("target").alias("edge_target"))

    def expand(members: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        names = ["relation", "status", "reason", "way", "membership", "segments", "edges", "in_order"]
        if members.empty:
            return pd.DataFrame(columns=names)
        relation, direction = members["relation"].iloc[0], members["direction"].iloc[0]
        place = {x: (int(a), int(b)) for x, a, b in zip(edges["edge_id"], edges["edge_source"], edges["edge_target"], strict=True)}
        reason, way, segments = expanded(members.sort_values(["member", "reverse"]), place, direction)
        row = (relation, "fail" if reason else "pass", reason, way, None if reason else f"route:{relation}:{direction}", len(segments), sum(len(e) for _, e in segments), sum(all(b == a + 1 for a, b in pairwise(m)) for m, _ in segments))
        return pd.DataFrame([row], columns=names, dtype=object)

    shape = "relation string, status string, reason string, way long, membership string, segments long, edges long, in_order long"
    return pieces.groupBy("relation").cogroup(ends.groupBy("relation")).applyInPandas(expand, shape)


def expanded(members: pd.DataFrame, place: dict[str, tuple[int, int]], direction: str) -> tuple[str | None, int | None, list[tuple[list[int], list[str]]]]:
    """A relation's segments as (members, edges), or a reason and the way that shows it. place: the ends of all edges of the network."""
    either, backward = direction in EITHER, direction in BACKWARD
    pieces, edges_of = [], {}
    for _, rows in members.groupby("member", sort=True):
        wanted = rows if either else rows[rows["reverse"] == backward]
        way = int(rows["way"].iloc[0])
        if (wanted["outcome"] == "several").any():
            return "several_edges", way, []
        mapped = wanted[wanted["outcome"] == "mapped"]
        if mapped.empty:
            return "no_edges_of_direction", way, []
        for r in mapped.to_dict("records"):
            pieces.append(chains.Member(int(r["member"]), way, bool(r["reverse"]), int(r["source"]), int(r["target"]), bool(r["link"])))
            edges_of[pieces[-1].member, pieces[-1].reverse] = list(r["edges"])
    found = chains.order_members(pieces, [(x, a, b) for x, (a, b) in place.items()], None if either else backward)
    if isinstance(found, chains.OrderError):
        return found.code, found.way, []
    segments = []
    for path in found:
        edges = [x for m in path for x in edges_of[m.member, m.reverse]]
        if any(place[a][1] != place[b][0] for a, b in pairwise(edges)):
            return "broken_path", path[0].way, []
        segments.append(([m.member for m in path], edges))
    return None, None, segments
