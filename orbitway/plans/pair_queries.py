"""Queries that make billing pairs of seeds and look for faults in pairs, ring by ring."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitway.operators.pairs import direct_path, fault, generate
from orbitway.operators.paths import Edge, Network
from orbitway.plans.build_queries import registering
from orbitway.sources.networks import PROFILE

QUERIES, ORACLE = {}, {}
rule = registering(QUERIES, ORACLE)
#: Kinds of faults that are put into sound pairs.
FAULTS = 24


def network_of(edges: pd.DataFrame, bars: pd.DataFrame) -> Network:
    rows = zip(edges["edge_id"], edges["source"], edges["target"], edges["kind"], edges["secs"], edges["meters"], strict=True)
    return Network({x: Edge(x, f"n:{int(a)}", f"n:{int(b)}", kind, int(s), int(m)) for x, a, b, kind, s, m in rows}, [tuple(r) for r in bars[["first", "second"]].itertuples(index=False)])


def ring_by_ring(rows: DataFrame, pairedge: DataFrame, pairbar: DataFrame, shape: str, run: Callable[[Network, pd.DataFrame], list[tuple]]) -> DataFrame:
    """What run makes of each ring's network and rows; bars go with the edges."""
    names = [x.split()[0] for x in shape.split(", ")]
    whole = pairedge.select("net", "edge_id", "source", "target", "kind", "secs", "meters", F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("second"))
    bars = pairbar.select("net", *(F.lit(None).cast(t).alias(c) for c, t in (("edge_id", "string"), ("source", "long"), ("target", "long"), ("kind", "string"), ("secs", "long"), ("meters", "long"))), "first", "second")

    def work(edges: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if edges.empty or asked.empty:
            return pd.DataFrame(columns=names)
        net = network_of(edges[edges["edge_id"].notna()], edges[edges["edge_id"].isna()])
        return pd.DataFrame(run(net, asked), columns=names, dtype=object)

    return whole.unionByName(bars).groupBy("net").cogroup(rows.groupBy("net")).applyInPandas(work, shape)


@rule("pairseed", "pairedge", "pairbar", sql="""hop as (select net, source, target, edge_id, secs from pairedge where kind = 'shutoko'),
asked as (select net, seed, k, entry_way - 2000000 - case when k % 13 = 5 then 1 else 0 end as start, exit_way - 3000000 - case when k % 13 = 6 then 1 else 0 end as goal from pairseed),
walk as (select net, seed, start as at_node, goal, [start] as seen, cast([] as varchar[]) as path, cast(0 as bigint) as secs from asked
  union all select w.net, seed, h.target, goal, list_append(seen, h.target), list_append(path, h.edge_id), w.secs + h.secs from walk w join hop h on h.net = w.net and h.source = w.at_node
  where w.at_node <> goal and not list_contains(seen, h.target)),
done as (select *, row_number() over (partition by seed order by secs, len(path), path) as turn from walk where at_node = goal)
select a.seed, d.secs as seconds, array_to_string(d.path, ',') as path from asked a left join done d on d.seed = a.seed and turn = 1""")
def r10_direct_paths(pairseed, pairedge, pairbar):
    """The quickest path from each seed's entry to its exit that visits no node twice, without regard to bars; of equals, that of fewer edges and smaller ids."""

    def run(net: Network, asked: pd.DataFrame) -> list[tuple]:
        free, out = Network(net.edges), []
        for seed, k, way_in, way_out in zip(asked["seed"], asked["k"], asked["entry_way"], asked["exit_way"], strict=True):
            path = direct_path(free, f"n:{way_in - 2000000 - (k % 13 == 5)}", f"n:{way_out - 3000000 - (k % 13 == 6)}")
            out.append((seed, None if path is None else sum(net.edges[x].seconds for x in path), None if path is None else ",".join(path)))
        return out

    return ring_by_ring(pairseed, pairedge, pairbar, "seed long, seconds long, path string", run)


PAIR = "entryId string, exitId string, anchorNodeId string, entryToAnchorEdgeIds array<string>, anchorToExitEdgeIds array<string>, status string, late boolean"


def generated(pairseed: DataFrame, pairedge: DataFrame, pairbar: DataFrame) -> DataFrame:
    def run(net: Network, asked: pd.DataFrame) -> list[tuple]:
        nodes, out = {n for e in net.edges.values() for n in (e.source, e.target)}, []
        for r in asked.to_dict("records"):
            prices = [{"amountYen": 300, "effectiveFrom": "2026-01-01T00:00:00Z", "effectiveTo": "2026-12-01T00:00:00Z" if r["late_price"] else "2026-10-01T00:00:00Z"}, {"amountYen": 400, "effectiveFrom": "2026-10-01T00:00:00Z", "effectiveTo": None}]
            seed = {"id": f"p:{r['seed']}", "status": r["status"], "oneSectionAheadVerified": r["one_ahead"], "source": r["address"], "sourceDate": r["day"], "entryWay": r["entry_way"], "exitWay": r["exit_way"], "anchorNode": r["anchor_node"], "vehicleProfile": PROFILE, "prices": prices}
            outcome, pair = generate(net, nodes, PROFILE, seed)
            fields = [None] * 6 if pair is None else [pair[k] for k in ("entryId", "exitId", "anchorNodeId", "entryToAnchorEdgeIds", "anchorToExitEdgeIds", "status")]
            out.append((r["net"], r["seed"], r["k"], outcome, *fields, r["late_price"]))
        return out

    return ring_by_ring(pairseed, pairedge, pairbar, f"net string, seed long, k long, outcome string, {PAIR}", run)


@rule("pairseed", "pairedge", "pairbar")
def q08_generated_pairs(pairseed, pairedge, pairbar):
    """The pair that each seed gives, by its two paths, or what keeps it from one."""
    made = generated(pairseed, pairedge, pairbar)
    return made.select("net", "seed", "outcome", F.array_join("entryToAnchorEdgeIds", ",").alias("to_anchor"), F.array_join("anchorToExitEdgeIds", ",").alias("to_exit"))


@rule("pairseed", "pairedge", "pairbar")
def v03_pair_faults(pairseed, pairedge, pairbar):
    """The first fault of each pair: of sound ones, and of as many with a wrong part each, by all parts in turn."""
    sound = generated(pairseed, pairedge, pairbar).where("outcome = 'ok'")
    turned = sound.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(FAULTS - 1))))

    def run(net: Network, asked: pd.DataFrame) -> list[tuple]:
        nodes = {n for e in net.edges.values() for n in (e.source, e.target)}
        ids = {kind: min(x for x, e in net.edges.items() if e.kind == kind) for kind in ("shutoko", "entry", "exit")}
        out = []
        for r in asked.to_dict("records"):
            pair = {k: r[k] for k in ("entryId", "exitId", "anchorNodeId", "status")} | {"id": f"p:{r['seed']}", "vehicleProfile": PROFILE, "entryToAnchorEdgeIds": list(r["entryToAnchorEdgeIds"]), "anchorToExitEdgeIds": list(r["anchorToExitEdgeIds"]), "prices": [{"amountYen": 300, "effectiveFrom": "2026-01-01T00:00:00Z", "effectiveTo": None}]}
            out.append((r["net"], r["seed"], r["part"], fault(net, nodes, PROFILE, wrong(pair, int(r["part"]), ids))))
        return out

    return ring_by_ring(turned, pairedge, pairbar, "net string, seed long, part int, fault string", run)


def wrong(pair: dict, part: int, ids: dict[str, str]) -> dict:
    """The pair with one part changed; part 0: as it is. ids: an edge of each kind."""
    to, fro, price = pair["entryToAnchorEdgeIds"], pair["anchorToExitEdgeIds"], pair["prices"][0]
    changes: list[dict] = [
        {}, {"id": ""}, {"id": "é" * 129}, {"vehicleProfile": "bus"}, {"anchorNodeId": "n:none"}, {"entryToAnchorEdgeIds": []}, {"anchorToExitEdgeIds": []}, {"entryToAnchorEdgeIds": [*to, "none"]}, {"anchorToExitEdgeIds": ["none", *fro]},
        {"entryId": "other"}, {"exitId": "other"}, {"entryId": ids["shutoko"], "entryToAnchorEdgeIds": [ids["shutoko"], *to[1:]]}, {"entryToAnchorEdgeIds": [*to, ids["exit"]]}, {"anchorToExitEdgeIds": [ids["exit"], *fro]}, {"exitId": fro[0], "anchorToExitEdgeIds": fro[:1]},
        {"entryToAnchorEdgeIds": [to[0], to[0], *to[1:]]}, {"anchorToExitEdgeIds": [*fro[:-1], *fro[:1], fro[-1]]}, {"prices": [price | {"amountYen": 0}]}, {"prices": [price | {"effectiveFrom": "2026-02-30T00:00:00Z"}]}, {"prices": [price | {"effectiveTo": "2026-01-01T00:00:00Z"}]},
        {"prices": [price, price | {"effectiveFrom": "2027-01-01T00:00:00Z"}]}, {"prices": [price | {"effectiveTo": "2026-06-01T00:00:01Z"}, price | {"effectiveFrom": "2026-06-01T00:00:00Z"}]}, {"prices": [price] * 1001}, {"prices": [price | {"effectiveFrom": "2026-06-01T00:00:00Z"}, price | {"effectiveTo": "2026-06-01T00:00:00Z"}]},
    ]
    return pair | changes[part]
