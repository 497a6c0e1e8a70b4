"""Searches between ramps: a pair of ramps that the request names, and tiers of entries, the nearest first, of which the first productive one answers."""

from __future__ import annotations

import functools
import json
import math
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitway.functions.geo import DETOUR
from orbitway.operators import search as base
from orbitway.operators.paths import Budget, Edge, Limits, Network, meters, seconds, too_alike
from orbitway.operators.search import PRODUCT_MINUTES, Prepared, by_time, candidate_id, fits, maps_url, midpoint, price_at, straight, surface_seconds, with_buffer

#: Anchors of a cyclic component, exits that a tier without verified pairs tries, edges of a route.
ANCHORS, EXITS, ROUTE_EDGES = 32, 2, 20_000

RESULT = (
    "request_id string, status string, reason string, ranking_mode string, min_plan_seconds long, expanded_states long, "
    "candidates array<struct<id:string, pair_kind:string, entry_ramp:string, exit_ramp:string, pair_id:string, edge_ids:array<string>, loop_edge_ids:array<string>, access_seconds:long, shutoko_seconds:long, return_seconds:long, "
    "base_seconds:long, buffer_seconds:long, plan_seconds:long, distance_meters:long, shutoko_meters:long, amount_yen:long, toll_source:string, maps_url:string, reasons:array<string>>>"
)


_NONE = np.zeros(0, np.int64)


def surface_meters(distance: float) -> int:
    return math.ceil(distance * DETOUR)


class Ends:
    """Of a tree's paths between its root and a node, with the ramp's edge at the root: their number of edges, whether they are legal, and the edges next to the node.

    Each follows from the node before it, so that no path is written out.
    """

    def __init__(self, network: Network, via: dict[str, Edge], root: str, ramp: Edge, backward: bool = False):
        self.network, self.via, self.backward = network, via, backward
        self.near = max(1, max(map(len, network.forbidden), default=1) - 1)
        self.known: dict[str, tuple[int, bool, tuple[Edge, ...]]] = {root: (1, True, (ramp,))}

    def at(self, node: str) -> tuple[int, bool, tuple[Edge, ...]]:
        steps, x = [], node
        while x not in self.known:
            steps.append((x, self.via[x]))
            x = self.via[x].target if self.backward else self.via[x].source
        for x, e in reversed(steps):
            n, legal, near = self.known[e.target if self.backward else e.source]
            line = (e, *near) if self.backward else (*near, e)
            # A sequence that the edge completes has it at its end.
            whole = e.id not in (self.network.starts if self.backward else self.network.ends) or self.network.legal(list(line))
            self.known[x] = n + 1, legal and whole, line[: self.near] if self.backward else line[-self.near :]
        return self.known[node]


class Loops(NamedTuple):
    """Loops that are neither too long nor too short, by anchor and in the order of its catalogue, with their seconds and numbers of edges."""

    anchors: list[str]
    loops: list[list[Edge]]
    seconds: np.ndarray
    sizes: np.ndarray


class Side(NamedTuple):
    """Of a ramp's tree: seconds to the anchor of each of the loops (-1 where it doesn't lead), edges on the way, whether it may go on with the loop, the nodes it settles, and the edges next to loops too short to tell the way in from the way out."""

    away: np.ndarray
    edges: np.ndarray
    sound: np.ndarray
    met: np.ndarray
    near: dict[int, tuple[Edge, ...]]


@dataclass
class Routes:
    """Ways from an entry over a loop to an exit, in the order in which they are tried, and the states that finding them took."""

    spent: int
    #: The verified pair of the two ramps, if there is one.
    pair: dict | None
    found_loop: bool
    loops: Loops
    #: Number of the loop of each, and its seconds.
    at: np.ndarray
    driven: np.ndarray

    @property
    def legal(self) -> list[tuple[int, str, list[Edge]]]:
        """Seconds, anchor and loop of each."""
        return [(int(d), self.loops.anchors[i], self.loops.loops[i]) for d, i in zip(self.driven, self.at, strict=True)]


class Way(NamedTuple):
    """A route from a ramp over a loop to a ramp, with what doesn't depend on the request."""

    path: list[Edge]
    legal: bool
    seconds: int
    meters: int
    edge_ids: list[str]
    loop_edge_ids: list[str]
    stops: list[str]


@dataclass
class Outcome:
    """What a pair of ramps gives for a request."""

    candidate: dict | None = None
    plans: list[int] = field(default_factory=list)
    found_loop: bool = False
    legal: bool = False
    late: bool = False
    unlinked: bool = False


class Junctions(Prepared):
    """A network with its ramps."""

    def __init__(self, graph: dict, limits: Limits = Limits()):
        super().__init__(graph, limits)
        self.ramps = {r["id"]: r for r in graph.get("ramps") or []}
        self.od = {(t["entryRampId"], t["exitRampId"]): t for t in graph.get("odTariffs") or []}
        self._routes: dict[tuple[str, str], Routes] = {}
        self._ways: dict[tuple, Way] = {}
        self._loops: dict[str | None, Loops] = {}
        self._sides: dict[tuple[str, str | None, bool], Side] = {}
        #: The ramps whose trees were made last, and these.
        self._last: tuple = (None, None, None)
        self._entries = [(x["id"], x["nodeId"], self.nodes[x["nodeId"]]) for x in self.ramps.values() if x["kind"] == "general_entry"]
        self._exit_lists: dict[tuple[str, str | None], list[dict]] = {}
        self.pairs_of: dict[str, list[dict]] = {}
        for p in self.pairs:
            if p.get("entryRampId"):
                self.pairs_of.setdefault(p["entryRampId"], []).append(p)

    @functools.cached_property
    def parts(self) -> dict[str, list[str]]:
        """The nodes of each cyclic component, in order."""
        parts: dict[str, list[str]] = {}
        for node, (part, cyclic) in sorted(self.network.components().items()):
            if cyclic:
                parts.setdefault(part, []).append(node)
        return parts

    @functools.cached_property
    def anchors(self) -> dict[str, str]:
        """Nodes whose loops are looked at, with their components: all of a small cyclic component, ANCHORS evenly spaced ones of a large one."""
        last = ANCHORS - 1
        return {x: part for part, own in self.parts.items() for x in (own if len(own) <= ANCHORS else [own[k * (len(own) - 1) // last] for k in range(ANCHORS)])}

    def loops(self, part: str | None) -> Loops:
        """The loops that routes may take, of a component or of all of them."""
        if part not in self._loops:
            own = [(x, loop) for x in sorted(a for a, p in self.anchors.items() if part in (None, p)) for loop in self.network.catalogue(x)[0] if len(loop) <= self.limits.loop_edges and meters(loop) >= self.limits.loop_meters]
            self._loops[part] = Loops([x for x, _ in own], [y for _, y in own], np.array([seconds(y) for _, y in own], np.int64), np.array([len(y) for _, y in own], np.int64))
        return self._loops[part]

    @functools.cached_property
    def places(self) -> dict[str, int]:
        return {n: i for i, n in enumerate(self.network.part)}

    def side(self, root: str, ramp: Edge, part: str | None, backward: bool = False) -> Side:
        """What a ramp's tree says of the loops of a component, or of all; made once for all ramps at the other end."""
        key = ramp.id, part, backward
        if key not in self._sides:
            loops, longest = self.loops(part), max(map(len, self.network.forbidden), default=1) - 1
            cost, via, _ = self.network.tree(root, backward, within=None if part is None else self.network.between(root, root))
            ends = Ends(self.network, via, root, ramp, backward)
            away, edges, sound, near = np.full(len(loops.loops), -1, np.int64), np.zeros(len(loops.loops), np.int64), np.zeros(len(loops.loops), bool), {}
            for i, (anchor, loop) in enumerate(zip(loops.anchors, loops.loops, strict=True)):
                if anchor in cost:
                    away[i] = cost[anchor]
                    edges[i], well, by = ends.at(anchor)
                    if len(loop) < longest:
                        sound[i], near[i] = well, by
                    else:
                        sound[i] = well and self.network.legal([*loop[len(loop) - longest :], *by] if backward else [*by, *loop[:longest]])
            met = np.zeros(len(self.places), bool)
            met[[self.places[x] for x in cost]] = True
            self._sides[key] = Side(away, edges, sound, met, near)
        return self._sides[key]

    def trees(self, entry: dict, exit_: dict) -> tuple[tuple, tuple]:
        """The trees from an entry and back from an exit, as far as ways between the two go; those made last are kept."""
        key = entry["id"], exit_["id"]
        if self._last[0] != key:
            start, goal = entry["mainlineNodeId"], exit_["mainlineNodeId"]
            within = self.network.between(start, goal)
            self._last = key, self.network.tree(start, within=within), self.network.tree(goal, backward=True, within=within)
        return self._last[1:]

    def routes(self, entry: dict, exit_: dict) -> Routes:
        """Every legal way from the entry to an anchor, around one of its loops and on to the exit; the anchors least out of the way first. Found once for all requests."""
        key = entry["id"], exit_["id"]
        if key not in self._routes:
            pair = next((p for p in self.pairs if (p.get("entryRampId") == entry["id"] or p["entryId"] == entry["edgeId"]) and (p.get("exitRampId") == exit_["id"] or p["exitId"] == exit_["edgeId"])), None)
            start, goal, way_in, way_out = entry["mainlineNodeId"], exit_["mainlineNodeId"], self.network.edges[entry["edgeId"]], self.network.edges[exit_["edgeId"]]
            if start not in self.places or goal not in self.places or not self.network.leads(start, goal):
                self._routes[key] = Routes(int(start == goal), pair, False, Loops([], [], _NONE, _NONE), _NONE, _NONE)
                return self._routes[key]
            part = self.network.part[start] if self.network.part[start] == self.network.part[goal] else None
            loops, there, back = self.loops(part), self.side(start, way_in, part), self.side(goal, way_out, part, True)
            both = (there.away >= 0) & (back.away >= 0)
            legal = both & there.sound & back.sound & (there.edges + loops.sizes + back.edges <= ROUTE_EDGES)
            for i in there.near:
                legal[i] = legal[i] and self.network.legal([*there.near[i], *loops.loops[i], *back.near[i]])
            at = np.flatnonzero(legal)
            at = at[np.argsort((there.away + back.away)[at], kind="stable")]
            self._routes[key] = Routes(int(np.count_nonzero(there.met & back.met)), pair, bool(both.any()), loops, at, way_in.seconds + (there.away + loops.seconds + back.away)[at] + way_out.seconds)
        return self._routes[key]

    def written(self, entry: dict, exit_: dict, anchor: str, loop: list[Edge]) -> list[Edge]:
        """All edges of one of the routes between two ramps."""
        start, goal, edges = entry["mainlineNodeId"], exit_["mainlineNodeId"], self.network.edges
        (_, via, _), (_, home, _) = self.trees(entry, exit_)
        return [edges[entry["edgeId"]], *self.network.route(via, anchor, start), *loop, *self.network.route(home, anchor, goal, backward=True), edges[exit_["edgeId"]]]

    def way(self, path: list[Edge], loop: list[Edge]) -> Way:
        stops = list(dict.fromkeys(x for x in (path[0].source, midpoint(loop), path[-1].target) if x))[:3]
        return Way(path, self.network.legal(path), seconds(path), meters(path), [e.id for e in path], [e.id for e in loop], stops)

    def row(self, r: dict, origin: dict, entry: str | None, exit_: str | None, pair: dict | None, way: Way, away: float | None = None) -> dict:
        """Times, metres, price and address of a route; a None address is too long. away: metres to the entry, if known."""
        first, last = self.nodes[way.path[0].source], self.nodes[way.path[-1].target]
        to, fro = straight(origin, first) if away is None else away, straight(last, origin)
        base_ = surface_seconds(to) + way.seconds + surface_seconds(fro)
        buffer, plan = with_buffer(base_)
        price = price_at(pair.get("prices") if pair else [], r["pricingAt"])
        od = self.od.get((entry, exit_)) if price is None else None
        if od is not None and not (od["effectiveFrom"] <= r["pricingAt"] and (od.get("effectiveTo") is None or r["pricingAt"] < od["effectiveTo"])):
            od = None
        return {
            "entry_ramp": entry, "exit_ramp": exit_, "pair_id": pair["id"] if pair else f"od:{entry}:{exit_}", "edge_ids": way.edge_ids, "loop_edge_ids": way.loop_edge_ids,
            "access_seconds": surface_seconds(to), "shutoko_seconds": way.seconds, "return_seconds": surface_seconds(fro), "base_seconds": base_, "buffer_seconds": buffer, "plan_seconds": plan,
            "distance_meters": way.meters + surface_meters(to) + surface_meters(fro), "shutoko_meters": way.meters, "amount_yen": (price or od or {}).get("amountYen"),
            "toll_source": "pair" if price else "od" if od else "unknown", "maps_url": maps_url(origin, [self.nodes[x] for x in way.stops]), "path": way.path,
        }

    def between(self, r: dict, origin: dict, entry: dict, exit_: dict, budget: Budget) -> Outcome:
        """The first route between two ramps that fits the request, and what the others show."""
        routes, out = self.routes(entry, exit_), Outcome()
        if not budget.take(routes.spent):
            return out
        out.found_loop, out.legal = routes.found_loop, bool(len(routes.at))
        if not out.legal:
            return out
        around = sum(surface_seconds(straight(origin, self.nodes[x["nodeId"]])) for x in (entry, exit_))
        total = around + routes.driven
        plan = total + np.maximum(300, -(-total // 5))  # as with_buffer
        fit = (total >= r["minMinutes"] * 60) & (plan <= r["maxMinutes"] * 60)  # as fits
        out.plans, out.late = [int(plan.min())], not fit.all()
        for k in np.flatnonzero(fit).tolist():
            key = entry["id"], exit_["id"], k
            if key not in self._ways:
                i = routes.at[k]
                self._ways[key] = self.way(self.written(entry, exit_, routes.loops.anchors[i], routes.loops.loops[i]), routes.loops.loops[i])
            row = self.row(r, origin, entry["id"], exit_["id"], routes.pair, self._ways[key])
            if row["maps_url"] is not None:
                out.candidate = row | {"pair_kind": "topologyOnly", "id": candidate_id([entry["id"], exit_["id"], *row["edge_ids"]])}
                break
            out.unlinked = True
        return out

    def origin(self, r: dict) -> dict:
        if r.get("origin"):
            return r["origin"]
        return self.nodes[r["originNodeId"] if r.get("originNodeId") else self.ramps[r["entryRampId"]]["nodeId"]]

    def fault(self, r: dict) -> str | None:
        """What is wrong with a request that may name ramps, if anything."""
        for key, kind in (("entryRampId", "general_entry"), ("exitRampId", "general_exit")):
            if r.get(key) and self.ramps.get(r[key], {}).get("kind") != kind:
                return f"unknown {key.removesuffix('RampId')} ramp id"
        if r.get("origin") or r.get("originNodeId"):
            return self.check(r)
        if not r.get("entryRampId"):
            return "either origin or originNodeId must be provided"
        return self.check(r | {"originNodeId": self.ramps[r["entryRampId"]]["nodeId"]})

    def answer(self, r: dict) -> dict:
        """A row of RESULT: a pair of ramps decides if the request names both, else the tiers of entries do."""
        blank = {"request_id": r.get("requestId"), "status": "no_candidates", "reason": None, "ranking_mode": "shutoko_time", "min_plan_seconds": None, "expanded_states": 0, "candidates": []}
        if wrong := self.fault(r):
            return blank | {"status": "invalid", "reason": wrong, "ranking_mode": None}
        return blank | (self.explicit(r) if r.get("entryRampId") and r.get("exitRampId") else self.tiers(r))

    def explicit(self, r: dict) -> dict:
        entry, exit_, budget = self.ramps[r["entryRampId"]], self.ramps[r["exitRampId"]], Budget(self.limits.states)
        found = Outcome()
        if budget.take(self.network.settled(entry["mainlineNodeId"])):
            found = self.between(r, self.origin(r), entry, exit_, budget)
        if budget.truncated:
            return {"status": "truncated", "reason": "SEARCH_LIMIT", "expanded_states": budget.spent}
        if found.unlinked:
            return {"status": "invalid", "reason": "explicit route handoff URL exceeds supported length", "ranking_mode": None}
        known = {"min_plan_seconds": min(found.plans, default=None), "expanded_states": budget.spent}
        if found.candidate:
            return known | {"status": "ok", "candidates": [_shown(found.candidate, ["TOPOLOGY_ONLY", "EXPLICIT_OD"])]}
        return known | {"reason": "TIME_WINDOW" if found.found_loop and found.plans else "NO_LOOP"}

    def tiers(self, r: dict) -> dict:
        """Entries by distance, time and id. One with verified pairs looks at their loops; any other at the ways to the exits of its place.

        The first tier with a candidate answers. If the nearest tier has a legal loop that doesn't fit, no
        farther one is tried; a tier without any lets the next one try. Nothing is taken from a tier after
        one that was cut short.
        """
        origin, wanted = self.origin(r), r.get("exitRampId")
        limit = self.limits.access_meters
        named, node = r.get("entryRampId"), r.get("originNodeId")
        far = sorted((d, surface_seconds(d), x) for x, at, spot in self._entries if (not named or x == named) and (not node or at == node) and ((d := straight(origin, spot)) <= limit or not limit))
        if not far:
            return {"reason": "NO_CONNECTION"}
        budget, wide = Budget(self.limits.states), Budget(self.limits.states)
        plans: list[int] = []
        seen = {"legal": False, "late": False, "unlinked": False}
        for turn, (away, _, name) in enumerate(far):
            entry = self.ramps[name]
            pairs = [p for p in self.pairs_of.get(name, []) if not wanted or wanted in (p.get("exitRampId"), p["exitId"]) or self.ramps[wanted]["edgeId"] == p["exitId"]]
            if len(pairs) > self.limits.pairs:
                return {"status": "truncated", "reason": "SEARCH_LIMIT", "ranking_mode": "time_per_yen", "expanded_states": budget.spent}
            if pairs:
                rows = self._verified(r, origin, entry, pairs, away, budget, wide, plans, seen)
                rows.sort(key=functools.cmp_to_key(_by_worth))
            else:
                exits = self._exits_of(name, wanted)
                if not exits:
                    continue
                if not budget.take(self.network.settled(entry["mainlineNodeId"])):
                    return {"status": "truncated", "reason": "SEARCH_LIMIT", "expanded_states": budget.spent}
                rows = self._dynamic(r, origin, entry, exits, budget, plans, seen)
                rows.sort(key=functools.cmp_to_key(by_time))
            if rows:
                chosen: list[dict] = []
                for c in rows:
                    if len(chosen) < self.limits.candidates and not any(too_alike(c["path"], o["path"]) for o in chosen):
                        chosen.append(c)
                by_clock = not pairs or any(c["amount_yen"] is None for c in chosen)
                best = ["BEST_SHUTOKO_TIME" if by_clock else "BEST_TIME_PER_YEN"]
                reasons = lambda i: ([*(best if i == 0 else []), "ONE_SECTION_TOLL"] if pairs else ["TOPOLOGY_ONLY"])  # noqa: B023, E731
                return {
                    "status": "truncated" if budget.truncated else "ok", "reason": "SEARCH_LIMIT" if budget.truncated else None, "ranking_mode": "shutoko_time" if by_clock else "time_per_yen",
                    "min_plan_seconds": None if budget.truncated or wide.truncated else min(plans, default=None), "expanded_states": budget.spent, "candidates": [_shown(c, reasons(i)) for i, c in enumerate(chosen)],
                }
            if budget.truncated or turn == 0 and seen["legal"]:
                break
        why = "SEARCH_LIMIT" if budget.truncated else "NO_LOOP" if not seen["legal"] else "NO_HANDOFF" if seen["unlinked"] and not seen["late"] else "TIME_WINDOW"
        return {"status": "truncated" if budget.truncated else "no_candidates", "reason": why, "min_plan_seconds": None if budget.truncated or wide.truncated else min(plans, default=None), "expanded_states": budget.spent}

    def _exits_of(self, name: str, wanted: str | None) -> list[dict]:
        if (name, wanted) not in self._exit_lists:
            self._exit_lists[name, wanted] = self._exits(self.ramps[name], wanted)
        return self._exit_lists[name, wanted]

    def _exits(self, entry: dict, wanted: str | None) -> list[dict]:
        """At most EXITS exits by id: those of the entry's place, or else those of verified pairs; none at the entry's own edge or node."""
        apart = lambda x: x["kind"] == "general_exit" and x["edgeId"] != entry["edgeId"] and x["mainlineNodeId"] != entry["mainlineNodeId"] and (not wanted or x["id"] == wanted)
        own = sorted(x["id"] for x in self.ramps.values() if x["facilityId"] == entry["facilityId"] and apart(x))
        paid = {p.get("exitRampId") for p in self.pairs}
        return [self.ramps[x] for x in (own or sorted(x["id"] for x in self.ramps.values() if x["id"] in paid and apart(x)))[:EXITS]]

    def _verified(self, r: dict, origin: dict, entry: dict, pairs: list[dict], away: float, budget: Budget, wide: Budget, plans: list[int], seen: dict) -> list[dict]:
        edges, rows = self.network.edges, []
        for p in pairs:
            before, after = ([edges[x] for x in p[k]] for k in ("entryToAnchorEdgeIds", "anchorToExitEdgeIds"))
            back = surface_seconds(straight(self.nodes[after[-1].target], origin))
            loops = self.network.loops(p["anchorNodeId"], r["maxMinutes"] * 60, self.limits, budget)
            if budget.truncated:
                return rows
            wider = self.network.loops(p["anchorNodeId"], PRODUCT_MINUTES * 60, self.limits, wide) if r["maxMinutes"] < PRODUCT_MINUTES else []
            for loop, counts in [*((x, True) for x in loops), *((x, False) for x in wider)]:
                if not (budget if counts else wide).take():
                    if counts:
                        return rows
                    break
                key = (id(p), *(e.id for e in loop))
                if key not in self._ways:
                    self._ways[key] = self.way([*before, *loop, *after], loop)
                way = self._ways[key]
                if not way.legal:
                    continue
                seen["legal"] = True
                total = surface_seconds(away) + way.seconds + back
                plan = with_buffer(total)[1]
                plans.append(plan)
                if not fits(total, plan, r["minMinutes"], r["maxMinutes"]):
                    seen["late"] = True
                elif counts:
                    if len(rows) == self.limits.beam:
                        budget.truncated = True
                        return rows
                    row = self.row(r, origin, entry["id"], p.get("exitRampId"), p, way, away)
                    if row["maps_url"] is None:
                        seen["unlinked"] = True
                        continue
                    # A verified pair's metres are those of the expressway alone.
                    rows.append(row | {"pair_kind": "legacyRing", "id": candidate_id([p["id"], *row["edge_ids"]]), "distance_meters": row["shutoko_meters"]})
        return rows

    def _dynamic(self, r: dict, origin: dict, entry: dict, exits: list[dict], budget: Budget, plans: list[int], seen: dict) -> list[dict]:
        rows = []
        for exit_ in exits:
            found = self.between(r, origin, entry, exit_, budget)
            if budget.truncated:
                break
            seen["legal"] |= found.legal
            seen["late"] |= found.late
            seen["unlinked"] |= found.unlinked
            plans += found.plans
            if found.candidate:
                rows.append(found.candidate)
        return rows


def _by_worth(a: dict, b: dict) -> int:
    """Seconds a yen by cross products, where an unknown price counts as one yen; then as by time."""
    x, y = a["shutoko_seconds"] * (b["amount_yen"] or 1), b["shutoko_seconds"] * (a["amount_yen"] or 1)
    return by_time(a, b) if x == y else -1 if x > y else 1


def _shown(c: dict, reasons: list[str]) -> dict:
    return {k: v for k, v in c.items() if k != "path"} | {"reasons": reasons}


def search_ramps(graphs: DataFrame, requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The answer to each request, as RESULT; requests may name an entry ramp, an exit ramp, or both. Dealt as in search()."""
    slices = requests.groupBy("release_id").agg(F.ceil(F.count("*") / F.lit(base.REQUESTS)).cast("int").alias("slices"))
    dealt = requests.join(slices, "release_id").withColumn("slice", F.pmod(F.xxhash64("request"), F.col("slices")).cast("int")).select("release_id", "slice", "request")
    wanted = graphs.join(slices, "release_id").select(F.col("release_id").alias("graph_release"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("graph_slice"), "graph")
    names = [x.split(" ")[0] for x in RESULT.split(", candidates")[0].split(", ")] + ["candidates"]

    def run(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(asked):
            return pd.DataFrame(columns=names)
        prepared = Junctions(json.loads(graph["graph"].iloc[0]), limits)
        return pd.DataFrame([prepared.answer(json.loads(r)) for r in asked["request"]], columns=names).astype({"min_plan_seconds": "Int64"})

    return wanted.groupBy("graph_release", "graph_slice").cogroup(dealt.groupBy("release_id", "slice")).applyInPandas(run, RESULT)
