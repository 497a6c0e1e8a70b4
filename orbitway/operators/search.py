"""Loop search over many requests at once: networks prepared once a task, requests dealt in slices."""

from __future__ import annotations

import functools
import hashlib
import json
import math
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitway.functions.geo import ACCESS_KMH, DETOUR, RADIUS
from orbitway.operators.paths import Budget, Edge, Limits, Network, meters, seconds

#: Requests that a task handles, on average.
REQUESTS = 2048
#: Longest window of the product, in minutes, and longest address of a map.
PRODUCT_MINUTES, MOST_URL = 240, 2048

RESULT = (
    "request_id string, status string, reason string, ranking_mode string, min_plan_seconds long, expanded_states long, "
    "candidates array<struct<id:string, pair_id:string, edge_ids:array<string>, road_names:array<string>, access_seconds:long, shutoko_seconds:long, return_seconds:long, base_seconds:long, "
    "buffer_seconds:long, plan_seconds:long, distance_meters:long, amount_yen:long, effective_from:string, effective_to:string, maps_url:string, maps_url_sha256:string, reasons:array<string>>>"
)


def straight(a: dict, b: dict) -> float:
    x = math.radians(b["lon"] - a["lon"]) * math.cos(math.radians((a["lat"] + b["lat"]) * 0.5))
    return math.hypot(x, math.radians(b["lat"] - a["lat"])) * RADIUS


def surface_seconds(distance: float) -> int:
    return math.ceil(distance * DETOUR / (ACCESS_KMH / 3.6))


def with_buffer(base: int) -> tuple[int, int]:
    """Buffer (a fifth, rounded up; five minutes at least) and plan."""
    buffer = max(300, -(-base // 5))
    return buffer, base + buffer


def fits(base: int, plan: int, least_minutes: int, most_minutes: int) -> bool:
    """The base must reach the least, and the plan stay in the most; both inclusive."""
    return base >= least_minutes * 60 and plan <= most_minutes * 60


def price_at(prices: list[dict], at: str) -> dict | None:
    """The price whose half-open interval holds the instant; texts of one form in UTC order like instants."""
    return next((p for p in prices or [] if p["effectiveFrom"] <= at and (p.get("effectiveTo") is None or at < p["effectiveTo"])), None)


def candidate_id(parts: list[str]) -> str:
    return "".join(f"{len(p.encode())}:{p}" for p in parts)


def midpoint(path: list[Edge]) -> str | None:
    """The node at which the metres driven come nearest to half; the first of several."""
    half, driven, best = 0.5 * meters(path), 0, None
    for e in path:
        driven += e.meters
        if best is None or abs(driven - half) < best[0]:
            best = abs(driven - half), e.target
    return best[1] if best else None


def maps_url(origin: dict, waypoints: list[dict]) -> str | None:
    """A round trip by the waypoints; None where the address gets too long."""
    spot = lambda p: f"{p['lat']:.6f},{p['lon']:.6f}"
    url = f"https://www.google.com/maps/dir/?api=1&origin={spot(origin)}&destination={spot(origin)}&travelmode=driving"
    if waypoints:
        url += "&waypoints=" + "%7C".join(map(spot, waypoints))
    return url if len(url) <= MOST_URL else None


def by_worth(a: dict, b: dict) -> int:
    """Mainline seconds a yen, compared by cross products in whole numbers; then longer, then less surface time, then smaller id."""
    if a["amount_yen"] is not None and b["amount_yen"] is not None:
        x, y = a["shutoko_seconds"] * b["amount_yen"], b["shutoko_seconds"] * a["amount_yen"]
        if x != y:
            return -1 if x > y else 1
    return by_time(a, b)


def by_time(a: dict, b: dict) -> int:
    key = lambda c: (-c["shutoko_seconds"], c["access_seconds"] + c["return_seconds"], c["id"])
    return -1 if key(a) < key(b) else int(key(a) > key(b))


class Course(NamedTuple):
    """A pair's way by one of its loops, with what doesn't depend on the request."""

    number: int
    legal: bool
    seconds: int
    meters: int
    stops: list[str]
    edge_ids: list[str]
    road_names: list[str]
    id: str
    weights: dict[str, int]
    weight: int


class Prepared:
    """A network with what all its requests share."""

    def __init__(self, graph: dict, limits: Limits = Limits()):
        self.limits = limits
        self.release, self.profile = graph["releaseId"], graph["vehicleProfile"]
        self.nodes = {n["id"]: n for n in graph["nodes"]}
        edges = [Edge(e["id"], e["from"], e["to"], e["kind"], e["durationSeconds"], e["distanceMeters"], e.get("name")) for e in graph["edges"]]
        self.network = Network({e.id: e for e in edges}, [tuple(s) for s in graph.get("forbiddenTransitions") or []])
        self.pairs = sorted((p for p in graph.get("billingPairs") or [] if p["status"] == "verified"), key=lambda p: p["id"])
        self.entries = sorted({e.source for e in edges if e.kind == "entry"})
        self._courses: dict[tuple[str, ...], Course] = {}
        self._alike: dict[tuple[int, int], bool] = {}

    def course(self, pair: dict, before: list[Edge], loop: list[Edge], after: list[Edge]) -> Course:
        """The pair's way by the loop; each is made once, whatever the number of requests."""
        key = (pair["id"], *(e.id for e in loop))
        if key not in self._courses:
            path = [*before, *loop, *after]
            ids, weights = [e.id for e in path], {e.id: e.meters for e in path}
            stops = list(dict.fromkeys(x for x in (before[0].source, midpoint(loop), after[-1].target) if x))[:3]
            names = list(dict.fromkeys(e.name for e in path if e.name is not None))
            self._courses[key] = Course(len(self._courses), self.network.legal(path), seconds(path), meters(path), stops, ids, names, candidate_id([pair["id"], *ids]), weights, sum(weights.values()))
        return self._courses[key]

    def alike(self, a: Course, b: Course) -> bool:
        """paths.too_alike of two courses; kept for each two."""
        key = (min(a.number, b.number), max(a.number, b.number))
        if key not in self._alike:
            shared = sum(m for x, m in a.weights.items() if x in b.weights)
            self._alike[key] = shared * 5 >= (a.weight + b.weight - shared) * 4
        return self._alike[key]

    def check(self, r: dict) -> str | None:
        """What is wrong with a request, if anything."""
        named, spot, text = r.get("originNodeId"), r.get("origin"), lambda x, n=256: bool(x) and len(x.encode()) <= n
        if r.get("releaseId") != self.release or r.get("vehicleProfile") != self.profile:
            return "incompatible release or vehicle profile"
        if (named is None) == (spot is None):
            return "either origin or originNodeId must be provided"
        if named is not None and not text(named):
            return "invalid origin node id"
        if spot is not None and not (math.isfinite(spot["lat"]) and math.isfinite(spot["lon"]) and abs(spot["lat"]) <= 90 and abs(spot["lon"]) <= 180):
            return "coordinates out of range or non-finite"
        if not text(r.get("requestId")) or not 1 <= r["minMinutes"] <= r["maxMinutes"] <= PRODUCT_MINUTES:
            return "time window must be ordered and between 1 and 240 minutes"
        if not (text(r.get("pricingAt"), 40) and r["pricingAt"].endswith("Z")):
            return "invalid timestamp"
        return "unknown origin node" if named is not None and named not in self.nodes else None

    def answer(self, r: dict) -> dict:
        """A row of RESULT."""
        out = {"request_id": r.get("requestId"), "status": "no_candidates", "reason": None, "ranking_mode": "shutoko_time", "min_plan_seconds": None, "expanded_states": 0, "candidates": []}
        if wrong := self.check(r):
            return out | {"status": "invalid", "reason": wrong, "ranking_mode": None}
        origin = r["origin"] if r.get("origin") else self.nodes[r["originNodeId"]]
        far = {n: straight(origin, self.nodes[n]) for n in self.entries} if r.get("origin") else {r["originNodeId"]: 0.0}
        if r.get("origin") and (not far or 0 < self.limits.access_meters < min(far.values())):
            return out | {"reason": "NO_CONNECTION"}
        edges = self.network.edges
        pairs = [p for p in self.pairs if edges[p["entryId"]].source in far]
        if r.get("origin"):
            pairs.sort(key=lambda p: (far[edges[p["entryId"]].source], p["id"]))
        budget, wide = Budget(self.limits.states), Budget(self.limits.states)
        budget.truncated = len(pairs) > self.limits.pairs
        most = r["maxMinutes"] * 60
        rows, plans = [], []
        seen = {"connection": False, "legal": False, "late": False, "handoff": False}
        for p in pairs[: self.limits.pairs]:
            before, after = ([edges[x] for x in p[k]] for k in ("entryToAnchorEdgeIds", "anchorToExitEdgeIds"))
            seen["connection"] = True
            way_in = surface_seconds(straight(origin, self.nodes[before[0].source]))
            way_out = surface_seconds(straight(self.nodes[after[-1].target], origin))
            loops = self.network.loops(p["anchorNodeId"], most, self.limits, budget)
            # Loops beyond the window tell only how long the shortest plan is; they have a budget of their own.
            wider = self.network.loops(p["anchorNodeId"], PRODUCT_MINUTES * 60, self.limits, wide) if r["maxMinutes"] < PRODUCT_MINUTES else []
            for loop, counts in [*((x, True) for x in loops), *((x, False) for x in wider)]:
                if not (budget if counts else wide).take():
                    break
                course = self.course(p, before, loop, after)
                if not course.legal:
                    continue
                seen["legal"] = True
                base = way_in + course.seconds + way_out
                buffer, plan = with_buffer(base)
                plans.append(plan)
                if not fits(base, plan, r["minMinutes"], r["maxMinutes"]):
                    seen["late"] = True
                elif counts:
                    if len(rows) == self.limits.beam:
                        budget.truncated = True
                        break
                    url = maps_url(origin, [self.nodes[x] for x in course.stops])
                    if url is None:
                        seen["handoff"] = True
                        continue
                    price = price_at(p.get("prices"), r["pricingAt"]) or {}
                    rows.append({
                        "id": course.id, "pair_id": p["id"], "edge_ids": course.edge_ids, "road_names": course.road_names,
                        "access_seconds": way_in, "shutoko_seconds": course.seconds, "return_seconds": way_out, "base_seconds": base, "buffer_seconds": buffer, "plan_seconds": plan,
                        "distance_meters": course.meters, "amount_yen": price.get("amountYen"), "effective_from": price.get("effectiveFrom"), "effective_to": price.get("effectiveTo"),
                        "maps_url": url, "course": course,
                    })
        time_only = any(c["amount_yen"] is None for c in rows)
        rows.sort(key=functools.cmp_to_key(by_time if time_only else by_worth))
        chosen: list[dict] = []
        for c in rows:
            if len(chosen) < self.limits.candidates and not any(self.alike(c["course"], o["course"]) for o in chosen):
                chosen.append(c)
        first = "BEST_SHUTOKO_TIME" if time_only else "BEST_TIME_PER_YEN"
        for i, c in enumerate(chosen):
            c["reasons"] = [*([first] if i == 0 else []), "ONE_SECTION_TOLL"]
            c["maps_url_sha256"] = hashlib.sha256(c["maps_url"].encode()).hexdigest()
            del c["course"]
        why = "SEARCH_LIMIT" if budget.truncated else None if chosen else "NO_BILLING_PAIR" if not self.pairs else "NO_CONNECTION" if not seen["connection"] else "NO_LOOP" if not seen["legal"] else "NO_HANDOFF" if seen["handoff"] and not seen["late"] else "TIME_WINDOW"
        return out | {
            "status": "truncated" if budget.truncated else "ok" if chosen else "no_candidates", "reason": why, "ranking_mode": "shutoko_time" if time_only else "time_per_yen",
            "min_plan_seconds": min(plans, default=None) if not (budget.truncated or wide.truncated) else None, "expanded_states": budget.spent, "candidates": chosen,
        }


def search(graphs: DataFrame, requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The answer to each request, as RESULT. graphs: release_id, graph (JSON text); requests: release_id, request (JSON text).

    A network's requests are cut by a hash into slices of about REQUESTS, each with its network, so that
    a network that most requests go to is searched by many tasks. A request whose release is unknown
    gives no row; an invalid one gives a row that says why.
    """
    slices = requests.groupBy("release_id").agg(F.ceil(F.count("*") / F.lit(REQUESTS)).cast("int").alias("slices"))
    dealt = requests.join(slices, "release_id").withColumn("slice", F.pmod(F.xxhash64("request"), F.col("slices")).cast("int")).select("release_id", "slice", "request")
    wanted = graphs.join(slices, "release_id").select(F.col("release_id").alias("graph_release"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("graph_slice"), "graph")

    def run(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(asked):
            return pd.DataFrame(columns=names)
        prepared = Prepared(json.loads(graph["graph"].iloc[0]), limits)
        return pd.DataFrame([prepared.answer(json.loads(r)) for r in asked["request"]], columns=names).astype({"min_plan_seconds": "Int64"})

    names = [x.split(" ")[0] for x in RESULT.split(", candidates")[0].split(", ")] + ["candidates"]
    return wanted.groupBy("graph_release", "graph_slice").cogroup(dealt.groupBy("release_id", "slice")).applyInPandas(run, RESULT)


def per_network(graphs: DataFrame, shape: str, run) -> DataFrame:
    """Rows that run(Prepared) yields as tuples for each network, with its release_id first."""
    names = [x.strip().split(" ")[0] for x in shape.split(",")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0):  # one at a time: a batch may hold all networks of a partition
                prepared = Prepared(json.loads(text.as_py()))
                rows = [(prepared.release, *r) for r in run(prepared)]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(["release_id", *names], r, strict=True)) for r in rows], schema=kind)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"release_id string, {shape}"
    kind = to_arrow_schema(_parse_datatype_string(schema))
    return graphs.select("graph").mapInArrow(work, schema)
