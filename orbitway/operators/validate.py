"""Structure of a graph document: the first rule that it breaks."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from orbitway.operators.paths import MAINLINE

#: Most seconds and metres of an edge, most edges of a forbidden sequence, most bytes of an id.
MOST_SECONDS, MOST_METERS, MOST_SEQUENCE, MOST_ID = 86_400, 10_000_000, 2_000, 256


def _named(x) -> bool:
    return isinstance(x, str) and 0 < len(x.encode()) <= MOST_ID


def _broken(g: dict) -> Iterator[str]:
    if g.get("schemaVersion") not in (2, 3, 4) or not _named(g.get("releaseId")) or not _named(g.get("vehicleProfile")):
        yield "header"
    nodes = Counter(n["id"] for n in g["nodes"])
    if any(not _named(x) or k > 1 for x, k in nodes.items()):
        yield "node id"
    if any(not (math.isfinite(n["lat"]) and math.isfinite(n["lon"]) and abs(n["lat"]) <= 90 and abs(n["lon"]) <= 180) for n in g["nodes"]):
        yield "node place"
    edges = {e["id"]: e for e in g["edges"]}
    if len(edges) < len(g["edges"]) or any(
        not _named(e["id"]) or e["from"] not in nodes or e["to"] not in nodes or not 0 < e["durationSeconds"] <= MOST_SECONDS or not 0 < e["distanceMeters"] <= MOST_METERS for e in g["edges"]
    ):
        yield "edge"
    for s in g.get("forbiddenTransitions") or []:
        if not 2 <= len(s) <= MOST_SEQUENCE or any(x not in edges for x in s) or any(edges[a]["to"] != edges[b]["from"] for a, b in zip(s, s[1:], strict=False)):
            yield "forbidden sequence"
    seen = set()
    for p in g.get("billingPairs") or []:
        if not _named(p["id"]) or p["id"] in seen or p.get("vehicleProfile", g["vehicleProfile"]) != g["vehicleProfile"] or p["anchorNodeId"] not in nodes:
            yield "pair"
        seen.add(p["id"])
        before, after = p["entryToAnchorEdgeIds"], p["anchorToExitEdgeIds"]
        if not before or not after or any(x not in edges for x in [*before, *after]):
            yield "pair path"
            continue
        way = [edges[x] for x in [*before, *after]]
        kinds = [e["kind"] for e in way]
        ends = before[0] == p["entryId"] and after[-1] == p["exitId"] and kinds == ["entry", *[MAINLINE] * (len(way) - 2), "exit"]
        joined = all(a["to"] == b["from"] for a, b in zip(way, way[1:], strict=False)) and edges[before[-1]]["to"] == p["anchorNodeId"]
        if not ends or not joined:
            yield "pair path"
        if len({way[0]["from"], *(e["to"] for e in way)}) <= len(way):
            yield "pair path has a lap"
        prices = sorted((x["effectiveFrom"], x.get("effectiveTo")) for x in p.get("prices") or [])
        if any(not x["amountYen"] for x in p.get("prices") or []) or any(b is not None and b <= a for a, b in prices):
            yield "price"
        if any(b is None or b > c for (_, b), (c, _) in zip(prices, prices[1:], strict=False)):
            yield "prices overlap"


def graph_violation(graph: dict) -> str | None:
    """The first broken rule, in the order in which a graph is read: header, nodes, edges, sequences, pairs; None if all hold."""
    return next(_broken(graph), None)
