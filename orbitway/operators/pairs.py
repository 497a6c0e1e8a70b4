"""Billing pairs: from a seed's ways and anchor to the direct path between two ramps, and everything that may be wrong with a pair."""

from __future__ import annotations

import heapq
import re
from collections.abc import Collection
from datetime import date, datetime
from itertools import pairwise

from orbitway.operators.chains import EXIT_STATES, first_exits
from orbitway.operators.paths import MAINLINE, Edge, Network

#: Bytes of an id, and intervals of prices of a pair, at most.
ID_BYTES, PRICES = 256, 1000
_HOST = re.compile(r"[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+")


def is_url(text: str) -> bool:
    """An http address whose host has two labels or more, with a port of at most 65535 if it has one."""
    m = re.fullmatch(r"https?://([^/:\s]*)(:[^/\s]*)?(/\S*)?", text or "")
    return bool(m and _HOST.fullmatch(m[1]) and (m[2] is None or m[2][1:].isdecimal() and m[2].isascii() and int(m[2][1:]) <= 65535))


def is_date(text: str) -> bool:
    try:
        return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", text or "", re.ASCII)) and date.fromisoformat(text) is not None
    except ValueError:
        return False


def instant(text: str | None) -> datetime | None:
    """The instant of an RFC 3339 text in UTC, of at most 40 characters, that ends in Z."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?Z", text or "", re.ASCII) or len(text) > 40:
        return None
    try:
        return datetime.fromisoformat(re.sub(r"(\.\d{6})\d*", r"\1", text.upper()))
    except ValueError:
        return None


def direct_path(network: Network, start: str, goal: str, before: str | None = None, after: str | None = None, without: Collection[str] = ()) -> list[str] | None:
    """The quickest mainline path, by edge ids, that visits no node twice, none of `without`, and holds no barred sequence.

    before and after: edges that it follows and that follow it; sequences may run over them. Of equally
    quick paths the one of fewer edges comes first, then that of smaller ids. Only the first way to a
    node, in that order, is carried on, so that a path over a later one isn't found.
    """
    first = [before] if before else []
    legal = lambda ids: not any(tuple(ids[i : i + len(s)]) == s for i, x in enumerate(ids) for s in network.starts.get(x, ()))
    if start == goal:
        return [] if not (before and after) or legal([before, after]) else None
    queue: list[tuple[int, int, list[str], str]] = [(0, 0, [], start)]
    first_way: dict[str, tuple[int, int, list[str]]] = {}
    while queue:
        cost, n, path, node = heapq.heappop(queue)
        if node == goal:
            if after is None or legal([*first, *path, after]):
                return path
            continue
        if (cost, n, path) > first_way.get(node, (cost, n, path)):
            continue
        visited = {x for i in path for x in (network.edges[i].source, network.edges[i].target)}
        for e in network.out.get(node, ()):
            if e.kind != MAINLINE or e.target in without or e.target in visited or not legal([*first, *path, e.id]):
                continue
            way = (cost + e.seconds, n + 1, [*path, e.id])
            if e.target not in first_way or way < first_way[e.target]:
                first_way[e.target] = way
                heapq.heappush(queue, (*way, e.target))
    return None


def generate(network: Network, nodes: Collection[str], profile: str, seed: dict) -> tuple[str, dict | None]:
    """('ok', pair), or why the seed gives none.

    The entry is the first edge of the seed's entry way, the exit the last one of its exit way, by id. The
    path goes on from the entry to the anchor and, without a node of that part, from there to the exit.
    """
    if seed["status"] == "verified" and not seed["oneSectionAheadVerified"]:
        return "UNVERIFIED_SECTION", None
    if not is_url(seed["source"]) or not is_date(seed["sourceDate"]):
        return "INVALID_PROVENANCE", None
    of = lambda kind, way: sorted((e for e in network.edges.values() if e.kind == kind and e.id.startswith(f"e:w{way}:")), key=lambda e: e.id)
    entries, exits = of("entry", seed["entryWay"]), of("exit", seed["exitWay"])
    if not entries:
        return "NO_ENTRY_EDGE", None
    if not exits:
        return "NO_EXIT_EDGE", None
    way_in, way_out, anchor = entries[0], exits[-1], f"n:{seed['anchorNode']}"
    if anchor not in nodes:
        return "ANCHOR_NOT_FOUND", None
    to = direct_path(network, way_in.target, anchor, before=way_in.id, without={way_in.source})
    if to is None:
        return "NO_PATH_TO_ANCHOR", None
    passed = {way_in.source, way_in.target, *(x for i in to for x in (network.edges[i].source, network.edges[i].target))} - {anchor} | {way_out.target}
    fro = direct_path(network, anchor, way_out.source, before=[way_in.id, *to][-1], after=way_out.id, without=passed)
    if fro is None:
        return "NO_PATH_TO_EXIT", None
    pair = {
        "id": seed["id"], "entryId": way_in.id, "exitId": way_out.id, "anchorNodeId": anchor, "entryToAnchorEdgeIds": [way_in.id, *to], "anchorToExitEdgeIds": [*fro, way_out.id],
        "status": seed["status"], "vehicleProfile": seed["vehicleProfile"], "prices": seed["prices"],
    }
    wrong = fault(network, nodes, profile, pair)
    return ("ok", pair) if wrong is None else (f"INVALID:{wrong}", None)


def fault(network: Network, nodes: Collection[str], profile: str, pair: dict, states: int = EXIT_STATES) -> str | None:
    """The first thing that is wrong with a pair, as a code; None if nothing is."""
    named = [pair[k] for k in ("id", "entryId", "exitId", "anchorNodeId", "vehicleProfile")]
    if any(not x or len(x.encode()) > ID_BYTES for x in named):
        return "ID_BOUNDS"
    if pair["vehicleProfile"] != profile:
        return "VEHICLE_PROFILE_MISMATCH"
    anchor = pair["anchorNodeId"]
    if anchor not in nodes:
        return "ANCHOR_NOT_FOUND"
    parts = []
    for key in ("entryToAnchorEdgeIds", "anchorToExitEdgeIds"):
        if not pair[key]:
            return "EMPTY_PATH"
        if any(x not in network.edges for x in pair[key]):
            return "EDGE_NOT_FOUND"
        parts.append([network.edges[x] for x in pair[key]])
    return _path_fault(parts[0], parts[1], pair) or _place_fault(network, parts[0] + parts[1], pair, states) or price_fault(pair["prices"])


def _path_fault(to: list[Edge], fro: list[Edge], pair: dict) -> str | None:
    anchor = pair["anchorNodeId"]
    if to[0].id != pair["entryId"]:
        return "ENTRY_EDGE_MISMATCH"
    if to[0].kind != "entry" or any(e.kind != MAINLINE for e in to[1:]):
        return "INVALID_EDGE_KIND"
    if to[-1].target != anchor or fro[0].source != anchor:
        return "ANCHOR_CONNECTION_MISMATCH"
    if any(e.kind != MAINLINE for e in fro[:-1]):
        return "INVALID_EDGE_KIND"
    if fro[-1].id != pair["exitId"]:
        return "EXIT_EDGE_MISMATCH"
    if fro[-1].kind != "exit":
        return "INVALID_EDGE_KIND"
    if any(a.target != b.source for part in (to, fro) for a, b in pairwise(part)):
        return "DISCONNECTED_PATH"
    visited = [to[0].source, *(e.target for e in to + fro)]
    return "HIDDEN_LOOP_OR_CYCLE" if len(set(visited)) < len(visited) else None


def _place_fault(network: Network, path: list[Edge], pair: dict, states: int) -> str | None:
    if not network.legal(path):
        return "FORBIDDEN_TRANSITION"
    if not network.closed_walk(pair["anchorNodeId"]):
        return "NO_SHUTOKO_LOOP"
    if pair["status"] == "verified":
        roads = [(e.id, e.source, e.target, e.meters) for e in network.edges.values() if e.kind == MAINLINE]
        exits = [(e.id, e.source, e.meters) for e in network.edges.values() if e.kind == "exit"]
        outcome, _, nearest = first_exits(roads, exits, network.forbidden, pair["anchorNodeId"], states)
        if outcome != "ok":
            return "FIRST_EXIT_SEARCH_FAILED"
        if pair["exitId"] not in nearest:
            return "FIRST_EXIT_MISMATCH"
    return None


def price_fault(prices: list[dict]) -> str | None:
    """Prices of over 0 yen in half-open intervals that don't overlap; one without an end is the last."""
    if len(prices) > PRICES:
        return "PRICE_LIMIT"
    spans = []
    for p in prices:
        start, end = instant(p["effectiveFrom"]), instant(p.get("effectiveTo"))
        if p["amountYen"] == 0:
            return "INVALID_PRICE_AMOUNT"
        if start is None or p.get("effectiveTo") is not None and (end is None or end <= start):
            return "INVALID_PRICE_INTERVAL"
        spans.append((start, end))
    spans.sort(key=lambda s: s[0])
    return "OVERLAPPING_PRICES" if any(end is None or end > start for (_, end), (start, _) in pairwise(spans)) else None
