"""Searches between ramps: what each tier gives, in order, and all routes of a pair against paths that are written out."""

import json
import random

import pytest

from orbitway.operators.paths import Limits, meters, seconds
from orbitway.operators.tiers import Junctions, search_ramps

REQUEST = {"requestId": "q", "releaseId": "r", "vehicleProfile": "car", "origin": {"lat": 35.0, "lon": 139.0}, "minMinutes": 1, "maxMinutes": 120, "pricingAt": "2026-05-01T00:00:00Z"}


def rings(blocks, pairs=(), open_=(), exits=(3,), facility=None, prices=({"amountYen": 300, "effectiveFrom": "2026-01-01T00:00:00Z", "effectiveTo": None},)):
    """Rings of six edges of a kilometre and a minute, ever farther from the origin, with an entry at the first node and exits at others."""
    nodes, edges, ramps, paid = [], [], [], []
    for b in range(blocks):
        spot = {"lat": 35.0 + 0.01 * b, "lon": 139.0}
        nodes += [{"id": f"r{b}{i}", **spot} for i in range(6)] + [{"id": f"i{b}", **spot}] + [{"id": f"o{b}{x}", **spot} for x in exits]
        edges += [{"id": f"e{b}{i}", "from": f"r{b}{i}", "to": f"r{b}{(i + 1) % 6}", "kind": "shutoko", "durationSeconds": 60, "distanceMeters": 1000} for i in range(5 if b in open_ else 6)]
        edges += [{"id": f"en{b}", "from": f"i{b}", "to": f"r{b}0", "kind": "entry", "durationSeconds": 30, "distanceMeters": 200}]
        edges += [{"id": f"ex{b}{x}", "from": f"r{b}{x}", "to": f"o{b}{x}", "kind": "exit", "durationSeconds": 30, "distanceMeters": 200} for x in exits]
        ramps += [{"id": f"in{b}", "kind": "general_entry", "nodeId": f"i{b}", "mainlineNodeId": f"r{b}0", "edgeId": f"en{b}", "facilityId": f"f{b}", "name": "x"}]
        ramps += [{"id": f"out{b}{x}", "kind": "general_exit", "nodeId": f"o{b}{x}", "mainlineNodeId": f"r{b}{x}", "edgeId": f"ex{b}{x}", "facilityId": f"f{b}" if facility is None else facility, "name": "y"} for x in exits]
    for k, b in enumerate(pairs):
        x = exits[0]
        paid += [{"id": f"p{k}{b}", "entryId": f"en{b}", "exitId": f"ex{b}{x}", "entryRampId": f"in{b}", "exitRampId": f"out{b}{x}", "anchorNodeId": f"r{b}0", "entryToAnchorEdgeIds": [f"en{b}"], "anchorToExitEdgeIds": [f"e{b}{i}" for i in range(x)] + [f"ex{b}{x}"], "status": "verified", "vehicleProfile": "car", "prices": list(prices)}]
    return {"schemaVersion": 2, "releaseId": "r", "vehicleProfile": "car", "nodes": nodes, "edges": edges, "ramps": ramps, "billingPairs": paid, "odTariffs": [{"entryRampId": "in0", "exitRampId": "out03", "amountYen": 777, "effectiveFrom": "2026-01-01T00:00:00Z", "effectiveTo": "2026-06-01T00:00:00Z"}], "forbiddenTransitions": []}


def ask(graph, limits=Limits(), **more):
    return Junctions(graph, limits).answer(REQUEST | more)


def test_first_productive_tier():
    """A nearest entry without a loop lets the next one answer; one with verified pairs answers by their loops."""
    out = ask(rings(3, pairs=(1,), open_=(0,)))
    assert (out["status"], out["ranking_mode"], [c["pair_id"] for c in out["candidates"]]) == ("ok", "time_per_yen", ["p01"])
    best = out["candidates"][0]
    assert best["edge_ids"] == ["en1", *(f"e1{i}" for i in range(6)), "e10", "e11", "e12", "ex13"] and best["loop_edge_ids"] == [f"e1{i}" for i in range(6)]
    assert (best["shutoko_seconds"], best["shutoko_meters"], best["distance_meters"], best["amount_yen"], best["toll_source"]) == (600, 9400, 9400, 300, "pair")
    assert best["reasons"] == ["BEST_TIME_PER_YEN", "ONE_SECTION_TOLL"] and best["access_seconds"] == best["return_seconds"] > 0
    assert best["base_seconds"] == best["access_seconds"] * 2 + 600 and best["plan_seconds"] == best["base_seconds"] + 300 == out["min_plan_seconds"]


def test_dynamic_tier():
    out = ask(rings(2, exits=(1, 2, 3, 4)))
    assert out["status"] == "ok" and out["ranking_mode"] == "shutoko_time"
    # Two exits by id, of which the routes share four fifths of their metres.
    assert [c["exit_ramp"] for c in out["candidates"]] == ["out02"] and out["candidates"][0]["reasons"] == ["TOPOLOGY_ONLY"]
    best = out["candidates"][0]
    assert best["pair_kind"] == "topologyOnly" and best["pair_id"] == "od:in0:out02" and best["amount_yen"] is None and best["toll_source"] == "unknown"
    assert best["distance_meters"] == best["shutoko_meters"] == 8400 and best["access_seconds"] == 0
    assert best["id"] == "3:in05:out02" + "".join(f"{len(x)}:{x}" for x in best["edge_ids"])


def test_tariffs_of_pairs_and_places():
    explicit = {"entryRampId": "in0", "exitRampId": "out03"}
    assert [ask(rings(1), **explicit, pricingAt=f"2026-{m}-01T00:00:00Z")["candidates"][0]["amount_yen"] for m in ("05", "06", "12")] == [777, None, None]
    got = ask(rings(1, pairs=(0,)), **explicit)["candidates"][0]
    assert (got["amount_yen"], got["toll_source"], got["pair_id"], got["reasons"]) == (300, "pair", "p00", ["TOPOLOGY_ONLY", "EXPLICIT_OD"])
    assert ask(rings(2, pairs=(0, 1), prices=()))["candidates"][0]["toll_source"] == "od"
    assert ask(rings(2, pairs=(0, 1), prices=()), pricingAt="2026-07-01T00:00:00Z")["candidates"][0]["reasons"] == ["BEST_SHUTOKO_TIME", "ONE_SECTION_TOLL"]


@pytest.mark.parametrize(
    "graph, more, want",
    [
        (rings(2, pairs=(0, 1)), {"minMinutes": 60}, ("no_candidates", "TIME_WINDOW", 900)),  # the nearest entry has a loop: no farther one is tried
        (rings(2), {"minMinutes": 60}, ("no_candidates", "TIME_WINDOW", 900)),
        (rings(2, open_=(0, 1)), {}, ("no_candidates", "NO_LOOP", None)),
        (rings(2, facility="g"), {}, ("no_candidates", "NO_LOOP", None)),  # no exit of its place, and none of a pair
        (rings(1), {"origin": {"lat": 45.0, "lon": 139.0}}, ("no_candidates", "NO_CONNECTION", None)),
        (rings(1), {"origin": None, "originNodeId": "i0"}, ("ok", None, 900)),
        (rings(1), {"origin": None, "originNodeId": "r00"}, ("no_candidates", "NO_CONNECTION", None)),
        (rings(1), {"origin": None, "entryRampId": "in0"}, ("ok", None, 900)),
        (rings(2), {"exitRampId": "out13"}, ("ok", None, None)),
        (rings(1), {"entryRampId": "in0", "exitRampId": "out03"}, ("ok", None, 900)),
        (rings(1), {"entryRampId": "in0", "exitRampId": "out03", "minMinutes": 60}, ("no_candidates", "TIME_WINDOW", 900)),
        (rings(2), {"entryRampId": "in0", "exitRampId": "out13"}, ("no_candidates", "NO_LOOP", None)),
        (rings(1), {"entryRampId": "out03", "exitRampId": "out03"}, ("invalid", "unknown entry ramp id", None)),
        (rings(1), {"exitRampId": "in0"}, ("invalid", "unknown exit ramp id", None)),
        (rings(1), {"origin": None}, ("invalid", "either origin or originNodeId must be provided", None)),
        (rings(1), {"releaseId": "x"}, ("invalid", "incompatible release or vehicle profile", None)),
        (rings(1, pairs=(0,) * 11), {}, ("truncated", "SEARCH_LIMIT", None)),
    ],
)
def test_outcomes(graph, more, want):
    out = ask(graph, **more)
    plan = out["min_plan_seconds"]
    assert (out["status"], out["reason"], plan if want[2] is not None or want[0] != "ok" else None) == want
    if more.get("exitRampId") == "out13" and "entryRampId" not in more:
        assert out["candidates"][0]["entry_ramp"] == "in1"


@pytest.mark.parametrize("states", [0, 3, 11])
def test_budgets_cut_short(states):
    for more in ({}, {"entryRampId": "in0", "exitRampId": "out03"}):
        out = ask(rings(2), Limits(states=states), **more)
        assert (out["status"], out["reason"], out["candidates"]) == ("truncated", "SEARCH_LIMIT", [])
    assert ask(rings(2, pairs=(0, 1)), Limits(states=states))["status"] == ("truncated" if states < 7 else "ok")


def test_fallback_to_exits_of_pairs():
    """An entry without an exit of its place takes those of verified pairs, two at most."""
    graph = rings(2, pairs=(1,), facility="g")
    graph["edges"] += [{"id": "on", "from": "r03", "to": "r10", "kind": "shutoko", "durationSeconds": 60, "distanceMeters": 1000}]
    out = ask(graph, entryRampId="in0")
    assert [(c["entry_ramp"], c["exit_ramp"]) for c in out["candidates"]] == [("in0", "out13")]


@pytest.mark.parametrize("seed", range(40))
def test_routes_against_written_paths(seed):
    pick = random.Random(seed)
    n = pick.randrange(4, 9)
    nodes = [{"id": f"n{i}", "lat": 35.0, "lon": 139.0} for i in range(n)] + [{"id": "i", "lat": 35.0, "lon": 139.0}, {"id": "o", "lat": 35.0, "lon": 139.0}]
    edges = [{"id": f"e{i:02}", "from": f"n{pick.randrange(n)}", "to": f"n{pick.randrange(n)}", "kind": "shutoko", "durationSeconds": pick.randrange(1, 9), "distanceMeters": 1000} for i in range(pick.randrange(n, 3 * n))]
    edges += [{"id": "en", "from": "i", "to": "n0", "kind": "entry", "durationSeconds": 3, "distanceMeters": 10}, {"id": "ex", "from": "n1", "to": "o", "kind": "exit", "durationSeconds": 4, "distanceMeters": 10}]
    ids = [e["id"] for e in edges]
    barred = [[pick.choice(ids) for _ in range(pick.choice([2, 3, 4]))] for _ in range(pick.randrange(12))]
    ramps = [{"id": "in", "kind": "general_entry", "nodeId": "i", "mainlineNodeId": "n0", "edgeId": "en", "facilityId": "f"}, {"id": "out", "kind": "general_exit", "nodeId": "o", "mainlineNodeId": "n1", "edgeId": "ex", "facilityId": "f"}]
    j = Junctions({"releaseId": "r", "vehicleProfile": "car", "nodes": nodes, "edges": edges, "ramps": ramps, "billingPairs": [], "forbiddenTransitions": barred}, Limits(loop_meters=0))
    net, found = j.network, j.routes(j.ramps["in"], j.ramps["out"])
    there, via, _ = net.tree("n0")
    back, home, settled = net.tree("n1", backward=True, within=set(there))
    parts = net.components()
    want = []
    for anchor in sorted((x for x in there if x in back and x in parts and parts[x][1]), key=lambda x: (there[x] + back[x], x)):
        for loop in net.catalogue(anchor)[0]:
            path = [net.edges["en"], *net.route(via, anchor, "n0"), *loop, *net.route(home, anchor, "n1", backward=True), net.edges["ex"]]
            text = ",".join(["", *(e.id for e in path), ""])
            if not any("," + ",".join(s) + "," in text for s in barred):
                want.append((seconds(path), anchor, [e.id for e in loop], [e.id for e in path]))
    got = [(s, a, [e.id for e in loop], [e.id for e in j.written(j.ramps["in"], j.ramps["out"], a, loop)]) for s, a, loop in found.legal]
    assert got == want and found.spent == settled and all(meters(x[2]) == 1000 * len(x[2]) for x in found.legal)


def test_large_components_have_spaced_anchors():
    graph = rings(1)
    graph["nodes"] += [{"id": f"z{i:03}", "lat": 35.0, "lon": 139.0} for i in range(100)]
    graph["edges"] += [{"id": f"z{i:03}", "from": f"z{i:03}", "to": f"z{(i + 1) % 100:03}", "kind": "shutoko", "durationSeconds": 1, "distanceMeters": 100} for i in range(100)]
    anchors = list(Junctions(graph).anchors)
    assert [x for x in anchors if x[0] == "r"] == [f"r0{i}" for i in range(6)]
    assert [x for x in anchors if x[0] == "z"] == [f"z{k * 99 // 31:03}" for k in range(32)]


def test_in_slices(spark, monkeypatch):
    from orbitway.operators import search as module

    monkeypatch.setattr(module, "REQUESTS", 4)
    asked = [("r", json.dumps(REQUEST | {"requestId": str(i), "minMinutes": 1 + 59 * (i % 2)})) for i in range(20)] + [("other", json.dumps(REQUEST))]
    out = search_ramps(spark.createDataFrame([("r", json.dumps(rings(2)))], "release_id string, graph string"), spark.createDataFrame(asked, "release_id string, request string"))
    assert {r["request_id"]: r["status"] for r in out.collect()} == {str(i): "no_candidates" if i % 2 else "ok" for i in range(20)}


def test_a_network_is_let_go():
    """A worker that is done with a network keeps nothing of it."""
    import weakref

    prepared = Junctions(rings(2, pairs=()))
    for name in prepared.ramps:
        prepared._exits_of(name, None)
    gone = weakref.ref(prepared)
    del prepared
    assert gone() is None
