"""The search on a small network whose answers are known, and path operators against plain versions."""

import itertools
import json
import random

import pytest

from orbitway.operators.paths import MAINLINE, Budget, Edge, Limits, Network, meters, seconds, too_alike
from orbitway.operators.search import Prepared, candidate_id, maps_url, search, with_buffer

GRAPH = {
    "schemaVersion": 2, "releaseId": "r1", "vehicleProfile": "etc",
    "nodes": [{"id": i, "lat": a, "lon": o} for i, a, o in (("i", 35.6815, 139.7675), ("a", 35.682, 139.768), ("b", 35.683, 139.77), ("c", 35.6825, 139.771), ("o", 35.6818, 139.7685))],
    "edges": [{"id": n, "from": a, "to": b, "kind": k, "durationSeconds": s, "distanceMeters": m} for n, a, b, k, s, m in (
        ("entry", "i", "a", "entry", 30, 200), ("ab", "a", "b", "shutoko", 600, 10000), ("bc", "b", "c", "shutoko", 600, 10000), ("ca", "c", "a", "shutoko", 600, 10000), ("exit", "a", "o", "exit", 30, 200))],
    "billingPairs": [{"id": "one-section", "entryId": "entry", "exitId": "exit", "anchorNodeId": "a", "entryToAnchorEdgeIds": ["entry"], "anchorToExitEdgeIds": ["exit"], "status": "verified",
                      "prices": [{"amountYen": 300, "effectiveFrom": "2026-01-01T00:00:00Z", "effectiveTo": "2026-10-01T00:00:00Z"}]}],
    "forbiddenTransitions": [],
}
REQUEST = {"requestId": "q", "releaseId": "r1", "vehicleProfile": "etc", "originNodeId": "i", "minMinutes": 30, "maxMinutes": 40, "pricingAt": "2026-09-10T00:00:00Z"}


def graph(**changes):
    out = json.loads(json.dumps(GRAPH))
    for k, v in changes.items():
        out[k] = v
    return out


def answer(g=None, **changes):
    return Prepared(g or GRAPH).answer(REQUEST | changes)


def test_known_answer():
    out = answer()
    assert (out["status"], out["reason"], out["ranking_mode"], len(out["candidates"])) == ("ok", None, "time_per_yen", 1)
    c = out["candidates"][0]
    assert c["edge_ids"] == ["entry", "ab", "bc", "ca", "exit"]
    assert [c[k] for k in ("access_seconds", "shutoko_seconds", "return_seconds", "base_seconds", "buffer_seconds", "plan_seconds")] == [0, 1860, 16, 1876, 376, 2252]
    assert (c["distance_meters"], c["amount_yen"], c["reasons"]) == (30400, 300, ["BEST_TIME_PER_YEN", "ONE_SECTION_TOLL"])
    assert out["min_plan_seconds"] == 2252


def test_window_bounds():
    assert answer(minMinutes=31)["status"] == "ok"
    assert answer(minMinutes=32)["reason"] == "TIME_WINDOW"
    assert answer(maxMinutes=37)["reason"] == "TIME_WINDOW"
    for duration, status in ((154, "ok"), (155, "no_candidates")):
        g = graph()
        g["edges"][0]["durationSeconds"] = duration
        assert answer(g)["status"] == status
    assert with_buffer(1500) == (300, 1800) and with_buffer(1501) == (301, 1802)


@pytest.mark.parametrize("at, yen", [("2025-12-31T23:59:59Z", None), ("2026-01-01T00:00:00Z", 300), ("2026-09-30T23:59:59Z", 300), ("2026-10-01T00:00:00Z", 400)])
def test_prices(at, yen):
    g = graph()
    g["billingPairs"][0]["prices"].append({"amountYen": 400, "effectiveFrom": "2026-10-01T00:00:00Z"})
    out = answer(g, pricingAt=at)
    assert out["candidates"][0]["amount_yen"] == yen
    assert out["ranking_mode"] == ("shutoko_time" if yen is None else "time_per_yen")


@pytest.mark.parametrize("path", ["entry>ab", "ab>bc", "bc>ca", "ca>exit", "bc>ca>exit"])
def test_forbidden_sequences(path):
    out = answer(graph(forbiddenTransitions=[path.split(">")]))
    assert out["candidates"] == [] and out["reason"] == "NO_LOOP"


def test_simple_cycles():
    g = graph()
    g["edges"] += [{"id": n, "from": n[0], "to": n[1], "kind": "shutoko", "durationSeconds": 600, "distanceMeters": 10000} for n in ("ba", "ac")]
    p = Prepared(g)
    assert sorted([e.id for e in x] for x in p.network.loops("a", 14400, Limits(), Budget(10**6))) == [["ab", "ba"], ["ab", "bc", "ca"], ["ac", "ca"]]


@pytest.mark.parametrize("changes, reason", [
    ({"releaseId": "x"}, "incompatible"), ({"originNodeId": None}, "either origin"), ({"origin": {"lat": 35.0, "lon": 139.0}}, "either origin"), ({"maxMinutes": 241}, "time window"), ({"minMinutes": 0}, "time window"),
    ({"minMinutes": 41}, "time window"), ({"pricingAt": "2026-09-10"}, "invalid timestamp"), ({"originNodeId": "zz"}, "unknown origin"), ({"originNodeId": None, "origin": {"lat": 91.0, "lon": 0.0}}, "coordinates"),
])
def test_invalid_requests(changes, reason):
    out = answer(**changes)
    assert out["status"] == "invalid" and out["reason"].startswith(reason)


def test_other_reasons():
    assert answer(originNodeId="b")["reason"] == "NO_CONNECTION"
    assert answer(graph(billingPairs=[]))["reason"] == "NO_BILLING_PAIR"
    assert answer(originNodeId=None, origin={"lat": 36.5, "lon": 139.7})["reason"] == "NO_CONNECTION"
    assert answer(originNodeId=None, origin={"lat": 35.6815, "lon": 139.7675})["status"] == "ok"
    assert Prepared(GRAPH, Limits(states=2)).answer(REQUEST)["reason"] == "SEARCH_LIMIT"
    assert Prepared(GRAPH, Limits(loop_meters=30_001)).answer(REQUEST)["reason"] == "NO_LOOP"


def test_ids_and_addresses():
    assert candidate_id(["p", "日本"]) == "1:p6:日本"
    assert maps_url({"lat": 1, "lon": 2}, [{"lat": 3, "lon": 4}, {"lat": 5, "lon": 6.5}]).endswith("destination=1.000000,2.000000&travelmode=driving&waypoints=3.000000,4.000000%7C5.000000,6.500000")
    assert maps_url({"lat": 1, "lon": 2}, [{"lat": 3, "lon": 4}] * 100) is None


def test_many_requests_in_slices(spark, monkeypatch):
    from orbitway.operators import search as module

    monkeypatch.setattr(module, "REQUESTS", 4)
    rows = [("r1", json.dumps(REQUEST | {"requestId": str(i), "minMinutes": 30 + i % 3})) for i in range(30)] + [("r9", json.dumps(REQUEST))]
    out = search(spark.createDataFrame([("r1", json.dumps(GRAPH))], "release_id string, graph string"), spark.createDataFrame(rows, "release_id string, request string"))
    got = {r["request_id"]: r["status"] for r in out.collect()}
    assert got == {str(i): "ok" if i % 3 < 2 else "no_candidates" for i in range(30)}


def random_network(seed, n=7, m=16):
    pick = random.Random(seed)
    ends = [(str(pick.randrange(n)), str(pick.randrange(n))) for _ in range(m)]
    edges = {f"e{i:02}": Edge(f"e{i:02}", a, b, MAINLINE, pick.randint(1, 9), 1000 * pick.randint(1, 9)) for i, (a, b) in enumerate(ends) if a != b}
    barred = [tuple(pick.choice(sorted(edges)) for _ in range(pick.choice([2, 3]))) for _ in range(6)]
    return Network(edges, barred)


def all_loops(net, anchor):
    found = []

    def go(path, node):
        for e in net.edges.values():
            if e.source == node:
                ids = tuple(x.id for x in [*path, e])
                if any(ids[i : i + len(s)] == s for s in net.forbidden for i in range(len(ids))):
                    continue
                if e.target == anchor:
                    found.append([x.id for x in [*path, e]])
                elif e.target not in {x.target for x in path}:
                    go([*path, e], e.target)

    go([], anchor)
    return found


@pytest.mark.parametrize("seed", range(12))
def test_paths_against_plain_versions(seed):
    net = random_network(seed)
    nodes = sorted({n for e in net.edges.values() for n in (e.source, e.target)})
    far = {(a, b): (0 if a == b else 10**9) for a in nodes for b in nodes}
    for e in net.edges.values():
        far[e.source, e.target] = min(far[e.source, e.target], e.seconds)
    for k, a, b in itertools.product(nodes, repeat=3):
        far[a, b] = min(far[a, b], far[a, k] + far[k, b])
    parts = net.components()
    for a in nodes:
        cost, via, _ = net.tree(a)
        assert cost == {b: far[a, b] for b in nodes if far[a, b] < 10**9}
        back, home, _ = net.tree(a, backward=True)
        assert back == {b: far[b, a] for b in nodes if far[b, a] < 10**9}
        assert all(seconds(net.route(via, b, a)) == cost[b] for b in cost) and all(seconds(net.route(home, b, a, backward=True)) == back[b] for b in back)
        assert net.reached(a, 9) == {b for b in cost if cost[b] <= 9}
        assert {b for b in nodes if parts[b][0] == parts[a][0]} == {b for b in nodes if far[a, b] < 10**9 and far[b, a] < 10**9}
        loops = all_loops(net, a)
        got = net.loops(a, 10**6, Limits(loop_meters=0, beam=10**6), Budget(10**9))
        assert sorted([e.id for e in x] for x in got) == sorted(loops)
        assert all([e.id for e in x] in loops for x in net.catalogue(a)[0])
        if loops:
            assert net.closed_walk(a)


def test_likeness_is_inclusive():
    a = [Edge(str(i), "", "", MAINLINE, 1, 100) for i in range(9)]
    b = [*a[:8], Edge("x", "", "", MAINLINE, 1, 100)]
    assert too_alike(a, b) and meters(a) == 900
    assert not too_alike(a, [*a[:7], *b[-1:], Edge("y", "", "", MAINLINE, 1, 100)])
