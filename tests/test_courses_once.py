"""What doesn't depend on a request is made once for all requests of a network."""

from orbitway.operators import search
from orbitway.operators.paths import too_alike


def _graph(n=40):
    nodes = [{"id": f"n{i}", "lat": 35.6 + i / 1000, "lon": 139.7} for i in range(n)] + [{"id": x, "lat": 35.6, "lon": 139.7} for x in "io"]
    edge = lambda x, a, b, kind, s, m: {"id": x, "from": a, "to": b, "kind": kind, "durationSeconds": s, "distanceMeters": m}
    edges = [edge(f"e{i}", f"n{i}", f"n{(i + 1) % n}", "shutoko", 60, 900) for i in range(n)] + [edge("c0", "n0", "n3", "shutoko", 150, 2000), edge("c9", "n9", "n30", "shutoko", 300, 9000)]
    edges += [edge("in", "i", "n0", "entry", 30, 200), edge("out", "n0", "o", "exit", 30, 200)]
    pair = {"id": "p", "entryId": "in", "exitId": "out", "anchorNodeId": "n0", "entryToAnchorEdgeIds": ["in"], "anchorToExitEdgeIds": ["out"], "status": "verified", "prices": []}
    return {"releaseId": "r", "vehicleProfile": "v", "nodes": nodes, "edges": edges, "billingPairs": [pair], "forbiddenTransitions": []}


def test_courses_are_made_once(monkeypatch):
    checked, legal = [], search.Network.legal
    prepared = search.Prepared(_graph())
    monkeypatch.setattr(search.Network, "legal", lambda self, path: checked.append(len(path)) or legal(self, path))
    ask = lambda k: {"requestId": str(k), "releaseId": "r", "vehicleProfile": "v", "origin": {"lat": 35.6 + k / 10_000, "lon": 139.7}, "minMinutes": 1, "maxMinutes": 100, "pricingAt": "2026-01-01T00:00:00Z"}
    answers = [prepared.answer(ask(k)) for k in range(20)]
    assert len(checked) == 4  # two chords, taken or not
    assert all(a["status"] == "ok" and a["candidates"] for a in answers)
    # A network of its own for each request gives the same.
    assert answers == [search.Prepared(_graph()).answer(ask(k)) for k in range(20)]
    edges = prepared.network.edges
    courses = list(prepared._courses.values())
    for a in courses:
        for b in courses:
            assert prepared.alike(a, b) == too_alike([edges[x] for x in a.edge_ids], [edges[x] for x in b.edge_ids])
