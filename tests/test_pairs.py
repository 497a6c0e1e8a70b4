"""Direct paths, pairs made of seeds, and every fault that a pair can have."""

import itertools
import random

import pytest

from orbitway.operators import pairs
from orbitway.operators.paths import MAINLINE, Edge, Network
from orbitway.plans.pair_queries import FAULTS, wrong


def ring(bars=(), closed=True, exits=(2, 3)):
    """A ring of five nodes with an entry at the first and exits at others."""
    edges = [Edge(f"e:w{i}:0", f"n:{i}", f"n:{(i + 1) % 5}", MAINLINE, 10, 1000) for i in range(5 if closed else 4)]
    edges += [Edge("e:w100:0", "n:50", "n:0", "entry", 5, 100), Edge("e:w100:1", "n:51", "n:0", "entry", 5, 100)]
    edges += [Edge(f"e:w{200 + x}:{k}", f"n:{x}", f"n:{60 + x}", "exit", 5, 100) for x in exits for k in (0, 1)]
    return Network({e.id: e for e in edges}, [tuple(b) for b in bars])


NODES = {f"n:{i}" for i in [*range(5), 50, 51, 62, 63]}
SEED = {"id": "p", "status": "verified", "oneSectionAheadVerified": True, "source": "https://a.example/x", "sourceDate": "2026-02-03", "entryWay": 100, "exitWay": 202, "anchorNode": 1, "vehicleProfile": "car", "prices": [{"amountYen": 300, "effectiveFrom": "2026-01-01T00:00:00Z", "effectiveTo": None}]}


def make(net=None, **more):
    return pairs.generate(net or ring(), NODES, "car", SEED | more)


def test_a_pair():
    outcome, pair = make()
    assert outcome == "ok" and pair["entryToAnchorEdgeIds"] == ["e:w100:0", "e:w0:0"] and pair["anchorToExitEdgeIds"] == ["e:w1:0", "e:w202:1"]
    assert (pair["entryId"], pair["exitId"], pair["anchorNodeId"]) == ("e:w100:0", "e:w202:1", "n:1")
    assert make(status="unverified", oneSectionAheadVerified=False)[0] == "ok"
    at_entry = make(anchorNode=0)[1]
    assert at_entry["entryToAnchorEdgeIds"] == ["e:w100:0"] and at_entry["anchorToExitEdgeIds"] == ["e:w0:0", "e:w1:0", "e:w202:1"]


@pytest.mark.parametrize(
    "net, more, outcome",
    [
        (None, {"oneSectionAheadVerified": False}, "UNVERIFIED_SECTION"), (None, {"source": "ftp://a.example"}, "INVALID_PROVENANCE"), (None, {"sourceDate": "2026-02-30"}, "INVALID_PROVENANCE"), (None, {"sourceDate": "2026-2-3"}, "INVALID_PROVENANCE"),
        (None, {"entryWay": 10}, "NO_ENTRY_EDGE"), (None, {"entryWay": 202}, "NO_ENTRY_EDGE"), (None, {"exitWay": 100}, "NO_EXIT_EDGE"), (None, {"anchorNode": 9}, "ANCHOR_NOT_FOUND"),
        (ring([("e:w100:0", "e:w0:0")]), {}, "NO_PATH_TO_ANCHOR"), (ring([("e:w0:0", "e:w1:0")]), {}, "NO_PATH_TO_EXIT"), (ring([("e:w0:0", "e:w1:0", "e:w202:1")]), {}, "NO_PATH_TO_EXIT"), (None, {"anchorNode": 3}, "NO_PATH_TO_EXIT"),
        (ring(closed=False), {}, "INVALID:NO_SHUTOKO_LOOP"), (None, {"exitWay": 203}, "INVALID:FIRST_EXIT_MISMATCH"), (None, {"exitWay": 203, "status": "unverified"}, "ok"), (None, {"prices": [{"amountYen": 0, "effectiveFrom": "2026-01-01T00:00:00Z"}]}, "INVALID:INVALID_PRICE_AMOUNT"),
        (None, {"vehicleProfile": "bus"}, "INVALID:VEHICLE_PROFILE_MISMATCH"), (None, {"id": ""}, "INVALID:ID_BOUNDS"),
    ],
)
def test_seeds_without_a_pair(net, more, outcome):
    assert make(net, **more)[0] == outcome


def test_every_fault():
    pair = make()[1]
    ids = {"shutoko": "e:w0:0", "entry": "e:w100:0", "exit": "e:w202:0"}
    codes = [pairs.fault(ring(), NODES, "car", wrong(pair, part, ids)) for part in range(FAULTS)]
    assert codes == [
        None, "ID_BOUNDS", "ID_BOUNDS", "VEHICLE_PROFILE_MISMATCH", "ANCHOR_NOT_FOUND", "EMPTY_PATH", "EMPTY_PATH", "EDGE_NOT_FOUND", "EDGE_NOT_FOUND", "ENTRY_EDGE_MISMATCH", "EXIT_EDGE_MISMATCH", "INVALID_EDGE_KIND", "INVALID_EDGE_KIND", "ANCHOR_CONNECTION_MISMATCH", "INVALID_EDGE_KIND",
        "INVALID_EDGE_KIND", "DISCONNECTED_PATH", "INVALID_PRICE_AMOUNT", "INVALID_PRICE_INTERVAL", "INVALID_PRICE_INTERVAL", "OVERLAPPING_PRICES", "OVERLAPPING_PRICES", "PRICE_LIMIT", None,
    ]
    check = lambda net=None, states=100, **more: pairs.fault(net or ring(), NODES, "car", pair | more, states)
    around = [f"e:w{i}:0" for i in (1, 2, 3, 4, 0, 1)]
    assert check(anchorToExitEdgeIds=[*around, "e:w202:1"]) == "HIDDEN_LOOP_OR_CYCLE"
    assert check(ring([("e:w0:0", "e:w1:0")])) == "FORBIDDEN_TRANSITION"
    assert check(ring(closed=False)) == "NO_SHUTOKO_LOOP"
    assert check(states=0) == "FIRST_EXIT_SEARCH_FAILED" and check(states=0, status="unverified") is None
    assert check(exitId="e:w203:0", anchorToExitEdgeIds=["e:w1:0", "e:w2:0", "e:w203:0"]) == "FIRST_EXIT_MISMATCH"
    assert check(exitId="e:w202:0", anchorToExitEdgeIds=["e:w1:0", "e:w202:0"]) is None  # an exit as near as the nearest
    assert check(entryToAnchorEdgeIds=["e:w100:0", "e:w4:0"]) == "ANCHOR_CONNECTION_MISMATCH"
    assert check(anchorToExitEdgeIds=["e:w1:0", "e:w100:0", "e:w202:1"]) == "INVALID_EDGE_KIND"


@pytest.mark.parametrize(
    "text, sound",
    [("2026-01-01T00:00:00Z", True), ("2026-01-01T00:00:00.123456789Z", True), ("2026-01-01T00:00:00+00:00", False), ("2026-02-29T00:00:00Z", False), ("2026-01-01", False), ("", False), (None, False), ("2026-01-01T24:00:00Z", False), ("2026-01-01T00:00:00." + "1" * 30 + "Z", False)],
)
def test_instants(text, sound):
    assert (pairs.instant(text) is not None) == sound


@pytest.mark.parametrize("url, sound", [("https://a.example", True), ("http://a.b.example:80/x", True), ("https://nodots", False), ("https://-a.example", False), ("https://a..b", False), ("https://a.example:99999", False), ("https://a.example:", False), ("https://a b.example", False), ("", False), (None, False)])
def test_addresses(url, sound):
    assert pairs.is_url(url) == sound


@pytest.mark.parametrize("seed", range(60))
def test_direct_paths(seed):
    """Without bars, the least of all paths by seconds, edges and ids; with bars, a path that holds none, and one where no quicker way was blocked."""
    pick = random.Random(seed)
    n = pick.randrange(3, 7)
    ends = [(f"n{pick.randrange(n)}", f"n{pick.randrange(n)}") for _ in range(pick.randrange(2, 14))]
    edges = [Edge(f"e{i:02}", a, b, MAINLINE, pick.randrange(1, 4), 1) for i, (a, b) in enumerate(ends) if a != b]
    bars = [tuple(pick.choice(edges).id for _ in range(2)) for _ in range(pick.randrange(3))] if edges else []
    without = {f"n{pick.randrange(n)}"} if pick.random() < 0.3 else set()

    def every(at, path, seen):
        if at == "n1":
            yield sum(e.seconds for e in path), len(path), [e.id for e in path]
            return
        for e in edges:
            if e.source == at and e.target not in seen and e.target not in without:
                yield from every(e.target, [*path, e], seen | {e.target})

    found = sorted(every("n0", [], {"n0"}))
    got = pairs.direct_path(Network({e.id: e for e in edges}), "n0", "n1", without=without)
    assert got == (found[0][2] if found else None) or found and got is not None and sum(1 for f in found if f[0] == found[0][0]) > 1 and [f for f in found if f[2] == got][0][0] == found[0][0]
    barred = pairs.direct_path(Network({e.id: e for e in edges}, bars), "n0", "n1", without=without)
    legal = [f for f in found if not any(f[2][i : i + 2] == list(b) for b in bars for i in range(len(f[2])))]
    assert barred is None or barred in [f[2] for f in legal]
    if found and found[0] in legal and len({f[0] for f in found}) == len(found):
        assert barred == found[0][2]


def test_bars_reach_over_the_ends():
    net = Network({e.id: e for e in (Edge("a", "0", "1", MAINLINE, 1, 1), Edge("b", "0", "1", MAINLINE, 5, 1), Edge("c", "1", "2", MAINLINE, 1, 1))}, [("in", "a"), ("c", "out"), ("in", "out")])
    assert pairs.direct_path(net, "0", "2") == ["a", "c"] and pairs.direct_path(net, "0", "2", before="in") == ["b", "c"]
    assert pairs.direct_path(net, "0", "2", after="out") is None and pairs.direct_path(net, "0", "0") == [] and pairs.direct_path(net, "0", "0", "in", "out") is None
    assert list(itertools.islice(net.out["0"], 2))[0].id == "a"


def test_of_equally_quick_paths_that_of_fewer_edges_wins():
    """Three edges and two lead to a node in 15 seconds; the way of two, which is found later, goes on."""
    hops = [("a", 0, 1, 5), ("b", 1, 2, 5), ("c", 2, 3, 5), ("d", 0, 4, 14), ("e", 4, 3, 1), ("f", 3, 5, 10)]
    net = Network({x: Edge(x, f"n:{a}", f"n:{b}", MAINLINE, s, 1000) for x, a, b, s in hops})
    assert pairs.direct_path(net, "n:0", "n:5") == ["d", "e", "f"]
