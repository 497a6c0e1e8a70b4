"""Trees of ramps follow the ramps, not the pairs of them that requests name."""

from orbitway.operators.paths import Network
from orbitway.operators.tiers import Junctions

from tests.test_tiers import REQUEST, rings


def test_a_tree_for_each_ramp(monkeypatch):
    """Twelve rings in a row, and requests from each to all that follow: 66 pairs."""
    graph = rings(12)
    graph["edges"] += [{"id": f"on{b}", "from": f"r{b}3", "to": f"r{b + 1}0", "kind": "shutoko", "durationSeconds": 60, "distanceMeters": 1000} for b in range(11)]
    made, tree = [], Network.tree
    monkeypatch.setattr(Network, "tree", lambda *a, **k: made.append(a[1]) or tree(*a, **k))
    j = Junctions(graph)
    out = [j.answer(REQUEST | {"entryRampId": f"in{a}", "exitRampId": f"out{b}3", "minMinutes": 120}) for a in range(12) for b in range(a + 1, 12)]
    # The ring at the exit: three edges on, or once around and then three edges on, are both over; the entry's tree settles all rings from its own on.
    assert {(x["reason"], x["expanded_states"] - 6 * (12 - a)) for x, a in zip(out, (a for a in range(12) for _ in range(a + 1, 12)), strict=True)} == {("TIME_WINDOW", 6 * n) for n in range(2, 13)}
    assert len(made) <= 12 * 6 + 12 + 12
