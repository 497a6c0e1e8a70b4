"""Searches and rounds within a ring need no rounds of joins over all rings: the jobs of a query don't grow with the length of a way."""

import random

from orbitway.operators import carriageways as ways
from orbitway.plans import carriageway_queries


def _rings(spark, rings=3, n=50):
    rows = [(f"r{k}", f"f{i:02}", i, (i + 1) % n, 900, "s", i, "inner" if i >= k else None) for k in range(rings) for i in range(n)]
    carriage = spark.createDataFrame(rows, "net string, edge_id string, source long, target long, meters long, segment string, turn long, label string")
    exits = spark.createDataFrame([("r0", 40, "inner"), ("r1", 7, "outer"), ("r9", 1, "inner")], "net string, node long, direction string")
    return carriage, exits


def test_a_long_way_takes_no_more_jobs(spark):
    carriage, exits = _rings(spark)
    context = spark.sparkContext
    context.setJobGroup("ring-search", "")
    got = {(r.net, r.edge_id): r.label for r in carriageway_queries.leading_off(carriage, exits).collect()}
    jobs = len(context.statusTracker().getJobIdsForGroup("ring-search"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 20  # a way of 49 edges took two jobs a round before
    # All of r0's inner edges lead to node 40 around the ring; r1 has an exit of the other direction only, r2 none.
    assert got == {(r.net, r.edge_id): r.label for r in carriage.collect()}


def test_leading_equals_brute_force():
    pick = random.Random(3)
    for _ in range(200):
        edges = [ways.Edge(f"e{i}", str(pick.randrange(9)), str(pick.randrange(9)), 1) for i in range(16)]
        labels = {e.id: pick.choice(ways.SIDES) for e in edges if pick.random() < 0.8}
        exits = [(pick.choice(ways.SIDES), str(pick.randrange(9))) for _ in range(pick.randrange(3))]
        want = {}
        for e in edges:
            if e.id not in labels:
                continue
            side, seen, open_ = labels[e.id], {e.target}, [e.target]
            while open_:
                here = open_.pop()
                for x in edges:
                    if labels.get(x.id) == side and x.source == here and x.target not in seen:
                        seen.add(x.target)
                        open_.append(x.target)
            if any(d == side and n in seen for d, n in exits) or all(d != side for d, _ in exits):
                want[e.id] = side
        assert ways.leading(edges, labels, exits) == want


def test_spread_goes_round_by_round():
    pairs = [("b", "a", 10, False), ("c", "b", 10, True), ("d", "a", 5, False), ("d", "z", 5, True), ("a", "b", 1, True)]
    assert ways.spread({"a": "inner", "z": "inner"}, pairs) == {"a": "inner", "z": "inner", "b": "inner", "c": "outer", "d": "outer"}
    assert ways.spread({}, pairs) == {}
