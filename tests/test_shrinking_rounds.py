"""Rounds of a search cost what is left of the edges, and searches by groups don't leave theirs."""

import random

from orbitway.operators import frontier
from orbitway.operators.frontier import reach


def test_rounds_shrink(spark, monkeypatch):
    """A thousand nodes are known from the start and a chain isn't: its rounds hold the chain's edges and nothing of the thousand."""
    known = [(i, (i + 1) % 1000) for i in range(1000)]
    chain = [(1000 + i, 1001 + i) for i in range(20)] + [(5, 1000)]
    sizes, cut = [], frontier.cut

    def counted(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(frontier, "cut", counted)
    found = reach(spark.createDataFrame(known + chain, "source long, target long"), spark.createDataFrame([(i,) for i in range(1000)], "node long"))
    assert {r.node for r in found.collect()} == set(range(1021)) and found.count() == 1021
    # The starts and, once in the first eight rounds, what was found by then.
    assert sum(n > 21 for n in sizes) == 2


def test_groups_stay_apart(spark):
    """The same node in two groups is two nodes; against a plain search."""
    rng = random.Random(7)
    edges = [(rng.choice("ab"), rng.randrange(60), rng.randrange(60)) for _ in range(120)]
    starts = [("a", 1), ("b", 2), ("b", 2), ("a", None)]
    for backward in (False, True):
        want = {s for s in starts if s[1] is not None}
        while more := {(g, s if backward else t) for g, s, t in edges if (g, t if backward else s) in want} - want:
            want |= more
        got = reach(spark.createDataFrame(edges, "net string, source long, target long"), spark.createDataFrame(starts, "net string, node long"), backward, by=["net"])
        assert sorted((r.net, r.node) for r in got.collect()) == sorted(want)
