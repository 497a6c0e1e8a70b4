"""Edges of ways either way, and what relations come to."""

import pandas as pd
import pytest

from orbitway.plans.membership_queries import expanded, way_edges


def rows(spark, places, edges):
    return spark.createDataFrame(places, "net string, way long, place long, node long"), spark.createDataFrame(edges, "net string, edge_id string, way long, source long, target long")


def test_way_edges(spark):
    places = [("n", 1, i, x) for i, x in enumerate([10, 11, 12])] + [("n", 2, 0, 12), ("n", 2, 1, 13), ("m", 1, 0, 10), ("m", 1, 1, 11)]
    edges = [("n", "a", 1, 10, 11), ("n", "b", 1, 11, 12), ("n", "c", 2, 12, 13), ("n", "d", 2, 12, 13), ("n", "e", 2, 13, 12), ("n", "f", 9, 11, 10), ("n", "g", 1, 12, 11)]
    got = {(r["net"], r["way"], r["reverse"]): (r["outcome"], r["place"], r["source"], r["target"], r["edges"]) for r in way_edges(*rows(spark, places, edges)).collect()}
    assert got == {
        ("n", 1, False): ("mapped", None, 10, 12, ["a", "b"]), ("n", 1, True): ("absent", None, None, None, None), ("n", 2, False): ("several", 0, None, None, None),
        ("n", 2, True): ("mapped", None, 13, 12, ["e"]), ("m", 1, False): ("absent", None, None, None, None), ("m", 1, True): ("absent", None, None, None, None),
    }


def member(k, way, ends, reverse=False, outcome="mapped", link=False):
    return {"member": k, "way": way, "link": link, "reverse": reverse, "outcome": outcome, "source": ends[0] if ends else None, "target": ends[1] if ends else None, "edges": [f"w{way}{'r' * reverse}"]}


PLACE = {"w1": (0, 1), "w2": (1, 2), "w3": (2, 3), "w4": (7, 8), "w2r": (2, 1), "x": (3, 7)}


@pytest.mark.parametrize(
    "members, direction, place, want",
    [
        ([member(0, 1, (0, 1)), member(1, 2, (1, 2))], "forward", PLACE, (None, None, [([0, 1], ["w1", "w2"])])),
        ([member(0, 2, (1, 2)), member(1, 1, (0, 1))], "forward", PLACE, (None, None, [([1, 0], ["w1", "w2"])])),
        ([member(0, 1, (0, 1)), member(1, 2, None, outcome="absent")], "forward", PLACE, ("no_edges_of_direction", 2, [])),
        ([member(0, 1, None, outcome="several"), member(1, 2, (1, 2))], "forward", PLACE, ("several_edges", 1, [])),
        ([member(0, 2, (1, 2)), member(0, 2, (2, 1), reverse=True)], "backward", PLACE, (None, None, [([0], ["w2r"])])),
        ([member(0, 2, (1, 2)), member(0, 2, None, reverse=True, outcome="several")], "inner", PLACE, ("several_edges", 2, [])),
        ([member(0, 2, (1, 2)), member(0, 2, None, reverse=True, outcome="absent"), member(1, 3, (2, 3))], "inner", PLACE, (None, None, [([0, 1], ["w2", "w3"])])),
        ([member(0, 3, (2, 3)), member(1, 4, (7, 8))], "forward", PLACE, ("leaves_relation", 3, [])),
        ([member(0, 3, (2, 3)), member(1, 4, (7, 8))], "forward", {k: v for k, v in PLACE.items() if k != "x"}, (None, None, [([0], ["w3"]), ([1], ["w4"])])),
        ([member(0, 1, (0, 1)), member(1, 2, (1, 2))], "forward", PLACE | {"w2": (5, 2)}, ("broken_path", 1, [])),
    ],
)
def test_relations(members, direction, place, want):
    assert expanded(pd.DataFrame(members), place, direction) == want
