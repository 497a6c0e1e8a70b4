"""A network from a few map elements, worked out by hand."""

import pytest

from orbitway.plans.topology_queries import build, forbidden, report

NAMES = "highway service oneway operator network ref name name_ja".split()
LANES = {"highway": "motorway", "oneway": "yes", "ref": "C1"}
RAMP = {"highway": "motorway_link", "oneway": "yes"}
#: Tags and nodes. 10 and 11 are the mainline; 20 and 21 enter, 30 and 31 leave, 40 joins, 50 is on its own, 60 to 63 are no part of it.
WAYS = {
    10: (LANES, [1, 2, 3]), 11: (LANES | {"oneway": "-1", "name_ja": "線"}, [5, 4, 3]), 20: (RAMP, [101, 102, 2]), 21: (RAMP, [111, 2]), 30: (RAMP, [3, 103]), 31: (RAMP, [3, 113]),
    40: ({"highway": "motorway_link"}, [2, 4]), 50: (RAMP, [7, 8]), 60: ({"highway": "residential"}, [101, 201]), 61: ({"highway": "footway"}, [113, 202]), 62: (LANES | {"ref": "E20"}, [1, 9]), 63: (RAMP, [5]), 64: (RAMP, [3, 404]),
}
TAGS = {101: "motorway_junction", 103: "traffic_signals", 111: "traffic_signals", 113: "crossing"}
#: Node 111 lies by the street at 201, but isn't on it; 404 has no coordinates.
PLACES = {n: (35.0 + n * 0.01, 139.0) for n in (1, 2, 3, 4, 5, 7, 8, 9, 101, 102, 103, 113, 201, 202)} | {111: (35.0 + 201 * 0.01 + 0.0005, 139.0)}
TURNS = [
    (1, "no_left_turn", False, 10, 3, None, None, 30), (2, "only_straight_on", False, 10, 3, None, None, 11), (3, None, True, 10, 3, None, None, 11), (4, None, False, 10, 3, None, None, 11), (5, "no_entry", False, 10, 3, None, None, 11),
    (6, "no_u_turn", False, None, 3, None, None, 11), (7, "no_u_turn", False, 10, None, None, None, 11), (8, "no_u_turn", False, 10, 3, None, None, 60), (9, "no_u_turn", False, 10, 2, None, None, 11),
    (10, "no_right_turn", False, 20, None, 10, 10, 30), (11, "only_right_turn", False, 20, None, 10, 10, 30), (12, "no_right_turn", False, 50, None, 10, 10, 30), (13, "no_right_turn", False, 20, None, 60, 60, 30), (14, "no_right_turn", False, 31, None, 10, 10, 30),
    (15, "no_right_turn", False, 20, None, 10, 11, 40), (16, "only_straight_on", False, 10, 3, None, None, 11),
]


@pytest.fixture(scope="module")
def made(spark):
    ways = spark.createDataFrame([(w, *(tags.get(n) for n in NAMES)) for w, (tags, _) in WAYS.items()], "way long, " + ", ".join(f"{n} string" for n in NAMES))
    places = spark.createDataFrame([(w, i, n) for w, (_, nodes) in WAYS.items() for i, n in enumerate(nodes)], "way long, pos int, node long")
    nodes = spark.createDataFrame([(n, *at, TAGS.get(n)) for n, at in PLACES.items()], "node long, lat double, lon double, tag string")
    return build(ways, places, nodes)


def test_edges(made):
    edges = {r["edge_id"]: (r["source"], r["target"], r["kind"]) for r in made.edges.collect()}
    assert edges == {
        "e:w10:0:f": (1, 2, "shutoko"), "e:w10:1:f": (2, 3, "shutoko"), "e:w11:0:r": (4, 5, "shutoko"), "e:w11:1:r": (3, 4, "shutoko"),
        "e:w20:0:f": (101, 102, "entry"),  # on a street, whatever its tag says
        "e:w20:1:f": (102, 2, "shutoko"), "e:w21:0:f": (111, 2, "shutoko"),  # a street is mapped near it, and doesn't have it
        "e:w30:0:f": (3, 103, "exit"),  # no street is mapped there; its tag decides
        "e:w31:0:f": (3, 113, "shutoko"),  # nothing says anything
        "e:w40:0:f": (2, 4, "shutoko"), "e:w40:0:r": (4, 2, "shutoko"),
    }
    seconds = {r["edge_id"]: (r["meters"], r["seconds"]) for r in made.edges.collect()}
    assert seconds["e:w10:0:f"] == (1112, 67) and seconds["e:w40:0:f"] == (2224, 200)
    assert {r["node"] for r in made.nodes.collect()} == {1, 2, 3, 4, 5, 101, 102, 103, 111, 113} and [r["node"] for r in made.nodes.where("snap").collect()] == [101]


def test_links(made):
    assert {r["edge_id"]: (r["side"], r["note"]) for r in made.links.where("note is not null or kind = 'dropped'").collect()} == {
        "e:w20:0:f": ("entry", "street against junction"), "e:w21:0:f": ("entry", "no street against signals"), "e:w31:0:f": ("exit", "undecidable"), "e:w50:0:f": ("dropped", None),
    }


def test_turns(spark, made):
    turns = spark.createDataFrame(TURNS, "relation long, value string, conditional boolean, from_way long, via_node long, via_first long, via_last long, to_way long")
    found, known = forbidden(turns, made)
    assert {r["relation"]: r["outcome"] for r in known.collect()} == {
        1: "no_turn_via_node", 2: "only_turn_via_node", 3: "skipped_conditional", 4: "skipped_missing_elements", 5: "skipped_unrecognized", 6: "skipped_missing_elements", 7: "skipped_no_via", 8: "skipped_missing_elements",
        9: "skipped_missing_elements", 10: "via_way", 11: "skipped_only_via_way", 12: "skipped_disconnected", 13: "skipped_missing_elements", 14: "skipped_disconnected", 15: "via_way", 16: "only_turn_via_node",
    }
    into, out = "e:w10:1:f", ["e:w30:0:f", "e:w31:0:f"]
    assert sorted((r["relation"], r["path"]) for r in found.collect()) == [
        (1, [into, out[0]]), (2, [into, out[0]]), (2, [into, out[1]]), (10, ["e:w20:1:f", into, out[0]]), (15, ["e:w20:1:f", into, "e:w11:1:r", "e:w40:0:r"]), (16, [into, out[0]]), (16, [into, out[1]]),
    ]
    counts = {r["item"]: r["n"] for r in report(turns, made).collect()}
    # Of the pairs of 2 and 16, one was forbidden before, and the other counts once.
    assert counts["only_turn_edge_pairs"] == 1 and counts["total_relations"] == len(TURNS)
    assert (counts["dropped_link_edges"], counts["undecidable_ramp_edges"], counts["surface_evidence_unavailable_ramp_edges"], counts["nodes"], counts["edges"], counts["snap_nodes"]) == (1, 1, 2, 10, 11, 1)


def test_nothing(spark, made):
    none = spark.createDataFrame([], "relation long, value string, conditional boolean, from_way long, via_node long, via_first long, via_last long, to_way long")
    assert {r["item"] for r in report(none, made).where("n > 0").collect()} == {"dropped_link_edges", "undecidable_ramp_edges", "surface_evidence_unavailable_ramp_edges", "nodes", "edges", "snap_nodes"}
