"""What streets show of ramps' ends in a network of map elements."""

from orbitway.plans.topology_queries import street_evidence


def test_street_evidence_by_place(spark):
    ways = spark.createDataFrame([(1, "residential", None), (2, "motorway_link", None)], "way long, highway string, service string")
    places = spark.createDataFrame([(1, 0, 10), (1, 1, 11), (2, 0, 11), (2, 1, 12), (2, 2, 13)], "way long, pos int, node long")
    nodes = spark.createDataFrame([(10, 35.5, 139.5, None), (11, 35.5001, 139.5, "crossing"), (12, 35.5002, 139.5, None), (13, 35.6, 139.5, None)], "node long, lat double, lon double, tag string")
    got = street_evidence(spark.createDataFrame([(11,), (12,), (13,)], "node long"), ways, places, nodes)
    assert {r.node: (r.evidence, r.tag) for r in got.collect()} == {11: ("shared_node", "crossing"), 12: ("no_shared_node", None), 13: ("unavailable", None)}
