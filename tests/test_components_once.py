"""Components are searched once, whatever reads them afterwards."""

from orbitway.plans.access_queries import components


def test_search_runs_once(spark, capsys):
    edges = spark.createDataFrame([("a", "e1", 1, 2, 10), ("a", "e2", 2, 1, 20), ("a", "e3", 2, 3, 5), ("b", "e4", 1, 2, 7)], "net string, edge_id string, source long, target long, meters long")
    found = components(edges)
    found.explain("simple")
    assert "FlatMapGroups" not in capsys.readouterr().out
    rows = {(r.net, r.node): (r.component, r.members, r.inside, r.cyclic) for r in found.collect()}
    assert rows == {("a", 1): (1, 2, 30, True), ("a", 2): (1, 2, 30, True), ("a", 3): (3, 1, 0, False), ("b", 1): (1, 1, 0, False), ("b", 2): (2, 1, 0, False)}
