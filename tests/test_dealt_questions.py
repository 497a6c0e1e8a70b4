"""Requests are dealt to networks by number, not by a loop over all pairs of them."""

import duckdb
from orbitway.functions.dialect import DUCK
from orbitway.sources.networks import road
from orbitway.sources.road import with_tables

SF = "/root/testdata/sf0.001"


def test_questions_meet_by_number(spark, capsys):
    frame, = road(spark, SF, "question")
    frame.explain("simple")
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_questions_equal_their_text(spark):
    con = duckdb.connect()
    for t in ("part", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(with_tables(("question",), "select * from question", DUCK)).fetchall()
    frame, = road(spark, SF, "question")
    assert sorted(map(tuple, frame.collect())) == sorted(want) and want
