"""Pairs that name no assignment are spread over tasks."""

import __spark_entry__


def test_no_join_by_a_key_that_is_null(spark, capsys):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        __spark_entry__.queries()["j12_pair_tariffs"](spark, "/root/testdata/sf0.001").explain("simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out
    assert "hashpartitioning(named#" in plan and "hashpartitioning(assignment#" not in plan
