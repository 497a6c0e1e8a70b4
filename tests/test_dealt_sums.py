"""Sums by a key deal their rows first, so that no task that reads a small file holds all keys."""

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["g02_way_nodes", "q10_device_gate"])
def test_one_exchange_before_all_sums(spark, capsys, name):
    __spark_entry__.queries()[name](spark, SF).explain("simple")
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.rindex("Aggregate") < plan.index("Exchange hashpartitioning")
