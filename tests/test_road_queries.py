"""Every road query against its SQL counterpart on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from orbitway import registry
from orbitway.functions.dialect import SPARK
from orbitway.functions.geo import fare_yen
from orbitway.sources.road import with_tables

SF = "/root/testdata/sf0.001"


def rows(frame):
    names = sorted(frame.columns)
    return sorted((tuple(None if pd.isna(v) else v.to_pydatetime() if hasattr(v, "to_pydatetime") else int(v) if isinstance(v, float) and v.is_integer() else v for v in r) for r in frame[names].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in registry.BASE:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [str(r) for r in rows(got)] == [str(r) for r in rows(want)]


@pytest.mark.parametrize("rule, meters, yen", [("2022-04", 14200, 630), ("2026-10", 14200, 670), ("2026-10", 3900, 300), ("2026-10", 4000, 310), ("2026-10", 4050, None), ("2022-04", 19400, 790), ("2026-10", 19400, 860)])
def test_published_fares(spark, rule, meters, yen):
    sql = with_tables(("rule",), f"select {fare_yen(f'cast({meters} as bigint)', 'u', 'div')} as yen from rule u where rule_id = '{rule}'", SPARK)
    assert spark.sql(sql).first()[0] == yen
