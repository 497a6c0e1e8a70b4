"""All named queries of the road engine with their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitway.functions.dialect import DUCK, SPARK
from orbitway.operators.diversity import alike_sets, diverse
from orbitway.operators.nearest import nearest
from orbitway.plans import access_queries, build_queries, carriageway_queries, documents_queries, ground_queries, member_files, membership_queries, network_queries, pair_queries, rules, topology_queries
from orbitway.plans.sql_queries import QUERIES as SHARED
from orbitway.sources.networks import BASE, over, road
from orbitway.sources.road import with_tables


def access(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """The k nearest entries of each request."""
    return nearest(*road(spark, sf_dir, "request", "entry"), k)


def _spark(make) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names, sql = make(SPARK)
        if "access" not in names:
            return over(spark, sf_dir, with_tables(names, sql, SPARK))
        return over(spark, sf_dir, with_tables(names, re.sub(r"(from|join) access\b", r"\1 {access}", sql), SPARK, given=("access",)), access=access(spark, sf_dir))

    run.__name__, run.__doc__ = make.__name__, make.__doc__
    return run


def j03_knn_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access(spark, sf_dir).select("request_id", "entry_id", F.col("rank").cast("int").alias("rank"))


def t06_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a request are the laps of its nearest entries; laps of one route are alike."""
    edge, = road(spark, sf_dir, "edge")
    laps = alike_sets(edge.select(F.col("route").alias("set_id"), F.col("edge_id").alias("edge"), "meters"))
    found = access(spark, sf_dir).select("request_id", "rank", F.col("entry_id").alias("id"), F.col("route").alias("set_id"))
    return diverse(found, laps, "request_id").select("request_id", F.array_join(F.col("chosen").cast("array<string>"), ",").alias("chosen"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _spark(make) for name, make in SHARED.items()}
QUERIES |= {"j03_knn_access": j03_knn_access, "t06_diversity": t06_diversity} | rules.QUERIES | network_queries.QUERIES | documents_queries.QUERIES | build_queries.QUERIES | carriageway_queries.QUERIES | ground_queries.QUERIES | pair_queries.QUERIES | access_queries.QUERIES | membership_queries.QUERIES | topology_queries.QUERIES | member_files.QUERIES
ORACLE: dict[str, str] = {name: with_tables(*make(DUCK), DUCK) for name, make in SHARED.items()}
ORACLE["j03_knn_access"] = with_tables(("access",), "select request_id, entry_id, cast(rank as int) as rank from access", DUCK)
ORACLE["t06_diversity"] = with_tables(("access",), "select request_id, string_agg(cast(entry_id as varchar), ',' order by rank) as chosen from (select *, row_number() over (partition by request_id, route order by rank) as rn from access) where rn = 1 group by request_id", DUCK)
ORACLE |= rules.ORACLE | network_queries.ORACLE | documents_queries.ORACLE | build_queries.ORACLE | carriageway_queries.ORACLE | ground_queries.ORACLE | pair_queries.ORACLE | access_queries.ORACLE | membership_queries.ORACLE | topology_queries.ORACLE | member_files.ORACLE
