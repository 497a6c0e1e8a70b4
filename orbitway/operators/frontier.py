"""Searches of one graph that no task holds: each round joins the frontier, a table, with the edges.

Edges have source and target, whatever their types; rounds end when nothing new is found. The edges
and each round's table are checkpointed, and only whether a table is empty reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitway.functions.checkpoints import cut

#: Rounds whose levels are written as one table.
MERGE = 8


def reach(edges: DataFrame, starts: DataFrame, backward: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """by, node: the starts (columns by and node) and all nodes that they reach; backward: all that reach one of them.

    One search from all starts at once, level by level, instead of one for each node that asks. edges and
    starts also have the columns `by`, which a search doesn't leave. A round goes on with the edges alone
    whose end isn't known yet, so that it costs what is left of them and not the whole graph.
    """
    here, there = ("target", "source") if backward else ("source", "target")
    ends = [*by, "next"]
    level = cut(starts.select(*by, "node").where("node is not null").distinct())
    known, recent, open_ = None, [level], edges.select(*by, F.col(here).alias("node"), F.col(there).alias("next")).where("node is not null and next is not null")
    while True:
        open_ = cut(open_.join(level.withColumnRenamed("node", "next"), ends, "left_anti"))
        # The edges from this level all end in the next one, so that its ends take them out too.
        level = cut(open_.join(level, [*by, "node"], "left_semi").select(*by, F.col("next").alias("node")).distinct())
        if not level.take(1):
            return reduce(DataFrame.unionByName, recent if known is None else [known, *recent])
        recent.append(level)
        if len(recent) > MERGE:
            merged = cut(reduce(DataFrame.unionByName, recent))
            known, recent = merged if known is None else known.unionByName(merged), []


def within(edges: DataFrame, starts: DataFrame, most: int, backward: bool = False) -> DataFrame:
    """key, node, meters: the nodes at most so far from each key's start (columns key and node), and their least distances.

    edges also have meters, none of them negative. A round lengthens only paths that the round before
    made shorter; a key with several starts has the nearest.
    """
    here, there = ("target", "source") if backward else ("source", "target")
    steps = cut(edges.select(F.col(here).alias("node"), F.col(there).alias("next"), F.col("meters").alias("step")))
    known = cut(starts.select("key", "node", F.lit(0).cast("long").alias("meters")).distinct())
    better = known
    while True:
        longer = better.join(steps, "node").select("key", F.col("next").alias("node"), (F.col("meters") + F.col("step")).alias("meters")).where(F.col("meters") <= most)
        least = longer.groupBy("key", "node").agg(F.min("meters").alias("meters"))
        old = known.withColumnRenamed("meters", "known")
        better = cut(least.join(old, ["key", "node"], "left").where("known is null or meters < known").select("key", "node", "meters"))
        if better.isEmpty():
            return known
        known = cut(known.join(better, ["key", "node"], "left_anti").unionByName(better))


def paths(edges: DataFrame, starts: DataFrame, on: list[str], goes_on: Column, ends: Column, most: Column, carry: dict[str, Column], enough: int | None = None) -> DataFrame:
    """starts' columns of every path that ends; a path grows by one edge a round.

    starts: path (edge ids), at (the node that it has come to) and any other columns; edges: edge_id,
    source, target, the columns `on`, by which they join too, and others. A path for which `ends` holds is
    given and goes no further. Any other of at most `most` edges is lengthened by each edge that it
    hasn't yet and for which `goes_on` holds; that sees the path's columns, the edge's, and next_at.
    carry: what the other columns become with an edge. enough: a key (column key) of which so many paths
    have ended isn't searched any more, and may have a few more of them.
    """
    steps = cut(edges.withColumnsRenamed({"source": "at", "target": "next_at"}))
    level, done = cut(starts), None
    while True:
        final = level.where(ends)
        done = final if done is None else done.unionByName(final)
        open_ = level.where(~ends & (F.size("path") <= most))
        if enough is not None:
            done = cut(done)
            open_ = open_.join(done.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= enough).select("key"), "key", "left_anti")
        longer = open_.join(steps, [*on, "at"]).where(~F.array_contains("path", F.col("edge_id")) & goes_on)
        grown = carry | {"path": F.concat("path", F.array("edge_id")), "at": F.col("next_at")}
        level = cut(longer.select(*(grown[c].alias(c) if c in grown else F.col(c) for c in starts.columns)))
        if level.isEmpty():
            return done
