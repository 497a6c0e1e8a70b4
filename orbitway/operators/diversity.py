"""Greedy choice of candidates that differ enough, as a fold over a ranked array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alike_sets(sets: DataFrame) -> DataFrame:
    """set_id, alike: the sets (itself included) that share four fifths of the metres that either has. sets: set_id, edge, meters.

    Sets meet by the edges that they share, once for all candidates; the threshold is inclusive.
    """
    total = sets.groupBy("set_id").agg(F.sum("meters").alias("total"))
    other = sets.select(F.col("set_id").alias("other"), "edge")
    shared = sets.join(other, "edge").groupBy("set_id", "other").agg(F.sum("meters").alias("shared"))
    both = shared.join(total, "set_id").join(total.select(F.col("set_id").alias("other"), F.col("total").alias("more")), "other")
    return both.where("shared * 5 >= (total + more - shared) * 4").groupBy("set_id").agg(F.collect_set("other").alias("alike"))


def diverse(candidates: DataFrame, alike: DataFrame, key: str, k: int = 3) -> DataFrame:
    """key and chosen (ids) of the first k candidates in rank order of which none is too like one chosen before.

    candidates: key, rank, id, set_id; alike: see alike_sets.
    """
    found = candidates.join(alike, "set_id")
    ranked = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "set_id", "alike"))).alias("all"))

    def step(chosen, c):
        differs = ~F.exists(chosen, lambda o: F.array_contains(c["alike"], o["set_id"]))
        return F.when((F.size(chosen) < k) & differs, F.concat(chosen, F.array(c))).otherwise(chosen)

    empty = F.filter("all", lambda _: F.lit(False))
    return ranked.select(key, F.transform(F.aggregate("all", empty, step), lambda c: c["id"]).alias("chosen"))
