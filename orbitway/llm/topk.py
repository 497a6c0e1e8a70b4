"""Exact top-k by inner product, with candidates ruled out by their distances to pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitway.llm.common import checkpointed, table

#: Pivots, and candidates and queries of a task, on average.
PIVOTS, CANDIDATES, QUERIES = 32, 8192, 4096
#: Candidates evaluated before the first look at the bound; twice as many before each later one.
STEP = 256
#: A bound may err by so much, in units of a score that are far above rounding and below 1.
SLACK = 0.25


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component; rows with a null vector, component or id, or one that isn't finite, take no part."""
    x = F.col(vec_col)
    sound = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return rows.where(sound).select(F.col(id_col).alias("vec_id"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long")).alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _distances(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    a, pivots = a.astype(float), pivots.astype(float)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * a @ pivots.T, 0))


def upper_bounds(gap: np.ndarray, own: float, norms: np.ndarray) -> np.ndarray:
    """The most that q.c can be. |q - c|^2 = |q|^2 + |c|^2 - 2 q.c, and |q - c| is at least the gap | |q - p| - |c - p| | of any pivot."""
    return (own + norms - gap * gap) / 2 + SLACK + 1e-9 * (own + norms)


def block_top(ids: np.ndarray, vectors: np.ndarray, near: np.ndarray, query_id: int, query: np.ndarray, query_near: np.ndarray, norms: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The k best candidates of a block for a query, by score and then by smaller id; those below `least` may be left out.

    The largest gap over all pivots gives each candidate's bound. Candidates are evaluated in the order
    of their bounds, until the k-th best score, or `least`, exceeds all bounds that are left; equal
    scores are still looked at.
    """
    bound = upper_bounds(np.abs(near - query_near[None, :]).max(axis=1), float((query * query).sum()), norms)
    bound[ids == query_id] = -np.inf
    open_ = np.flatnonzero(bound >= least) if least > -np.inf else np.flatnonzero(bound > -np.inf)
    order = open_[np.argsort(-bound[open_], kind="stable")]
    best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, step = 0, STEP
    while at < len(order) and not (len(best) == k and bound[order[at]] < best[-1]):
        chosen = order[at : at + step]
        at, step = at + step, 2 * step
        score = vectors[chosen] @ query
        if len(best) == k:
            chosen, score = chosen[score >= best[-1]], score[score >= best[-1]]
        best_id, best = np.concatenate([best_id, ids[chosen]]), np.concatenate([best, score])
        if len(best) > 4 * k:  # only what may still be among the best is sorted
            least_best = np.partition(best, len(best) - k)[len(best) - k]
            best_id, best = best_id[best >= least_best], best[best >= least_best]
        top = np.lexsort((best_id, -best))[:k]
        best_id, best = best_id[top], best[top]
    return best_id, best


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with all other rows.

    vectors: vec_id, v (see integer_vectors). Queries are the rows whose vec_id is divisible by `every`.
    Shorter vectors count as filled with zeros. Distances to the pivots are computed once a row. Rows
    belong to the cluster of their nearest pivot; a cluster's candidates are cut by a hash into slices of
    about CANDIDATES rows, and the queries that go there into slices of about QUERIES rows; a task has
    one of each. A query first meets one slice of its own cluster, which gives it a score that its k best
    have at least; then only clusters whose distances to the pivots allow that score are opened, and in
    them only candidates whose own bounds allow it. Only k rows a query and slice go on, so that equal
    vectors, however many, meet nowhere. Pivots are the `pivots` rows with the smallest md5 of their id:
    what the driver holds has a fixed size. Rows that share a query's vec_id count as the query itself;
    other repeated rows are candidates like any other, ties to the smaller vec_id. Very long vectors are
    rows like any other. An empty table, or one without queries, gives no rows.
    """
    spark = vectors.sparkSession
    vectors = checkpointed(vectors.select("vec_id", "v"))
    total, queries, width = vectors.agg(F.count("*"), F.count(F.when(F.pmod("vec_id", F.lit(every)) == 0, 1)), F.max(F.size("v"))).first()
    if not total or not queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chosen = vectors.orderBy(F.md5(F.col("vec_id").cast("string").cast("binary")), "vec_id").limit(pivots).collect()
    points = _matrix([r["v"] for r in chosen], width)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = _matrix(b["v"], width)
            near = _distances(v, points)
            yield b.assign(near=list(near), home=near.argmin(axis=1).astype(np.int32), norm=(v * v).sum(1).astype(float))

    kind = "vec_id long, v array<long>, near array<double>, home int, norm double"
    measured = checkpointed(vectors.mapInPandas(measure, kind).withColumn("salt", F.xxhash64("vec_id", F.monotonically_increasing_id())))
    ends = [f(F.col("near")[i]).alias(f"{n}{i}") for i in range(len(points)) for n, f in (("low", F.min), ("high", F.max))]
    clusters = measured.groupBy("home").agg(F.count("*").alias("n"), F.max("norm").alias("norm"), *ends).collect()
    home = np.array([c["home"] for c in clusters])
    norms = np.array([c["norm"] for c in clusters])
    low, high = (np.array([[c[f"{n}{i}"] for i in range(len(points))] for c in clusters]) for n in ("low", "high"))
    slices = {int(c["home"]): -(-c["n"] // CANDIDATES) for c in clusters}
    counts = F.create_map(*(F.lit(x) for pair in slices.items() for x in pair))
    candidates = measured.withColumn("slice", F.pmod("salt", counts[F.col("home")]).cast("int")).withColumnRenamed("home", "cluster")
    asked = measured.where(F.pmod("vec_id", F.lit(every)) == 0)

    def meet(sent: DataFrame, first_slice: bool) -> DataFrame:
        """The k best of each query in each slice of candidates of the clusters that it is sent to. sent: also cluster and least."""
        here = {r["cluster"]: -(-r["n"] // QUERIES) for r in sent.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
        columns = F.create_map(*(F.lit(x) for pair in here.items() for x in pair))
        left = candidates.where("slice = 0") if first_slice else candidates
        left = left.where(F.col("cluster").isin(*here)).select("vec_id", "v", "near", "norm", "cluster", "slice").withColumn("column", F.explode(F.sequence(F.lit(0), columns[F.col("cluster")] - 1)))
        right = sent.withColumn("column", F.pmod("salt", columns[F.col("cluster")]).cast("int"))
        right = right.withColumn("slice", F.lit(0) if first_slice else F.explode(F.sequence(F.lit(0), (counts[F.col("cluster")] - 1).cast("int"))))
        # New names: both sides come from one table, whose columns a cogroup would take for the same.
        right = right.select("cluster", "slice", "column", *(F.col(c).alias(f"query_{c}") for c in ("vec_id", "v", "near", "least")))
        keys = "cluster", "slice", "column"
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score long")

    def compare(candidates: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(wanted):
            ids, v, near = candidates["vec_id"].to_numpy(np.int64), _matrix(candidates["v"], width), np.stack(candidates["near"])
            norm = candidates["norm"].to_numpy(float)
            for q, own, at, least in zip(wanted["query_vec_id"], _matrix(wanted["query_v"], width), wanted["query_near"], wanted["query_least"], strict=True):
                found, score = block_top(ids, v, near, q, own, np.asarray(at), norm, k, -np.inf if np.isnan(least) else least)
                out.append(pd.DataFrame({"query_id": q, "vec_id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near, own = np.stack(b["near"]), b["norm"].to_numpy(float)
            row, to = [], []
            for i, least in enumerate(b["least"].to_numpy(float)):
                gap = np.maximum(np.maximum(low - near[i], near[i] - high), 0).max(axis=1)
                there = home if np.isnan(least) else home[upper_bounds(gap, own[i], norms) >= least]
                row += [i] * len(there)
                to += there.tolist()
            yield b.iloc[row].assign(cluster=np.array(to, np.int32))

    shape = "vec_id long, v array<long>, near array<double>, norm double, salt long, least double"
    first = meet(asked.withColumnsRenamed({"home": "cluster"}).withColumn("least", F.lit(None).cast("double")), True)
    # k rows a query (and row that repeats its id) at most. What the k best of some rows reach, the k best of all do.
    least = first.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("best"))
    least = least.select(F.col("query_id").alias("vec_id"), F.when(F.size("best") >= k, F.try_element_at("best", F.lit(k))).cast("double").alias("least"))
    plain = asked.select("vec_id", "v", "near", "norm", "salt").join(least, "vec_id", "left").select("vec_id", "v", "near", "norm", "salt", "least")
    sent = checkpointed(plain.mapInPandas(send, f"{shape}, cluster int"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = meet(sent, False).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


SQL = """
with usable as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from usable q join usable c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
