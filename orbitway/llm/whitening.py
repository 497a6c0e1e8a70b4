"""Whitening by leading principal components, from products of the centred rows with blocks of vectors; the covariance is never formed."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitway.llm.common import checkpointed, table

#: Vectors of a block, and blocks that the search keeps before it starts anew from the best vectors.
BLOCK, KEPT = 16, 8
#: A component is certified when its residual is below this share of the largest eigenvalue.
RESIDUAL = 1e-13
#: Passes after which the search gives up with an error; nothing uncertified is returned.
PASSES = 1000
#: Whole numbers from here on are an error: sums of 2^23 of them fit in 64 bits.
MOST = 1 << 40
#: Rows of a matrix that a task multiplies at once.
ROWS = 8192
SEED = 42


class Model(NamedTuple):
    """n and sums of the fit list; components (one a column) with their eigenvalues; the trace; residuals as shares of the largest eigenvalue; passes."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int


def integer_rows(rows: DataFrame, vec_col: str, scale: int = 256) -> DataFrame:
    """rows with x, the whole numbers floor(scale * c) of the vector, for the vectors without null or non-finite entries."""
    c = F.col(vec_col)
    sound = c.isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))

    def whole(e: Column) -> Column:
        x = F.lit(float(scale)) * e.cast("double")
        return F.when(F.abs(x) < float(MOST), F.floor(x).cast("long")).otherwise(F.raise_error(F.lit("a vector has an entry that is too large")).cast("long"))

    return rows.where(sound).withColumn("x", F.transform(c, whole))


def _matrices(batches: Iterator[pa.RecordBatch], column: str, width: int) -> Iterator[np.ndarray]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield np.asarray(b.column(b.schema.get_field_index(column)).slice(at, ROWS).flatten()).reshape(-1, width)


def _summed(fit: DataFrame, width: int, columns: int, kind: type, part) -> np.ndarray:
    """The sum of part(matrix), a (width, columns) array, over all rows of fit: each task adds up its own, then Spark adds the rows of equal number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, columns), kind)
        for m in _matrices(batches, "x", width):
            total += part(m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), *(pa.array(total[:, j]) for j in range(columns))], names=["i", *(f"c{j}" for j in range(columns))])

    name = "long" if kind is np.int64 else "double"
    shape = "i int, " + ", ".join(f"c{j} {name}" for j in range(columns))
    added = fit.select("x").mapInArrow(work, shape).groupBy("i").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(columns)))
    out = np.zeros((width, columns), kind)
    for r in added.collect():  # a row for each dimension
        out[r[0]] = r[1:]
    return out


def fit_model(fit: DataFrame, width: int, k: int = 4, block: int = BLOCK) -> Model:
    """The k leading components of the centred rows of fit (column x, arrays of `width` numbers).

    Block subspace iteration that needs products only: a pass over the rows computes X'(XQ) / n for the
    orthonormal columns of Q, X being centred. Rayleigh-Ritz takes the best approximations from all
    blocks of which products are known; QR makes the next block from their residuals. The passes end
    when the residuals certify all k components, or the blocks span everything; after KEPT blocks the
    search starts anew from the best 2 * block vectors. The driver holds KEPT blocks of `width` rows.
    Fewer rows or dimensions than k, or components without variance, give fewer components.
    """
    n = fit.count()
    sums = _summed(fit, width, 1, np.int64, lambda m: m.sum(axis=0)[:, None])[:, 0] if n else np.zeros(width, np.int64)
    if not n or not width:
        return Model(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0, np.zeros(0), 0)
    mean = sums / n
    trace = float(_summed(fit, width, 1, np.float64, lambda m: ((m - mean) ** 2).sum(axis=0)[:, None]).sum()) / n

    def product(q: np.ndarray) -> np.ndarray:
        def part(m: np.ndarray) -> np.ndarray:
            centred = m - mean
            return centred.T @ (centred @ q)

        return _summed(fit, width, q.shape[1], np.float64, part) / n

    basis = images = np.zeros((width, 0))
    fresh = np.random.default_rng(SEED).normal(size=(width, min(block, width)))
    for passes in range(1, PASSES + 1):
        q = _orthonormal(fresh, basis)
        basis, images = np.hstack([basis, q]), np.hstack([images, product(q)])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, image = basis @ turn, images @ turn
        apart = image - vectors * values
        size = np.linalg.norm(apart, axis=0)
        largest = max(values[0], np.finfo(float).tiny)
        whole = basis.shape[1] == width
        if whole or (len(values) >= k and (size[:k] <= RESIDUAL * largest).all()):
            sound = int((values[:k] > 1e-12 * largest).sum()) if trace > 0 else 0
            return Model(n, sums, vectors[:, :sound] / np.linalg.norm(vectors[:, :sound], axis=0), values[:sound], trace, size[:sound] / largest, passes)
        if basis.shape[1] + block > KEPT * block:
            basis, images = vectors[:, : 2 * block], image[:, : 2 * block]
            basis, r = np.linalg.qr(basis)
            images = np.linalg.solve(r.T, images.T).T
        fresh = apart[:, :block]
    raise RuntimeError(f"no {k} certified components after {PASSES} passes")


def _orthonormal(fresh: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns, orthogonal to basis, of the span of fresh; where that has fewer dimensions, others take their place."""
    free = basis.shape[0] - basis.shape[1]
    out = fresh[:, : min(fresh.shape[1], free)]
    size = np.linalg.norm(out, axis=0)
    out = np.where(size > 0, out / np.where(size > 0, size, 1), 0)
    for _ in range(3):
        out = out - basis @ (basis.T @ out)
        out, r = np.linalg.qr(out)
        lost = np.abs(np.diag(r)) < 1e-8
        if lost.any():
            out[:, lost] = np.random.default_rng(SEED + basis.shape[1]).normal(size=(len(out), int(lost.sum())))
    return out - basis @ (basis.T @ out)


def _whitened(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch, its rows as whole numbers, and their whitened coordinates."""
    mean, scale = model.sums / model.n, np.sqrt(model.eigenvalues)
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            piece = b.slice(at, ROWS)
            x = np.asarray(piece.column(piece.schema.get_field_index("x")).flatten()).reshape(-1, len(mean))
            yield piece, x, (x - mean) @ model.components / scale


def identity_error(fit: DataFrame, model: Model) -> float:
    """Largest absolute entry of the covariance of the whitened fit list, centred first, minus the identity."""
    k = len(model.eigenvalues)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, w in _whitened(batches, model):
            yield pa.RecordBatch.from_arrays([pa.array(w[:, j]) for j in range(k)], names=[f"w{j}" for j in range(k)])

    white = fit.select("x").mapInArrow(work, ", ".join(f"w{j} double" for j in range(k)))
    entries = [F.abs(F.covar_pop(f"w{i}", f"w{j}") - F.lit(float(i == j))) for i in range(k) for j in range(i, k)]
    return max(float(e) for e in white.agg(*entries).first())


def squared_distances(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The sum over the dimensions of (n * x - S)^2 of each row, exact; None where it is too large for 64 bits."""
    most = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if most * most * max(1, x.shape[1]) < 1 << 63:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", k: int = 4, block: int = BLOCK) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error, residual of each row and component.

    Vectors that are null or hold null or non-finite entries are dropped; entries become whole numbers
    (integer_rows; whole numbers of MOST or more are an error). The fit list has each distinct vector
    once, however many copies there are: they are pre-aggregated before the shuffle. Shorter vectors, and
    empty ones, count as filled with zeros. Null and repeated ids, repeated rows and other columns change
    nothing. deviation is null where it exceeds 64 bits. An empty table, a single vector and vectors that
    are all equal have no components and give no rows; with fewer than k dimensions or independent
    directions, that many components are given. Components of equal eigenvalues are any basis of theirs.
    """
    spark = rows.sparkSession
    usable = integer_rows(rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("c")), "c").select("vec_id", "x")
    shape = "vec_id " + usable.schema["vec_id"].dataType.simpleString() + ", component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    width = usable.agg(F.max(F.size("x"))).first()[0] or 0
    wide = usable.withColumn("x", F.when(F.size("x") < width, F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))).otherwise(F.col("x")))
    if not width:
        return spark.createDataFrame([], shape)
    fit = checkpointed(wide.select("x").distinct())
    model = fit_model(fit, width, k, block)
    if not len(model.eigenvalues):
        return spark.createDataFrame([], shape)
    error = identity_error(fit, model)
    kept, kind = len(model.eigenvalues), T.StructType([usable.schema["vec_id"], T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x, w in _whitened(batches, model):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * kept), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("vec_id")), pa.array(squared_distances(x, model.n, model.sums), pa.int64()), lists], names=["vec_id", "deviation", "w"])

    def constants(values: np.ndarray):  # noqa: ANN202
        return F.array(*(F.lit(float(v)) for v in values))[F.col("at")]

    flat = wide.mapInArrow(work, kind).select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return flat.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        constants(model.eigenvalues / model.trace).alias("explained"), F.lit(error).alias("identity_error"), constants(model.residuals).alias("residual"),
    )


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
