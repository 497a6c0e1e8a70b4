"""Near-duplicate vectors: random projections decoded to points of the lattice E8 propose, cosines decide."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from orbitway.llm.common import checkpointed, table
from orbitway.llm.components import connected_components
from orbitway.llm.simhash import Forest

#: Vectors link from this cosine. Products of matrices, which add up in any order, are trusted but for so much.
LEAST, NEAR = 0.93, 1e-12
#: Tables of cells, cells that a vector visits besides its own in each, and the width of a cell for vectors of length 1.
#: A pair at the threshold meets in a table with chance 0.64 and in one of five with 0.994; at a cosine of 0.97, 0.9999.
TABLES, PROBES, WIDTH = 5, 3, 1.5
#: Vectors of a side of a comparison, and rows that are multiplied at once.
SIDE, ROWS = 2048, 512
SEED = 42


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps from a cell to its neighbours."""
    two = [(i, j, s, t) for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
    out = np.zeros((len(two), 8))
    for row, (i, j, s, t) in zip(out, two, strict=True):
        row[i], row[j] = s, t
    halves = np.array([h for h in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in h) % 2 == 0])
    return np.vstack([out, halves])


def _even(y: np.ndarray) -> np.ndarray:
    """The nearest points whose whole coordinates have an even sum: where the sum is odd, the coordinate farthest from its whole number goes the other way."""
    near = np.rint(y)
    off = y - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def nearest_points(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row: E8 is the even points, and the same moved by a half in each coordinate."""
    whole, half = _even(y), _even(y - 0.5) + 0.5
    closer = ((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; no square overflows. Rows must not be zero."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


@lru_cache(maxsize=64)
def _projection(number: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng((SEED, number, width))
    return random.normal(size=(width, 8)) / WIDTH, random.uniform(0, 2, 8)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b, added up in one order: a row has the same result in whatever batch it is."""
    out = np.zeros((len(a), b.shape[1]))
    for k in range(a.shape[1]):
        out += a[:, k : k + 1] * b[k]
    return out


def cells(units: np.ndarray, number: int, probes: int = PROBES) -> np.ndarray:
    """64-bit keys of each vector's own cell in a table (first column) and of the `probes` neighbouring cells nearest to it."""
    turn, shift = _projection(number, units.shape[1])
    y = _times(units, turn) + shift
    own = nearest_points(y)
    nearer = _times(y - own, roots().T)  # of neighbours, all as far from `own`, the one most in the vector's direction is nearest
    step = np.argpartition(-nearer, probes - 1, axis=1)[:, :probes] if probes else np.zeros((len(y), 0), int)
    points = np.concatenate([own[:, None, :], own[:, None, :] + roots()[step]], axis=1)
    doubled = np.ascontiguousarray((2 * points).astype("<i2")).reshape(-1, 8)
    keys = np.fromiter((xxh64_intdigest(p, number) for p in map(bytes, doubled)), np.uint64, len(doubled))
    return keys.view(np.int64).reshape(len(units), probes + 1)


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(float).reshape(-1, size)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class, table and cell that it visits. node, size, v, label go in; node, label, size, number, cell, home come out."""
    for b in batches:
        sizes = b.column(1).to_numpy()
        for size in np.unique(sizes):
            some = b.filter(pc.equal(b.column(1), pa.scalar(size)))
            units = unit_rows(_vectors(some.column(2), int(size)))
            node = some.column(0).to_numpy()
            for number in range(TABLES):
                key = cells(units, number)
                home = np.zeros(key.shape, bool)
                home[:, 0] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(node, key.shape[1])), some.column(3).take(pa.array(np.repeat(np.arange(len(node)), key.shape[1]))), pa.array(np.full(key.size, size, np.int32)), pa.array(np.full(key.size, number, np.int32)), pa.array(key.ravel()), pa.array(home.ravel())],
                    names=["node", "label", "size", "number", "cell", "home"],
                )


def _first_meeting(units: np.ndarray, node: np.ndarray, a: np.ndarray, b: np.ndarray, number: int, cell: int) -> np.ndarray:
    """Whether pairs (a[i], b[i]) meet first in this cell of this table; two meet where one visits the other's own cell."""
    first = np.ones(len(a), bool)
    rows, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    pa_, pb = place[: len(a)], place[len(a) :]
    for before in range(number + 1):
        key = cells(units[rows], before)
        at_b = (key[pa_] == key[pb, :1]).any(axis=1)  # a visits b's own cell
        at_a = (key[pb] == key[pa_, :1]).any(axis=1)
        if before < number:
            first &= ~(at_a | at_b)
        else:  # in one table the own cell of the smaller node comes first
            low_a = node[a] < node[b]
            low_home = np.where(low_a, key[pa_, 0], key[pb, 0])
            first &= (low_home == cell) | ~np.where(low_a, at_a, at_b)
    return first


def _compare(table_: pa.Table) -> pa.Table:
    """Links of one pair of slices of a cell: node, links (by copies), other (a node linked with it, perhaps over others)."""
    size, number, cell = (table_.column(c)[0].as_py() for c in ("size", "number", "cell"))
    one, two = table_.column("a")[0].as_py(), table_.column("b")[0].as_py()
    units = unit_rows(_vectors(table_.column("v").combine_chunks(), size))
    node, copies, home, own = (table_.column(c).to_numpy() for c in ("node", "copies", "home", "own"))
    left, right = np.flatnonzero(own == one), np.flatnonzero(own == two)
    links, forest = np.zeros(len(node), np.int64), Forest(len(node))
    for at in range(0, len(left), ROWS):
        rows = left[at : at + ROWS]
        cosine = units[rows] @ units[right].T
        close = (cosine >= LEAST - NEAR) & (home[rows, None] | home[None, right])
        if one == two:
            close &= rows[:, None] < right[None, :]
        i, j = np.nonzero(close)
        if not len(i):
            continue
        x, y = rows[i], right[j]
        doubt = np.flatnonzero(cosine[i, j] < LEAST + NEAR)
        sure = np.ones(len(x), bool)
        sure[doubt] = (units[x[doubt]] * units[y[doubt]]).sum(axis=1) >= LEAST
        x, y = x[sure], y[sure]
        fresh = _first_meeting(units, node, x, y, number, cell)
        x, y = x[fresh], y[fresh]
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        forest.link(x, y)
    met = np.flatnonzero(links)
    return pa.table({"node": node[met], "links": links[met], "other": node[forest.up[met]]})


def linked(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Rows of equal labels link if the cosine of their vectors is LEAST or more and some table brings them
    together; what no table brings together is missed (see TABLES), nothing below LEAST links. Equal
    vectors of a label are one class, aggregated before the shuffle: they link with each other, and a
    link of two classes counts for all of their copies, without a row for each pair. Classes that visit a
    cell are compared in slices of at most about SIDE; a task gives no more rows than it gets, whatever
    the number of links, and each link counts in the first cell that it is found in. Vectors that are
    null, empty or zero or hold null or non-finite entries, and rows without a label, link with nothing;
    vectors of different lengths don't link. Rows that repeat an id are rows of their own. component_id is
    the smallest id that links reach, null if all of them are null; kept tells whether it is the row's own.
    Other columns aren't read. An empty table gives no rows.
    """
    every = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf"))) & F.exists("v", lambda e: e != 0)
    alike = every.where(sound).groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    # Numbers of classes and labels: they are what a written table has, and never change.
    classes = checkpointed(alike.withColumn("node", F.monotonically_increasing_id()).withColumn("size", F.size("v")))
    keys = ["label", "size", "number", "cell"]
    met = checkpointed(classes.select("node", "size", "v", "label").mapInArrow(_meetings, f"node long, label {classes.schema['label'].dataType.simpleString()}, size int, number int, cell long, home boolean"))
    # Aggregates are checkpointed before a join by their keys: then a join may split a cell that many visit.
    cuts = checkpointed(met.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where("n > 1 and homes > 0").select(*keys, F.ceil(F.col("n") / F.lit(SIDE)).cast("int").alias("slices")))
    own = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    dealt = met.join(cuts, keys).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    dealt = dealt.select("node", "home", *keys, "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    pairs = dealt.join(classes.select("node", "copies", "v"), "node").groupBy(*keys, "a", "b")
    found = checkpointed(pairs.applyInArrow(_compare, "node long, links long, other long"))
    links = checkpointed(found.groupBy("node").agg(F.sum("links").alias("links")))
    reached = connected_components(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    grouped = checkpointed(classes.select("node", "label", "v", "copies", "least").join(links, "node", "left").join(reached, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = checkpointed(grouped.groupBy("root").agg(F.min("least").alias("component_id")))
    known = checkpointed(grouped.join(least, "root").select("label", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    # One row of known for each vector: a common vector's rows, which meet it, may be split.
    joined = every.where(sound).join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = every.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_lattice_links(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))
