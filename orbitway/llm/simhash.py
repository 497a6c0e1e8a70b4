"""SimHash near-duplicates: fingerprints compared tile by tile, exactly."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from orbitway.llm.common import appended, checkpointed, keep_one, pieces, table, text_digest
from orbitway.llm.components import connected_components

SEED = 42
BITS = 64
#: A fingerprint's population counts are taken over this many equal parts of its bits.
PARTS = 4
#: Rows that a tile compares at once, and rows of each side of a tile task, on average.
BLOCK, SIDE = 1024, 4096
#: Bits of a part's value at most, and rows of a cell that are compared with those of other cells in one go.
VALUE, SMALL = 24, 64


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of the shingles of `size` words of a text, repeats included.

    Words are runs of bytes other than 9 to 13 and 32, in ASCII lower case; fewer words than size make
    one shingle; no word (or a null text) makes none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    if len(words) <= size:
        return np.array([xxh64_intdigest(line, SEED)], np.uint64)
    starts = [0, *(e + 1 for e in ends[: len(words) - size])]
    return np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)), np.uint64, len(starts))


def fingerprint(text: bytes | None, size: int) -> int:
    """Bit i is 1 if it is set in over half of the text's shingle hashes; signed 64 bits."""
    return fingerprint_of(shingle_hashes(text, size))


def fingerprint_of(hashes: np.ndarray) -> int:
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(documents: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp of every row; texts are read whole, as bytes."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return appended(rows, "text", lambda texts: ([fingerprint(t, size) for t in texts],), T.StructType().add("fp", "long"))


def _counts(fp: np.ndarray) -> np.ndarray:
    """Population counts of the PARTS parts of each fingerprint."""
    width = BITS // PARTS
    mask = np.uint64((1 << width) - 1)
    return np.stack([np.bitwise_count((fp >> np.uint64(width * p)) & mask) for p in range(PARTS)], axis=1).astype(np.int64)


def _visits(fp: np.ndarray, radius: int) -> pd.DataFrame:
    """The tiles that each fingerprint goes to: its own (home), and lower ones that counts within the radius reach.

    A tile is a box of population counts, 2 * (radius + 1) wide in each part. Two fingerprints that
    differ in at most radius bits have counts that differ by at most radius in total, so that they are in
    one tile or in adjacent ones, and the one of the higher tile visits the lower.
    """
    wide = 2 * (radius + 1)
    origin = BITS // PARTS // 2 - wide // 2  # the middle counts share a box
    counts = _counts(fp) - origin + wide * BITS
    box, at = counts // wide, counts % wide
    side = BITS // wide * 2 + 3
    place = np.array([side**p for p in range(PARTS)], np.int64)
    own = box @ place
    out = [pd.DataFrame({"tile": own, "fp": fp.view(np.int64), "home": True})]
    down, up = at + 1, wide - at
    for step in product((-1, 0, 1), repeat=PARTS):
        shift = int(np.dot(step, place))
        if shift >= 0:
            continue
        cost = sum(np.where(s < 0, down[:, p], up[:, p]) for p, s in enumerate(step) if s)
        near = cost <= radius
        if near.any():
            out.append(pd.DataFrame({"tile": own[near] + shift, "fp": fp[near].view(np.int64), "home": False}))
    return pd.concat(out)


def _cells(visits: pd.DataFrame, radius: int) -> pd.DataFrame:
    """cell, fp, home of each visit, for each of radius + 1 parts of the bits: a cell is a tile and the part's value.

    Of radius + 1 parts, radius bits leave one as it is, so that two fingerprints that close share a cell of each tile that they share.
    """
    parts = radius + 1
    width = min(VALUE, BITS // parts)
    tile, fp = visits["tile"].to_numpy(np.int64), visits["fp"].to_numpy(np.int64)
    values = [(fp.view(np.uint64) >> np.uint64(BITS // parts * p) & np.uint64((1 << width) - 1)).astype(np.int64) for p in range(parts)]
    cells = np.concatenate([(tile * parts + p) << width | v for p, v in enumerate(values)])
    return pd.DataFrame({"cell": cells, "fp": np.tile(fp, parts), "home": np.tile(visits["home"].to_numpy(bool), parts)})


class Forest:
    """Union-find over row numbers; the smaller root wins."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[i] with b[i], all at once: roots fall to the smaller until nothing changes."""
        while True:
            ra, rb = self.up[a], self.up[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            apart = low != high
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, high[apart], low[apart])
            while not np.array_equal(deeper := self.up[self.up], self.up):
                self.up = deeper


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the left rows (right: None), or between left and right rows.

    Both sides are ordered by population count and cut into blocks; a pair of blocks whose counts lie
    further apart than the radius is skipped, others are compared whole by exclusive-or and bit count.
    """
    order = lambda x: x[np.argsort(np.bitwise_count(x), kind="stable")]
    n = len(left)
    rows = order(left) if right is None else np.concatenate([order(left), order(right)])
    ones = np.bitwise_count(rows).astype(np.int64)
    forest = Forest(len(rows))
    cut = lambda a, b: [(x, min(x + BLOCK, b)) for x in range(a, b, BLOCK)]
    own = cut(0, n)
    for a0, a1 in own:
        for b0, b1 in cut(n, len(rows)) if right is not None else own:
            if right is None and b0 < a0 or ones[b0] - ones[a1 - 1] > radius or ones[a0] - ones[b1 - 1] > radius:
                continue
            i, j = np.nonzero(np.bitwise_count(rows[a0:a1, None] ^ rows[None, b0:b1]) <= radius)
            if len(i):
                forest.link(i + a0, j + b0)
    child = np.nonzero(forest.up != np.arange(len(rows)))[0]
    return rows[child], rows[forest.up[child]]


def cell_links(cell: np.ndarray, fp: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of one cell (ordered by cell) of which one is at home; they connect just those that all such links connect.

    Rows of small cells are compared with the next one, the one after it and so on, of all cells at once; a larger cell is a tile of its own.
    """
    firsts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[firsts, len(cell)])
    forest = Forest(len(cell))
    rest = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    for step in range(1, SMALL):
        rest = rest[rest < len(cell) - step]
        rest = rest[cell[rest] == cell[rest + step]]
        if not len(rest):
            break
        near = rest[(np.bitwise_count(fp[rest] ^ fp[rest + step]) <= radius) & (home[rest] | home[rest + step])]
        if len(near):
            forest.link(near, near + step)
    child = np.flatnonzero(forest.up != np.arange(len(cell)))
    found = [(fp[child], fp[forest.up[child]])]
    for a, n in zip(firsts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        own, here = fp[a : a + n], home[a : a + n]
        if here.any():
            found.append(tile_links(own[here], None, radius))
            if not here.all():
                found.append(tile_links(own[here], own[~here], radius))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def links(prints: DataFrame, radius: int) -> DataFrame:
    """u, v: edges between distinct fingerprints (column fp, no repeats) that connect just those which links of at most radius bits connect.

    A tile's home rows are compared with each other and with its visitors, if they share a cell: the value of one of radius + 1 parts of
    the bits, which close ones must share. A row has a fixed number of cells, however many rows there are. Where a cell has more than SIDE
    rows of a kind, both kinds are cut into slices of about SIDE rows by a hash, and each two slices meet in a task of their own, so that
    no task has more than two slices, however dense the cell.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_pandas(_cells(_visits(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), radius), radius), preserve_index=False)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[np.ndarray]) -> pa.RecordBatch:
            u, v = cell_links(rows[0], rows[1].view(np.uint64), rows[2], radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        for b in batches:
            held = [np.concatenate([x, b.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate(held)]
            # The last cell may go on in the next batch.
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if whole:
                yield done([x[:whole] for x in held])
                held = [x[whole:] for x in held]
        if len(held[0]):
            yield done(held)

    def compare_slices(key, group: pd.DataFrame) -> pd.DataFrame:
        fp, home, side = group["fp"].to_numpy(np.int64).view(np.uint64), group["home"].to_numpy(bool), group["side"].to_numpy(np.int64)
        _, a, visiting, b = (int(x) for x in key)
        left, right = fp[home & (side == a)], fp[~home] if visiting else None if a == b else fp[home & (side == b)]
        u, v = tile_links(left, right, radius) if len(left) and (right is None or len(right)) else (fp[:0], fp[:0])
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    cells = prints.select("fp").mapInArrow(spread, "cell long, fp long, home boolean")
    slices = lambda which: F.ceil(F.count(F.when(which, 1)) / F.lit(SIDE)).cast("int")
    dense = checkpointed(cells.groupBy("cell").agg(slices(F.col("home")).alias("homes"), slices(~F.col("home")).alias("visitors")).where("homes > 1 or visitors > 1"))
    sparse = cells if dense.isEmpty() else cells.join(dense.select("cell"), "cell", "left_anti")
    found = sparse.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "u long, v long")
    if sparse is cells:
        return found
    # A cell without home rows has no comparison to make.
    cut = cells.join(dense.where("homes > 0"), "cell").withColumn("side", F.pmod(F.xxhash64("fp"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("visitors"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one = lambda a, visiting, b: F.struct(a.alias("a"), F.lit(visiting).alias("visiting"), b.alias("b"))
    home_pairs = F.transform(upto("homes"), lambda x: one(F.least(x, F.col("side")), 0, F.greatest(x, F.col("side"))))
    home_visits = F.when(F.col("visitors") > 0, F.transform(upto("visitors"), lambda x: one(F.col("side"), 1, x))).otherwise(F.array())
    meets = F.when(F.col("home"), F.concat(home_pairs, home_visits)).otherwise(F.transform(upto("homes"), lambda x: one(x, 1, F.col("side"))))
    dealt = cut.select("cell", "fp", "home", "side", F.explode(meets).alias("meet")).select("cell", "meet.*", "fp", "home", "side")
    return found.unionByName(dealt.groupBy("cell", "a", "visiting", "b").applyInPandas(compare_slices, "u long, v long"))


def near_duplicates(documents: DataFrame, size: int = 5, radius: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row.

    Rows whose fingerprints of `size`-word shingles differ in at most radius bits are linked;
    component_id is the smallest doc_id that links reach. Equal fingerprints are one node, so that a
    group of copies, however large, is one row before any comparison. A null or empty text has
    fingerprint 0, which links like any other. Null ids don't name a component unless it has no other
    id. Repeated rows all come back. Other columns aren't read. An empty table gives no rows.
    """
    prints = checkpointed(fingerprints(documents, size, id_col, text_col))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(nodes, radius))
    whole = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = whole.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_first(documents: DataFrame, size: int = 5, radius: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents but for near-duplicates: of each component, one row with its smallest id stays.

    All columns come back as they were. A component whose ids are all null keeps one row. Of rows that
    repeat the smallest id, the one with the smallest text stays. Components are told apart by their
    texts, so that different texts may share an id, or have none.
    """
    nodes = documents.select(text_digest(text_col).alias("node"), F.col(text_col).alias("text"))
    found = near_duplicates(nodes, size, radius, "node", "text")
    return keep_one(documents, found.select(F.col("doc_id").alias("node"), F.col("component_id").alias("root")).distinct(), id_col, text_col)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
