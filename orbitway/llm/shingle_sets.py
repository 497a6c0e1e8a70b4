"""Near-duplicates by exact similarity of shingle sets: SimHash tiles and MinHash bands propose, the sets themselves decide."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from orbitway.llm.common import appended, checkpointed, keep_one, release, scratch, text_digest
from orbitway.llm.components import connected_components
from orbitway.llm.simhash import SEED, fingerprint_of, shingle_hashes
from orbitway.llm.simhash import links as tile_links

#: Sets are similar from Jaccard 4/5. A pair that similar has no band of ROWS MinHashes in common, of BANDS, with chance (1 - 0.8**4)**32 = 5e-8.
LEAST = (4, 5)
BANDS, ROWS = 32, 4
#: Texts whose SimHashes differ in so many bits at most, or are linked by such, are compared. Of pairs just above LEAST most differ in more: the bands find them.
RADIUS = 3
#: Bytes of text of a side of a comparison.
SLICE = 8 << 20
#: Shingles that are hashed at once.
BLOCK = 256

_random = np.random.default_rng(SEED)
_FLIP = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def buckets(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band of the set's MinHashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        mixed = (hashes[at : at + BLOCK, None] ^ _FLIP) * _TIMES
        mixed ^= mixed >> np.uint64(32)
        mixed *= _TIMES[::-1]
        np.minimum(least, mixed.min(axis=0), out=least)
    keys = [xxh64_intdigest(band.tobytes(), seed) for seed, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def similar_links(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links between sets (sorted, without repeats) of Jaccard LEAST or more, which connect just the sets that all such links connect.

    Breadth first: each set that was reached is compared with those that weren't. Two empty sets are similar.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    every, code = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(code, np.cumsum(sizes)[:-1])
    owner = np.repeat(np.arange(len(sets)), sizes)
    mark, left = np.zeros(len(every), bool), np.ones(len(sets), bool)
    u, v = [], []
    for first in range(len(sets)):
        queue = [first] if left[first] else []
        left[first] = False
        while queue:
            x = queue.pop()
            mark[codes[x]] = True
            common = np.bincount(owner[mark[code]], minlength=len(sets))
            mark[codes[x]] = False
            near = np.flatnonzero(left & (common * sum(LEAST) >= LEAST[0] * (sizes + sizes[x])))
            if len(near):
                left[near] = False
                u += [x] * len(near)
                v += near.tolist()
                queue += near.tolist()
                stay = left[owner]
                code, owner = code[stay], owner[stay]
            if not left.any():
                return u, v
    return u, v


def links(documents: DataFrame, size: int, text_col: str = "text") -> DataFrame:
    """u, v: digests of similar texts; they connect just those that all pairs of similar texts connect.

    The texts of each component of SimHashes (the tiles of simhash.links: exclusive-or and bit count)
    meet, and so do texts that share the key of a band of MinHashes; their sets of `size`-word shingles
    are compared whole. Components and bands in which the same texts meet count once. Where more than SLICE bytes of text meet, they are
    cut into slices by a hash, and each two slices meet.
    """

    def sign(texts: list[bytes | None]) -> tuple:
        hashes = [shingle_hashes(t, size) for t in texts]
        return [buckets(h) for h in hashes], [fingerprint_of(h) for h in hashes]

    def compare(key, group: pd.DataFrame) -> pd.DataFrame:
        node = group["node"].to_numpy()
        u, v = similar_links([np.unique(shingle_hashes(t, size)) for t in group["text"]])
        return pd.DataFrame({"u": node[np.array(u, np.int64)], "v": node[np.array(v, np.int64)]})

    texts = documents.select(text_digest(text_col).alias("node"), F.col(text_col).cast("binary").alias("text"))
    signed = checkpointed(appended(texts, "text", sign, T.StructType().add("buckets", T.ArrayType(T.LongType())).add("fp", T.LongType())).dropDuplicates(["node"]))
    prints = checkpointed(signed.select("fp").distinct())
    roots = connected_components(tile_links(prints, RADIUS))
    # A component has more than one text if several have a fingerprint, too.
    alike = signed.select("node", "fp").join(roots, signed["fp"] == roots["node"], "left").select(signed["node"], F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("bucket"))
    met = checkpointed(signed.select("node", F.explode("buckets").alias("bucket")).unionByName(alike).repartition("bucket"))
    shared = met.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("mix"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("other")).where("n > 1")
    different = shared.groupBy("n", "mix", "other").agg(F.min("bucket").alias("bucket")).select("bucket")
    members = checkpointed(met.join(different, "bucket").select("bucket", "node"))
    release(signed, met)
    wanted = checkpointed(texts.join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    sized = members.join(wanted.select("node", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")), "node")
    cuts = sized.groupBy("bucket").agg(F.ceil(F.sum("bytes") / F.lit(SLICE)).cast("int").alias("slices"))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).cast("int")
    other = F.explode(F.when(F.col("slices") <= 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("slices") - 1), F.col("own"))))
    dealt = members.join(cuts, "bucket").withColumn("own", F.when(F.col("slices") > 1, own).otherwise(0)).withColumn("other", other)
    pairs = dealt.select("node", "bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    return pairs.join(wanted, "node").groupBy("bucket", "a", "b").applyInPandas(compare, "u binary, v binary")


def keep_first(documents: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents but for near-duplicates: of each component of similar texts, one row with its smallest id stays.

    Texts are similar if the Jaccard similarity of their sets of `size`-word shingles is LEAST or more.
    Texts without words are similar to each other. All columns come back as they were; the row that
    stays is that of keep_one.
    """
    with scratch() as made:
        found = checkpointed(links(documents, size, text_col))
        made.pop()
    return keep_one(documents, connected_components(found), id_col, text_col)
