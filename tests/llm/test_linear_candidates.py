"""What is compared grows with the fingerprints and not with their square; rounds over few rows have few tasks."""

import numpy as np
import pytest

from orbitway.llm import common, components, repeats, simhash


def _components(n, pairs):
    forest = simhash.Forest(n)
    for a, b in pairs:
        ra, rb = forest.find(a), forest.find(b)
        forest.up[max(ra, rb)] = min(ra, rb)
    return [forest.find(x) for x in range(n)]


@pytest.mark.parametrize("radius", [2, 3, 6])
@pytest.mark.parametrize("side", [4096, 40])
def test_links_equal_brute_force(spark, monkeypatch, radius, side):
    """Scattered fingerprints and dense groups; with small sides, cells are cut into slices."""
    monkeypatch.setattr(simhash, "SIDE", side)
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 1 << 64, 12, np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (900, 4)).astype(np.uint64), axis=1)
    fp = np.unique(np.r_[centres, rng.choice(centres, 900) ^ flips, rng.integers(0, 1 << 64, 600, np.uint64), np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    prints = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long").repartition(3)
    at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    got = [(at[r.u], at[r.v]) for r in simhash.links(prints, radius).collect()]
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= radius
    assert _components(len(fp), got) == _components(len(fp), np.argwhere(np.triu(near, 1)))


def test_cells_of_a_row_do_not_grow_with_the_rows():
    """A row went to as many tasks as its tiles had slices."""
    fp = np.random.default_rng(1).integers(0, 1 << 64, 200_000, np.uint64)
    small, large = (len(simhash._cells(simhash._visits(fp[:n], 3), 3)) for n in (40_000, 200_000))
    assert 4.9 * small < large < 5.1 * small and large < 20 * len(fp)


def test_rounds_over_few_rows_have_few_tasks(spark, monkeypatch):
    """Components and lower levels of repeats had as many tasks a step as a shuffle has partitions."""
    conf = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    parts, keep = [], common.checkpointed

    def watched(df):
        out = keep(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    for k, v in conf.items():
        spark.conf.set(k, v)
    monkeypatch.setattr(components, "checkpointed", watched)
    monkeypatch.setattr(repeats, "checkpointed", watched)
    monkeypatch.setattr(repeats, "CROWD", 2)
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
        found = {r.node: r.root for r in components.connected_components(edges).collect()}
        assert found == dict.fromkeys(range(41), 0)
        assert max(parts[1:]) == 1
        parts.clear()
        shared = "".join(chr(97 + (k * k // 7 + k) % 26) for k in range(60))
        rows = [(i, "".join(chr(65 + (k * i + i) % 26) for k in range(50)) + shared + "z" * i) for i in range(1, 9)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        kept = {r.doc_id: r.text for r in repeats.without_repeats(docs, 40, across=True).collect()}
        starts = {}
        for i, t in rows:
            for k in range(len(t) - 39):
                starts.setdefault(t[k : k + 40], set()).add(i)
        for i, t in rows:
            gone = {x for k in range(len(t) - 39) if len(starts[t[k : k + 40]]) > 1 for x in range(k, k + 40)}
            assert kept[i] == "".join(c for x, c in enumerate(t) if x not in gone)
        assert all(shared not in t for t in kept.values())
        assert sum(n <= 2 for n in parts) > len(parts) // 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
