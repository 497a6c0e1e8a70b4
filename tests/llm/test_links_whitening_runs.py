"""op11, op12 and op13 against plain versions, and on rows that are null, empty, repeated or odd."""

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from orbitway.llm import lattice_links, whitening, word_runs

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, node long, copies long, x int, w int, at int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0, 0, 0) for r in rows], VECTORS).repartition(3)


def near_groups(seed, groups, size, width=16):
    """Rows (id, vector, label) around centres, at cosines from about 0.9 to 1 of them."""
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        centre = rng.normal(size=width)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            off = rng.normal(size=width)
            off -= centre * (off @ centre)
            angle = rng.uniform(0, 0.3)
            v = np.cos(angle) * centre + np.sin(angle) * off / np.linalg.norm(off)
            out.append((len(out), (v * rng.uniform(0.5, 3)).astype(np.float32).tolist(), g % 3))
    return out


def plain_links(rows, least=0.93):
    n, up = len(rows), list(range(len(rows)))
    links = [0] * n
    unit = [None if v is None or not v or any(e is None or not np.isfinite(e) for e in v) or not any(v) else np.array(v, float) / np.linalg.norm(np.array(v, float)) for _, v, _ in rows]
    for i in range(n):
        for j in range(i):
            if unit[i] is None or unit[j] is None or len(unit[i]) != len(unit[j]) or rows[i][2] is None or rows[i][2] != rows[j][2]:
                continue
            if unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                a, b = i, j
                while up[a] != a:
                    a = up[a]
                while up[b] != b:
                    b = up[b]
                up[max(a, b)] = min(a, b)
    root = []
    for i in range(n):
        while up[i] != i:
            i = up[i]
        root.append(i)
    return links, [min((rows[k][0] for k in range(n) if root[k] == r and rows[k][0] is not None), default=None) for r in root]


@pytest.mark.parametrize("side", [2048, 16])
def test_links_are_those_of_brute_force(spark, monkeypatch, side):
    """Recall is at least 0.99 and nothing else links; cells that many visit are cut into slices without loss."""
    monkeypatch.setattr(lattice_links, "SIDE", side)
    rows = near_groups(3, 12, 30)
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(50)]
    got = {r["vec_id"]: r for r in lattice_links.linked(vectors(spark, rows)).collect()}
    links, _ = plain_links(rows)
    found = [got[r[0]]["n_links"] for r in rows]
    assert all(f <= w for f, w in zip(found, links, strict=True)) and sum(found) >= 0.99 * sum(links) > 5000
    for (i, _, _), n in zip(rows, found, strict=True):
        assert got[i]["component_id"] <= i and got[i]["kept"] == (got[i]["component_id"] == i)
        assert got[got[i]["component_id"]]["kept"] and (n > 0 or got[i]["kept"])


def test_links_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (2, [1.0, 0.1], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1), (8, [], 1)]
    rows += [(9, [1.0, 0.0], None), (10, [1.0, 0.0], None), (None, [0.9, 0.1], 1), (None, [0.0, 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e30, 1e29], 1), (13, [1.0, 0.0], 2), (14, [float("inf"), 1.0], 2)]
    out = lattice_links.linked(vectors(spark, rows))
    links, least = plain_links(rows)
    key = lambda x: str(x)
    want = [(r[0], n, m, r[0] == m) for r, n, m in zip(rows, links, least, strict=True)]
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(want, key=key)
    assert lattice_links.linked(vectors(spark, rows).where("false")).count() == 0


def test_lattice_points():
    """Nearest points against a search of all points near zero, and whole steps to 240 neighbours."""
    near = [p for p in np.stack(np.meshgrid(*[[-1, 0, 1]] * 8), -1).reshape(-1, 8) if p.sum() % 2 == 0]
    half = [p for p in np.stack(np.meshgrid(*[[-0.5, 0.5]] * 8), -1).reshape(-1, 8) if p.sum() % 2 == 0]
    every = np.array(near + half)
    y = np.random.default_rng(1).uniform(-0.5, 0.5, (300, 8))
    best = ((y[:, None, :] - every[None]) ** 2).sum(-1).min(1)
    assert np.allclose(((y - lattice_links.nearest_points(y)) ** 2).sum(1), best)
    assert len(np.unique(lattice_links.roots(), axis=0)) == 240 and np.allclose((lattice_links.roots() ** 2).sum(1), 2)


def plain_whitening(rows, k):
    sound = [(i, [e for e in v]) for i, v in rows if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    width = max((len(v) for _, v in sound), default=0)
    x = np.array([np.floor(256 * np.array(v + [0.0] * (width - len(v)), np.float32).astype(float)) for _, v in sound]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    values, turn = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return [i for i, _ in sound], ((n * x - sums) ** 2).sum(1), (x - sums / n) @ turn / np.sqrt(values), values / np.cov(fit.T.astype(float), bias=True).trace(), n


@pytest.mark.parametrize("width, block", [(64, 16), (150, 8), (5, 16)])
def test_whitening(spark, width, block):
    rng = np.random.default_rng(width)
    turned = rng.normal(size=(300, width)) * np.linspace(2, 0.5, width) @ np.linalg.qr(rng.normal(size=(width, width)))[0]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(turned)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(900, None), (901, [None] * width), (902, [float("nan")] * width), (903, [1.0])]
    got = whitening.whiten(vectors(spark, [(*r, 1) for r in rows]), block=block).toPandas()
    ids, deviation, white, explained, n = plain_whitening(rows, 4)
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    for j in range(4):
        assert min(abs(table[:, j] - white[:, j]).max(), abs(table[:, j] + white[:, j]).max()) < 1e-9
    one = got[got["component"] == 1].set_index("vec_id").loc[ids]
    assert one["deviation"].tolist() == deviation.tolist() and (got["n"] == n).all()
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9 and got["residual"].max() < 1e-10


def test_whitening_of_little(spark):
    few = lambda rows: whitening.whiten(vectors(spark, [(*r, 1) for r in rows]))
    assert few([(1, None)]).count() == 0 and few([(1, [0.5, 1.0])]).count() == 0 and few([(1, []), (2, [])]).count() == 0
    assert few([(i, [0.5, 1.0]) for i in range(5)]).count() == 0
    line = few([(None, [0.0, 0.0]), (1, [1.0, 1.0]), (1, [2.0, 2.0])]).collect()
    assert [r["component"] for r in line] == [1, 1, 1] and {r["n"] for r in line} == {3} and abs(line[0]["explained"] - 1) < 1e-12
    assert whitening.squared_distances(np.array([[1 << 39, 0]]), 1 << 22, np.array([0, 0])) == [None]
    big = whitening.squared_distances(np.array([[1 << 20, 3]]), 1 << 11, np.array([5, 7]))
    assert big == [((1 << 31) - 5) ** 2 + (3 * (1 << 11) - 7) ** 2]
    with pytest.raises(Exception, match="too large"):
        few([(1, [3e30]), (2, [1.0])]).count()


def plain_runs(x, least=6, times=4):
    n, out = len(x), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            if i + q - start >= max(least, times * q):
                out.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def test_runs_are_those_of_brute_force():
    pick = random.Random(7)
    for turn in range(1500):
        x, kinds = [], pick.choice([1, 2, 3, 5])
        for _ in range(pick.randrange(12)):
            if x and pick.random() < 0.4:
                at = pick.randrange(len(x))
                x += x[at : at + pick.randrange(1, 40)]
            else:
                x += [pick.randrange(kinds) for _ in range(pick.randrange(1, 5))] * pick.randrange(1, 8)
        assert word_runs.runs(x) == plain_runs(x) and word_runs.runs(x, 2, 2) == plain_runs(x, 2, 2)
        assert sum(n for n, _ in word_runs.factors(x)) == len(x)
        texts = [[b"%d" % c for c in x], [], [b"0"] * (turn % 9), [b"%d" % c for c in x[::-1]]]
        assert word_runs.runs_of_all(texts) == [plain_runs(t) for t in texts]


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_documents(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: tuple(r) for r in word_runs.op13_word_runs(spark, SF).collect()}
    assert len(got) == frame.count()
    for r in frame.collect():
        if len(r["text"] or "") < 20000:
            assert got[r["doc_id"]] == plain_row(r["doc_id"], r["text"])


def test_runs_of_odd_rows(spark):
    periodic = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = [None, "", " \t\n", "a " * 9, "a\x0bb " * 5 + "c", "é\x1cé " * 8, "one two three " * 3 + "one", "x " * 50000 + "y z " * 30000, "only"]
    rows = [(i, t, 1, 1) for i, t in enumerate(texts)] + [(p, t, 1, 1) for p, t in zip(periodic, texts, strict=False)] + [(None, "b b b b b b", 1, 1), (3, "a " * 9, 1, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, words int, start int").repartition(2)
    text = word_runs.periodic_text(F.col("text"), F.col("doc_id"))
    got = word_runs.digests(frame.withColumn("text", text)).collect()
    short = [r for r in rows if len(r[1] or "") < 1000]
    for r in short:
        assert plain_row(r[0], r[1]) in [tuple(x) for x in got]
    whole = word_runs.with_runs(frame.withColumnRenamed("start", "begin")).collect()
    assert len(whole) == len(rows)
    long = next(r for r in whole if r["doc_id"] == 7)
    assert [tuple(x) for x in long["runs"]] == [(0, 50000, 1), (50000, 60000, 2)] and long["collapsed"] == "x y z"
    assert word_runs.digests(frame.where("false")).count() == 0


def test_vectors_of_the_tables(spark):
    sf = "/root/testdata/check_s"
    if not os.path.isdir(sf):
        pytest.skip("the tables with planted vectors aren't here")
    table = pq.read_table(f"{sf}/embeddings.parquet")
    chosen = spark.read.parquet(f"{sf}/embeddings.parquet").where("label = 1")
    got = {r["vec_id"]: r["n_links"] for r in lattice_links.linked(chosen).collect()}
    keep = np.array([x == 1 for x in table["label"].to_pylist()])
    unit = lattice_links.unit_rows(np.array(table["embedding"].to_pylist(), float)[keep])
    links = (unit @ unit.T >= 0.93).sum(1) - 1
    ids = np.array(table["vec_id"].to_pylist())[keep]
    found = np.array([got[i] for i in ids.tolist()])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum() > 10000
