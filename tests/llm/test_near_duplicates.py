"""The pipeline's near-duplicate stage against a brute-force version."""

import random

import pytest

import corpus_pipeline
from orbitway.llm import shingle_sets


def shingles(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def similar(a, b):
    return not a and not b or len(a & b) * 5 >= 4 * len(a | b)


def brute_roots(sets):
    up = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    return up


def edited_texts(seed, bases=60):
    """Random texts and copies of them with a few words replaced: similarities from about 0.6 to 1."""
    rng, out = random.Random(seed), []
    for _ in range(bases):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        out.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            copy = list(words)
            for at in rng.sample(range(len(copy)), rng.randrange(1, max(2, len(copy) // 25))):
                copy[at] = f"v{rng.randrange(5000)}"
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("slice_bytes", [shingle_sets.SLICE, 2000])
def test_stage_keeps_what_brute_force_keeps(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(shingle_sets, "SLICE", slice_bytes)
    texts = [*edited_texts(7), "", " \n", None, "one two", "ONE  two"]
    sets = [shingles(t) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 0.8 <= len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) < 0.9]
    assert len(near) > 20
    roots = brute_roots(sets)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == sorted(set(roots))


def test_links_are_exact():
    sets = [[1, 2, 3, 4], [1, 2, 3, 4, 5], [2, 3, 4, 5, 6], [], [], [9]]
    import numpy as np

    u, v = shingle_sets.similar_links([np.array(s, np.uint64) for s in sets])
    assert sorted(zip(u, v, strict=True)) == [(0, 1), (3, 4)]
