"""What goes between op10's steps is as small as its numbers are."""

import numpy as np
import pandas as pd

from orbitway.llm import ngram_scores


def test_planes_as_the_numbers_need():
    """Numbers of three bytes take three, and come back."""
    for values in (np.arange(1 << 16, 3 << 16, dtype=np.uint32), np.array([0, 2**64 - 1], np.uint64), np.zeros(0, np.uint64), np.array([7], np.int64)):
        size, data = values.dtype.itemsize, ngram_scores._packed(values)
        assert ngram_scores._unpacked(data, size).tolist() == values.tolist()
    assert len(ngram_scores._packed(np.arange(1 << 16, 3 << 16, dtype=np.uint32))) == 1 + 3 * (1 << 17)


def test_a_block_is_scored_in_runs_of_documents(spark, monkeypatch):
    """Documents of 0 to 39 words, scored 1 word at a time, all at once, and with order 3; and a block without any word."""
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(41), "text": [" ".join(f"w{(i * j) % 17}" for j in range(i % 40)) for i in range(41)]})).coalesce(1)
    for order in (2, 3):
        monkeypatch.setattr(ngram_scores, "SCORED_WORDS", 1 << 17, raising=False)
        plain = sorted(ngram_scores.stupid_backoff(docs, order).collect())
        monkeypatch.setattr(ngram_scores, "SCORED_WORDS", 1, raising=False)
        assert sorted(ngram_scores.stupid_backoff(docs, order).collect()) == plain
    none = ngram_scores.stupid_backoff(docs.where("doc_id in (0, 40)")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["log10_score"], r["mean_log10"]) for r in none) == [(0, 0, 0.0, None), (40, 0, 0.0, None)]
