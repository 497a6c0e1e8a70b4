"""Parts of op10's count tables follow the words of the documents, not the partitions that they come in."""

import pandas as pd

from orbitway.llm import ngram_scores


def test_parts_grow_with_words(spark, monkeypatch):
    """2000 words in one partition: a part has so few that no task holds many, and the scores are the same."""
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(40), "text": [" ".join(f"w{(i * j) % 97}" for j in range(50)) for i in range(40)]})).coalesce(1)
    seen, counted = [], ngram_scores._counted
    monkeypatch.setattr(ngram_scores, "_counted", lambda blocks, order, parts: seen.append(parts) or counted(blocks, order, parts))
    plain = sorted(ngram_scores.stupid_backoff(docs).collect())
    monkeypatch.setattr(ngram_scores, "PART_WORDS", 50, raising=False)
    assert sorted(ngram_scores.stupid_backoff(docs).collect()) == plain
    assert seen == [4, 40]
