"""From documents to token ids in five stages: each works on all that the one before it kept, written as Parquet and read again.

1. toxicity: documents that score at the threshold or above go; the model learns from the labelled
   documents outside the held-out fold.
2. near_duplicates: sets of five-word shingles of Jaccard similarity 0.8 or more, found by SimHash tiles and, where fingerprints
   differ in more bits, by MinHash bands; of each group one document stays.
3. repeats: passages of PASSAGE_WORDS whole words or more go from the texts if all of their bytes lie in
   strings of PASSAGE_BYTES bytes that also start in another document.
4. mixing: documents come as often as their source's target takes them, in the order of the training.
5. tokens: SentencePiece ids of each document, and what they decode to, as digests.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orbitway.llm import mixing, pieces, repeats, shingle_sets, toxicity
from orbitway.llm.common import remove_folder, scratch, shared_folder, table

#: Words of a shingle.
SHINGLE = 5
#: A passage that repeats: over fifty words. So many words have more bytes than this, unless they have three letters on average.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_rows(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_sets.keep_first(docs, SHINGLE)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(docs, PASSAGE_BYTES, PASSAGE_WORDS, across=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.arrange(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digests(docs, pieces.default_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]
#: No SQL expresses the stages; tests compare each with a plain version on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages make of the documents. Of the tables between them, the last stays: the result reads it."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
