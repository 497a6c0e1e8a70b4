import os
import random

from orbitway.llm import common, repeats, shingle_sets


def _texts(n: int = 40) -> list[str]:
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(600)).split()
    return [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(100, 100 + n)]


def test_simhash_alone_finds_close_texts(spark, monkeypatch):
    """Texts that differ in one word of 600 meet by their fingerprints, if no band does."""
    far = [" ".join(f"x{random.Random(i).randrange(10**6)}" for i in range(k, k + 300)) for k in (0, 1000)]
    rows = list(enumerate(_texts(6) + far))
    monkeypatch.setattr(shingle_sets, "buckets", lambda hashes: [hash((hashes.tobytes(), i)) for i in range(3)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r[0] for r in shingle_sets.keep_first(docs).collect()]
    assert sorted(kept) == [0, 6, 7]


def test_scratch_leaves_no_checkpoint(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(_texts(8) + ["a b c"])), "doc_id long, text string")
    files = lambda: sum(len(f) for _, _, f in os.walk(spark.sparkContext.getCheckpointDir().removeprefix("file:")))
    common.shared_folder(spark)
    before = files()
    with common.scratch():
        repeats.without_repeats(shingle_sets.keep_first(docs), 200, 50, across=True).write.parquet(str(tmp_path / "out"))
        assert files() > before
    assert files() <= before
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_only_what_is_read_later_stays(spark):
    """Texts, bands and segments are gone when a stage's result is still to be read."""
    docs = spark.createDataFrame(list(enumerate(_texts(8) + ["a b c"])), "doc_id long, text string")
    common.shared_folder(spark)
    with common.scratch() as made:
        kept = shingle_sets.keep_first(docs)
        cut = repeats.without_repeats(docs, 200)
        left = [set(df.columns) for df in made if os.path.exists(df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:"))]
        assert not any(c & {"text", "bucket", "buckets", "segment", "windows", "within"} for c in left)
        assert kept.count() == 2 and cut.count() == 9
