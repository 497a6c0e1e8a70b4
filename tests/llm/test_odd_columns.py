"""Ids beside nulls and above 2**53, and extra columns with the names that operators use inside."""

import numpy as np
import pytest

import corpus_pipeline
from orbitway.llm import html_text, media, mixing, ngram_scores, pieces, repeats, shingle_sets, simhash, token_files, toxicity

BIG = 9007199254740993
CLASHES = ["_md5", "_bytes", "_starts", "_turn", "_position", "toxicity", "main_text", "media", "image", "_text_id", "_key", "_node", "_first", "key", "text_key", "size", "root", "fp"]
TEXT = "these words stand in a row so that the text is long enough for everything"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(BIG, TEXT, "en", "s", 5), (None, "another text", "en", None, 5), (BIG + 2, TEXT, "de", "s", 5), (None, None, None, "t", None)]
    extra = ", ".join(f"{c} long" for c in CLASHES)
    return spark.createDataFrame([(*r, *[5] * len(CLASHES)) for r in rows], f"doc_id long, text string, lang string, source string, n_chars int, {extra}").coalesce(1)


def ids(frame, name="doc_id"):
    return sorted((r[name] for r in frame.select(name).collect()), key=lambda x: x or 0)


ALL = [None, None, BIG, BIG + 2]


def test_ids_stay_whole(spark, docs, tmp_path):
    prints = simhash.near_duplicates(docs, 3, 2)
    assert ids(prints) == ALL
    assert {r["doc_id"]: r["component_id"] for r in prints.where("doc_id is not null").collect()} == {BIG: BIG, BIG + 2: BIG}
    assert ids(media.digests(docs)) == ALL
    assert ids(pieces.digests(docs, pieces.default_model())) == ALL
    assert ids(pieces.encode(docs, pieces.default_model())) == ALL
    assert ids(ngram_scores.stupid_backoff(docs)) == ALL
    assert ids(mixing.mix(docs)) == ALL
    token_files.write_shards(docs, str(tmp_path / "t"), token_files.default_vocabulary())
    assert ids(token_files.read_shards(spark, str(tmp_path / "t"))) == ALL
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    assert ids(repeats.op9_repeats(spark, str(tmp_path))) == ALL


@pytest.mark.parametrize("stage", ["repeats", "near", "simhash", "arrange", "clean", "extract", "media"])
def test_columns_come_back(spark, docs, stage):
    model = toxicity.Model({"bad": 3.0}, {})
    out = {
        "repeats": lambda: repeats.without_repeats(docs, 20),
        "near": lambda: shingle_sets.keep_first(docs),
        "simhash": lambda: simhash.keep_first(docs),
        "arrange": lambda: mixing.arrange(docs),
        "clean": lambda: toxicity.clean_rows(docs, model),
        "extract": lambda: html_text.extract(docs, html_col="text"),
        "media": lambda: media.decode(media.encode(docs), "media_"),
    }[stage]()
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == 5 for r in rows for c in CLASHES)
    if stage == "media":
        assert sorted(bytes(r["image_"]["payload"]).rstrip() for r in rows) == sorted((t or "").encode() for t in (TEXT, TEXT, "another text", None))


def test_stages_take_odd_rows(spark, docs, tmp_path):
    spark.createDataFrame([(BIG, 0), (None, 1), (7, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for frame in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path))
            assert out.count() >= 0
            if name != "tokens":
                assert out.columns == docs.columns


def test_keys_find_their_documents(spark, tmp_path, monkeypatch):
    """Through the router and each shard's own index, also where an id's rows fill more than one shard."""
    monkeypatch.setattr(token_files, "ROUTED", 50)
    rows = [(i, f"text number {i}") for i in range(300)] + [(None, "nameless")] + [(42, f"again {i} " + "word " * 300000) for i in range(4)]
    path, own = str(tmp_path / "files"), token_files.encoder(token_files.default_vocabulary())
    token_files.write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, token_files.default_vocabulary())
    assert spark.read.parquet(f"{path}/shards").count() > 1 and spark.read.parquet(f"{path}/router").count() > 3
    asked = [7, 42, 299, None, 1000, 7]
    got = token_files.find(spark.createDataFrame([(x,) for x in asked], "doc_id long"), path).collect()
    want = sorted((x or -1, np.frombuffer(own.encode(t), "<u4").tolist() + [2]) for x, t in rows if x in set(asked))
    assert sorted((r["doc_id"] or -1, list(r["ids"])) for r in got) == want


def test_sparse_pages():
    text = html_text.default_model().text
    assert text("<p>a</p>") == "a"
    assert text("<article><dl><dt>term</dt><dd>what it means</dd></dl></article>") == "term\nwhat it means"
    assert text("<div>" * 3000 + "some text" + "</div>" * 3000) == "some text"
    assert text("<article>a<svg class='i'/>b <a href=/it's>c</a> d</article>") == "ab c d"
    assert text("<nav><a href=x>menu</a></nav>") == ""


def test_passages_point_at_the_text():
    model = toxicity.Model({"awful": 4.0, "nasty": 4.0}, {}, rate=1.0, log_k=0.0)
    text = "İ plain words first. You awful, nasty thing! and then many plain words after it"
    (begin, end, evidence), = model.passages(text)
    assert text[begin:end] == "awful, nasty" and abs(evidence - model.evidence(text)) < 1e-9
    assert model.passages(None) == model.passages("") == []


def test_only_long_passages_go(spark):
    long, short = " ".join(f"word{i}" for i in range(60)), " ".join(f"somewhatlongerwords{i}" for i in range(15))
    rows = [(1, f"one {long} end"), (2, f"two {long} fin"), (3, f"three {short} end"), (4, f"four {short} fin")]
    out = {r[0]: r[1] for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 200, 50).collect()}
    assert "word5" not in out[1] + out[2] and out[1].startswith("one") and out[2].endswith("fin")
    assert out[3] == rows[2][1] and out[4] == rows[3][1]


def plain_across(texts, length):
    starts = [{t[i : i + length] for i in range(len(t) - length + 1)} for t in texts]
    out = []
    for k, t in enumerate(texts):
        others = set().union(*(s for j, s in enumerate(starts) if j != k))
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if t[i : i + length] in others:
                cover[i : i + length] = b"\x01" * length
        out.append(bytes(b for b, c in zip(t, cover, strict=True) if not c))
    return out


@pytest.mark.parametrize("crowd", [512, 2])
def test_repeats_across_rows(spark, monkeypatch, crowd):
    import random

    monkeypatch.setattr(repeats, "CROWD", crowd)
    pick = random.Random(4)
    passages = ["".join(pick.choice("abcde") for _ in range(40)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = ["".join(pick.choice("abcde") for _ in range(pick.randint(0, 30))) for _ in range(4)]
        own = "".join(pick.choice("xyz") for _ in range(30))
        texts.append(own.join(parts) if pick.random() < 0.5 else pick.choice(passages).join(parts[:2]))
    texts += ["que " * 40, "que " * 15 + "other", texts[0], texts[1] + texts[1]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r[0]: r[1] for r in repeats.without_repeats(frame, 24, across=True).collect()}
    assert [got[i] for i in range(len(texts))] == [x.decode() for x in plain_across([t.encode() for t in texts], 24)]
