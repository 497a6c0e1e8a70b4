"""Each operator against a plain version on small tables, and on rows that are null, empty, repeated or odd."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from orbitway.llm import html_text, jpeg, media, mixing, ngram_scores, pieces, repeats, simhash, token_files, topk, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, an empty text, ties, repeated rows, and extra columns with clashing names."""
    rows = [(1, "a b c d e", "s"), (2, None, None), (None, "A b  c", "s"), (3, "", "t"), (1, "a b c d e", "s"), (4, "x " * 900 + "é<|endoftext|>", "t"), (5, "\x1c\n \t", None)]
    return spark.createDataFrame([(*r, 0, "k", 1) for r in rows], "doc_id long, text string, source string, size long, key string, id int")


def documents(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    return frame, frame.toPandas().sort_values("doc_id").reset_index(drop=True)


def empty(frame):
    return frame.where("false")


@pytest.mark.parametrize("module, run", [(mixing, mixing.op2_mixing), (topk, topk.op1_topk), (ngram_scores, ngram_scores.op10_ngram_scores)])
def test_sql(spark, module, run):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = run(spark, SF).toPandas(), con.execute(module.SQL).df()
    keys = [c for c in ("query_id", "rank", "doc_id") if c in got]
    got, want = (x.sort_values(keys)[sorted(want.columns)].reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_mix_takes_targets(spark, odd):
    out = mixing.mix(odd).toPandas()
    assert len(out) == 7 and (out["taken"] <= 3 * out["size"]).all()
    assert mixing.mix(empty(odd)).count() == 0 and mixing.arrange(empty(odd)).count() == 0
    frame, _ = documents(spark)
    mixed = mixing.mix(frame).toPandas().groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(mixed["taken"] - mixed["target"]) <= 1).all()


def test_simhash_components(spark, odd):
    got = simhash.op3_simhash(spark, SF).toPandas().sort_values("doc_id")
    prints = [int(x, 16) for x in got["fingerprint"]]
    ids, up = got["doc_id"].tolist(), list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    assert got["component_id"].tolist() == [ids[u] for u in up]
    out = simhash.near_duplicates(odd, 3, 2).toPandas()
    assert len(out) == 7 and set(out.loc[out["fp"] == 0, "component_id"]) == {2}
    assert simhash.near_duplicates(empty(odd)).count() == 0
    assert simhash.keep_first(odd, 3, 2).columns == odd.columns


def test_simhash_tiles_lose_nothing():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, np.uint64)
    flips = [b ^ np.uint64(1 << int(rng.integers(63))) ^ np.uint64(1 << int(rng.integers(63))) for b in base for _ in range(4)]
    fp = np.unique(np.concatenate([base, flips]))
    visits = simhash._visits(fp, 2)
    home = dict(zip(visits.loc[visits["home"], "fp"], visits.loc[visits["home"], "tile"], strict=True))
    where = set(zip(visits["fp"], visits["tile"], strict=True))
    signed = fp.view(np.int64)
    for i, a in enumerate(fp):
        for j in np.flatnonzero(np.bitwise_count(fp ^ a) <= 2):
            x, y = signed[i], signed[j]
            assert (x, home[y]) in where or (y, home[x]) in where


def test_media_round_trip(spark, odd):
    payloads = [media.padded(x) for x in (None, b"", "é".encode() * 500, bytes(range(256)) * 30)]
    stored = media.store(payloads)
    back, tensors = media.load(stored)
    assert back == payloads
    images, coefficients = jpeg.decode(stored)
    assert all((jpeg.tensor(i, coefficients) == t).all() for i, t in zip(images, tensors, strict=True))
    assert media.store(payloads[2:3])[0] == stored[2]
    out = media.digests(odd).toPandas()
    assert len(out) == 7 and out["payload_sha256"][1] == out["payload_sha256"][3] == hashlib.sha256(b" " * 192).hexdigest()
    assert out["tail_crc32"][1] == zlib.crc32(b" " * 16)
    assert media.digests(empty(odd)).count() == 0
    assert media.decode(media.encode(odd)).select("image.payload").first()[0] == media.padded(b"a b c d e")


def test_inverse_transform_is_the_cosine_sum():
    rng = np.random.default_rng(1)
    c = rng.integers(-60, 60, (5, 64))
    got = jpeg.samples(c, np.ones(64, np.int64)).astype(float)
    natural = np.zeros((5, 64))
    natural[:, jpeg.ZIGZAG] = c
    a = [[(8**-0.5 if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)]
    want = np.clip(np.array(a) @ natural.reshape(5, 8, 8) @ np.array(a).T + 128, 0, 255)
    assert abs(got - want).max() <= 1


def test_token_files(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    path = token_files.default_vocabulary()
    plain = Tokenizer.from_file(path)
    _, rows = documents(spark)
    got = token_files.op5_token_files(spark, SF).toPandas().sort_values("doc_id")
    ids = [e.ids + [2] for e in plain.encode_batch(list(rows["text"]), add_special_tokens=False)]
    n = np.array([len(x) for x in ids])
    assert got["n_tokens"].tolist() == n.tolist() and got["start"].tolist() == (np.cumsum(n) - n).tolist()
    assert got["ids_crc32"].tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    token_files.write_shards(odd, str(tmp_path / "odd"), path)
    assert token_files.read_shards(spark, str(tmp_path / "odd")).count() == 7
    token_files.write_shards(empty(odd), str(tmp_path / "none"), path)
    assert token_files.read_shards(spark, str(tmp_path / "none")).count() == 0


def test_index_refuses_unknown_keys():
    keys = [token_files.key_bytes(k) for k in range(3000)]
    index = token_files.Index(token_files.build_index(keys, np.arange(3000), np.arange(3000) + 1))
    starts, lengths = index.find(keys)
    assert starts.tolist() == list(range(3000)) and lengths.tolist() == list(range(1, 3001))
    assert (index.find([token_files.key_bytes(k) for k in range(5000, 6000)])[0] >= 0).sum() == 0


def test_chunk_tables_match_the_libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    pick = random.Random(1)
    bpe, plain = token_files.encoder(token_files.default_vocabulary()), Tokenizer.from_file(token_files.default_vocabulary())
    words, model = pieces.codec(pieces.default_model()), sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    parts = [" ", "  ", "\n", "\r", "a", "B", "'s", "1", "é", ".", "<|endoftext|>", "\t", "日本", "\xa0", "\x85", "\x1c", "½", "▁", "😀"]
    for _ in range(3000):
        x = "".join(pick.choice(parts) for _ in range(pick.randint(0, 12)))
        assert np.frombuffer(bpe.encode(x), "<u4").tolist() == plain.encode(x, add_special_tokens=False).ids
        ids = model.encode(x, add_bos=True, add_eos=True)
        assert np.frombuffer(words.encode(x), "<u4").tolist() == ids and words.decode(words.encode(x)) == model.decode(ids)


def test_sentencepiece_rows(spark, odd):
    out = pieces.digests(odd, pieces.default_model()).toPandas()
    assert len(out) == 7 and out["n_tokens"][1] == out["n_tokens"][3] == 2
    assert pieces.encode(odd, pieces.default_model()).select("ids").first()[0][0] == 1
    assert pieces.digests(empty(odd), pieces.default_model()).count() == 0


def test_html_labelled_pages():
    model = html_text.default_model()
    wrong = total = 0
    for page, content in html_text.labelled_pages(150, seed=11):
        tree = html_text.parse(page)
        p = model.marginals(tree)
        total += len(tree.runs)
        wrong += sum((p[i] >= 0.5) != content[i] for i, _, _ in tree.runs)
    assert wrong < 0.04 * total


def test_html_messages_are_exact():
    """Marginals equal those of summing over all states of a small tree."""
    model = html_text.default_model()
    tree = html_text.parse("<body><nav><a href=x>m</a></nav><article><p>one two three</p><div class=ad>buy</div></article></body>")
    n = len(tree.tags)
    own = [1 / (1 + np.exp(-sum(model.unary.get(f, 0.0) for f in fs))) for fs in html_text._features(tree)]
    total, ones = 0.0, np.zeros(n)
    for k in range(1 << n):
        y = [(k >> i) & 1 for i in range(n)]
        w = 1 / (1 + np.exp(-model.bias)) if y[0] else 1 - 1 / (1 + np.exp(-model.bias))
        for i in range(n):
            w *= own[i] if y[i] else 1 - own[i]
            if i:
                stay = model.pairs.get((tree.tags[tree.parent[i]], tree.tags[i]), model.stay)[y[tree.parent[i]]]
                w *= stay if y[i] == y[tree.parent[i]] else 1 - stay
        total += w
        ones += w * np.array(y)
    assert np.allclose(model.marginals(tree), ones / total)


def test_html_articles(spark):
    """The text of each page is that of its article: elements under the first article tag, on pages whose articles are short, too."""
    sf = "/root/testdata/sf0.1"
    texts = {r["page_id"]: r["text"] for r in html_text.op6_html(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(texts) == len(pages) == 2500
    for r in pages:
        tree = html_text.parse(r["html"])
        first, under = tree.tags.index("article"), [False] * len(tree.tags)
        for i, p in enumerate(tree.parent):
            under[i] = i == first or i > 0 and under[p]
        assert texts[r["page_id"]] == "\n".join(t for i, t, _ in tree.runs if under[i]), r["page_id"]


def test_html_where_nothing_stands_out():
    model = html_text.default_model()
    assert model.text("<nav><a href=x>menu</a></nav><article><h1>Oh.</h1><p><b>Oh.<br></article><footer>about us</footer>") == "Oh.\nOh."
    assert model.text("<div class=ad>buy</div><article><p>a</article>") == "a"


def test_html_rows(spark):
    frame = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "plain &amp; text", 3), (4, "<article><p>a  b<p>c", 4), (4, "<article><p>a  b<p>c", 4)], "page_id long, html string, text int")
    assert [r[0] for r in html_text.extract(frame).select("main_text").collect()][:3] == ["", "", "plain & text"]
    assert html_text.extract(empty(frame)).count() == 0


def test_segments_match_the_definition():
    """The best segment is the first; segments don't overlap; and none has a prefix or suffix of no worth."""
    pick = random.Random(2)
    for _ in range(300):
        w = [pick.uniform(-3, 2) for _ in range(pick.randint(0, 15))]
        best = max([sum(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)], default=0)
        found = toxicity.segments(w)
        assert abs(max(found, default=0) - max(best, 0)) < 1e-9


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op8_toxicity(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got["held_out"]]
    ranks = held["score"].rank()
    ones = held["toxic"] == 1
    auc = (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert auc > 0.8 and held["score"].between(0, 1).all()


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    assert toxicity.score(odd, model).count() == 7
    assert toxicity.clean_rows(empty(odd), model).columns == odd.columns


def plain_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = b"\x01" * length
        out.append(bytes(b for b, c in zip(t, cover, strict=True) if not c))
    return out


def test_transform_finds_repeats():
    pick = random.Random(3)
    for _ in range(150):
        length = pick.choice([1, 2, 3, 5, 9])
        texts = [bytes(pick.choice(b"ab") if pick.random() < 0.8 else pick.choice(b"abcd\x00\xff") for _ in range(pick.randint(0, 30))) for _ in range(pick.randint(1, 8))]
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [[i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1] for t in texts]
        assert [x.tolist() for x in repeats.repeated_starts(texts, length)] == want


@pytest.mark.parametrize("crowd", [512, 2])
def test_repeats(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    _, rows = documents(spark)
    got = repeats.op9_repeats(spark, SF).toPandas().sort_values("doc_id")
    want = plain_repeats([t.encode() for t in rows["text"]], 400)
    assert got["kept_sha256"].tolist() == [hashlib.sha256(x).hexdigest() for x in want]


def test_repeats_odd_rows(spark, odd):
    out = repeats.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == 7
    assert repeats.without_repeats(empty(odd)).count() == 0


def test_scores_of_odd_rows(spark, odd):
    out = ngram_scores.stupid_backoff(odd, order=3).toPandas()
    assert len(out) == 7 and out.loc[out["n_words"] == 0, "log10_score"].eq(0).all()
    assert ngram_scores.stupid_backoff(empty(odd)).count() == 0


def test_top_k_odd_rows(spark):
    rows = [(0, [0.5, 0.25]), (50, [0.5, None]), (100, None), (1, [0.5, float("nan")]), (2, [0.1, 0.1]), (3, [0.1, 0.1]), (None, [1.0, 1.0]), (4, [])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, v int")
    out = topk.top_k(topk.integer_vectors(frame, "vec_id", "embedding")).toPandas().sort_values("rank")
    assert out["vec_id"].tolist() == [2, 3, 4] and set(out["query_id"]) == {0}
    assert topk.top_k(topk.integer_vectors(empty(frame), "vec_id", "embedding")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs, rows = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(out.toPandas(), out.schema)
    assert docs.count() > 0


def subsampled_stream(luma, blue, red, width, height, h, v):
    """A progressive stream of flat blocks, h x v luma blocks a unit and one of each chroma; only direct terms, in one scan of all three components."""
    bits = ""
    # One Huffman code of four bits for each size from 0 to 11.
    symbols = list(range(12))
    past = [0, 0, 0]
    rows, columns = -(-height // (8 * v)), -(-width // (8 * h))
    for y in range(rows):
        for x in range(columns):
            unit = [(0, luma[y * v + j][x * h + i]) for j in range(v) for i in range(h)] + [(1, blue[y][x]), (2, red[y][x])]
            for k, level in unit:
                change = level - past[k]
                past[k] = level
                size = abs(change).bit_length()
                bits += format(size, "04b") + (format(change if change > 0 else change + (1 << size) - 1, f"0{size}b") if size else "")
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    segment = lambda marker, body: bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, h << 4 | v, 0, 2, 0x11, 0, 3, 0x11, 0])
    counts = [0, 0, 0, 12] + [0] * 12
    return b"\xff\xd8" + segment(0xDB, bytes([0] + [8] + [1] * 63)) + segment(0xC2, frame) + segment(0xC4, bytes([0, *counts, *symbols])) + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0])) + data + b"\xff\xd9"


@pytest.mark.parametrize("h, v", [(1, 1), (2, 1), (1, 2), (2, 2)])
@pytest.mark.parametrize("width, height", [(32, 32), (29, 35), (5, 3)])
def test_chroma_is_upsampled(h, v, width, height):
    rng = np.random.default_rng(7 * h + v)
    rows, columns = -(-height // (8 * v)), -(-width // (8 * h))
    luma, blue, red = rng.integers(-128, 128, (rows * v, columns * h)).tolist(), rng.integers(-60, 60, (rows, columns)).tolist(), rng.integers(-60, 60, (rows, columns)).tolist()
    images, coefficients = jpeg.decode([subsampled_stream(luma, blue, red, width, height, h, v)] * 2)
    for image in images:
        got = jpeg.tensor(image, coefficients)
        assert got.shape == (height, width, 3)
        for y in range(height):
            for x in range(width):
                # A direct term times its quantiser, 8, over 8 is the level of the whole block.
                l, b, r = luma[y // 8][x // 8] + 128, blue[y // (8 * v)][x // (8 * h)], red[y // (8 * v)][x // (8 * h)]
                want = [l + 1.402 * r, l - 0.344136 * b - 0.714136 * r, l + 1.772 * b]
                assert np.abs(got[y, x] - np.clip(want, 0, 255)).max() <= 1
