import hashlib
import io

import numpy as np
import pytest

from orbitway.llm import jpeg, media


def test_streams_have_half_size_chroma():
    """Own streams go through chroma upsampling, whatever the number of 192-byte pieces, and columns of units."""
    rng = np.random.default_rng(3)
    payloads = [rng.integers(0, 256, 192 * n, np.uint8).tobytes() for n in (1, 2, 3, 5, 16, 17, 33)]
    stored = media.store(payloads)
    images, coefficients = jpeg.decode(stored)
    for image in images:
        y, b, r = image.components.values()
        assert (y.h, y.v, b.h, b.v, r.h, r.v) == (2, 2, 1, 1, 1, 1)
    assert media.load(stored)[0] == payloads
    saved, media.MOST_ROWS = media.MOST_ROWS, 3
    try:
        wide = media.store(payloads)
        assert media.load(wide)[0] == payloads and media.load(wide)[1][-1].shape == (48, 96, 3)
    finally:
        media.MOST_ROWS = saved


def test_pixels_are_those_of_another_decoder():
    image_module = pytest.importorskip("PIL.Image")
    payload = bytes(range(97, 123)) * 48
    payload = media.padded(payload)
    stored = media.store([payload])[0]
    picture = image_module.open(io.BytesIO(stored))
    picture.draft("YCbCr", picture.size)
    other = np.asarray(picture.convert("YCbCr"))[:, :, 0].astype(int)
    images, coefficients = jpeg.decode([stored])
    y = next(iter(images[0].components.values()))
    own = jpeg.samples(coefficients[y.first : y.first + y.width * images[0].height // 8], np.ones(64, np.int64))
    own = own.reshape(-1, y.width, 8, 8).transpose(0, 2, 1, 3).reshape(images[0].height, images[0].width)
    assert abs(other - own).max() <= 2


def test_digests_read_the_stored_column(spark):
    """The bytes that are read back come out of a column, in a step after that which stored them."""
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "x" * 1000)], "doc_id long, text string")
    found = media.digests(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "media" in plan
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.encode(docs).collect()}
    for r in found.collect():
        assert r["media_sha256"] == hashlib.sha256(stored[r["doc_id"]]).hexdigest() and r["media_bytes"] == len(stored[r["doc_id"]])
        assert r["payload_bytes"] % 192 == 0
