"""Media columns: payloads kept as progressive JPEG, read back as coefficients and RGB tensors."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitway.llm import jpeg
from orbitway.llm.common import appended, free_name, table

#: Payloads are filled with spaces to a multiple of this; an image's unit, four blocks of luma and one of each chroma, holds two of them.
UNIT = 192
#: A coefficient is a byte and this, so that none is zero or new in a refining scan.
SHIFT = 2
#: Payload bytes that a worker handles at once, and rows of an image at most.
BATCH, MOST_ROWS = 2 << 20, 4095


def padded(text: bytes | None) -> bytes:
    data = text or b""
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def store(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG of each payload; its quantised coefficients are the payload's bytes, 384 for each unit of four blocks of luma and one of each chroma."""
    images = []
    for p in payloads:
        units = -(-len(p) // (2 * UNIT))
        columns = -(-units // MOST_ROWS)
        rows = -(-units // columns)
        full = np.frombuffer(p + b" " * (columns * rows * 2 * UNIT - len(p)), np.uint8).reshape(-1, 6, 64)
        images.append((full.astype(np.int32) + SHIFT, columns, rows, struct.pack(">Q", len(p))))
    return jpeg.encode(images)


def load(media: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Payloads and RGB tensors of stored media: every scan is read, the tensors are made from the coefficients, and chroma goes up to the size of luma."""
    images, coefficients = jpeg.decode(media)
    payloads, tensors = [], []
    all_samples = jpeg.samples(coefficients, np.ones(64, np.int64)) if all((q == 1).all() for i in images for q in i.quantisers.values()) else None
    for image in images:
        y, b, r = image.components.values()
        n = b.width * (image.height // 16)
        luma = coefficients[y.first : y.first + 4 * n].reshape(-1, 2, b.width, 2, 64).transpose(0, 2, 1, 3, 4).reshape(n, 4, 64)
        blocks = np.concatenate([luma, coefficients[b.first : b.first + n, None], coefficients[r.first : r.first + n, None]], axis=1)
        payloads.append((blocks - SHIFT).astype(np.uint8).tobytes()[: struct.unpack(">Q", image.comment)[0]])
        tensors.append(jpeg.tensor(image, coefficients, all_samples))
    return payloads, tensors


def feature(rgb: np.ndarray) -> str:
    """Size, sums of the three channels, and a checksum of all pixels."""
    sums = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
    return f"{rgb.shape[1]}x{rgb.shape[0]}:{sums[0]}:{sums[1]}:{sums[2]}:{zlib.crc32(np.ascontiguousarray(rgb)):08x}"


def _batches(b: pd.DataFrame, column: str) -> Iterator[pd.DataFrame]:
    """Pieces of a batch of about BATCH bytes."""
    sizes = np.array([len(x or b"") + UNIT for x in b[column]], np.int64)
    group = (np.cumsum(sizes) - sizes) // BATCH
    for _, piece in b.groupby(group, sort=True):
        yield piece


def encode(documents: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """documents with column media_col (binary): the progressive JPEG of each whole text's padded bytes.

    Null and empty texts are one unit of spaces; long texts take more columns of blocks, and are stored
    whole; repeated rows come back as they are. Where documents have such a column already, underscores
    are put after the new one's name. An empty table gives no rows.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.concat([pd.Series(store([padded(t) for t in p["x"]])) for p in _batches(pd.DataFrame({"x": s}), "x")]) if len(s) else s

    udf = F.pandas_udf(run, "binary", F.PandasUDFType.SCALAR_ITER)
    return documents.withColumn(free_name(documents, media_col), udf(F.col(text_col).cast("binary")))


def decode(frame: DataFrame, media_col: str = "media", image_col: str = "image") -> DataFrame:
    """frame with column image_col: struct of payload, width, height and rgb (the full-resolution tensor's bytes, rows first).

    Null media give null; where frame has such a column already, underscores are put after the new
    one's name. All rows and other columns come back. An empty table gives no rows.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        nothing = store([padded(None)])[0]
        for s in batches:
            out = []
            for p in _batches(pd.DataFrame({"x": s}), "x"):
                payloads, tensors = load([x or nothing for x in p["x"]])
                out.append(pd.DataFrame({"payload": payloads, "width": [t.shape[1] for t in tensors], "height": [t.shape[0] for t in tensors], "rgb": [t.tobytes() for t in tensors]}))
            yield pd.concat(out) if out else pd.DataFrame({"payload": [], "width": [], "height": [], "rgb": []})

    udf = F.pandas_udf(run, "payload binary, width int, height int, rgb binary", F.PandasUDFType.SCALAR_ITER)
    return frame.withColumn(free_name(frame, image_col), F.when(F.col(media_col).isNotNull(), udf(F.col(media_col))))


def digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each text's stored form and of what is read back from it.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 16 payload bytes),
    media_bytes, media_sha256, feature (see feature()). Texts are stored in a column of media, as by
    encode() but a few megabytes at a time, and everything but n_bytes comes from that column: what is
    read back is made in a step of its own that has nothing else of a text. Tensors stay in the worker that made them, a few megabytes
    at a time. Equal texts give equal values, whatever batch they are in. Null counts as empty; null ids
    and repeated rows come back as they are; other columns aren't read. An empty table gives no rows.
    """
    def write(texts: list[bytes]) -> tuple:
        return (store([padded(t) for t in texts]),)

    def read(media: list[bytes]) -> tuple:
        payloads, tensors = load(media)
        sha = [hashlib.sha256(x).hexdigest() for x in payloads]
        return [len(x) for x in payloads], sha, [zlib.crc32(x[-16:]) for x in payloads], [feature(t) for t in tensors]

    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    sized = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    stored = appended(sized, "text", write, T.StructType().add("media", "binary"), size=BATCH)
    media = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    shape = T.StructType()
    for name in ("payload_bytes", "payload_sha256", "tail_crc32", "feature"):
        shape.add(name, "string" if name in ("payload_sha256", "feature") else "long")
    return appended(media, "media", read, shape, size=BATCH).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op4_media(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
