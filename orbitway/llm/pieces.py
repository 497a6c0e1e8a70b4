"""SentencePiece encoding and decoding by a table of distinct marked words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitway.llm.chunks import ChunkTable
from orbitway.llm.common import appended, table

MARK = "▁"
#: Marked words that a worker's table keeps; a reused worker holds on to them through later stages.
WORDS = 100_000
_RUNS = re.compile(" +[^ ]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _words(text: str | None) -> list[str]:
    """What follows each marker of the marked text."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in _RUNS.findall(f" {text}")]
    return text.split(" ")


class WordCodec:
    """Encodes and decodes exactly as a SentencePiece model does, one distinct marked word at a time.

    It needs a model whose normalizer is the identity with one marker put first, and whose pieces hold
    markers only at their start: no piece then crosses the start of a run of markers, and the ids of a
    text are those of its marked words in turn. Both are checked when the model is loaded.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this model crosses a whitespace marker")
        probe = " a  ﬁ\nÉ "
        if self.model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("this model's normalizer changes more than spaces")
        self.first, self.last = (np.array([x], "<u4").tobytes() for x in (self.model.bos_id(), self.model.eos_id()))
        self.words = ChunkTable(self._encode, WORDS)
        self.words[""] = np.array([self.model.piece_to_id(MARK)], "<u4").tobytes()  # a marker with nothing after it

    def _encode(self, words: list[str]) -> Iterator[bytes]:
        return (np.array(x, "<u4").tobytes() for x in self.model.encode(words, num_threads=1))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text with begin and end id as little-endian unsigned 32-bit integers; a word that is new to the table is segmented once for all texts."""
        marked = [_words(t) for t in texts]
        return [self.first + x + self.last for x in self.words.joined_all(marked)]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        return self.model.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    """One for each worker process and model, so that tables serve all its tasks."""
    return WordCodec(path)


def encode(documents: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of the whole text's ids with begin and end id), decoded (text).

    One pass without a shuffle. Null texts count as empty and give the two marks; repeated rows and
    null ids come back as they are; texts are whole, however long; other columns aren't read. An
    empty table gives no rows.
    """

    def run(texts: list[str | None]) -> tuple:
        own = codec(model)
        ids = own.encode_all(texts)
        return [np.frombuffer(x, "<u4").astype(np.int32) for x in ids], [own.decode(x) for x in ids]

    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return appended(rows, "text", run, T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string"))


def digests(documents: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode()'s values without moving them out of the worker."""

    def run(texts: list[str | None]) -> tuple:
        own = codec(model)
        ids = own.encode_all(texts)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return [len(x) // 4 for x in ids], [sha(x) for x in ids], [sha(own.decode(x).encode()) for x in ids]

    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return appended(rows, "text", run, T.StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string"))


def op7_sentencepiece(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model or default_model())
