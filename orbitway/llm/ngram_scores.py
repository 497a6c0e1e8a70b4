"""Stupid-backoff scores: n-gram count tables partitioned by hash, joined to the documents' n-grams."""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from orbitway.llm.common import input_partitions, pieces, shared_folder, table

#: Words of a block of documents, count-table partitions for each input partition, and the backoff factor.
BLOCK_WORDS, SPLIT, ALPHA = 1 << 20, 4, 0.4
#: Words of all documents to a part of the count tables, on average: a task's arrays stay as large as a block's, however few partitions the input has.
PART_WORDS = 1 << 20
#: Words of a block that are scored at once, in whole documents.
SCORED_WORDS = 1 << 17


class _Ids(dict):
    """Numbers words in the order in which they come up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _packed(values: np.ndarray) -> bytes:
    """Integers as planes of their bytes, as many as the largest one needs, after a byte that tells how many."""
    size = values.dtype.itemsize
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype(f"<u{size}").view(np.uint8).reshape(-1, size)[:, :width].T.tobytes()


def _unpacked(data: pa.Buffer | bytes, size: int = 8) -> np.ndarray:
    """What _packed got, as integers of `size` bytes."""
    found = np.frombuffer(data, np.uint8)
    width = int(found[0])
    out = np.zeros(((len(found) - 1) // width, size), np.uint8)
    out[:, :width] = found[1:].reshape(width, -1).T
    return out.view(f"<u{size}").reshape(-1)


def _grams(words: np.ndarray, doc: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to order: hash of the n-gram that ends at each word, and whether it lies in one document."""
    h, good = words, np.ones(len(words), bool)
    yield h, good
    for _ in range(2, order + 1):
        before, whole = h, good
        h, good = np.zeros_like(words), np.zeros(len(words), bool)
        if len(words) > 1:
            x = before[:-1] * np.uint64(0x9E3779B97F4A7C15)
            x += words[1:]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            h[1:] = x
            good[1:] = whole[:-1] & (doc[1:] == doc[:-1])
        yield h, good


_ANSWERS = "block long, part long, gram int, totals binary"


def _blocks(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents: their ids and sizes, their words as numbers, and the hashes of the numbered words."""
    # Ids go as text, so that null and very large ones come back as they were.
    rows = documents.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.StringType())), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("sequence", T.BinaryType()), T.StructField("hashes", T.BinaryType())])

    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def block(number: int, names: list, sizes: list[int], ids: _Ids, words: array) -> pa.RecordBatch:
        hashes = np.fromiter((xxh64_intdigest(w) for w in ids), np.uint64, len(ids))
        values = (number, names, sizes, _packed(np.frombuffer(words, np.uint32)), hashes.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, seq = TaskContext.get().partitionId(), 0
        names, sizes, ids, words = [], [], _Ids(), array("I")
        for b in pieces(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = (text or b"").lower().split()
                names.append(doc_id)
                sizes.append(len(found))
                words.extend(map(ids.__getitem__, found))
                if len(words) >= BLOCK_WORDS:
                    yield block(at << 32 | seq, names, sizes, ids, words)
                    names, sizes, ids, words, seq = [], [], _Ids(), array("I"), seq + 1
        if names:
            yield block(at << 32 | seq, names, sizes, ids, words)

    return rows.mapInArrow(run, schema)


def _sequences(block: pa.RecordBatch | pa.Table, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each document of a block, the document of each word, and the hash of each word."""
    sizes = block["sizes"][row].values.to_numpy()
    hashes = np.frombuffer(block["hashes"][row].as_buffer(), np.uint64)
    return sizes, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), hashes[_unpacked(block["sequence"][row].as_buffer(), 4)]


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split(" ") for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


_COUNTS = "block long, part long, gram int, steps binary, counts binary"


def _counted(blocks: DataFrame, order: int, parts: int) -> DataFrame:
    """A block's distinct n-grams of each part of the count tables, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                number = b["block"][row].as_py()
                _, doc, words = _sequences(b, row)
                for n, (h, good) in enumerate(_grams(words, doc, order), 1):
                    distinct, count = np.unique(h[good], return_counts=True)
                    part = ((distinct >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                    cuts = np.searchsorted(part, np.arange(parts + 1))
                    del part
                    own = [(number, p, n, _packed(np.diff(distinct[x:y], prepend=np.uint64(0))), _packed(count[x:y])) for p, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if x < y]
                    del distinct, count
                    if own:
                        yield _rows(_COUNTS, own)

    return blocks.select("block", "sizes", "sequence", "hashes").mapInArrow(run, _COUNTS)


def _totals(key: tuple, group: pa.Table) -> pa.Table:
    """A part of the count tables: sums the blocks' counts, and answers each block in the order of its own n-grams."""
    out, part, gram, blocks = [], key[0].as_py(), group["gram"].to_numpy(), group["block"].to_numpy()
    for n in np.unique(gram).tolist():
        own = np.flatnonzero(gram == n).tolist()
        hashes = [np.cumsum(_unpacked(group["steps"][i].as_buffer()), dtype=np.uint64) for i in own]
        distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, np.concatenate([_unpacked(group["counts"][i].as_buffer()).astype(np.int64) for i in own]))
        at = 0
        for i, h in zip(own, hashes, strict=True):
            out.append((int(blocks[i]), part, n, _packed(total[place[at : at + len(h)]])))
            at += len(h)
    return pa.Table.from_batches([_rows(_ANSWERS, out)])


def stupid_backoff(documents: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log10_score, mean_log10: each text under the n-gram counts of all other documents.

    Words are runs of bytes other than 9 to 13 and 32, in ASCII lower case. The score of a word is
    c(n-gram) / c(its first n - 1 words) for the longest n-gram up to `order` that ends at it, lies in
    the text and is seen elsewhere, times ALPHA for each order given up; a word seen nowhere else counts
    ALPHA of once. All counts leave out the document's own. Sums are of log10.

    The count tables are partitioned by hash, and joined to the exploded n-grams of the documents in
    nested rows: documents go through in blocks, and a row holds the distinct n-grams of a block that lie
    in one part, with their counts, so that an n-gram of all documents is one entry a block, and no task
    holds more than a part or a block. There are never more rows than a row for each distinct n-gram of
    each block. 64-bit hashes stand for
    n-grams. Null and empty texts have no words, score 0 and a null mean; repeated rows count as
    documents of their own; null ids come back as they are; long texts are whole. An empty table gives
    no rows.
    """
    spark = documents.sparkSession
    path = f"{shared_folder(spark)}/ngram-blocks-{uuid.uuid4().hex}"
    _blocks(documents, id_col, text_col).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.parquet(path)
    whole = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y))).first()[0] or 0
    parts = max(SPLIT * max(1, input_partitions(documents)), -(-whole // PART_WORDS))
    totals = _counted(blocks, order, parts).groupBy("part").applyInArrow(_totals, _ANSWERS)
    out = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("log10_score", T.DoubleType())])

    def logs(words: np.ndarray, sizes: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The sum of each of some documents of a block. tables: its distinct n-grams, in order, and their counts in all documents."""
        doc = np.repeat(np.arange(len(sizes)), sizes)
        others = whole - sizes[doc]  # words of other documents
        value = np.where(others > 0, ALPHA / np.maximum(others, 1), 1.0)  # of a word that nothing else has
        value = value * ALPHA ** (order - 1)
        context = None
        for n, ((h, good), (distinct, total)) in enumerate(zip(_grams(words, doc, order), tables, strict=True), 1):
            count = np.zeros(len(h), np.int64)
            own, place = np.unique(h[good], return_inverse=True)
            _, pair, mine = np.unique(place * len(sizes) + doc[good], return_inverse=True, return_counts=True)
            count[good] = total[np.searchsorted(distinct, own)].astype(np.int64)[place] - mine[pair]
            below, seen = others if n == 1 else np.concatenate([[0], context[:-1]]), count > 0
            value[seen] = count[seen] / below[seen] * ALPHA ** (order - n)
            context = count
        return np.bincount(doc, np.log10(value), len(sizes))

    def score(key: tuple, block: pa.Table, answer: pa.Table) -> pa.Table:
        sizes, doc, words = _sequences(block, 0)
        gram, part, tables = answer["gram"].to_numpy(), answer["part"].to_numpy(), []
        for n, (h, good) in enumerate(_grams(words, doc, order), 1):
            rows = np.flatnonzero(gram == n)
            rows = rows[np.argsort(part[rows])].tolist()
            tables.append((np.unique(h[good]), np.concatenate([_unpacked(answer["totals"][i].as_buffer()) for i in rows] or [np.zeros(0, "<u8")])))
        del doc, h, good
        sums, ends, at = np.zeros(len(sizes)), np.cumsum(sizes), 0
        while at < len(sizes):
            begin = ends[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(ends, begin + SCORED_WORDS, side="right")))
            if begin < ends[to - 1]:
                sums[at:to] = logs(words[begin : ends[to - 1]], sizes[at:to], tables)
            at = to
        return pa.table({"doc_id": block["doc_ids"][0].values, "n_words": sizes, "log10_score": sums})

    scored = blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, out)
    scored = scored.withColumn("doc_id", F.col("doc_id").cast(documents.schema[id_col].dataType))
    return scored.withColumn("mean_log10", F.when(F.col("n_words") > 0, F.col("log10_score") / F.col("n_words")))


def op10_ngram_scores(spark, sf_dir: str) -> DataFrame:
    scored = stupid_backoff(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log10_score", 4).alias("log10_score"), F.round("mean_log10", 4).alias("mean_log10"))


SQL = """
with lists as (
  select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents),
words as (select r, i, w[i]::varchar as word, case when i > 1 then w[i - 1] end::varchar as before from (select r, w, unnest(range(1, len(w) + 1)) as i from lists)),
sizes as (select r, doc_id, len(w) as n from lists),
whole as (select sum(n) as n from sizes),
one as (select word, count(*) as c from words group by word),
one_own as (select r, word, count(*) as c from words group by r, word),
two as (select before, word, count(*) as c from words where before is not null group by before, word),
two_own as (select r, before, word, count(*) as c from words where before is not null group by r, before, word),
own as (
  select w.r, w.i, coalesce(t.c - o2.c, 0) as c2, u.c - o1.c as c1, coalesce(v.c - p1.c, 0) as cb, whole.n - s.n as others
  from words w join sizes s on s.r = w.r cross join whole
  join one u on u.word = w.word join one_own o1 on o1.r = w.r and o1.word = w.word
  left join one v on v.word = w.before left join one_own p1 on p1.r = w.r and p1.word = w.before
  left join two t on t.before = w.before and t.word = w.word left join two_own o2 on o2.r = w.r and o2.before = w.before and o2.word = w.word),
scored as (
  select r, sum(log10(case when c2 > 0 then c2::double / cb when c1 > 0 then 0.4 * c1 / others
                           when others > 0 then 0.4 * 0.4 / others else 0.4 end)) as s from own group by r)
select s.doc_id, s.n::bigint as n_words, round(coalesce(x.s, 0), 4) as log10_score,
       case when s.n > 0 then round(x.s / s.n, 4) end as mean_log10
from sizes s left join scored x on x.r = s.r
"""
