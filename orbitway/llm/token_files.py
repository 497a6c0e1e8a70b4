"""Token-ID files: raw id payloads with a minimal perfect hash index over document keys."""

from __future__ import annotations

import struct
import uuid
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from orbitway.llm.chunks import ChunkTable
from orbitway.llm.common import checkpointed, pieces, shared_folder, table, text_key

#: Id that ends each document in a file.
END = 2
#: A shard is closed once it holds so many ids.
SHARD_IDS = 1 << 20
#: Bits a key in each level of the perfect hash.
ROOM = 1.5
#: Parts chunks in one string, and their ids in one run of bytes; no id has the latter's value.
CUT, CUT_BYTES = "\r", b"\xff" * 4
#: Keys of a row of the router, on average.
ROUTED = 1 << 16
#: Parts that a look-up names to the scan, at most; beyond them it reads all parts.
MOST_PARTS = 1000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --- encoding -----------------------------------------------------------------------------------


class ByteBpe:
    """Encodes as Tokenizer.encode(text, add_special_tokens=False) of a byte-level BPE file does.

    The pre-tokenizer always cuts before a single space between other characters, so that the pieces
    between such spaces can be encoded once each and joined. Texts with other runs of white space
    around spaces, or with an added token's string, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A space between two other characters of white space, or at an end next to one.
        self.whole = regex.compile(r"(?:^|\s) (?:\s|$)")
        # GPT-2's split, here only for plain characters; others go through the tokenizer's own. CUT, which no
        # plain chunk holds, parts chunks that are split in one go.
        self.plain = regex.compile(f"[ !-~¡-¬®-ɏ\n{CUT}]+")
        self.split = regex.compile(rf"{CUT}|'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|[^\S{CUT}]+(?!\S)|[^\S{CUT}]+")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)} | {ord(CUT): CUT}
        self.letters = "".join(letters[b] for b in range(256))
        self.tokens = ChunkTable(self._token_ids)
        self.tokens[CUT] = CUT_BYTES
        self.first = ChunkTable(self._chunks)
        self.later = ChunkTable(lambda chunks: self._chunks([f" {c}" for c in chunks]))

    def _token_ids(self, tokens: list[str]) -> Iterator[bytes]:
        shown = charmap_decode(CUT.join(tokens).encode(), "strict", self.letters)[0].split(CUT)
        found = [*map(self.tokenizer.model.tokenize, shown)]
        ends = [*accumulate(map(len, found))]
        ids = np.array([t.id for x in found for t in x], "<u4").tobytes()
        return [ids[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        line = CUT.join(chunks)
        if line.count(CUT) == len(chunks) - 1 and self.plain.fullmatch(line):
            return self.tokens.joined(self.split.findall(line)).split(CUT_BYTES)
        return [self.tokens.joined(self.split.findall(c)) if CUT not in c and self.plain.fullmatch(c) else self._slow(c) for c in chunks]

    def _slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; chunks that are new to the tables are encoded once for all texts."""
        cut = [(t or "").split(" ") for t in texts]
        distinct = set().union(*[c[1:] for c in cut])
        ends = {c for c in distinct if c[-1:].isspace()}
        for i, (t, c) in enumerate(zip(texts, cut, strict=True)):
            # Without two spaces in a row, a space has white space on both sides only at an end of the text or
            # where the chunk before it ends in another such character.
            odd = not c[0] or not c[-1] or c[0][-1].isspace() or "  " in t or ends and not ends.isdisjoint(c)
            if t and (any([a in t for a in self.added]) or odd and self.whole.search(t)):
                cut[i] = []
        first = self.first.joined_all([c[:1] if c and c[0] else [] for c in cut])
        rest = [c[1:] for c in cut]
        later = self.later.joined_all(rest, distinct if all(cut) else None)
        return [a + b if c or not t else self._slow(t) for t, c, a, b in zip(texts, cut, first, later, strict=True)]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


# --- minimal perfect hash -----------------------------------------------------------------------


def key_bytes(doc_id, occurrence: int = 0) -> bytes:
    """Key of the occurrence-th row with this id; a null id has a key of its own."""
    return b"%s\x00%d" % (b"null" if doc_id is None else str(doc_id).encode(), occurrence)


def _mix(x: np.ndarray, step: int) -> np.ndarray:
    """Another well-spread 64-bit value for each level."""
    x = x + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_index(keys: list[bytes], starts: np.ndarray, lengths: np.ndarray) -> bytes:
    """Index of n keys in n slots: a minimal perfect hash of levels of bits.

    A key that falls alone on a bit of a level (ROOM bits for each key there) sets it; the others go on
    to the next level. A key's slot is the number of bits set before its own, over all levels; counts by
    64 bits make that one look-up. A slot holds a 32-bit fingerprint of its key (so that an unknown key is
    refused), its start in the payload, in ids, and its length.
    """
    n = len(keys)
    for seed in range(1 << 16):
        hashes = np.array([xxh64_intdigest(k, seed) for k in keys], np.uint64)
        if len(np.unique(hashes)) == n:
            break
    left, sizes, bits = hashes, [], []
    while len(left):
        size = 64 * -(-int(ROOM * len(left)) // 64)
        place = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[place]]
    words = np.packbits(np.concatenate([np.zeros(0, bool), *bits]), bitorder="little").view("<u8")
    ranks = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
    head = struct.pack("<QQQ", n, seed, len(sizes)) + np.array(sizes, "<u8").tobytes() + words.tobytes() + ranks.astype("<u4").tobytes()
    slot = _slots(hashes, sizes, words, ranks)
    prints, at, size = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u8")
    prints[slot], at[slot], size[slot] = hashes >> np.uint64(32), starts, lengths
    return head + prints.tobytes() + at.tobytes() + size.tobytes()


def _slots(hashes: np.ndarray, sizes: list[int], words: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The slot of each hash; -1 where no level has it."""
    out = np.full(len(hashes), -1)
    open_, base = np.arange(len(hashes)), 0
    for level, size in enumerate(sizes):
        place = base + (_mix(hashes[open_], level) % np.uint64(size)).astype(np.int64)
        word, bit = words[place >> 6], (place & 63).astype(np.uint64)
        held = (word >> bit) & np.uint64(1) == 1
        below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        out[open_[held]] = ranks[place[held] >> 6] + below[held]
        open_, base = open_[~held], base + size
    return out


class Index:
    """Constant-time access by key; each lookup computes one slot and checks its fingerprint."""

    def __init__(self, data: bytes):
        self.n, self.seed, levels = struct.unpack_from("<QQQ", data)
        self.sizes = np.frombuffer(data, "<u8", levels, 24).tolist()
        n, count = self.n, sum(self.sizes) // 64
        at = 24 + 8 * levels
        self.words = np.frombuffer(data, "<u8", count, at)
        self.ranks = np.frombuffer(data, "<u4", count, at := at + 8 * count).astype(np.int64)
        self.prints = np.frombuffer(data, "<u4", n, at := at + 4 * count)
        self.starts = np.frombuffer(data, "<u8", n, at := at + 4 * n)
        self.lengths = np.frombuffer(data, "<u8", n, at + 8 * n)

    def find(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Start and length in ids of each key; -1 where the index doesn't hold it."""
        if not self.n:
            return np.full(len(keys), -1), np.full(len(keys), -1)
        hashes = np.array([xxh64_intdigest(k, self.seed) for k in keys], np.uint64)
        slot = _slots(hashes, self.sizes, self.words, self.ranks)
        held = (slot >= 0) & (self.prints[slot] == (hashes >> np.uint64(32)))
        return np.where(held, self.starts[slot].astype(np.int64), -1), np.where(held, self.lengths[slot].astype(np.int64), -1)


# --- files --------------------------------------------------------------------------------------


def _end_ids(width: int, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts with END after each, and how many each has."""
    end = np.array([END], "<u4").tobytes()
    return np.frombuffer(b"".join([x for t in texts for x in (t, end)]), "<u4").astype(f"<u{width}"), np.array([len(t) // 4 + 1 for t in texts], np.int64)


def write_shards(documents: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text, END after each document, as shards in ascending doc_id order, and a router to them.

    Rows go to range partitions of doc_id (null first) and a hash of the text, so that rows that share an
    id spread, and each partition writes shards of about SHARD_IDS ids in turn. A shard is a row of the
    table `shards`: part and seq (its place), base (ids in earlier shards of the part), width (bytes an
    id), n_ids, keys (its documents' ids in order), occurrences (how many earlier rows of the part have
    the same id), index (a minimal perfect hash of these keys) and payload (little-endian ids). The table
    `router` has a minimal perfect hash from each key, without its occurrence, to the first shard that
    holds it and the number of shards that do, in rows of about ROUTED keys; `spread` names all shards of
    the keys that have more than one. Spark's writer commits all three, so that a lost executor's rows are
    written anew and never twice.

    Null and empty texts have the END id alone; null ids are a key of their own; repeated rows are
    documents of their own; texts are whole; other columns aren't read. An empty table has no shards.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(text_col).alias("spread"))
    order = F.col("doc_id").asc_nulls_first(), F.col("spread"), F.col("text").asc_nulls_first()
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part = encoder(vocabulary), TaskContext.get().partitionId()
        width = 2 if own.tokenizer.get_vocab_size() <= 1 << 16 else 4
        seq = base = size = 0
        keys: list = []
        payload: list[np.ndarray] = []
        sizes: list[int] = []
        last, again = object(), 0

        def shard() -> pa.RecordBatch:
            lengths = np.array(sizes, np.int64)
            index = build_index([key_bytes(*k) for k in keys], np.cumsum(lengths) - lengths, lengths)
            values = (part, seq, base, width, size, [k for k, _ in keys], [n for _, n in keys], index, b"".join([x.tobytes() for x in payload]))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names=schema.names)

        for b in pieces(batches):
            ids, lengths = _end_ids(width, own.encode_all(b.column(1).to_pylist()))
            at = done = 0
            for doc_id, n in zip(b.column(0).to_pylist(), lengths.tolist(), strict=True):
                again = again + 1 if doc_id == last else 0
                last = doc_id
                keys.append((doc_id, again))
                sizes.append(n)
                size += n
                at += n
                if size >= SHARD_IDS:
                    payload.append(ids[done:at])
                    yield shard()
                    done, seq, base, size, keys, payload, sizes = at, seq + 1, base + size, 0, [], [], []
            payload.append(ids[done:])
        if keys:
            yield shard()

    schema = T.StructType()
    for name in ("part", "seq", "base"):
        schema.add(name, "long")
    schema.add("width", "integer").add("n_ids", "long").add("keys", T.ArrayType(kind)).add("occurrences", T.ArrayType(T.LongType())).add("index", "binary").add("payload", "binary")
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    rows.mapInArrow(run, schema).write.parquet(f"{path}/shards")
    _write_router(documents.sparkSession, path)


def _write_router(spark: SparkSession, path: str) -> None:
    shards = spark.read.parquet(f"{path}/shards")
    held = shards.select("part", "seq", F.explode(F.array_distinct("keys")).alias("key"))
    total = shards.agg(F.sum(F.size("keys"))).first()[0] or 0
    named = held.groupBy("key").agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("shards"))
    bucket = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(max(1, -(-total // ROUTED))))

    def build(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
        names = [key_bytes(k) for k in batch.column("key").to_pylist()]
        part, seq = batch.column("part").to_numpy(), batch.column("seq").to_numpy()
        index = build_index(names, part << 32 | seq, batch.column("shards").to_numpy())
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "index": pa.array([index], pa.binary())})

    dealt = named.select(bucket.cast("long").alias("bucket"), F.col("key"), "first.*", "shards")
    dealt.groupBy("bucket").applyInArrow(build, "bucket long, index binary").write.parquet(f"{path}/router")
    held.join(named.where("shards > 1").select(F.col("key").alias("held")), F.col("key").eqNullSafe(F.col("held"))).select("key", "part", "seq").write.parquet(f"{path}/spread")


def find(keys: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, occurrence, ids (array of int) of every document whose id is in keys: one probe of the router, and one of each shard that it names.

    Of the shards only the files of the parts that the router names are read, unless these are more than MOST_PARTS.

    An id that isn't in the files gives no row; a null id finds the documents without one; an id that
    keys repeat is found once.
    """
    spark = keys.sparkSession
    shards, router = spark.read.parquet(f"{path}/shards"), spark.read.parquet(f"{path}/router")
    kind = shards.schema["keys"].dataType.elementType
    wanted = keys.select(F.col(id_col).cast(kind).alias("key")).distinct()
    rows = router.count()
    wanted = wanted.withColumn("bucket", F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(max(1, rows))).cast("long"))

    def route(key, asked: pa.Table, held: pa.Table) -> pa.Table:
        names = asked.column("key").to_pylist()
        out: list[tuple] = []
        for index in held.column("index").to_pylist():
            places, counts = Index(index).find([key_bytes(k) for k in names])
            out += [(k, p >> 32, p & 0xFFFFFFFF, n) for k, p, n in zip(names, places.tolist(), counts.tolist(), strict=True) if p >= 0]
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("key", "part", "seq", "n"), columns, (asked.schema.field("key").type, *[pa.int64()] * 3), strict=True)})

    routed = T.StructType().add("key", kind).add("part", "long").add("seq", "long").add("n", "long")
    found = wanted.groupBy("bucket").cogroup(router.groupBy("bucket")).applyInArrow(route, routed)
    one = found.where("n = 1").select("key", "part", "seq")
    several = found.where("n > 1").select(F.col("key").alias("asked"))
    spread = spark.read.parquet(f"{path}/spread").join(several, F.col("key").eqNullSafe(F.col("asked"))).select("key", "part", "seq")
    places = checkpointed(one.unionByName(spread))
    # Files hold rows of one part: by their bounds the scan passes over those that no key names. What reaches the driver is no more than MOST_PARTS numbers.
    parts = [r[0] for r in places.select("part").distinct().limit(MOST_PARTS + 1).collect()]
    if len(parts) <= MOST_PARTS:
        shards = shards.where(F.col("part").isin(parts))
    asked = places.groupBy("part", "seq").agg(F.collect_list(F.struct("key")).alias("asked"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            row = b.to_pylist()[0]
            ids, most = np.frombuffer(row["payload"], f"<u{row['width']}"), max(row["occurrences"], default=0) + 1
            own = {k["key"] for k in row["asked"]}
            names = [(k, n) for k, n in zip(row["keys"], row["occurrences"], strict=True) if k in own] if most > 1 else [(k, 0) for k in own]
            starts, lengths = Index(row["index"]).find([key_bytes(*n) for n in names])
            got = [(k, n, ids[s : s + w].astype(np.int32)) for (k, n), s, w in zip(names, starts.tolist(), lengths.tolist(), strict=True) if s >= 0]
            columns = zip(*got, strict=True) if got else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=out.names)

    out = T.StructType().add("doc_id", kind).add("occurrence", "long").add("ids", T.ArrayType(T.IntegerType()))
    kinds = [to_arrow_type(f.dataType) for f in out.fields]
    return shards.select("part", "seq", "width", "keys", "occurrences", "index", "payload").join(asked, ["part", "seq"]).mapInArrow(fetch, out)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files at path, each found by its key.

    start adds the sums of earlier parts (one row a part) to the shard's base and the key's offset.
    """
    shards = spark.read.parquet(f"{path}/shards")
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("before"))
    kind = shards.schema["keys"].dataType.elementType
    schema = T.StructType().add("part", "long").add("doc_id", kind).add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            row = b.to_pylist()[0]
            starts, lengths = Index(row["index"]).find([key_bytes(k, n) for k, n in zip(row["keys"], row["occurrences"], strict=True)])
            if (starts < 0).any():
                raise ValueError("a shard's index lacks one of its keys")
            ids = np.frombuffer(row["payload"], f"<u{row['width']}").astype("<u4")
            crc = [zlib.crc32(ids[s : s + n]) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
            values = [row["part"]] * len(crc), row["keys"], row["base"] + starts, lengths, crc
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, kinds, strict=True)], names=schema.names)

    return shards.mapInArrow(lookup, schema).join(bases, "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark, sf_dir: str, path: str | None = None, vocabulary: str | None = None) -> DataFrame:
    path = path or f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_shards(table(spark, sf_dir, "documents"), path, vocabulary or default_vocabulary())
    return read_shards(spark, path)
