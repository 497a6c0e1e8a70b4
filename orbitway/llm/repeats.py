"""Removal of long repeated byte strings by a Burrows-Wheeler transform, over texts of any number."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from orbitway.llm.common import appended, checkpointed, free_name, pieces, release, remove_folder, scratch, shared_folder, table

#: Shortest repeat, in bytes.
LENGTH = 400
#: Windows of n bytes must share a string of n // ANCHOR bytes to be compared at all, at the first level; later levels halve the rest.
ANCHOR = 3
#: Different segments of a key that are compared together; keys with more go one level down.
CROWD = 512
#: Bytes of a transform, bytes of a task's segments, and window starts that are looked at in one go.
BATCH, TASK, PIECE = 1 << 19, 8 << 20, 1 << 18
#: Runs of windows of a task of a level below the first.
RUNS = 1 << 17
_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = []


# --- one transform ------------------------------------------------------------------------------


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first `depth` symbols at least, by prefix doubling from seven at once; symbols are below 512.

    Suffixes that share more stay in any order: that moves no bound of an interval of a string of up to
    `depth` symbols.
    """
    n = len(text)
    first = np.zeros(n, np.int64)
    for k in range(min(7, n)):
        first[: n - k] |= text[k:].astype(np.int64) << (9 * (6 - k))
    order = np.argsort(first)
    ordered = first[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
    step = 7
    while rank[order[-1]] < n - 1 and step < min(n, depth):
        both = rank * (n + 1)
        both[: n - step] += rank[step:] + 1
        # Only suffixes that still share a rank are ordered anew; their places are those of the rank.
        sorted_ = rank[order]
        same = np.r_[False, sorted_[1:] == sorted_[:-1]]
        places = np.flatnonzero(same | np.r_[same[1:], False])
        shared = order[places]
        order[places] = shared[np.argsort(both[shared])]
        ordered = both[order]
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        step *= 2
    return order


def long_prefixes(order: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix, in order, shares `length` symbols with the one before it.

    Breadth-first backward extension on the transform: the interval of a string is extended to the left
    by each symbol in it; the intervals of length l strings fix the common prefixes of value l - 1 at
    their right ends, and only those that fix a new one are extended further. Values thus come in
    increasing order, and it stops at `length`; what isn't fixed by then is at least that long. Symbol 0
    separates texts: strings may end in it, and aren't extended over it.
    """
    n = len(text)
    bwt = text[order - 1]  # the symbol before each suffix; the first's is the last of all, a separator
    back = np.empty(n, np.int64)
    back[np.argsort(bwt, kind="stable")] = np.arange(n)
    fixed = np.zeros(n + 1, bool)
    fixed[[0, n]] = True
    here, names, letters = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, text.dtype)
    place, interval = np.arange(n), np.zeros(n, np.int64)
    for value in range(length):
        symbol = bwt[place]
        if value:
            live = symbol != 0
            place, interval, symbol = place[live], interval[live], symbol[live]
        if not len(place):
            break
        at = back[place]
        if len(at) > n // 16:  # the order by a pass over all places
            here[at] = True
            names[at], letters[at] = interval, symbol
            at = np.flatnonzero(here)
            here[at] = False
            interval, symbol = names[at], letters[at]
        else:
            turn = np.argsort(at)
            at, interval, symbol = at[turn], interval[turn], symbol[turn]
        starts = np.r_[True, (interval[1:] != interval[:-1]) | (symbol[1:] != symbol[:-1])]
        interval = np.cumsum(starts) - 1
        last = np.r_[starts[1:], True]
        right = at[last] + 1
        fresh = ~fixed[right]
        fixed[right[fresh]] = True
        keep = fresh[interval]
        place, interval = at[keep], interval[keep]
    return ~fixed[:n]


def repeated_starts(segments: list[bytes], length: int, owners: list | None = None) -> list[np.ndarray]:
    """For each segment, where strings of `length` bytes start that also start elsewhere in these segments.

    With owners, only strings count that start in segments of two owners, or in one of several (None).
    """
    sizes = np.array([len(s) for s in segments])
    text = np.zeros(int(sizes.sum()) + len(segments), np.int16)
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    for s, a in zip(segments, begins, strict=True):
        text[a : a + len(s)] = np.frombuffer(s, np.uint8)
        text[a : a + len(s)] += 1
    order = suffix_array(text, length)
    like = long_prefixes(order, text, length)
    hit = np.zeros(len(text), bool)
    hit[order] = like | np.r_[like[1:], False]
    if owners is not None:
        names: dict = {}
        number = np.array([-1 if o is None else names.setdefault(o, len(names)) for o in owners])
        of = np.repeat(number, sizes + 1)[order]
        firsts = np.flatnonzero(~like)
        low, high = np.minimum.reduceat(of, firsts), np.maximum.reduceat(of, firsts)
        hit[order] &= np.repeat((low != high) | (low < 0), np.diff(np.r_[firsts, len(of)]))
    return [np.flatnonzero(hit[a : a + max(0, n - length + 1)]) for a, n in zip(begins, sizes, strict=True)]


# --- windows and their keys ---------------------------------------------------------------------


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        ones = lambda x: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, np.uint64), dtype=np.uint64)])
        _POWERS[:] = [ones(_BASE), ones(pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def window_keys(data: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of `anchor` bytes, and a key of each window of `length` bytes: the least hash in it. Equal windows have equal keys."""
    n = len(data)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64, out=total[1:])
    h = (total[anchor:] - total[: n - anchor + 1]) * down[: n - anchor + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    wide, least = 1, h
    want = length - anchor + 1
    while 2 * wide <= want:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    rest = want - wide
    return h, np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _parts(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """(text, begin, end) of the parts that are looked at in one go; a long text has more parts, which overlap by length - 1 bytes."""
    found, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t) - length + 1, PIECE):
            found.append((i, at, min(len(t), at + PIECE + length - 1)))
            size += found[-1][2] - at
            if size >= PIECE:
                yield found
                found, size = [], 0
    if found:
        yield found


def _again(h: np.ndarray, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, more: int) -> np.ndarray:
    """Whether the hash keys[i] comes more than once among the sizes[i] + more hashes from starts[i]."""
    small = np.sort(h[h <= keys.max()])
    twice = np.unique(small[1:][small[1:] == small[:-1]])
    again = np.isin(keys, twice) if len(twice) else np.zeros(len(keys), bool)
    for i in np.flatnonzero(again):
        again[i] = np.count_nonzero(h[starts[i] : starts[i] + sizes[i] + more] == keys[i]) > 1
    return again


def key_runs(texts: list[bytes], length: int, anchor: int) -> Iterator[dict[str, np.ndarray]]:
    """text, start, windows, key, hash, again of each run of windows with one key in any of the texts.

    The windows cover a segment of windows + length - 1 bytes, whose hash it is. Two windows of one run
    can only be equal if the string that gives the key comes again in the segment. Parts of texts are
    laid side by side; windows that cross from one to the next are left out.
    """
    for parts in _parts(texts, length):
        line = b"".join(texts[i][a:b] for i, a, b in parts)
        owner, first, end = np.array(parts, np.int64).T
        begins = np.cumsum(end - first) - (end - first)
        stops = begins + (end - first) - length + 1
        h, keys = window_keys(np.frombuffer(line, np.uint8), length, anchor)
        cut = np.r_[True, keys[1:] != keys[:-1], True]
        cut[begins] = cut[stops] = True
        cuts = np.flatnonzero(cut)
        starts, sizes = cuts[:-1], np.diff(cuts)
        part = np.searchsorted(begins, starts, "right") - 1
        inside = starts < stops[part]
        starts, sizes, part = starts[inside], sizes[inside], part[inside]
        hashes = [xxh64_intdigest(line[a:b]) for a, b in zip(starts.tolist(), (starts + sizes + length - 1).tolist(), strict=True)]
        yield {
            "text": owner[part], "start": (starts - begins[part] + first[part]).astype(np.int32), "windows": sizes.astype(np.int32), "key": keys[starts].view(np.int64),
            "hash": np.array(hashes, np.uint64).view(np.int64), "again": _again(h, keys[starts], starts, sizes, length - anchor),
        }


def _next_anchor(anchor: int, length: int) -> int:
    return min(length, anchor + max(1, (length - anchor + 1) // 2))


# --- all texts ----------------------------------------------------------------------------------


def _tasks(size: int, length: int, anchor: int) -> int:
    """Tasks for so many bytes of a level's segments: by TASK, and by RUNS where windows share so long a string that most of them are runs of their own."""
    return max(1, -(-size // TASK), -(-2 * size // (length - anchor + 2) // RUNS))


def _repeats(texts: DataFrame, length: int, anchor: int, across: bool = False, tasks: int | None = None) -> DataFrame:
    """id, starts: where strings of `length` bytes start in each text that also start elsewhere, as (first, number) pairs.

    With across, elsewhere is in a text of another owner. texts: id, row, text, owner (null: several);
    rows of one id have the same text. Every window of a text belongs to one
    segment, and equal windows to segments of one key. Equal segments are counted before anything else;
    one that comes twice is repeated throughout. Different segments of one key (and one that may repeat
    itself) are compared by a
    transform; the texts of just these are fetched, once each. A key with more than CROWD different
    segments (a passage in ever other surroundings) goes down a level, where windows must share a longer
    string to have one key; at the last level the key stands for the whole window. tasks: as many as a lower
    level's bytes need (_tasks), so that a level of few segments has few tasks, however many partitions a shuffle has.
    """
    spark = texts.sparkSession
    held = (lambda df: df.coalesce(tasks)) if tasks else lambda df: df

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            for runs in key_runs(b.column(2).to_pylist(), length, anchor):
                of = pa.array(runs.pop("text"))
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(of) for i in (0, 1, 3)), *map(pa.array, runs.values())], names=["id", "row", "owner", *runs])

    path = f"{shared_folder(spark)}/repeats-{uuid.uuid4().hex}"
    held(texts).select("id", "row", "text", "owner").mapInArrow(cut, "id binary, row string, owner long, start int, windows int, key long, hash long, again boolean").write.parquet(path)
    # Most keys have one run, that cannot repeat anything: they go before anything wider than a key is aggregated.
    found = held(spark.read.parquet(path))
    # Aggregates are checkpointed before they are joined by their keys: then a join is free to split a frequent key.
    alike = F.max(F.col("owner").isNull()) | (F.min("owner") < F.max("owner"))  # of two owners or several
    may = F.expr("all > 1 and apart") if across else F.expr("all > 1 or self")
    live = checkpointed(held(found.groupBy("key").agg(F.count("*").alias("all"), F.max("again").alias("self"), alike.alias("apart")).where(may).select("key")))
    runs = checkpointed(held(found.join(live, "key")))
    remove_folder(spark, path)
    release(live)
    segments = checkpointed(held(runs.groupBy("key", "hash").agg(F.count("*").alias("n"), F.min(F.struct("id", "row", "start", "windows")).alias("at"), F.max("again").alias("again"), F.when(~alike, F.min("owner")).alias("owner"))))
    crowds = checkpointed(held(segments.groupBy("key").agg(F.count("*").alias("crowd"))))
    open_ = F.col("crowd") > 1 if across else (F.col("crowd") > 1) | F.col("again") & (F.col("n") == 1)
    shared = checkpointed(held(segments.join(crowds, "key").select("key", "hash", "n", "crowd", "owner", open_.alias("open"), "at.*")))
    release(segments, crowds)
    last = anchor >= length
    to_fetch = shared.where("open").groupBy("id", "row").agg(F.collect_list(F.struct("key", "hash", "crowd", "owner", "start", "windows")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 100):
            wanted = b.column(1).flatten()
            fields = {n: wanted.field(n) for n in ("key", "hash", "crowd", "owner", "start", "windows")}
            owner = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy(zero_copy_only=False))
            begins, windows, texts_ = fields["start"].to_numpy(), fields["windows"].to_numpy(), b.column(0)
            ends = np.cumsum(windows.astype(np.int64) + length)
            at = 0
            while at < len(owner):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TASK, "right")))
                segments, last, text = [], -1, b""
                for o, x, w in zip(owner[at:to].tolist(), begins[at:to].tolist(), windows[at:to].tolist(), strict=True):
                    if o != last:
                        last, text = o, texts_[o].as_py()
                    segments.append(text[x : x + w + length - 1])
                yield pa.RecordBatch.from_arrays([*(fields[n].slice(at, to - at) for n in ("key", "hash", "crowd", "owner")), pa.array(segments, pa.binary())], names=["key", "hash", "crowd", "owner", "segment"])
                at = to

    fetched = held(texts.select("id", "row", "text").join(held(to_fetch), ["id", "row"])).select("text", "wanted").mapInArrow(fetch, "key long, hash long, crowd long, owner long, segment binary")
    crowded, bytes_ = F.col("crowd") > CROWD, F.col("windows") + length
    few, many, size, below_size = shared.where("open").agg(F.count(F.when(~crowded, 1)), F.count(F.when(crowded, 1)), F.sum(bytes_), F.sum(F.when(crowded, bytes_))).first()
    whole = shared.where("owner is null" if across else "n > 1").select("key", "hash", F.lit(None).cast("array<int>").alias("within"))
    marks = whole
    if few or many:
        fetched = checkpointed(fetched)
        near = fetched if last else fetched.where(F.col("crowd") <= CROWD)
        dealt = held(near.repartition(max(1, -(-int(size) // TASK)), "key").sortWithinPartitions("key", "hash"))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def done(names: list, owners: list, segments: list[bytes]) -> pa.RecordBatch:
                starts = repeated_starts(segments, length, owners if across else None)
                rows = [(k, h, _pairs(s)) for (k, h), s in zip(names, starts, strict=True) if len(s)]
                columns = zip(*rows, strict=True) if rows else ([], [], [])
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["key", "hash", "within"])

            names: list[tuple[int, int]] = []
            owners: list[int | None] = []
            segments: list[bytes] = []
            size = 0
            for b in pieces(batches):
                for k, h, o, s in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    if names and names[-1] == (k, h):
                        continue
                    if size >= BATCH and names[-1][0] != k:
                        yield done(names, owners, segments)
                        names, owners, segments, size = [], [], [], 0
                    names.append((k, h))
                    owners.append(o)
                    segments.append(s)
                    size += len(s)
            if names:
                yield done(names, owners, segments)

        marks = marks.unionByName(dealt.select("key", "hash", "owner", "segment").mapInArrow(compare, "key long, hash long, within array<int>"))
        if many and not last:
            name = F.concat_ws(":", "key", "hash")
            lower = _next_anchor(anchor, length)
            dense = fetched.where(crowded).select(name.cast("binary").alias("id"), F.lit("").alias("row"), F.col("segment").alias("text"), "owner").dropDuplicates(["id"])
            below = _repeats(dense, length, lower, across, _tasks(int(below_size), length, lower))
            parts = F.split(F.col("id").cast("string"), ":")
            marks = marks.unionByName(below.select(parts[0].cast("long").alias("key"), parts[1].cast("long").alias("hash"), F.col("starts").alias("within")))
    # A segment that is repeated throughout needs no other mark.
    marks = checkpointed(held(marks.groupBy("key", "hash").agg(F.max(F.col("within").isNull()).alias("full"), F.flatten(F.collect_list("within")).alias("within"))))
    release(shared, *([fetched] if few or many else []))
    marked = runs.join(marks, ["key", "hash"]).select(
        "id",
        F.when(F.col("full"), F.array("start", "windows")).otherwise(
            F.transform("within", lambda x, i: F.when(i % 2 == 0, x + F.col("start")).otherwise(x))
        ).alias("pairs"),
    )
    return held(held(marked).groupBy("id").agg(F.flatten(F.collect_set("pairs")).alias("starts")))


def _pairs(starts: np.ndarray) -> np.ndarray:
    """(first, number) of each run of consecutive starts."""
    cuts = np.flatnonzero(np.diff(starts) > 1) + 1
    first = np.r_[0, cuts]
    return np.stack([starts[first], np.diff(np.r_[first, len(starts)])], axis=1).reshape(-1).astype(np.int32)


def spans(starts: np.ndarray | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes, [begin, end), of strings that start at (first, number) pairs."""
    if starts is None or not len(starts):
        return []
    pairs = np.asarray(starts, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    begins, ends = pairs[:, 0], np.maximum.accumulate(pairs[:, 0] + pairs[:, 1] - 1 + length)
    new = np.r_[True, begins[1:] > ends[:-1]]
    return list(zip(begins[new].tolist(), ends[np.r_[new[1:], True]].tolist(), strict=True))


def _kept(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in removed for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _found(documents: DataFrame, id_col: str, text_col: str, length: int, data_col: str, starts_col: str, across: bool = False) -> DataFrame:
    """documents with the text as UTF-8 (null: empty) and the (first, number) pairs of its repeated strings."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = documents.select(F.unhex(F.md5(data)).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("row"), data.alias("text"))
    # 64 bits stand for a row; owners are told apart only where matches must lie across rows.
    texts = texts.withColumn("owner", (F.xxhash64("id", "row") if across else F.lit(None)).cast("long"))
    md5, text_id = free_name(documents, "_md5"), free_name(documents, "_text_id")
    with scratch() as made:
        found = checkpointed(_repeats(texts, length, max(1, length // ANCHOR), across).select(F.col("id").alias(text_id), F.col("starts").alias(starts_col)))
        made.pop()
    named = documents.withColumns({data_col: data, md5: F.unhex(F.md5(data))})
    return named.join(found, F.col(md5) == F.col(text_id), "left").drop(md5, text_id)


def _long_enough(text: bytes, found: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """The spans that hold at least `words` whole words."""
    if not words:
        return found
    space = b" \t\n\v\f\r"
    return [(a, b) for a, b in found if len(text[a:b].split()) - (a > 0 and text[a - 1] not in space and text[a] not in space) - (b < len(text) and text[b] not in space and text[b - 1] not in space) >= words]


def without_repeats(documents: DataFrame, length: int = LENGTH, words: int = 0, across: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with the repeated bytes of each text removed: every byte of a string of `length` bytes that also starts elsewhere.

    With `words`, only runs of such bytes that hold so many whole words go; with `across`, only strings
    count that also start in another row (rows alike in id and text are one). Texts count as UTF-8, null as
    empty; matches don't cross texts, may overlap, and are judged on the input. Equal rows are repeats of
    each other. Where a cut leaves part of a character, that part goes too. Very long texts are looked at
    in overlapping parts, whole. All rows and other columns come back, whatever their names; column
    n_chars, if there is one, counts anew. An empty table gives no rows.
    """
    names = documents.columns
    data_col, starts_col = free_name(documents, "_bytes"), free_name(documents, "_starts")
    found = _found(documents, id_col, text_col, length, data_col, starts_col, across)

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for data, starts in batches:
            yield pd.Series([_kept(t, _long_enough(t, spans(s, length), words)).decode("utf-8", "ignore") for t, s in zip(data, starts, strict=True)], dtype=object)

    udf = F.pandas_udf(cut, "string", F.PandasUDFType.SCALAR_ITER)
    same = F.col(starts_col).isNull()
    out = found.withColumn(text_col, F.when(same, F.col(text_col)).otherwise(udf(F.when(~same, F.col(data_col)).otherwise(F.lit(b"")), F.col(starts_col))))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.char_length(text_col)).cast(documents.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in names))


def op9_repeats(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = _found(documents, "doc_id", "text", LENGTH, "_bytes", "_starts").select("doc_id", F.struct("_bytes", "_starts").alias("found"))
    long = T.LongType()
    shape = T.StructType().add("n_bytes", long).add("n_removed", long).add("n_spans", long).add("kept_sha256", "string")

    def run(rows: list[dict]) -> tuple:
        cuts = [spans(r["_starts"], LENGTH) for r in rows]
        return (
            [len(r["_bytes"]) for r in rows], [sum(y - x for x, y in c) for c in cuts], [len(c) for c in cuts],
            [hashlib.sha256(_kept(r["_bytes"], c)).hexdigest() for r, c in zip(rows, cuts, strict=True)],
        )

    return appended(found, "found", run, shape)
