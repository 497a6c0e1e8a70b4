"""Helpers that the operators of this package share."""

from __future__ import annotations

import re
import tempfile
import threading
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes 9 to 13 and 32 separate words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_lock = threading.Lock()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which driver and executors share.

    Only where neither that setting nor an earlier call names one, and driver and executors are one
    process (tests, local runs), is a temporary folder set; a cluster must name one.
    """
    context = spark.sparkContext
    with _lock:
        if not context.getCheckpointDir():
            named = context.getConf().get("spark.checkpoint.dir")
            if not named and not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(named or tempfile.mkdtemp(prefix="orbitway-"))
    return context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables that nothing reads any more, wherever it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Checkpoints that stages under way have made, by thread.
_made = threading.local()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    for frames in getattr(_made, "open", []):
        frames.append(out)
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of checkpoints that nothing reads any more."""
    for df in frames:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            remove_folder(df.sparkSession, file.get())


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes, at its end, the checkpoints that were made in it by this thread, but for those taken off the list; what was made of them must have been written by then."""
    frames: list[DataFrame] = []
    _made.open = [*getattr(_made, "open", []), frames]
    try:
        yield frames
        release(*frames)
    finally:
        _made.open = _made.open[:-1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words in text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


#: Rows and bytes of a piece of an Arrow batch that a Python worker turns into objects at once.
PIECE_ROWS, PIECE_BYTES = 1000, 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut, without copying, into pieces of at most `rows` rows and (but for a single row) `size` bytes."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(rows, b.num_rows - at)
            while n > 1 and b.slice(at, n).nbytes > size:
                n //= 2
            yield b.slice(at, n)
            at += n


def appended(df: DataFrame, column: str, run: Callable[[list], Sequence[Sequence]], added: T.StructType, **limits: int) -> DataFrame:
    """df without `column`, and with the columns that run makes of its values, piece by piece.

    The other columns stay in Arrow, so that null and very large ids come back as they were.
    """
    kept = [f for f in df.schema.fields if f.name != column]
    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    at = df.columns.index(column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, **limits):
            made = run(b.column(at).to_pylist())
            own = [b.column(i) for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(own + [pa.array(x, k) for x, k in zip(made, kinds, strict=True)], names=[f.name for f in kept] + added.names)

    return df.mapInArrow(work, T.StructType(kept + added.fields))


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as make it differ from all columns of df (whatever their case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def input_partitions(df: DataFrame) -> int:
    """Partitions that a scan of df has: grows with the input, and no job runs."""
    return df.rdd.getNumPartitions()


def text_key(text_col: str) -> Column:
    """64 bits that stand for a text, whatever its row's id; a null text is as an empty one."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))


def text_digest(text_col: str) -> Column:
    """128 bits that stand for a text wherever rows go or stay by it; a null text is as an empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))))


def keep_one(documents: DataFrame, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of documents for each component of texts; all columns come back as they were.

    roots: node (a text_digest) and root of the texts that links reach; any other text is a component of
    its own. The row that stays has the smallest id of its component, or a null one if all are null; of
    several such rows it has the smallest text. Which row that is, is settled on ids and digests: copies
    are pre-aggregated, and no component's texts meet in one task.
    """
    key, node, first, turn = (free_name(documents, n) for n in ("_key", "_node", "_first", "_turn"))
    texts = documents.select(text_digest(text_col).alias("node"), F.col(id_col).alias("id"))
    least = texts.groupBy("node").agg(F.min("id").alias("least"))
    linked = roots.select(F.col("node").alias("linked"), "root")
    whole = checkpointed(least.join(linked, F.col("node") == F.col("linked"), "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    # Aggregates are checkpointed before they are joined by their keys: then a join may split a large component.
    named = checkpointed(whole.groupBy("root").agg(F.min("least").alias("first")))
    chosen = checkpointed(whole.join(named, "root").where(F.col("least").eqNullSafe(F.col("first"))).select("node", "root", "first"))
    # Mostly one text of a component has its smallest id; of several, min_by keeps one a partition before its shuffle.
    several = checkpointed(chosen.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root"))
    final = chosen.join(several, "root", "left_anti").select(F.col("node").alias(node), F.col("first").alias(first))
    keyed = documents.withColumn(key, text_digest(text_col))
    if not several.isEmpty():
        tied = chosen.join(several, "root").select(F.col("node").alias(node), F.col("root").alias("root"), F.col("first").alias(first))
        smallest = keyed.select(F.col(key), F.col(text_col).alias("text")).join(tied, F.col(key) == F.col(node)).groupBy("root").agg(F.min_by(F.struct(node, first), F.struct("text", key)).alias("best"))
        final = final.unionByName(smallest.select("best.*"))
    rows = keyed.join(final, F.col(key) == F.col(node)).where(F.col(id_col).eqNullSafe(F.col(first)))
    # Copies of one text with one id: the row with the smallest hash of its plain columns.
    plain = [F.col(f"`{f.name}`") for f in documents.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
    placed = rows.withColumn(turn, F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*plain))))
    return placed.where(F.col(turn) == 1).select(*(F.col(f"`{c}`") for c in documents.columns))
