"""Mixing sources to target weights along a training curriculum (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitway.llm.common import SPACE, checkpointed, free_name, table, text_digest, word_count

#: Weights that the sources get in order, repeating.
WEIGHTS = (1, 2, 3)
#: Slope of the sources' weight schedules in order, repeating: a share starts at (1 - slope) of its mean and ends at (1 + slope).
SLOPES = (0.5, -0.5, 0.0)
#: A target stops at this many times the words of its source.
MOST = 3
#: Slices of a source's stream by the first hex digits of a document's order key.
SLICE_DIGITS = 3
#: Decimal digits of a position as it is given; the order is that of exact positions.
POSITION_DIGITS = 6


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, slope of every source in sizes (source, size).

    Sources by code point, null last, get WEIGHTS and SLOPES in turn. Targets share the words of all
    sources by weight; one that would pass MOST times its source stops there, and the others share the
    excess by weight until none is above: all sources below some level MOST * size / weight stop, the
    others get level * weight. One row a source is all that meets in a window.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (turn % len(values) + 1).cast("int"))
    ranked = totals.select("source", "source_size", pick(WEIGHTS).alias("weight"), pick(SLOPES).alias("slope"))
    most = F.lit(MOST).cast("long") * F.col("source_size")
    level = most.cast("double") / F.col("weight")
    before = Window.orderBy(level, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(level, F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    shared = ranked.withColumns({
        "level": level,
        "offer": (F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0).cast("long"))).cast("double") / F.sum("weight").over(rest),
    })
    # Offers rise as long as sources stop; the first that isn't above its own level holds for it and all after it.
    common = F.min(F.when(F.col("offer") <= F.col("level"), F.struct("level", "offer"))).over(everything)["offer"]
    target = F.when(F.col("offer") > F.col("level"), most.cast("double")).otherwise(F.least(common * F.col("weight"), most.cast("double")))
    return shared.select("source", "source_size", target.alias("target"), "slope")


def _streams(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, slope and start: the words of its source's stream before each document."""
    sizes = checkpointed(
        documents.select(
            F.col(id_col).alias("doc_id"),
            text_digest(text_col).alias("text_key"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"),
        ).withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    )
    slices = sizes.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = slices.select("source", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0).cast("long")).alias("base"))
    plan = bases.alias("b").join(source_targets(sizes).alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.*", "source_size", "target", "slope")
    inside = Window.partitionBy("source", "slice").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long"))).alias("d")
    return placed.join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.slice") == F.col("p.slice"))).select(
        "d.doc_id", "d.text_key", "d.source", "size", "source_size", "target", "slope", (F.col("base") + F.col("inner")).alias("start")
    )


def _words():
    return F.round("target").cast("long")


def _passes():
    return F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0).cast("long"))


def _position(word):
    """When the training reaches a word of a source's stream: the inverse of t + slope * (t * t - t), its share of the demand up to t."""
    x, slope = F.try_divide(word, F.round("target")), F.col("slope")
    bent = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * x) - (1 - slope)) / (2 * slope)
    return F.when(slope == 0, x).otherwise(bent)


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document the mix takes, and at what point of the training.

    Returns doc_id, source, size, source_size, target, taken, passes, position, sorted by position in
    range partitions; the order is that of exact positions, which are rounded after it. Each source is a stream of its documents in the order of md5(id), repeated as
    often as its target asks; a document's taken words are the part of [0, round(target)) that falls on
    it, so that a source's taken words add up to its rounded target. A source's share of the batch at
    time t of the training is proportional to 1 + slope * (2t - 1); its integral is the demand up to t,
    and inverting that at the document's place in the stream gives its first position in [0, 1].

    Offsets are two-level sums: a window over the (at most 16**SLICE_DIGITS) slices of a source, then
    one inside each slice, so no task holds a source. Null ids, texts and sources are values like any
    other; an empty text has size 0 and no position; repeated rows are taken as documents of their
    own, in one place of the order; columns other than the three named aren't read. An empty table
    gives no rows. Runs agree, since nothing depends on partitions: rows that tie in id and size get
    the same numbers in either order.
    """
    joined = _streams(documents, id_col, text_col, source_col)
    passes = _passes()
    left = _words() - passes * F.col("source_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - F.col("start")))
    out = joined.select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), passes.alias("passes"),
        F.when(taken > 0, _position(F.col("start"))).alias("position"),
    )
    order = F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_first()
    placed = out.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.withColumn("position", F.round("position", POSITION_DIGITS))


def arrange(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: documents as often as their targets take them, in the order of the training.

    Each pass over a source that reaches a document before its target is full gives the document once,
    whole, at the position of that pass; documents that no pass reaches, and those without words, are
    not in the mix. Columns come back as they were. Rows that share an id are documents of their own:
    source, id, text and a number among rows alike in these three tell rows apart.
    """
    names = documents.columns
    streams = _streams(documents, id_col, text_col, source_col).where("size > 0")
    alike = Window.partitionBy("doc_id", "text_key", "source").orderBy("start")
    streams = streams.withColumn("copy", F.row_number().over(alike))
    reached = streams.withColumn("times", _passes() + (F.col("start") < _words() - _passes() * F.col("source_size")).cast("long")).where("times > 0")
    turns = reached.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    placed = turns.select("doc_id", "text_key", "source", "copy", _position(F.col("start") + F.col("pass") * F.col("source_size")).alias("position"))
    own = {n: free_name(documents, f"_mix_{n}") for n in ("doc_id", "text_key", "source", "copy", "position")}
    placed = placed.select(*(F.col(n).alias(x) for n, x in own.items()))
    key, copy = free_name(documents, "_own_key"), free_name(documents, "_own_copy")
    turn = Window.partitionBy(id_col, key, source_col).orderBy(key)
    rows = documents.withColumn(key, text_digest(text_col)).withColumn(copy, F.row_number().over(turn))
    same = F.col(id_col).eqNullSafe(F.col(own["doc_id"])) & (F.col(key) == F.col(own["text_key"])) & F.col(source_col).eqNullSafe(F.col(own["source"])) & (F.col(copy) == F.col(own["copy"]))
    out = rows.join(placed, same)
    order = F.col(own["position"]), F.col(id_col).asc_nulls_first()
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*(F.col(f"`{c}`") for c in names))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = f"""
with sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as key
  from documents),
totals as (select source, sum(size)::bigint as source_size from sizes group by source),
ranked as (select source, source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::int as weight,
                  [0.5::double, -0.5::double, 0.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as slope from totals),
offers as (
  select *, (3 * source_size)::double / weight as level,
         ((sum(source_size) over ())::bigint - coalesce(sum(3 * source_size) over (order by (3 * source_size)::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint)::double
           / (sum(weight) over (order by (3 * source_size)::double / weight, source nulls last rows between current row and unbounded following))::double as offer
  from ranked),
targets as (
  select source, source_size, slope,
         case when offer > level then (3 * source_size)::double
              else least((select o.offer from offers o where o.offer <= o.level order by o.level, o.offer limit 1) * weight, (3 * source_size)::double) end as target
  from offers),
placed as (
  select s.doc_id, s.source, s.size, t.source_size, t.target, t.slope,
         coalesce(sum(s.size) over (partition by s.source order by s.key, s.doc_id nulls first, s.size rows between unbounded preceding and 1 preceding), 0)::bigint as start,
         round(t.target)::bigint as words,
         case when t.source_size > 0 then round(t.target)::bigint // t.source_size else 0 end as passes
  from sizes s join targets t on s.source is not distinct from t.source),
done as (
  select *, (passes * size + greatest(0, least(size, words - passes * source_size - start)))::bigint as taken,
         case when words > 0 then start::double / round(target) end as x from placed)
select doc_id, source, size, source_size, target, taken, passes::bigint as passes,
       case when taken > 0 then round(case when slope = 0 then x
            else (sqrt((1 - slope) * (1 - slope) + 4 * slope * x) - (1 - slope)) / (2 * slope) end, 6) end as position
from done
"""
