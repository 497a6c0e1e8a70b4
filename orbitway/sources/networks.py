"""Networks and requests in the wire form of the search, from the road tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitway.functions.dialect import SPARK
from orbitway.sources.road import with_tables

#: Yen before and from the change of prices.
PRICES = ((300, "2026-01-01T00:00:00Z", "2026-10-01T00:00:00Z"), (400, "2026-10-01T00:00:00Z", None))
PROFILE = "etc_normal_car"


#: The folder's tables that road tables are made of.
BASE = ("part", "customer", "orders", "events", "lineitem", "supplier")


def over(spark: SparkSession, sf_dir: str, sql: str, **frames: DataFrame) -> DataFrame:
    """What the SQL gives over the folder's tables and other frames, which get no names in the session's catalogue."""
    for t in BASE:
        if re.search(rf" from {t}\b", sql):
            sql = re.sub(rf" from {t}\b", f" from {{{t}}}", sql)
            frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(sql, **frames)


def road(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Road tables over the folder's tables."""
    return [over(spark, sf_dir, with_tables((name,), f"select * from {name}", SPARK)) for name in names]


def _edge(id_, source, target, kind: str, seconds, meters, name=None):
    fields = {"id": id_, "from": source, "to": target, "kind": F.lit(kind), "durationSeconds": seconds, "distanceMeters": meters, "name": F.lit(None).cast("string") if name is None else name}
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """release_id, graph: each network as JSON text of the second version of the wire form."""
    net, node = road(spark, sf_dir, "net", "node")
    at = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    rows = net.join(node, "id")
    first = F.col("pos") == 0
    last = F.col("pos") == F.col("n") - 1
    ahead = F.when(last, at("n:", "anchor")).otherwise(at("n:", "next_id"))
    thirty, two = F.lit(30).cast("long"), F.lit(200).cast("long")
    edges = F.array_compact(F.array(
        F.when(~last | F.col("closed"), _edge(at("e:", "id"), at("n:", "id"), ahead, "shutoko", F.col("secs"), F.col("meters"), at("road ", "pos"))),
        F.when(F.col("chord_secs").isNotNull(), _edge(at("c:", "id"), at("n:", "id"), at("n:", "far_id"), "shutoko", F.col("chord_secs"), F.col("meters"))),
        F.when(first, _edge(at("en:", "id"), at("i:", "id"), at("n:", "id"), "entry", thirty, two)),
        F.when(first, _edge(at("ex:", "id"), at("n:", "id"), at("o:", "id"), "exit", thirty, two)),
    ))
    place = lambda prefix: F.struct(at(prefix, "id").alias("id"), "lat", "lon")
    nodes = F.when(first, F.array(place("n:"), place("i:"), place("o:"))).otherwise(F.array(place("n:")))
    # An open ring's last node has no edge ahead, so that no sequence can end with it.
    barred = F.when(F.col("barred") & (F.col("closed") | (F.col("pos") < F.col("n") - 2)), F.array(at("e:", "id"), at("e:", "next_id")))
    prices = F.array(*(F.struct(F.lit(y).cast("long").alias("amountYen"), F.lit(a).alias("effectiveFrom"), F.lit(b).cast("string").alias("effectiveTo")) for y, a, b in PRICES))
    pair = F.struct(
        at("p:", "anchor").alias("id"), at("en:", "anchor").alias("entryId"), at("ex:", "anchor").alias("exitId"), at("n:", "anchor").alias("anchorNodeId"),
        F.array(at("en:", "anchor")).alias("entryToAnchorEdgeIds"), F.array(at("ex:", "anchor")).alias("anchorToExitEdgeIds"), F.lit("verified").alias("status"), F.lit(PROFILE).alias("vehicleProfile"), prices.alias("prices"),
    )
    whole = rows.groupBy("net", "anchor").agg(
        F.flatten(F.collect_list(nodes)).alias("nodes"), F.flatten(F.collect_list(edges)).alias("edges"), F.collect_list(barred).alias("forbiddenTransitions")
    )
    graph = F.to_json(F.struct(F.lit(2).alias("schemaVersion"), F.col("net").alias("releaseId"), F.lit(PROFILE).alias("vehicleProfile"), "nodes", "edges", F.array(pair).alias("billingPairs"), "forbiddenTransitions"))
    return whole.select(F.col("net").alias("release_id"), graph.alias("graph"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """release_id, request: each request as JSON text."""
    asked, = road(spark, sf_dir, "question")
    request = F.to_json(F.struct(
        F.col("request_id").cast("string").alias("requestId"), F.col("net").alias("releaseId"), F.lit(PROFILE).alias("vehicleProfile"),
        F.when(F.col("by_node"), F.concat(F.lit("i:"), F.col("anchor").cast("string"))).alias("originNodeId"), F.when(~F.col("by_node"), F.struct("lat", "lon")).alias("origin"),
        F.col("min_minutes").alias("minMinutes"), F.col("max_minutes").alias("maxMinutes"), F.col("priced_at").alias("pricingAt"),
    ))
    return asked.select(F.col("net").alias("release_id"), request.alias("request"))


def large_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """release_id, graph: the large networks as JSON text, with ramps. A loop leads back over 60 nodes of a block; a skip leads over ten of them."""
    slab, = road(spark, sf_dir, "slab")
    at = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    whole, place, block = F.col("whole"), F.col("place"), F.col("block")
    forty, thirty, two = F.lit(40).cast("long"), F.lit(30).cast("long"), F.lit(200).cast("long")
    entry, leaves = whole & (place == 3), whole & ((place == 20) | ((place == 40) & (block % 3 == 0)))
    edges = F.array_compact(F.array(
        F.when(F.col("next_id").isNotNull(), _edge(at("e:", "id"), at("n:", "id"), at("n:", "next_id"), "shutoko", F.col("secs"), F.col("meters"))),
        F.when(whole & (place == 63), _edge(at("k:", "id"), at("n:", "id"), at("n:", "back_id"), "shutoko", forty, two)),
        F.when(entry, _edge(at("j:", "id"), at("n:", "id"), at("n:", "skip_id"), "shutoko", 2 * F.col("secs") + 1, F.col("meters"))),
        F.when(entry, _edge(at("en:", "id"), at("i:", "id"), at("n:", "id"), "entry", thirty, two)),
        F.when(leaves, _edge(at("ex:", "id"), at("n:", "id"), at("o:", "id"), "exit", thirty, two)),
    ))
    spot = lambda prefix: F.struct(at(prefix, "id").alias("id"), "lat", "lon")
    nodes = F.array_compact(F.array(spot("n:"), F.when(entry, spot("i:")), F.when(leaves, spot("o:"))))
    ramp = lambda prefix, kind, own, edge, facility: F.struct(at(prefix, "id").alias("id"), F.lit(kind).alias("kind"), at(own, "id").alias("nodeId"), at("n:", "id").alias("mainlineNodeId"), at(edge, "id").alias("edgeId"), facility.alias("facilityId"), at("ramp ", "id").alias("name"))
    here = F.concat(F.lit("f:"), block.cast("string"))
    ramps = F.array_compact(F.array(F.when(entry, ramp("ri:", "general_entry", "i:", "en:", here)), F.when(leaves, ramp("ro:", "general_exit", "o:", "ex:", F.when(block % 4 == 3, F.concat(F.lit("g:"), block.cast("string"))).otherwise(here)))))
    ahead = Window.partitionBy("slab").orderBy("pos").rowsBetween(0, 16)
    exit_id = F.lead("id", 17).over(Window.partitionBy("slab").orderBy("pos"))
    prices = F.array(*(F.struct(F.lit(y).cast("long").alias("amountYen"), F.lit(a).alias("effectiveFrom"), F.lit(b).cast("string").alias("effectiveTo")) for y, a, b in PRICES))
    rows = slab.withColumns({"way_on": F.collect_list(at("e:", "id")).over(ahead), "exit_id": exit_id})
    pair = F.struct(
        at("p:", "id").alias("id"), at("en:", "id").alias("entryId"), at("ex:", "exit_id").alias("exitId"), at("ri:", "id").alias("entryRampId"), at("ro:", "exit_id").alias("exitRampId"), at("n:", "id").alias("anchorNodeId"), F.array(at("en:", "id")).alias("entryToAnchorEdgeIds"),
        F.concat(F.col("way_on"), F.array(at("ex:", "exit_id"))).alias("anchorToExitEdgeIds"), F.lit("verified").alias("status"), F.lit(PROFILE).alias("vehicleProfile"), prices.alias("prices"),
    )
    od = F.struct(at("ri:", "id").alias("entryRampId"), at("ro:", "exit_id").alias("exitRampId"), (F.lit(500) + block).cast("long").alias("amountYen"), F.lit("2026-01-01T00:00:00Z").alias("effectiveFrom"), F.lit(None).cast("string").alias("effectiveTo"))
    grouped = rows.groupBy("net").agg(
        F.flatten(F.collect_list(nodes)).alias("nodes"), F.flatten(F.collect_list(edges)).alias("edges"), F.flatten(F.collect_list(ramps)).alias("ramps"), F.collect_list(F.when(entry & (block % 2 == 0), pair)).alias("billingPairs"),
        F.collect_list(F.when(entry & (block % 3 == 1), od)).alias("odTariffs"), F.collect_list(F.when(whole & (place == 30) & (block % 5 == 2), F.array(at("e:", "id"), at("e:", "next_id")))).alias("forbiddenTransitions"),
    )
    graph = F.to_json(F.struct(F.lit(2).alias("schemaVersion"), F.col("net").alias("releaseId"), F.lit(PROFILE).alias("vehicleProfile"), "nodes", "edges", "ramps", "billingPairs", "odTariffs", "forbiddenTransitions"))
    return grouped.select(F.col("net").alias("release_id"), graph.alias("graph"))


def ramp_questions(spark: SparkSession, sf_dir: str, explicit: bool) -> DataFrame:
    """release_id, request: each request of a customer at one of the large networks; explicit: with an entry of one of its blocks and an exit, mostly of the same one; else at its place, some with an entry or an exit."""
    asked, slab = road(spark, sf_dir, "request", "slab")
    ramps = slab.where("whole and place in (3, 20)").groupBy("net", "block").agg(F.max(F.when(F.col("place") == 3, F.col("id"))).alias("entry"), F.max(F.when(F.col("place") == 20, F.col("id"))).alias("exit"))
    nets = slab.groupBy("slab", "net").agg(F.floor(F.max("n") / 64).cast("long").alias("blocks")).where("blocks > 0")
    count = slab.select(F.count_distinct("slab").alias("slabs"))
    spread = asked.crossJoin(F.broadcast(count)).withColumn("slab", F.col("request_id") % F.col("slabs")).join(nets, "slab")
    dealt = spread.withColumn("block", (F.col("request_id") * 7) % F.col("blocks")).withColumn("other", F.when(F.col("request_id") % 9 == 0, (F.col("block") + 1) % F.col("blocks")).otherwise(F.col("block")))
    first, second = ramps.select("net", "block", "entry"), ramps.select("net", F.col("block").alias("other"), "exit")
    rows = dealt.join(first, ["net", "block"]).join(second, ["net", "other"])
    entry, leave = F.concat(F.lit("ri:"), F.col("entry").cast("string")), F.concat(F.lit("ro:"), F.col("exit").cast("string"))
    some = lambda c, k, part: c if explicit else F.when(F.col("request_id") % k == part, c)
    spot = F.when(F.col("request_id") % 8 == 5, F.struct((F.col("lat") + 40).alias("lat"), "lon")).otherwise(F.struct("lat", "lon"))
    request = F.to_json(F.struct(
        F.col("request_id").cast("string").alias("requestId"), F.col("net").alias("releaseId"), F.lit(PROFILE).alias("vehicleProfile"), (F.when(F.col("request_id") % 2 == 0, F.struct("lat", "lon")) if explicit else spot).alias("origin"),
        some(entry, 6, 1).alias("entryRampId"), some(leave, 6, 2).alias("exitRampId"), F.col("min_minutes").alias("minMinutes"), (F.col("max_minutes") + 60).alias("maxMinutes"), F.when(F.col("request_id") % 3 == 0, "2026-10-01T00:00:00Z").otherwise("2026-09-30T23:59:59Z").alias("pricingAt"),
    ))
    return rows.select(F.col("net").alias("release_id"), request.alias("request"))
