"""k nearest points by grid cells: an equality join that widens its rings until every request is answered."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitway.functions import geo
from orbitway.functions.checkpoints import cut
from orbitway.functions.geo import RADIUS

#: Points that a cell holds, on average.
CELL_POINTS = 8


def nearest(requests: DataFrame, points: DataFrame, k: int, key: str = "request_id") -> DataFrame:
    """request columns with entry_id, route, pos, meters and rank of the k nearest points; ties (to the millimetre) to the smaller id.

    requests: key, lat, lon; points: id, lat, lon, route, pos. Places meet, not rows: requests at one
    place have the same answer, and of the points at one place only the k of the smallest ids can be in
    any. Places of points lie in square cells of so many degrees that a cell has about CELL_POINTS of
    them. A request's place meets the cells within a ring of its own; its answer is final if its k-th
    point is nearer than anything outside the ring can be. The others meet a ring twice as wide, and so
    on; a ring as wide as all points holds everything. Requests without a place get no row; fewer than k
    points are all given. Each round is checkpointed, so that plans don't grow with the rounds, and no
    join sends a table through the driver.
    """
    at = ["lat", "lon"]
    turn = F.row_number().over(Window.partitionBy(*at).orderBy("id"))
    held = cut(points.select("id", *at, "route", "pos").where("lat is not null and lon is not null").withColumn("_turn", turn).where(F.col("_turn") <= k))
    bounds = held.agg(F.count("*"), F.count_if(F.col("_turn") == 1), F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    shape = requests.columns
    n, places, south, north, west, east = bounds
    columns = [*(F.col(c) for c in shape), F.col("id").alias("entry_id"), "route", "pos", "meters", "rank"]
    if not n:
        empty = points.select("id", "route", "pos").where("false").withColumns({"meters": F.lit(0.0), "rank": F.lit(1)})
        return requests.join(empty, F.lit(True)).select(columns)
    side = max(math.sqrt(max(north - south, 1e-6) * max(east - west, 1e-6) * CELL_POINTS / places), 1e-6)
    cell_of = lambda c, x0: F.floor((c - F.lit(x0)) / F.lit(side)).cast("long")
    placed = held.select("id", F.col("lat").alias("point_lat"), F.col("lon").alias("point_lon"), "route", "pos", cell_of(F.col("lat"), south).alias("row"), cell_of(F.col("lon"), west).alias("column"))
    steep = F.cos(F.radians(F.greatest(F.abs("lat"), F.lit(max(abs(south), abs(north))))))
    whole = math.ceil(max(north - south, east - west) / side) + 1
    out, left, ring = None, requests.select(*at).where("lat is not null and lon is not null").distinct(), 1
    inside = lambda c, low, high: F.least(F.greatest(F.col(c), F.lit(low)), F.lit(high))
    # Requests outside the points' box look from its edge: a point in the box is no farther from there, in latitude and in longitude.
    left = cut(left.withColumns({"_row": cell_of(inside("lat", south, north), south), "_column": cell_of(inside("lon", west, east), west)}))
    while True:
        around = lambda c: F.explode(F.sequence(F.col(c) - ring, F.col(c) + ring))  # noqa: B023, E731
        met = left.withColumn("row", around("_row")).withColumn("column", around("_column")).join(placed.hint("merge"), ["row", "column"])
        distance = F.expr(geo.equirectangular("lat", "lon", "point_lat", "point_lon"))
        ranked = met.withColumn("meters", distance).withColumn("rank", F.row_number().over(Window.partitionBy(*at).orderBy(F.round("meters", 3), "id"))).where(F.col("rank") <= k)
        last = ring >= whole
        # From a cell's inside to the outside of its ring are at least `ring` sides, in degrees of latitude or longitude.
        safe = F.lit(math.radians(ring * side) * RADIUS) * steep - 0.001
        final = ranked if last else ranked.withColumn("_sure", F.max(F.when((F.col("rank") == min(k, n)) & (F.col("meters") < safe), True)).over(Window.partitionBy(*at))).where("_sure")
        done = cut(final.select(*at, "id", "route", "pos", "meters", "rank"))
        out = done if out is None else out.unionByName(done)
        if not last:
            left = cut(left.join(done.select(*at).distinct().hint("merge"), at, "left_anti"))
            ring = min(2 * ring, whole)
        if last or ring < whole and left.isEmpty():
            return requests.join(out.hint("merge"), at).select(columns)
