"""k nearest points against a plain version, with many rows at one place and with requests that take many rounds."""

import math
import random

import pandas as pd

from orbitway.functions.geo import RADIUS
from orbitway.operators.nearest import nearest


def plain(requests, points, k):
    rows = []
    for r in requests.itertuples():
        def away(p):
            x = math.radians(p.lon - r.lon) * math.cos(math.radians((r.lat + p.lat) * 0.5)) * RADIUS  # noqa: B023
            return math.hypot(x, math.radians(p.lat - r.lat) * RADIUS)  # noqa: B023
        best = sorted(points.itertuples(), key=lambda p: (round(away(p), 3), p.id))[:k]
        rows += [(r.request_id, i + 1, p.id) for i, p in enumerate(best)]
    return sorted(rows)


def test_piles_of_points_and_requests(spark):
    """Only the smallest ids of a pile can be in an answer; requests at one place are answered alike."""
    rnd = random.Random(5)
    spots = [(35.5 + rnd.randrange(9) / 100, 139.5 + rnd.randrange(9) / 100) for _ in range(12)]
    points = pd.DataFrame([(i, *spots[rnd.randrange(12)], "r", i) for i in range(2000)], columns=["id", "lat", "lon", "route", "pos"])
    asked = pd.DataFrame([(i, *rnd.choice([*spots, (35.7, 139.9), (36.5, 139.5)])) for i in range(60)], columns=["request_id", "lat", "lon"])
    asked = pd.concat([asked, pd.DataFrame([(60, None, 139.5)], columns=asked.columns)], ignore_index=True)
    got = nearest(spark.createDataFrame(asked.astype(object).where(asked.notna(), None), "request_id long, lat double, lon double"), spark.createDataFrame(points), 3)
    assert sorted((r.request_id, r.rank, r.entry_id) for r in got.collect()) == plain(asked[:60], points, 3)


def test_plans_do_not_grow_with_rounds(spark):
    """Two far groups of points make cells so small that a request between them takes nine rounds; plans stay small."""
    rnd = random.Random(6)
    points = pd.DataFrame([(i, 35.0 + (i % 2) + rnd.random() / 500, 139.0 + (i % 2) + rnd.random() / 500, "r", i) for i in range(4000)], columns=["id", "lat", "lon", "route", "pos"])
    asked = pd.DataFrame([(i, 35.0 + i / 20, 139.0 + i / 20) for i in range(21)], columns=["request_id", "lat", "lon"])
    got = nearest(spark.createDataFrame(asked), spark.createDataFrame(points), 3)
    assert len(got._jdf.queryExecution().toString()) < 100_000
    assert sorted((r.request_id, r.rank, r.entry_id) for r in got.collect()) == plain(asked, points, 3)
