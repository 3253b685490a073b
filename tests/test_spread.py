"""Operators that spread what one group or place has: percentiles, windows over one key, nearest cities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from albumlake.operators import geo, quality, reports
from albumlake.operators.quality import exact_percentiles
from albumlake.sources.scratch import Scratch

SHARES = [0.0, 0.25, 0.5, 0.95, 0.999, 1.0]


def same(spark, df, groups, **more):
    got = {tuple(r)[:-1]: r["p"] for r in exact_percentiles(df, "v", groups, SHARES, **more).collect()}
    want = {tuple(r)[:-1]: r["p"] for r in df.groupBy(*groups).agg(F.percentile("v", F.array(*map(F.lit, SHARES))).alias("p")).collect()}
    assert got.keys() == want.keys()
    for k, p in want.items():
        if p is None:
            assert got[k] is None or set(got[k]) == {None}
        else:
            assert np.allclose(got[k], p, rtol=1e-12, atol=0, equal_nan=True), (k, got[k], p)


def test_percentiles_equal_those_of_spark(spark):
    x = spark.range(60_000).withColumn("g", F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))))
    heavy = F.exp(F.randn(1) * 20) * F.when(F.col("id") % 3 == 0, -1).otherwise(1)
    same(spark, x.withColumn("v", heavy), ["g"], few=20, grid=50)
    same(spark, x.withColumn("v", (F.col("id") % 5).cast("double")), ["g"], few=20, grid=50)  # ties beyond any bound
    same(spark, x.withColumn("v", F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("id") % 100)), [], few=10, grid=20)


def test_percentiles_of_odd_groups(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", None), ("b", 5.0), ("c", float("nan")), ("c", 1.0), ("c", float("inf")), ("d", 2.0), ("d", 2.0)]
    same(spark, spark.createDataFrame(rows, "g string, v double"), ["g"])
    assert exact_percentiles(spark.createDataFrame([], "g string, v double"), "v", ["g"], [0.5]).count() == 0


def test_no_task_gets_a_hot_group(spark):
    x = spark.range(100_000).select(F.lit("one").alias("g"), F.hash("id").cast("double").alias("v"))
    plan = exact_percentiles(x, "v", ["g"], [0.5, 0.95])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
    same(spark, x, ["g"])
    got = quality.latency_summary(x, "v", "g").first()
    v = np.array([r[0] for r in x.select("v").collect()])
    assert np.allclose([got["median"], got["p95"]], np.percentile(v, [50, 95]), atol=1e-6)


def test_transfer_rate_over_one_direction(spark):
    r = np.random.default_rng(3)
    at = np.sort(np.round(r.uniform(0, 200, 3000), 1))
    rows = [("in", float(a), i, int(b)) for i, (a, b) in enumerate(zip(at, r.integers(1, 1000, 3000)))]
    df = spark.createDataFrame(rows, "direction string, at double, event_id long, bytes long")
    got = {x["event_id"]: x["rate"] for x in reports.transfer_rate(df, 10, block=13).collect()}
    b = np.array([x[3] for x in rows])
    for i in range(0, 3000, 37):
        last = (at >= at[i] - 10) & (at <= at[i])
        assert got[i] == pytest.approx(b[last].sum() / max(0.1, min(10.0, at[i] - at[last].min())))
    assert len(got) == 3000


def places(spark, n, seed, name):
    """Half of them in dense towns, some at the poles and the date line."""
    r = np.random.default_rng(seed)
    town = np.random.default_rng(1).uniform([-80, -180], [80, 180], (40, 2))
    lat = np.where(np.arange(n) % 2, town[r.integers(0, 40, n), 0] + 0.3 * r.normal(size=n), np.degrees(np.arcsin(r.uniform(-1, 1, n))))
    lon = np.where(np.arange(n) % 2, town[r.integers(0, 40, n), 1] + 0.3 * r.normal(size=n), r.uniform(-180, 180, n))
    edge = [(90.0, 0.0), (-90.0, 10.0), (0.0, 180.0), (0.0, -180.0), (89.99, 5.0)]
    for i, e in enumerate(edge):
        lat[i], lon[i] = e
    import pandas as pd

    return np.clip(lat, -90, 90), lon, spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "name": [f"{name}{i}" for i in range(n)], "latitude": np.clip(lat, -90, 90), "longitude": lon}))


def brute(lat, lon, clat, clon):
    xyz = lambda a, b: np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], 1)
    return xyz(*np.radians([lat, lon])) @ xyz(*np.radians([clat, clon])).T


@pytest.mark.parametrize("n", [1, 30, 3000, 250_000])
def test_nearest_of_many_cities(spark, n):
    clat, clon, cities = places(spark, max(n, 5), 2, "c")
    cities = cities.filter(F.col("id") < n)
    lat, lon, points = places(spark, 400, 3, "p")
    points = points.withColumns({"user_latitude": F.lit(None).cast("double"), "user_longitude": F.lit(None).cast("double"), "geo_text": F.lit("")})
    got = {r["id"]: r["city_id"] for r in geo.nearest_city(points, cities).collect()}
    score = np.round(brute(lat, lon, clat[:n], clon[:n]), 12)
    assert len(got) == 400
    for i in range(400):
        assert score[i, got[i]] >= score[i].max() - 2e-12, i


def test_candidates_are_bounded(spark):
    _, _, cities = places(spark, 250_000, 2, "c")
    _, _, points = places(spark, 2000, 3, "p")
    cube = lambda df: geo._in_cubes(df.withColumns(dict(zip("xyz", geo._xyz(F.col("latitude"), F.col("longitude"))))))
    work = Scratch(spark)
    cities, seen = work.keep(cube(cities)), 0
    for level, pairs in geo.city_candidates(cube(points), cities, work):
        c = cities.groupBy(geo._cube("q", level).alias("c")).count()
        top = pairs.join(c, "c").groupBy("p").agg(F.sum("count").alias("n")).agg(F.max("n"), F.count("*")).first()
        assert top[0] is None or top[0] <= 32 or level == geo.LEVELS
        seen += top[1]
    assert 100 < seen <= 2000
