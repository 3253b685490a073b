"""Search under conditions: stops when a page is full, asks as few as it can, drops stale hits."""

from pyspark.sql import functions as F

from albumlake.operators.quality import verdict_key
from albumlake.operators.verified import VerifiedSearch

NONE = "cache_key string, verdict string"


def session(spark, cache=None, n=1000):
    def load():
        def check(asset, conditions):
            if asset % 11 == 0:
                raise RuntimeError("no picture")
            return [(c, "yes" if asset % int(c) == 0 else "no") for c in conditions]

        return check

    hits = spark.range(n).selectExpr("id as asset_id", "cast(case when id % 17 = 3 then 1 else 2 end as bigint) as file_version", "cast(id as string) as unit_id", f"{n} - id as score")
    assets = spark.range(n).selectExpr("id", "cast(2 as bigint) as version", "id % 13 <> 1 as present")
    return VerifiedSearch(hits, assets, [F.desc("score"), F.col("asset_id")], ["2", "3"], spark.createDataFrame([], NONE) if cache is None else cache, load)


def ids(n=1000):
    return [i for i in range(n) if i % 17 != 3 and i % 13 != 1]


def test_stops_when_the_page_is_full(spark):
    s, order = session(spark), ids()
    yes = [i for i in order if i % 6 == 0 and i % 11]
    page = s.page(0, 20)
    assert [r["asset_id"] for r in page.orderBy("place").collect()] == yes[:20]
    last = order.index(yes[19])
    assert s.counts() == {"candidates": len(order), "checked": (last // 40 + 1) * 40, "asked": (last // 40 + 1) * 40, "yes": sum(i in yes for i in order[: (last // 40 + 1) * 40])}
    before = s.counts()["asked"]
    assert [r["asset_id"] for r in s.page(5, 10).orderBy("place").collect()] == yes[5:15] and s.counts()["asked"] == before  # nothing anew
    assert s.page(0, 500, "uncertain").count() == sum(i % 11 == 0 for i in order[: s.counts()["checked"]])  # checks that failed
    assert s.page(0, 5000, "pending").count() == len(order) - s.counts()["checked"]


def test_whole_stream_without_enough(spark):
    s, order = session(spark, n=200), ids(200)
    assert s.page(0, 200).count() == sum(i % 6 == 0 and i % 11 > 0 for i in order)
    assert s.counts()["checked"] == s.counts()["candidates"] == len(order)


def test_cache_spares_the_model(spark):
    order = ids()
    known = spark.range(1000).filter("id % 2 = 1").selectExpr("'verify-1' as model_version", "id as asset_id", "2L as file_version", "cast(id as string) as unit_id", "array('2', '3') as conditions")
    s = session(spark, known.select(verdict_key().alias("cache_key"), F.lit("no").alias("verdict")))
    s.page(0, 5)
    assert s.counts()["asked"] == sum(i % 2 == 0 for i in order[: s.counts()["checked"]])
