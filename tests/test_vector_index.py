"""The stored approximate index: recall, files read, filters, changes, rebuilds, deep pages."""

import re

import numpy as np
from pyspark.sql import functions as F

from albumlake.operators import vectors
from albumlake.operators.vector_index import VectorIndex

SCHEMA = "unit_id long, asset_id long, camera string, vector array<float>"


def clustered(spark, n=8000, groups=80, d=24, seed=1, first=0):
    r = np.random.default_rng(seed)
    c = np.random.default_rng(0).normal(size=(groups, d))
    x = c[r.integers(0, groups, n)] + 0.15 * r.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(first + i, (first + i) // 2, f"cam_{i % 3}", v.tolist()) for i, v in enumerate(x)], SCHEMA)


def asked(units):
    return units.filter("unit_id % 50 = 0").select(F.col("unit_id").alias("query_id"), "vector")


def recall(index, units, **more):
    return vectors.ann_recall(index.search(asked(units), 20, **more), vectors.knn(units, asked(units), 20), 20).first()["recall"]


def test_few_cells_hold_the_neighbours(spark, tmp_path):
    units = clustered(spark)
    index = VectorIndex(spark, str(tmp_path))
    index.build(units)
    s = index.state()
    cells = len(s["parts"][0]["cells"])
    assert s["probes"] <= cells / 10 and recall(index, units) >= 0.95
    one = asked(units).filter("query_id = 100")
    found = index.search(one, 20)
    read = {re.search(r"cell=(\d+)", f).group(1) for f in found.inputFiles() if "cell=" in f}
    assert 0 < len(read) <= s["probes"] and len(read) <= cells / 10  # files of the asked cells only
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 20 and "code" in plan


def test_scan_reads_codes_and_filters_reach_it(spark, tmp_path):
    units = clustered(spark, 2000)
    index = VectorIndex(spark, str(tmp_path))
    index.build(units, cells=12)
    where = F.col("camera") == "cam_1"
    found = index.search(asked(units), 10, probes=12, refine=30, where=where)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(camera,cam_1)" in plan
    assert re.search(r"ReadSchema: struct<unit_id:bigint,camera:string,code:binary>", plan)  # no vectors where codes are ranked
    want = vectors.knn(units.filter(where), asked(units), 10)
    key = ["query_id", "rank", "unit_id"]
    assert sorted(found.select(key).collect()) == sorted(want.select(key).collect())
    allowed = units.filter("asset_id % 5 = 0").select("asset_id")
    found = index.search(asked(units), 10, probes=12, refine=30, allowed=allowed)
    assert sorted(found.select(key).collect()) == sorted(vectors.knn(units.filter("asset_id % 5 = 0"), asked(units), 10).select(key).collect())


def test_changes_and_rebuild(spark, tmp_path):
    units = clustered(spark, 2000)
    index = VectorIndex(spark, str(tmp_path))
    index.build(units, cells=20)
    moved = clustered(spark, 100, seed=9).withColumn("camera", F.lit("new"))
    index.apply(moved, spark.range(1900, 2000).select(F.col("id").alias("unit_id")))
    now = units.filter("unit_id >= 100 and unit_id < 1900").unionByName(moved)
    assert len(index.state()["parts"]) == 2
    same = lambda: sorted((r["unit_id"], r["camera"]) for r in index.rows().collect()) == sorted((r["unit_id"], r["camera"]) for r in now.collect())
    assert same() and recall(index, now, probes=20) >= 0.99
    again = clustered(spark, 50, seed=3)
    index.apply(again)  # replaces rows of the part before
    now = now.filter("unit_id >= 50").unionByName(again)
    assert same() and recall(index, now, probes=20) >= 0.99
    more = clustered(spark, 600, seed=5, first=5000)
    index.apply(more)
    now = now.unionByName(more)
    s = index.state()
    assert len(s["parts"]) == 1 and not s["dead"] and s["built"] == now.count()  # grown by more than a quarter
    assert same() and recall(index, now) >= 0.9


def test_pages_meet_at_rank_1000(spark, tmp_path):
    units = clustered(spark, 1500, groups=10)
    index = VectorIndex(spark, str(tmp_path))
    index.build(units, cells=8)
    one = asked(units).filter("query_id < 100")
    exact = {(r["query_id"], r["rank"]): r["unit_id"] for r in vectors.knn(units, one, 1200).collect()}
    deep = index.page(one, 1000, 200)
    assert {(r["query_id"], r["rank"]): r["unit_id"] for r in deep.collect()} == {k: v for k, v in exact.items() if k[1] > 1000}
    assert index.page(one, 40, 20).agg(F.min("rank"), F.max("rank"), F.count("*")).first()[:] == (41, 60, 40)


def test_nothing_to_index(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path))
    units = clustered(spark, 100)
    index.build(units.limit(0))
    assert index.search(asked(units), 5).count() == 0 and index.rows().count() == 0
    index.apply(units.withColumn("vector", F.when(F.col("unit_id") > 3, F.col("vector"))))
    assert index.rows().count() == 96
    assert index.search(asked(units).limit(0), 5).count() == 0
