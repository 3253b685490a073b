"""People, vectors and streams on small fixtures."""

import math

import numpy as np
from pyspark.sql import functions as F

from albumlake.operators import people, vectors
from albumlake.plans import queries_search
from albumlake.sources.tables import shared_dir
from albumlake.streaming import streams

from compare import DATA


def faces(spark, rows):
    return spark.createDataFrame(rows, "person int, face_id long, asset_id long, unit_id long")


def test_match_people(spark):
    m = faces(spark, [(0, 1, 1, 1), (1, 2, 1, 1), (0, 3, 2, 2), (1, 3, 2, 2)])
    assert [r["asset_id"] for r in people.match_people(m, 2, "all").collect()] == [1]
    assert sorted(r["asset_id"] for r in people.match_people(m, 2, "any").collect()) == [1, 2]
    assert people.match_people(people.drop_rejected(m, spark.createDataFrame([(0, 1)], "person int, face_id long")), 2, "all").count() == 0


def test_several_examples(spark):
    v = lambda i: [math.cos(i / 320 * math.pi / 2), math.sin(i / 320 * math.pi / 2)]
    f = spark.createDataFrame([(i + 1, i + 1, v(i)) for i in range(321)], "face_id long, asset_id long, vector array<float>")
    e = spark.createDataFrame([(0, 1, v(0)), (0, 321, v(320))], "person int, face_id long, vector array<float>")
    got = {r["face_id"]: r["score"] for r in vectors.face_match(f, e, 0.363).collect()}
    assert len(got) == 321
    for i in range(321):
        assert abs(got[i + 1] - max(np.dot(v(i), v(0)), np.dot(v(i), v(320)))) < 1e-5


def test_merge_people(spark):
    p = spark.createDataFrame([(1, "x", [1, 2], [9], 1), (2, "y", [2, 3], [1], 2)], "id long, name string, examples array<long>, rejected array<long>, cover long")
    got = people.merge_people(p, spark.createDataFrame([(0, 1), (1, 2)], "position int, id long")).first()
    assert (got["id"], got["name"], got["examples"], got["rejected"]) == (1, "x", [1, 2, 3], [9])
    assert people.merge_people(p, spark.createDataFrame([(0, 1)], "position int, id long")).isEmpty()
    assert people.split_person(p, F.array(F.lit(3).cast("long"))).first()["stay"] == [2]


def test_diverse_pick(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(42):
        x = rng.normal(size=16)
        rows.append((0, i, i // 2, i % 2 == 0, 0.001 * i, (x / np.linalg.norm(x)).tolist()))
    df = spark.createDataFrame(rows, "person int, face_id long, asset_id long, inside boolean, distance double, vector array<double>")
    got = people.diverse_pick(df).orderBy("place").collect()
    assert len(got) == 6 and sum(r["inside"] for r in got) == 3 and len({r["asset_id"] for r in got}) == 6


def test_non_maximum(spark):
    b = spark.createDataFrame([(1, 1, 0.9, [0.0, 0.0, 1.0, 1.0]), (1, 2, 0.8, [0.1, 0.0, 1.0, 1.0]), (1, 3, 0.7, [2.0, 2.0, 3.0, 3.0])], "image_id long, box_id long, score double, box array<double>")
    assert sorted(r["box_id"] for r in people.non_maximum(b).collect()) == [1, 3]


def test_people_all_brute_force(spark):
    f = queries_search.faces(spark, DATA)
    known = queries_search.examples(spark, DATA).filter("person in (0, 1)")
    hits = {(r["person"], r["face_id"]) for r in vectors.face_match(f, known, 0.1).collect()}
    want = set()
    by = {}
    for p, x in hits:
        by.setdefault(x // 2, {}).setdefault(p, set()).add(x)
    for asset, g in by.items():
        if len(g) == 2 and any(a != b for a in g[0] for b in g[1]):
            want.add(asset)
    assert {r["asset_id"] for r in queries_search.face_match_people_all(spark, DATA).collect()} == want


def test_ann_recall(spark):
    approx = queries_search.vector_ann_knn(spark, DATA)
    exact = vectors.knn(queries_search.vec_units(spark, DATA), queries_search.asked(spark, DATA), 20)
    assert vectors.ann_recall(approx, exact, 20).first()["recall"] >= 0.9


def test_knn_of_many_queries(spark):
    """More than 32 queries, several blocks of both sides, ties at the k-th place, a missing vector."""
    rng = np.random.default_rng(2)
    v = rng.integers(-1, 2, (300, 6)) / 2
    rows = [(i, i // 3, x.tolist()) for i, x in enumerate(v)] + [(300, 100, None)]
    units = spark.createDataFrame(rows, "unit_id long, asset_id long, vector array<double>").repartition(5)
    queries = units.filter("unit_id % 5 = 0").select(F.col("unit_id").alias("query_id"), "vector")
    got = {}
    for r in vectors.knn(units, queries, 7, block=9).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["unit_id"], r["asset_id"]))
    want = {q: [(n + 1, i, i // 3) for n, i in enumerate(sorted(range(300), key=lambda i: (-(v[i] @ v[q]), i))[:7])] for q in range(0, 300, 5)}
    assert {q: sorted(x) for q, x in got.items()} == want


def test_match_many_stays_on_executors(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, (200, 5)) / 4
    units = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "unit_id long, vector array<double>").repartition(3)
    queries = units.select(F.col("unit_id").alias("query_id"), "vector")
    got = vectors.match_many(units, queries, 0.25, block=7)
    assert sorted((r["query_id"], r["unit_id"], r["score"]) for r in got.collect()) == [(a, b, v[a] @ v[b]) for a in range(200) for b in range(200) if v[a] @ v[b] >= 0.25]
    plans = [vectors.match_many(units, queries, 0.25, block=n)._jdf.queryExecution().analyzed().toString() for n in (7, 100)]
    assert len({p.count("\n") for p in plans}) == 1 and "Union" not in plans[0]  # one plan however many blocks
    assert vectors.match_many(units, queries.limit(0), 0.25).count() == 0


def test_all_queries_are_asked(spark):
    n = queries_search.vec_units(spark, DATA).filter("unit_id % 50 = 0").count()
    assert queries_search.vector_knn_all(spark, DATA).select("query_id").distinct().count() == n > 8
    assert queries_search.vector_ann_knn(spark, DATA).select("query_id").distinct().count() == n
    assert queries_search.vector_ann_recall(spark, DATA).first()["enough"]


def test_commit_counts_on_stream(spark):
    base = shared_dir(spark)
    rows = [("local", "faces", 1, "done", "2024-01-01 00:00:01"), ("local", "faces", 1, "done", "2024-01-01 00:00:02"), ("local", "faces", 2, "error", "2024-01-01 00:00:03")]
    df = spark.createDataFrame(rows, "source string, stage string, job long, status string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{base}/in")
    s = streams.commit_counts(spark.readStream.schema(df.schema).parquet(f"{base}/in"))
    q = s.writeStream.format("memory").queryName("commit_counts").outputMode("complete").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["status"], r["n"]) for r in spark.table("commit_counts").collect()) == [("done", 1), ("error", 1)]


def test_replayed_batch_changes_nothing(spark):
    base = shared_dir(spark)
    listing = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "path string, size long, mtime long")
    listing.write.parquet(f"{base}/in")
    for ck in ("one", "two"):  # a second checkpoint replays the same batch
        streams.ingest_stream(streams.read_stream(spark, f"{base}/in", "path string, size long, mtime long"), f"{base}/catalog", f"{base}/{ck}").awaitTermination()
    assert sorted((r["path"], r["version"]) for r in streams.catalog_table(spark, f"{base}/catalog").read().collect()) == [("a", 1), ("b", 1)]


def test_matched_unit_goes_by_rank_over_all_units(spark):
    """Every unit is a hit, and the ranks decide: for some assets a later unit of the same stream is the one to show."""
    got = queries_search.search_matched_unit(spark, DATA).collect()
    assert sum(len(r["units"].split(",")) for r in got) == spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    first = {r["asset_id"]: min((int(u) % 2, int(u)) for u in r["units"].split(","))[1] for r in got}
    assert any(r["unit_id"] != first[r["asset_id"]] for r in got)
