"""Keyed tables: bytes per batch, replays, crashes, retention, change feeds."""

import os

import pytest
from pyspark.sql import functions as F

from albumlake.sources.states import KeyedTable, States, change_feed
from albumlake.sources.tables import apply_changes
from albumlake.streaming import streams

SCHEMA = "id long, text string"


def upsert(known, changes):
    return apply_changes(known, changes, changes.limit(0), "id")


def rows(spark, ids, text):
    return spark.range(1).select(F.explode(F.array(*[F.lit(i).cast("long") for i in ids])).alias("id"), F.lit(text).alias("text"))


def files(folder):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_a_batch_writes_its_buckets_only(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), SCHEMA, "id", buckets=32, keep=1)
    t.apply(spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")), upsert, 0)
    whole, written = files(tmp_path), []
    for batch, ids in enumerate(([5], [5, 6], list(range(100, 108))), 1):
        before = set(files(tmp_path))
        assert t.apply(rows(spark, ids, f"b{batch}"), upsert, batch)
        new = {f: n for f, n in files(tmp_path).items() if f not in before}
        assert len(new) <= len(ids)  # one file a bucket touched
        written.append(sum(new.values()))
        assert len(files(tmp_path)) == 32  # superseded buckets are gone, the others stayed where they were
    assert written[0] <= sum(whole.values()) / 16 and written[0] < written[2]
    got = {r["id"]: r["text"] for r in t.read().filter("id < 200").collect()}
    assert got[5] == got[6] == "b2" and got[103] == "b3" and len(got) == 200 and t.read().count() == 20_000


def test_replay_and_old_batches(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), SCHEMA, "id", buckets=4)
    assert t.apply(rows(spark, [1, 2], "a"), upsert, 7)
    assert not t.apply(rows(spark, [1], "again"), upsert, 7) and not t.apply(rows(spark, [1], "old"), upsert, 6)
    assert t.apply(rows(spark, [3], "b").limit(0), upsert, 8) and t.state()["batch"] == 8
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "a")]
    assert KeyedTable(spark, str(tmp_path), SCHEMA, "id", buckets=99).buckets == 4


def test_crash_before_publishing(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path), SCHEMA, "id", buckets=4, keep=1)
    t.apply(rows(spark, [1, 2], "a"), upsert, 0)
    kept = set(files(tmp_path))
    with monkeypatch.context() as m:
        m.setattr(States, "publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            t.apply(rows(spark, [1, 3], "b"), upsert, 1)
    assert set(files(tmp_path)) > kept and sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "a")]
    assert t.apply(rows(spark, [1, 3], "b"), upsert, 1)  # the stream tries the batch again
    assert sorted(map(tuple, t.read().collect())) == [(1, "b"), (2, "a"), (3, "b")]
    named = {f"{x}/bucket={b}" for b, x in t.state()["buckets"].items()}
    assert {"/".join(f.split("/")[-3:-1]) for f in files(tmp_path)} == named  # what the crash left is gone


def test_two_writers(spark, tmp_path):
    s = States(spark, str(tmp_path))
    s.publish(1, {"a": 1})
    with pytest.raises(FileExistsError):
        s.publish(1, {"a": 2})
    assert s.read() == (1, {"a": 1}) and States(spark, f"{tmp_path}/none").read() == (0, {})


def test_deletes_empty_buckets(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), SCHEMA, "id", buckets=4, keep=1)
    t.apply(rows(spark, [1, 2, 3], "a"), upsert, 0)
    gone = lambda known, changes: known.join(changes, "id", "left_anti")
    t.apply(rows(spark, [1, 2, 3], ""), gone, 1)
    assert t.read().isEmpty() and t.state()["buckets"] == {} and not files(tmp_path)


def test_change_feed_between_states(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), SCHEMA, "id", buckets=4, keep=2)
    t.apply(rows(spark, [1, 2, 3], "a"), upsert, 0)
    t.apply(rows(spark, [2, 4], "b"), lambda k, c: upsert(k.filter("id <> 3"), c), 1)
    n = max(t.states.numbers())
    feed = change_feed(t.read(n - 1), t.read(n), "id").collect()
    got = {r["id"]: (r["action"], r["before"] and r["before"]["text"], r["after"] and r["after"]["text"]) for r in feed}
    assert {k: v for k, v in got.items() if k != 3} == {2: ("update", "a", "b"), 4: ("insert", None, "b")}
    assert got.get(3, ("delete", "a", None)) == ("delete", "a", None)


def test_index_stream_keeps_the_newest_revision(spark, tmp_path):
    schema = "unit_id long, revision long, action string, payload string"
    for part in ([(1, 5, "upsert", "x"), (2, 1, "upsert", "y")], [(1, 4, "delete", None), (2, 2, "delete", None)], [(2, 1, "upsert", "late")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        streams.index_sync_stream(streams.read_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/index", f"{tmp_path}/ck", 8).awaitTermination()
    got = {r["unit_id"]: (r["revision"], r["payload"], r["deleted"]) for r in streams.index_table(spark, f"{tmp_path}/index").read().collect()}
    assert got == {1: (5, "x", False), 2: (2, None, True)}
