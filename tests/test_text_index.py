"""The stored inverted table against BM25 over the texts."""

import os

import pytest
from pyspark.sql import functions as F

from albumlake.operators.search import bm25
from albumlake.operators.text_index import TextIndex
from albumlake.sources.states import States

QUERIES = [(1, "дачи летом"), (2, "red cat"), (3, "красивая дача, the cat"), (4, "nothing here"), (5, "")]


def texts(spark, n, seed=0):
    words = F.array(*[F.lit(w) for w in "red blue cat dog дача даче дачи летом лето красивая красивый the a of house".split()])
    at = lambda i: F.get(words, F.pmod(F.xxhash64("id", F.lit(seed), F.lit(0) + i), F.lit(15) - i % 5).cast("int"))
    count = (F.pmod(F.xxhash64("id", F.lit(seed + 100)), F.lit(30))).cast("int")
    text = F.array_join(F.transform(F.sequence(F.lit(0), count), at), " ")
    return spark.range(n).select(F.col("id").alias("unit_id"), F.when(F.col("id") % 50 == 0, None).otherwise(text).alias("search_text"))


def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id long, q string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["unit_id"], round(r["score"], 7)) for r in df.collect())


def test_same_rows_as_over_texts(spark, tmp_path):
    now, queries = texts(spark, 3000), asked(spark)
    index = TextIndex(spark, str(tmp_path), buckets=16)
    index.apply(now.filter("unit_id < 2500"), batch=0)
    index.apply(now.filter("unit_id >= 2500"), batch=1)
    assert not index.apply(now.limit(5), batch=1)
    assert rows(index.search(queries)) == rows(bm25(now, queries))
    for limit in (1, 7, 200):
        assert rows(index.search(queries, limit)) == rows(bm25(now, queries, limit))


def test_changes_deletes_and_compaction(spark, tmp_path):
    now, queries = texts(spark, 1500), asked(spark)
    index = TextIndex(spark, str(tmp_path), buckets=4)
    index.apply(now)
    changed = texts(spark, 200, seed=7).filter("unit_id % 2 = 0")
    index.apply(changed, spark.range(1400, 1600).select(F.col("id").alias("unit_id")))
    now = now.filter("unit_id < 1400 and not (unit_id < 200 and unit_id % 2 = 0)").unionByName(changed)
    state = index.state()
    assert len(state["segments"]) == 2 and state["dead_units"] == 200 and state["units"] == 1400
    assert rows(index.search(queries)) == rows(bm25(now, queries)) and rows(index.search(queries, 9)) == rows(bm25(now, queries, 9))
    index.apply(texts(spark, 1400, seed=3).filter("unit_id >= 800"))
    now = now.filter("unit_id < 800").unionByName(texts(spark, 1400, seed=3).filter("unit_id >= 800"))
    state = index.state()
    assert len(state["segments"]) == 1 and not state["dead"] and state["units"] == 1400  # more than a quarter was dead
    assert rows(index.search(queries)) == rows(bm25(now, queries))


def test_reads_the_buckets_of_its_terms(spark, tmp_path):
    index, size = TextIndex(spark, str(tmp_path), buckets=32), lambda files: sum(os.path.getsize(f.removeprefix("file:").replace("//", "/")) for f in files)
    one = spark.createDataFrame([(1, "house")], "query_id long, q string")
    index.apply(texts(spark, 2000))
    read = index.postings(index.asked(one)).inputFiles()
    assert {f.split("bucket=")[1].split("/")[0] for f in read if "bucket=" in f} == {str(r[0]) for r in index.asked(one).select(index.bucket()).collect()}
    before = size(read)
    long = texts(spark, 2000).withColumn("search_text", F.concat("search_text", F.lit(" "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("w"), F.col("unit_id") * 0 + i)), " ")))
    index = TextIndex(spark, f"{tmp_path}/long", buckets=32)
    index.apply(long.filter("search_text is not null"))
    whole = size(index._rows(index.state(), None).inputFiles())
    assert size(index.postings(index.asked(one)).inputFiles()) < whole / 5  # twenty times the text, and yet little more to read
    assert before > 0


def test_blocks_are_left_out(spark, tmp_path):
    """Only the first block holds texts worth ranking: the others' postings aren't unpacked."""
    text = F.when(F.col("id") < 1024, "cat").otherwise(F.lit("cat " + "x y z " * 20))
    units = spark.range(20 * 1024).select(F.col("id").alias("unit_id"), text.alias("search_text"))
    index = TextIndex(spark, str(tmp_path), buckets=2)
    index.apply(units)
    q = spark.createDataFrame([(1, "cat")], "query_id long, q string")
    assert rows(index.search(q, 5)) == rows(bm25(units, q, 5))


def test_crash_before_publishing(spark, tmp_path, monkeypatch):
    now, queries = texts(spark, 600), asked(spark)
    index = TextIndex(spark, str(tmp_path), buckets=4)
    index.apply(now.filter("unit_id < 500"), batch=0)
    publish = States.publish
    with monkeypatch.context() as m:
        m.setattr(States, "publish", lambda self, n, s: publish(self, n, s) if self.folder.endswith("lengths") else (_ for _ in ()).throw(OSError("lost")))
        for part in ("unit_id >= 400", "unit_id < 100", "unit_id >= 400"):
            with pytest.raises(OSError, match="lost"):
                index.apply(now.filter(part).withColumn("search_text", F.lit("lost lost")), batch=1)
    assert rows(index.search(queries)) == rows(bm25(now.filter("unit_id < 500"), queries))
    assert index.apply(now.filter("unit_id >= 400"), batch=1)
    assert index.state()["units"] == 600 and rows(index.search(queries)) == rows(bm25(now, queries))


def test_nothing_there(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path), buckets=4)
    assert index.search(asked(spark)).count() == 0 and index.search(asked(spark), 3).count() == 0
    index.apply(texts(spark, 10).limit(0))
    assert index.search(asked(spark)).count() == 0
