"""The listing as a data source, snapshots, and the SQL surface."""

import os
import re

import pytest

from albumlake.functions import scalars as S
from albumlake.functions import sql as functions_sql
from albumlake.plans import queries_catalog
from albumlake.sources import listing, tables
from albumlake.streaming import streams

from compare import DATA


def tree(root, names):
    for n in names:
        os.makedirs(os.path.dirname(f"{root}/{n}"), exist_ok=True)
        with open(f"{root}/{n}", "w") as f:
            f.write(n)


def listed(spark, root, **options):
    listing.register(spark)
    reader = spark.read.format("file_listing").option("root", root)
    for k, v in options.items():
        reader = reader.option(k, v)
    return sorted((r["path"].removeprefix(os.path.realpath(root.removeprefix("file://")) + "/"), r["size"], r["extension"], r["supported"]) for r in reader.load().collect())


def test_listing(spark, tmp_path):
    names = ["a/x.JPG", "a/deep/er/y.txt", "a/deep/z.cr2", "b/w.mp4", "c/no.jpg", "skip/s.jpg", "a/skip/t.jpg", "top"]
    tree(tmp_path, names)
    os.symlink(f"{tmp_path}/c", f"{tmp_path}/a/link")
    ext = lambda n: os.path.splitext(n)[1].lower()
    row = lambda n: (n, len(n), ext(n), ext(n) in (".jpg", ".cr2", ".mp4"))
    assert listed(spark, str(tmp_path)) == sorted(map(row, names))
    assert listed(spark, f"file://{tmp_path}", paths='["a", "b", "a/deep", "a"]', skip='["a/skip"]', parts="1") == sorted(row(n) for n in names if n[0] in "ab" and "skip" not in n)
    for options in ({"paths": '["../up"]'}, {"paths": '["missing"]'}):
        with pytest.raises(Exception, match="outside|No such file"):
            listed(spark, str(tmp_path), **options)


def test_skipped_folders_are_never_entered(tmp_path, monkeypatch):
    tree(tmp_path, [f"{a}/{b}/f.jpg" for a in ("x", "y", "skip") for b in "pqr"])
    entered, scandir = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: (entered.append(str(p)), scandir(p))[1])
    r = listing.ListingReader({"root": str(tmp_path), "skip": '["skip", "y/q"]', "parts": "2"})
    found = [f[0] for p in r.partitions() for f in r.read(p)]
    assert len(found) == 5 and not any(e.removeprefix(str(tmp_path)).startswith(("/skip", "/y/q")) for e in entered)


def test_listing_feeds_the_ingest_stream(spark, tmp_path):
    tree(tmp_path, ["in/a.jpg", "in/b/c.jpg"])
    listing.register(spark)
    for names in (["in/d.jpg"], ["in/d.jpg", "in/e.jpg"]):
        feed = spark.readStream.format("file_listing").option("root", f"{tmp_path}/in").load().selectExpr("path", "size", "unix_millis(modified) as mtime")
        streams.ingest_stream(feed, f"{tmp_path}/catalog", f"{tmp_path}/ck", 4).awaitTermination()
        tree(tmp_path, [])
        for n in names:
            with open(f"{tmp_path}/{n}", "a") as f:
                f.write("more")
    feed = spark.readStream.format("file_listing").option("root", f"{tmp_path}/in").load().selectExpr("path", "size", "unix_millis(modified) as mtime")
    streams.ingest_stream(feed, f"{tmp_path}/catalog", f"{tmp_path}/ck", 4).awaitTermination()
    got = {r["path"].rsplit("/", 1)[1]: r["version"] for r in streams.catalog_table(spark, f"{tmp_path}/catalog").read().collect()}
    assert got == {"a.jpg": 1, "c.jpg": 1, "d.jpg": 2, "e.jpg": 1}


def test_snapshots(spark, tmp_path):
    tables.publish(spark.range(3), str(tmp_path))
    tables.publish(spark.range(5), str(tmp_path))
    assert tables.current_snapshot(spark, str(tmp_path)).count() == 5


def test_functions_in_sql_are_those_of_columns(spark):
    functions_sql.register(spark)
    rows = [("/a/Web", "IMG.CR2.jpg", "Straße"), ("/a/[developed]", "x.jpeg", "İ"), (None, None, None), ("/b/rawer", "noext", "ΣΑΣ")]
    df = spark.createDataFrame(rows, "f string, n string, w string")
    df.createOrReplaceTempView("words_here")
    got = spark.sql("SELECT version_folder(f), version_name(n), fold(w), exact_fold(w) FROM words_here").collect()
    want = df.select(S.version_folder("f"), S.version_name("n"), S.fold("w"), S.exact_fold("w")).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and got[0][3] == "strasse"
    assert [tuple(r) for r in spark.sql("SELECT * FROM ancestor_folders('a/b/c')").collect()] == [(1, "a"), (2, "a/b"), (3, "a/b/c")]
    assert spark.sql("SELECT count(*) FROM frame_times(25000)").first()[0] == 3


def test_filters_reach_the_vectors_scan(spark):
    query = queries_catalog.sql_vector_table(spark, DATA)._jdf.queryExecution()
    plan = spark._jvm.PythonSQLUtils.explainString(query, "formatted")  # in full
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan).group(1)
    assert "EqualTo(camera,cam_1)" in pushed and "IsNotNull(present)" in pushed and "EqualTo(present,true)" in pushed
    assert "search_text" not in re.search(r"ReadSchema: struct<([^\n]*)", plan).group(1)
