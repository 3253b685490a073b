"""Scenarios with hand-computed answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from albumlake.functions import scalars as S
from albumlake.operators import filters, geo, ordering, quality, reconcile, reports, search, stacks, stages
from albumlake.sources import tables

DAY = "2003-05-01T"
ROWS = [
    (1, "2003", "a.jpg", DAY + "10:00:00", "A"),
    (2, "2003", "b.jpg", DAY + "10:00:01", "A"),
    (3, "2003", "c.jpg", DAY + "10:00:03", "A"),
    (4, "2003", "d.jpg", DAY + "10:00:08", "A"),
    (5, "2003", "e.jpg", None, "A"),
    (6, "2003", "f.jpg", None, "A"),
    (7, "2003", "g.mp4", DAY + "10:00:01", "A"),
    (8, "2003", "h.jpg", DAY + "10:00:01", "B"),
    (9, "2004/sub", "IMG_01.CR2", "2004-05-01T10:00:00", "A"),
    (10, "2004/sub/web", "IMG_01.CR2.jpg", "2004-05-01T10:00:00", "A"),
]


@pytest.fixture(scope="module")
def media(spark):
    df = spark.createDataFrame(ROWS, "id long, folder string, filename string, captured_at string, camera string")
    ext = F.lower(F.regexp_extract("filename", r"(\.[^.]+)$", 1))
    return df.withColumns({"extension": ext, "present": F.lit(True), "metadata_ready": F.lit(True), "relative_path": F.concat("folder", F.lit("/"), "filename")})


def shown(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def ordinals(media):
    return ordering.with_ordinal(media.select("id", "captured_at"), ordering.order_by("added")).select("id", "ordinal")


def test_bursts_and_cards(spark, media):
    keys = dict(shown(stacks.burst_stacks(media, 2), "id", "stack_key"))
    assert keys == {1: "b:1", 2: "b:1", 3: "b:1", 4: "b:4", 8: "b:8", 9: "b:9", 10: "b:9"}
    none = spark.createDataFrame([], "stack_key string, asset_id long")
    cards = stacks.stack_cards(ordinals(media), stacks.burst_stacks(media, 2), none)
    assert stacks.visible_cards(cards).count() == 7
    assert stacks.visible_cards(cards, ["b:1"]).count() == 9
    big = {r["stack_key"]: r["n"] for r in cards.collect()}
    assert big["b:1"] == 3 and big["a:5"] == 1


def test_stack_under_filter(spark, media):
    none = spark.createDataFrame([], "stack_key string, asset_id long")
    match = ordinals(media.filter("id = 2"))
    card = stacks.stack_cards(match, stacks.burst_stacks(media, 2), none).first()
    assert (card["n"], card["stack_total"]) == (1, 3)


def test_versions_covers_exclusions(spark, media):
    v = stacks.version_stacks(media)
    keys = dict(shown(v, "id", "stack_key"))
    assert keys[9] == keys[10] == "v:9" and len(set(keys.values())) == 6
    chosen = spark.createDataFrame([("v:9", 9)], "stack_key string, asset_id long")
    cards = stacks.stack_cards(ordinals(media), v, chosen)
    assert {r["cover_id"] for r in cards.filter("stack_key = 'v:9'").collect()} == {9}
    without = stacks.version_stacks(media, spark.createDataFrame([(9,)], "asset_id long"))
    assert stacks.visible_cards(stacks.stack_cards(ordinals(media), without, chosen)).count() == 10


def test_folder_boundary(media):
    assert shown(media.filter(filters.in_folder("2004")), "id") == [(9,), (10,)]
    assert shown(media.filter(filters.in_folder("2004/sub", False)), "id") == [(9,)]
    assert shown(media.filter(filters.in_folder("200")), "id") == []


def test_wrong_dates_and_bounds():
    with pytest.raises(ValueError):
        filters.captured_between("2003-02-30")
    with pytest.raises(ValueError):
        filters.Filters(bounds=(0, float("nan"), 1, 1)).condition()


@pytest.mark.parametrize(
    "text,side,lat,want",
    [("55 45 20.5", "N", True, 55.755694), ("37:37:3", "E", False, 37.6175), ("10.5S", None, True, -10.5), ("-10 30", None, True, -10.5), ("91", None, True, None), ("10 60", None, True, None), ("10E", None, True, None), ("1 2 3 4", None, True, None), ("x", None, True, None)],
)
def test_coordinates(spark, text, side, lat, want):
    df = spark.createDataFrame([(text, side)], "t string, s string")
    got = df.select(S.coordinate("t", "s" if side else None, lat)).first()[0]
    assert got is None if want is None else abs(got - want) < 1e-5


def test_names_times(spark):
    df = spark.createDataFrame([("Trip/[Developed]", "IMG.CR2.jpg", 3_723_000, "2003:05:01 10:00:00\x00"), ("a", "b", None, "0000:00:00 00:00:00")], "f string, n string, ms long, t string")
    got = [tuple(r) for r in df.select(S.version_folder("f"), S.version_name("n"), S.timestamp_text("ms"), S.capture_time("t")).collect()]
    assert got == [("trip", "img", "1:02:03", "2003-05-01T10:00:00"), ("a", "b", "0:00", None)]


def test_exact_fold(spark):
    df = spark.createDataFrame([("Straße",)], "s string")
    assert df.select(S.exact_fold("s")).first()[0] == "strasse"
    assert df.select(S.fold("s")).first()[0] == "straße"


def test_orientation_composes(spark):
    df = spark.createDataFrame([(1, 90), (6, 270), (2, 180), (9, 90), (1, 45)], "e int, a int")
    assert [r[0] for r in df.select(S.compose_orientation("e", "a")).collect()] == [6, 1, 4, 6, None]


def listing(spark, rows):
    return spark.createDataFrame(rows, "path string, size long, mtime long")


def test_reconcile(spark):
    old = spark.createDataFrame([("r/keep", 1, 1, 1, True), ("r/replace", 1, 1, 1, True), ("r/remove", 1, 1, 1, True), ("r2/other", 1, 1, 1, True)], "path string, size long, mtime long, version long, present boolean")
    new = listing(spark, [("r/keep", 1, 1), ("r/replace", 2, 5), ("r/new", 1, 1)])
    first = reconcile.reconcile(old, new, ["r"])
    assert dict(shown(first, "path", "action")) == {"r/keep": "unchanged", "r/replace": "changed", "r/remove": "removed", "r/new": "added", "r2/other": "unchanged"}
    back = reconcile.reconcile(tables.materialize(first.drop("action")), listing(spark, [("r/remove", 1, 1)]), ["r/none"])
    assert back.filter("path = 'r/remove'").select("action", "version").first() == ("restored", 1)
    assert reconcile.guarded_reconcile(old, new, ["r"], []).filter("action = 'removed'").isEmpty()


def test_changes_replay(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "unit_id long, v string")
    ups, gone = spark.createDataFrame([(2, "c"), (3, "d")], base.schema), spark.createDataFrame([(1,)], "unit_id long")
    once = tables.apply_changes(base, ups, gone)
    assert shown(once, "unit_id", "v") == shown(tables.apply_changes(once, ups, gone), "unit_id", "v") == [(2, "c"), (3, "d")]


def test_publish(spark, tmp_path):
    folder = f"file://{tmp_path}/snap"
    tables.publish(spark.range(3), folder)
    tables.publish(spark.range(5), folder)
    assert tables.current_snapshot(spark, folder).count() == 5


def test_scan_files(spark, tmp_path):
    for p in ("a/x.JPG", "a/y.xmp", "b/c/z.mp4", "skip/q.png"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    got = tables.scan_files(spark, f"file://{tmp_path}", ["a", "b", "skip", "a"], ["skip"])
    assert sorted((r["path"].rsplit("/", 1)[1], r["supported"]) for r in got.collect()) == [("x.JPG", True), ("y.xmp", False), ("z.mp4", True)]
    with pytest.raises(Exception):
        tables.scan_files(spark, f"file://{tmp_path}/nowhere").count()
    with pytest.raises(ValueError):
        tables.scan_files(spark, f"file://{tmp_path}", ["../up"])


def test_apple_double(spark):
    df = spark.createDataFrame([("d/._a.jpg", bytearray(b"\x00\x05\x16\x07zz")), ("d/._a.jpg", bytearray(b"\xff\xd8zzz"))], "p string, h binary")
    assert [r[0] for r in df.select(tables.classify_format(F.col("p"), F.col("h"))).collect()] == ["sidecars", "jpeg"]


def test_gazetteer_gold_catalog(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("1\tRiga\tRīga, Riga,Riga\tLV\t56.9\t24.1\n", encoding="utf-8")
    assert tables.read_gazetteer(spark, f"file://{tmp_path}/c.tsv").first()["aliases"] == ["Rīga", "Riga"]
    (tmp_path / "g.json").write_text('[{"query": "q", "conditions": ["c", "d"], "positive": [1], "negative": [2, 3]}]')
    assert tables.read_gold(spark, f"file://{tmp_path}/g.json").count() == 6
    spark.range(2).write.parquet(f"file://{tmp_path}/k/assets")
    row = tables.read_catalog(spark, f"file://{tmp_path}/k").first()
    assert row["version"] == 1 and row["media_kind"] == "photo" and row["latitude"] is None


def test_frozen_pages_stay(spark):
    rows = spark.range(550).selectExpr("id", "cast(id as string) as captured_at")
    frozen = ordering.freeze(rows, ordering.order_by("added"))
    assert [r["ordinal"] for r in ordering.page(frozen, 500).orderBy("ordinal").collect()] == list(range(500, 550))
    verdicts = frozen.withColumn("verdict", F.when(F.col("id") % 2 == 1, "yes"))
    page = ordering.verdict_page(verdicts, "yes", 200)
    assert page.count() == 75 and not page.first()["has_more"]


def test_rrf_equals_page_by_page(spark):
    import random

    rng = random.Random(5)
    hits = [(s, w, r, rng.randrange(90)) for s, w in (("a", 1.0), ("b", 2.0)) for r in range(500)]
    score, order = {}, []
    for p in range(3):
        page = {}
        for s, w in (("a", 1.0), ("b", 2.0)):
            first = set()
            for t, _, r, asset in hits:
                if t == s and 200 * p <= r < 200 * p + 200 and asset not in first:
                    first.add(asset)
                    page[asset] = page.get(asset, 0) + w / (60 + r)
        for asset in sorted(page, key=lambda a: (-round(page[a], 9), a)):
            if asset not in score:
                score[asset] = page[asset]
                order.append(asset)
    got = search.fuse_rrf(spark.createDataFrame(hits, "stream string, weight double, r long, asset_id long")).orderBy("ordinal").collect()
    assert [r["asset_id"] for r in got] == order


def test_retention_order(spark):
    rows = [(i, 10, i, i == 2) for i in range(1, 11)]
    items = spark.createDataFrame(rows, "id long, size long, used long, pinned boolean")
    out = dict(shown(quality.retention(items, 100), "id", "evicted"))
    assert [i for i, e in sorted(out.items()) if e] == [1, 3] and 2 not in out


STEMS = """в:в вагон:вагон вагона:вагон вагоне:вагон вагонов:вагон вагоном:вагон вагоны:вагон важная:важн важнее:важн важнейшие:важн важнейшими:важн
важничал:важнича важно:важн важного:важн важной:важн важность:важност падает:пада падай:пада падал:пада падали:пада паденье:паден пади:пад
павильон:павильон ёлка:елк ёлки:елк собака:собак собаки:собак собаками:собак смеялся:смея прочитав:прочита прочитавши:прочита длинный:длин длинная:длин
бодрость:бодрост активность:активн beach:beach x1:x1 стр:стр"""


def test_stems(spark):
    from albumlake.functions.stemming import stems

    pairs = [p.split(":") for p in STEMS.split()]
    df = spark.createDataFrame([([a for a, _ in pairs],), ([],), (None,), (["the", "boats"],)], "w array<string>")
    got = [r["s"] for r in df.select(stems(F.col("w")).alias("s")).collect()]
    assert dict(zip([a for a, _ in pairs], got[0])) == dict(pairs)
    assert got[1:] == [[], None, ["the", "boats"]]


def test_text_search_by_stem(spark):
    texts = spark.createDataFrame([(1, "Собаки на пляже"), (2, "кошка"), (3, "dogs"), (4, None)], "unit_id long, search_text string")
    ask = spark.createDataFrame([(0, "собака пляж")], "query_id int, q string")
    assert [r["unit_id"] for r in search.bm25(texts, ask).collect()] == [1]
    assert search.bm25(texts, ask, stem=False).collect() == []


def test_nearest_city_everywhere(spark):
    """Against all cities, over poles, the date line, edges of cells and equal places."""
    dice = random.Random(5)
    where = [(90.0, 0.0), (-90.0, 180.0), (10.0, 179.99), (10.0, -179.99), (0.0, 0.0), (45.0, 45.0)]
    where += [(dice.uniform(-90, 90), dice.uniform(-180, 180)) for _ in range(300)] + [(48 + dice.random(), 2 + dice.random()) for _ in range(100)]
    towns = [(n, f"c{n}", dice.uniform(-90, 90), dice.uniform(-180, 180)) for n in range(60)] + [(100 + n, f"d{n}", 48 + dice.random(), 2 + dice.random()) for n in range(60)]
    towns += [(200, "again", *towns[-1][2:]), (-1, "before", *towns[0][2:])]
    points = spark.createDataFrame([(n, a, b, None, None, "") for n, (a, b) in enumerate(where)], "id long, latitude double, longitude double, user_latitude double, user_longitude double, geo_text string")
    cities = spark.createDataFrame(towns, "id long, name string, latitude double, longitude double")

    def vector(lat, lon):
        a, b = math.radians(lat), math.radians(lon)
        return math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)

    want = {n: min((-round(sum(x * y for x, y in zip(vector(*p), vector(c[2], c[3]))), 12), c[0]) for c in towns)[1] for n, p in enumerate(where)}
    for cell in (1.0, 7.5):
        assert {r["id"]: r["city_id"] for r in geo.nearest_city(points, cities, cell=cell).collect()} == want


def test_nearest_city(spark):
    cities = spark.createDataFrame([(1, "west", 0.0, -179.0), (2, "east", 0.0, 170.0)], "id long, name string, latitude double, longitude double")
    points = spark.createDataFrame([(1, 0.0, 179.5, None, None, "")], "id long, latitude double, longitude double, user_latitude double, user_longitude double, geo_text string")
    assert geo.nearest_city(points, cities).first()["city"] == "west"


def test_map_provenance(spark):
    rows = [(1, 55.0, 37.0, None, None), (2, None, None, 55.01, 37.01)]
    g = geo.geo_grid(spark.createDataFrame(rows, "id long, latitude double, longitude double, user_latitude double, user_longitude double"), 1.0).first()
    assert (g["n"], g["manual"], g["metadata"]) == (2, 1, 1)


def test_storyboard_and_frames(spark):
    f = spark.createDataFrame([(1, f"u{i:02d}", i * 10) for i in range(16)], "asset_id long, unit_id string, timestamp_ms long")
    assert [r["place"] for r in stages.storyboard(f).orderBy("place").collect()] == [0, 2, 4, 6, 9, 11, 13, 15]
    m = search.moments(f)
    assert m.count() == 12 and m.first()["n"] == 16


def test_stage_keeps_good_rows(spark):
    u = spark.createDataFrame([(1, 1, "a"), (2, 1, "bad"), (3, 1, "c")], "unit_id long, file_version long, value string")

    def load():
        def f(batch):
            if (batch == "bad").any():
                raise ValueError("no")
            return [len(x) for x in batch]

        return f

    got = {r["unit_id"]: (r["result"], r["error"]) for r in stages.run_stage(u, load, "int", "m").collect()}
    assert got == {1: (1, None), 2: (None, "ValueError: no"), 3: (1, None)}


def test_rates_fall_to_zero(spark):
    c = spark.createDataFrame([("local", "faces", "2024-01-01 00:00:00"), ("local", "faces", "2024-01-01 00:00:59"), ("local", "faces", "2024-01-01 00:02:00")], "source string, stage string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r["n"] for r in reports.rolling_rate(c).orderBy("at").collect()] == [1, 2, 1]


def test_cover_folders(spark):
    f = lambda *x: spark.createDataFrame([(i,) for i in x], "folder string")
    got = dict(shown(reconcile.cover_folders(f("a/b", "c"), f("A", "c/d", "e")), "folder", "state"))
    assert got == {"A": "added", "e": "added", "c/d": "skipped", "a/b": "absorbed", "c": "kept"}


def test_cover_folders_as_written(spark):
    """A folder written with a slash at its end lies below the same one without it."""
    f = lambda *x: spark.createDataFrame([(i,) for i in x], "folder string")
    got = dict(shown(reconcile.cover_folders(f("h/a", "h/b/", "h/b/c"), f("h/a/", "h/b", "h/d", "h/d/"), exact=True), "folder", "state"))
    assert got == {"h/a": "kept", "h/a/": "skipped", "h/b": "added", "h/b/": "absorbed", "h/b/c": "absorbed", "h/d": "added", "h/d/": "skipped"}


def test_bursts_of_one_folder_over_many_ranges(spark):
    """One folder and camera; stacks go on over the borders of ranges, whatever their number."""
    import random
    from datetime import datetime, timedelta

    rng, at, rows = random.Random(3), datetime(2020, 1, 1), []
    for i in range(400):
        at += timedelta(seconds=rng.choice([0, 1, 2, 2, 3, 5]) if i > 60 else 1)
        rows.append((i, "f", None, at.isoformat(" "), True, True, ".jpg"))
    df = spark.createDataFrame(rows, "id long, folder string, camera string, captured_at string, present boolean, metadata_ready boolean, extension string")
    want, last, key = {}, None, None
    for r in rows:
        now = datetime.fromisoformat(r[3])
        key = r[0] if last is None or (now - last).total_seconds() > 2 else key
        want[r[0]], last = f"b:{key}", now
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "8", "90"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert {r["id"]: r["stack_key"] for r in stacks.burst_stacks(df, 2).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
