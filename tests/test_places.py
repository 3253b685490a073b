"""Places set by hand."""

from albumlake.operators import places

COMMAND = "id long, version long, seq long, name string, latitude double, longitude double"


def test_set_places(spark, tmp_path):
    assets = places.placed_assets(spark, str(tmp_path), 4)
    rows = [(i, 1, i != 5, "Рига", "", None, None) for i in range(1, 9)]
    assets.apply(spark.createDataFrame(rows, places.PLACED), lambda known, new: new, 0)
    commands = [(1, 1, 1, "first", 1.0, 1.0), (1, 1, 2, "  second ", 2.0, 2.0), (2, 2, 1, "other version", 1.0, 1.0), (3, 1, 1, "half", 1.0, None), (4, 1, 1, "far", 91.0, 0.0), (5, 1, 1, "hidden", 0.0, 0.0), (6, 1, 1, "x" * 600, None, None), (7, 1, 1, " ", 5.0, 5.0), (99, 1, 1, "none", 0.0, 0.0)]
    commands = spark.createDataFrame(commands, COMMAND)
    assert places.set_places(assets, commands, 1) and not places.set_places(assets, commands, 1)
    got = {r["id"]: (r["user_place"], r["user_latitude"]) for r in assets.read().collect()}
    assert got == {1: ("second", 2.0), 2: ("", None), 3: ("", None), 4: ("", None), 5: ("hidden", 0.0), 6: ("x" * 500, None), 7: ("", 5.0), 8: ("", None)}
    feed = places.place_feed(assets, 1, 2)
    assert {r["id"]: r["action"] for r in feed.collect()} == {i: "update" for i in (1, 5, 6, 7)}
    out = {r["unit_id"]: (r["revision"], r["action"], r["payload"]) for r in places.outbox(feed, 9).collect()}
    assert out == {1: (9, "upsert", "second"), 5: (9, "delete", None), 6: (9, "upsert", "x" * 500)}
