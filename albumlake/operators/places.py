"""Places set by hand: keyed updates of the catalogue, and the index changes that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import valid_place
from ..sources.states import KeyedTable, change_feed, newest

PLACED = "id long, version long, present boolean, geo_text string, user_place string, user_latitude double, user_longitude double"


def placed_assets(spark: SparkSession, folder: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, folder, PLACED, "id", buckets)


def set_places(assets: KeyedTable, commands: DataFrame, batch: int | None = None) -> bool:
    """Apply commands (id, version, seq, name, latitude, longitude): the last of each asset sets its
    place, if it is for the asset's version and its coordinates are valid, both or none. Names are
    trimmed and cut at 500 characters. Only the buckets of the commands' assets are written."""
    name = F.substring(F.trim(F.coalesce("name", F.lit(""))), 1, 500)
    given = commands.withColumn("name", name).filter(valid_place("latitude", "longitude", "name"))

    def merge(known: DataFrame, commands: DataFrame) -> DataFrame:
        last = newest(commands, "id", "seq").select("id", F.col("version").alias("_version"), "name", "latitude", "longitude")
        both = known.join(last, "id", "left")
        fits = F.coalesce(F.col("_version") == F.col("version"), F.lit(False))
        now = {"user_place": "name", "user_latitude": "latitude", "user_longitude": "longitude"}
        return both.withColumns({old: F.when(fits, F.col(new)).otherwise(F.col(old)) for old, new in now.items()})

    return assets.apply(given, merge, batch)


def place_feed(assets: KeyedTable, before: int, after: int) -> DataFrame:
    """What changed between two states: (id, action, before, after)."""
    return change_feed(assets.read(before), assets.read(after), "id")


def place_of(row: str) -> Column:
    """The place that is shown of a struct of ``PLACED``."""
    own = F.col(f"{row}.user_place")
    return F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(F.col(f"{row}.geo_text"))


def outbox(feed: DataFrame, revision: int) -> DataFrame:
    """Changes (unit_id, revision, action, payload) for the index: an asset that is gone or not
    present is deleted, another gets the place that is shown, if that is what changed."""
    gone = F.col("after").isNull() | ~F.col("after.present")
    moved = ~place_of("before").eqNullSafe(place_of("after")) | F.col("before").isNull() | ~F.col("before.present")
    kept = feed.filter(F.coalesce(gone, F.lit(False)) | moved)
    return kept.select(F.col("id").alias("unit_id"), F.lit(revision).cast("long").alias("revision"), F.when(gone, "delete").otherwise("upsert").alias("action"), F.when(~gone, place_of("after")).alias("payload"))
