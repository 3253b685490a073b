"""Bursts and versions as stacks, their covers and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import version_folder, version_name
from ..sources.scratch import materialize
from .filters import browsable, is_video
from .ordering import with_ordinal


def stackable(media: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """Browsable, dated photos that nobody took out of stacks."""
    out = media.filter(browsable() & ~is_video() & F.col("captured_at").isNotNull())
    return out if exclusions is None else out.join(exclusions.select(F.col("asset_id").alias("id")), "id", "left_anti")


def burst_stacks(media: DataFrame, seconds: int = 2, versions: bool = True, exclusions: DataFrame | None = None) -> DataFrame:
    """(id, stack_key) of photos of one camera and folder that follow each other within ``seconds``
    (0 to 60, equal gaps stay together); with ``versions``, folders of versions count as one.

    The order is cut into ranges, so one large folder of one camera is no single task."""
    seconds = max(0, min(60, seconds))
    place = version_folder("folder") if versions else F.col("folder")
    stamp = F.unix_timestamp(F.try_to_timestamp("captured_at"))
    rows = stackable(media, exclusions).select("id", place.alias("place"), "camera", "captured_at", stamp.alias("at")).filter("at IS NOT NULL")
    parts = int(media.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(rows.repartitionByRange(parts, "place", "camera", "captured_at", "id").withColumn("part", F.spark_partition_id()))
    # Within a range of the order every gap but the first is known.
    lie = Window.partitionBy("part", "place", "camera").orderBy("captured_at", "id")
    marked = rows.withColumn("first", F.when(F.col("at") - F.lag("at").over(lie) > seconds, F.col("id"))).withColumn("own", F.last("first", ignorenulls=True).over(lie))
    # One row for each range and place says how it begins and ends; they pass the open stack on.
    ends = marked.groupBy("part", "place", "camera").agg(F.min_by(F.struct("id", "at"), F.struct("captured_at", "id")).alias("head"), F.max_by(F.struct("own", "at"), F.struct("captured_at", "id")).alias("tail"))
    along = Window.partitionBy("place", "camera").orderBy("part")
    gap = F.col("head.at") - F.lag("tail.at").over(along)
    ends = ends.withColumn("opened", F.when(gap.isNull() | (gap > seconds), F.col("head.id")))
    before = F.last(F.coalesce("tail.own", "opened"), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("part", "place", "camera", F.coalesce("opened", before).alias("carried"))
    m, e = marked.alias("m"), ends.alias("e")
    same = (F.col("m.part") == F.col("e.part")) & F.col("m.place").eqNullSafe(F.col("e.place")) & F.col("m.camera").eqNullSafe(F.col("e.camera"))
    return m.join(e, same).select("m.id", F.concat(F.lit("b:"), F.coalesce("own", "carried").cast("string")).alias("stack_key"))


def version_stacks(media: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """(id, stack_key) of the versions of one shot: same folder of versions, name, time and camera."""
    of = Window.partitionBy(version_folder("folder"), version_name("filename"), "captured_at", "camera")
    return stackable(media, exclusions).select("id", F.concat(F.lit("v:"), F.min("id").over(of).cast("string")).alias("stack_key"))


def stack_join(matches: DataFrame, stacks: DataFrame, covers: DataFrame) -> DataFrame:
    """Matches (id, ordinal) with their stack key ('a:id' for a row alone) and the chosen cover."""
    keyed = matches.join(stacks, "id", "left").withColumn("stack_key", F.coalesce("stack_key", F.concat(F.lit("a:"), F.col("id").cast("string"))))
    return keyed.join(covers.select("stack_key", F.col("asset_id").alias("chosen")), "stack_key", "left")


def stack_cards(matches: DataFrame, stacks: DataFrame, covers: DataFrame) -> DataFrame:
    """Per match: stack_key, first ordinal and size of its stack here, cover_id, choice (1 the cover,
    others ordinal + 2) and stack_total, the stack's size over the whole catalogue."""
    rows = stack_join(matches, stacks, covers)
    here = rows.groupBy("stack_key").agg(
        F.min("ordinal").alias("first"),
        F.count("*").alias("n"),
        F.coalesce(F.max(F.when(F.col("id") == F.col("chosen"), F.col("id"))), F.min_by("id", "ordinal")).alias("cover_id"),
    )
    whole = stacks.groupBy("stack_key").agg(F.count("*").alias("whole"))
    cards = rows.drop("chosen").join(here, "stack_key").join(whole, "stack_key", "left")
    choice = F.when(F.col("id") == F.col("cover_id"), F.lit(1)).otherwise(F.col("ordinal") + 2).cast("long")
    return cards.withColumn("choice", choice).withColumn("stack_total", F.greatest("n", F.coalesce("whole", F.lit(0)))).drop("whole")


def visible_cards(cards: DataFrame, expanded: list[str] = ()) -> DataFrame:
    """Covers, and all other members of expanded stacks, with their position."""
    covers = cards.filter("choice = 1")
    members = cards.filter((F.col("choice") > 1) & F.col("stack_key").isin(*expanded)) if expanded else cards.limit(0)
    return with_ordinal(covers.unionByName(members), [F.col("first"), F.col("choice")], "position")


def media_totals(media: DataFrame) -> DataFrame:
    """Rows by media kind, and all of them."""
    kind = F.when(is_video(), "video").otherwise("photo")
    return media.rollup(kind.alias("kind")).agg(F.count("*").alias("n")).select(F.coalesce("kind", F.lit("all")).alias("kind"), "n")
