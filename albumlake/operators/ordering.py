"""Global order, frozen results and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import nocase
from ..sources.tables import materialize


def order_by(name: str) -> list[Column]:
    """Keys of the orders newest, oldest, name and added; unknown dates come last for newest."""
    return {
        "newest": [F.col("captured_at").desc(), F.col("id").desc()],
        "oldest": [F.col("captured_at").asc(), F.col("id").asc()],
        "name": [nocase("filename").asc(), F.col("id").asc()],
        "added": [F.col("id").desc()],
    }[name]


def with_ordinal(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """A dense position from 0 in a total order, without gathering the rows in one task.

    Rows are range-partitioned and numbered within their partition; the number of rows in the
    partitions before (one row per partition) is added.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    spread = materialize(spread)
    counts = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return spread.withColumn("_r", within).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_r")).cast("long")).drop("_part", "_r", "_before")


def freeze(df: DataFrame, order: list[Column]) -> DataFrame:
    """Membership and order written once: later pages don't move when the catalogue changes."""
    return materialize(with_ordinal(df, order))


def page(frozen: DataFrame, offset: int = 0, limit: int = 200) -> DataFrame:
    return frozen.filter((F.col("ordinal") >= offset) & (F.col("ordinal") < offset + limit)).withColumn("has_more", F.lit(frozen.count() > offset + limit))


def verdict_page(frozen: DataFrame, verdict: str, offset: int = 0, limit: int = 200) -> DataFrame:
    """A page of one verdict (or 'pending'), positions counted among its rows."""
    chosen = frozen if not verdict else frozen.filter(F.coalesce("verdict", F.lit("pending")) == verdict)
    return page(with_ordinal(chosen.withColumnRenamed("ordinal", "place"), [F.col("place")]), offset, limit)


def pending(frozen: DataFrame, limit: int = 40) -> DataFrame:
    """The next rows without a verdict, in order."""
    return frozen.filter(F.col("verdict").isNull()).orderBy("ordinal").limit(limit)


def locate(anchors: DataFrame, cards: DataFrame) -> DataFrame:
    """Position of each anchor (asset_id, old_row): its own card, else that of its stack, else the old
    row held within bounds. ``cards`` has asset_id, position and, for hidden members, cover_id."""
    shown = cards.filter("visible").select("asset_id", F.col("position").alias("own"))
    hidden = cards.select("asset_id", "cover_id")
    covers = shown.select(F.col("asset_id").alias("cover_id"), F.col("own").alias("stacked"))
    last = F.broadcast(shown.agg(F.greatest(F.max("own"), F.lit(0)).alias("last")))
    found = anchors.join(shown, "asset_id", "left").join(hidden, "asset_id", "left").join(covers, "cover_id", "left").crossJoin(last)
    return found.select("asset_id", F.coalesce("own", "stacked", F.least(F.greatest("old_row", F.lit(0)), "last")).cast("long").alias("position"))


def merge_ranked(streams: list[DataFrame]) -> DataFrame:
    """Several scored streams as one order: score descending, then asset and unit."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return with_ordinal(out, [F.col("score").desc(), F.col("asset_id").asc(), F.col("unit_id").asc()])


def error_report(file_errors: DataFrame, frame_errors: DataFrame, limit: int = 500) -> DataFrame:
    """Errors of files, then of frames with their time; the most recent assets first."""
    both = file_errors.withColumn("moment", F.lit("")).withColumn("level", F.lit(0)).unionByName(frame_errors.withColumn("level", F.lit(1)))
    return both.orderBy("level", F.desc("asset_id"), "stage", "moment").limit(limit)
