"""Facets, timelines, totals and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ancestors
from .filters import browsable, is_video

STAGES = ("metadata", "embedding", "caption", "faces", "location")


def catalog_stats(assets: DataFrame, jobs: DataFrame, outbox: DataFrame) -> DataFrame:
    """One row: assets, ready, unknown dates, pending and failed jobs of current versions, done by
    stage, and the length of the outbox. One pass over each table."""
    a = assets.agg(
        F.count_if("present").alias("assets"),
        F.count_if(browsable()).alias("ready"),
        F.count_if(browsable() & F.col("captured_at").isNull()).alias("unknown_dates"),
    )
    now = jobs.join(assets.filter("present").select(F.col("id").alias("asset_id"), F.col("version").alias("file_version")), ["asset_id", "file_version"])
    done = [F.count_if((F.col("stage") == s) & (F.col("status") == "done")).alias(f"done_{s}") for s in STAGES]
    j = now.agg(F.count_if(F.col("status").isin("pending", "running")).alias("pending"), F.count_if(F.col("status") == "error").alias("errors"), *done)
    return a.crossJoin(j).crossJoin(outbox.agg(F.count("*").alias("outbox")))  # one row each


def facets(assets: DataFrame) -> DataFrame:
    """(facet, value): distinct folders, cameras and extensions, and the first and last day."""
    here = assets.filter("present")
    named = [here.select(F.lit(c).alias("facet"), F.col(c).alias("value")).filter("value <> ''").distinct() for c in ("folder", "camera", "extension")]
    day = F.substring("captured_at", 1, 10)
    ends = assets.filter(browsable()).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    days = ends.select(F.expr("stack(2, 'first_day', first_day, 'last_day', last_day) as (facet, value)"))
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(days)


def folder_counts(assets: DataFrame) -> DataFrame:
    """Browsable files by folder, whatever the filters."""
    return assets.filter(browsable()).groupBy("folder").agg(F.count("*").alias("n"))


def month_histogram(assets: DataFrame, condition: Column) -> DataFrame:
    """Files by month (null: unknown) under the filters other than dates and kind."""
    return assets.filter(condition).groupBy(F.substring("captured_at", 1, 7).alias("month")).agg(F.count("*").alias("n"))


def media_counts(assets: DataFrame, condition: Column) -> DataFrame:
    """Files by kind under the filters other than kind."""
    return assets.filter(condition).groupBy(F.when(is_video(), "video").otherwise("photo").alias("kind")).agg(F.count("*").alias("n"))


def folder_rollup(counts: DataFrame) -> DataFrame:
    """Each folder's files added to all folders above it."""
    return counts.select(F.explode(ancestors("folder")).alias("folder"), "n").groupBy("folder").agg(F.sum("n").alias("n"))


def year_rollup(months: DataFrame) -> DataFrame:
    """Months (month, n) with their years; month is null in a year's row."""
    dated = months.filter("month IS NOT NULL").select(F.substring("month", 1, 4).alias("year"), "month", "n")
    return dated.rollup("year", "month").agg(F.sum("n").alias("n")).filter("year IS NOT NULL")


def format_totals(formats: DataFrame) -> DataFrame:
    """(group, n) -> totals by group, and of images, supported files and all files."""
    known = formats.groupBy("group").agg(F.sum("n").alias("n"))
    images = F.col("group").isin("jpeg", "raw", "other_images")
    sums = known.agg(F.sum(F.when(images, F.col("n"))).alias("images"), F.sum(F.when(images | (F.col("group") == "video"), F.col("n"))).alias("supported"), F.sum("n").alias("files"))
    return known.unionByName(sums.select(F.expr("stack(3, 'images', images, 'supported', supported, 'files', files) as (`group`, n)")).withColumn("n", F.coalesce("n", F.lit(0))))


def verdict_groups(rows: DataFrame) -> DataFrame:
    """Counts of all, pending, yes, no and uncertain."""
    return rows.rollup(F.coalesce("verdict", F.lit("pending")).alias("verdict")).agg(F.count("*").alias("n")).select(F.coalesce("verdict", F.lit("all")).alias("verdict"), "n")


def profile_counts(assets: DataFrame) -> DataFrame:
    year = F.coalesce(F.substring("captured_at", 1, 4), F.lit("unknown"))
    return assets.filter("present").groupBy(year.alias("year"), "extension").agg(F.count("*").alias("n"))


def stage_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("stage").agg(F.count_if(F.col("status") == "done").alias("done"))


def progress_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Done per stage, now less before."""
    b = stage_counts(before).withColumnRenamed("done", "was")
    both = stage_counts(after).join(b, "stage", "full_outer")
    return both.select("stage", (F.coalesce("done", F.lit(0)) - F.coalesce("was", F.lit(0))).alias("delta"))


def rolling_rate(commits: DataFrame, seconds: int = 60) -> DataFrame:
    """Commits of the last ``seconds`` at each second that has some, by source and stage."""
    per = commits.groupBy("source", "stage", F.unix_timestamp("ts").alias("at")).agg(F.count("*").alias("here"))
    last = Window.partitionBy("source", "stage").orderBy("at").rangeBetween(-(seconds - 1), 0)
    return per.select("source", "stage", "at", F.sum("here").over(last).alias("n"))


def transfer_rate(traffic: DataFrame, seconds: int = 10, block: int = 600) -> DataFrame:
    """Bytes a second over the last ``seconds`` at each event, at least a tenth of a second long.

    Bytes of one moment are summed first. The moments of a direction are cut into blocks of ``block``
    seconds, each with a copy of the last ``seconds`` of the one before, so that no direction is one
    task; events of one moment get its rate.
    """
    length = max(block, seconds)
    moments = traffic.groupBy("direction", "at").agg(F.sum("bytes").alias("bytes")).withColumn("own", F.floor(F.col("at") / length))
    spill = F.col("at") >= (F.col("own") + 1) * length - seconds
    copies = F.when(spill, F.array(F.col("own"), F.col("own") + 1)).otherwise(F.array("own"))
    blocks = moments.withColumn("block", F.explode(copies))
    last = Window.partitionBy("direction", "block").orderBy("at").rangeBetween(-seconds, 0)
    span = F.greatest(F.lit(0.1), F.least(F.lit(float(seconds)), F.col("at") - F.min("at").over(last)))
    rates = blocks.withColumn("rate", F.sum("bytes").over(last) / span).filter("block = own").select("direction", "at", "rate")
    return traffic.select("direction", "at", "event_id").join(rates, ["direction", "at"]).select("direction", "at", "event_id", "rate")
