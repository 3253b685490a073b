"""Structured Streaming: ingest, index sync, live counts and bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reconcile import reconcile
from ..sources.states import KeyedTable, newest
from ..sources.tables import apply_changes


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _snapshot(spark: SparkSession, folder: str, schema, before: int) -> DataFrame:
    """The newest snapshot of a batch before ``before``, or an empty table."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(fs_path)] if fs.exists(fs_path) else []
    done = [int(n[6:]) for n in names if n.startswith("batch-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    older = [b for b in done if b < before]
    return spark.read.schema(schema).parquet(f"{folder}/batch-{max(older)}") if older else spark.createDataFrame([], schema)


def latest(spark: SparkSession, folder: str, schema) -> DataFrame:
    return _snapshot(spark, folder, schema, 1 << 62)


CATALOG = "path string, size long, mtime long, version long, present boolean"


def catalog_table(spark: SparkSession, folder: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, folder, CATALOG, "path", buckets)


def ingest_stream(listings: DataFrame, folder: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Listings (path, size, mtime) become versioned catalogue rows, batch by batch.

    Each batch rewrites the buckets that its paths are in and publishes them; a replayed batch
    changes nothing, and files that didn't change keep their version.
    """

    def merge(known: DataFrame, seen: DataFrame) -> DataFrame:
        return reconcile(known, newest(seen, "path", "mtime"), complete=False)

    def apply(batch: DataFrame, batch_id: int) -> None:
        catalog_table(batch.sparkSession, folder, buckets).apply(batch, merge, batch_id)

    return listings.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


INDEX = "unit_id long, revision long, payload string, deleted boolean"


def index_table(spark: SparkSession, folder: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, folder, INDEX, "unit_id", buckets)


def index_sync_stream(outbox: DataFrame, folder: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Changes (unit_id, revision, action, payload) applied to an index, at least once each but with
    the effect of once: a batch's newest revision per unit wins, and never over a newer one. Deleted
    units stay as marks, so that an older change that comes late doesn't bring them back. A batch
    rewrites the buckets that its units are in."""

    def merge(known: DataFrame, changes: DataFrame) -> DataFrame:
        last = newest(changes, "unit_id", "revision")
        newer = last.join(known.select("unit_id", F.col("revision").alias("have")), "unit_id", "left").filter(F.col("have").isNull() | (F.col("revision") > F.col("have"))).drop("have")
        rows = newer.select("unit_id", "revision", F.when(F.col("action") == "upsert", F.col("payload")).alias("payload"), (F.col("action") == "delete").alias("deleted"))
        return apply_changes(known, rows, rows.limit(0))

    def apply(batch: DataFrame, batch_id: int) -> None:
        index_table(batch.sparkSession, folder, buckets).apply(batch, merge, batch_id)

    return outbox.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_stale_results(results: DataFrame, assets: DataFrame, done: DataFrame) -> DataFrame:
    """Results (batch or stream) with a receipt: discarded where the file version is outdated or the
    stage is done already, saved otherwise."""
    now = assets.filter("present").select(F.col("id").alias("asset_id"), F.col("version").alias("file_version"), F.lit(True).alias("_now"))
    had = done.select("asset_id", "file_version", "stage", F.lit(True).alias("_had")).distinct()
    both = results.join(now, ["asset_id", "file_version"], "left").join(had, ["asset_id", "file_version", "stage"], "left")
    return both.withColumn("receipt", F.when(F.col("_now") & F.col("_had").isNull(), "saved").otherwise("discarded")).drop("_now", "_had")


def first_ends(commits: DataFrame, late: str = "1 hour") -> DataFrame:
    """First end of each (job, stage). On a stream, repeats are remembered for ``late``."""
    ends = commits.filter(F.col("status").isin("done", "error"))
    return ends.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job", "stage"]) if commits.isStreaming else ends.dropDuplicates(["job", "stage"])


def commit_counts(commits: DataFrame, late: str = "1 hour") -> DataFrame:
    """First end of each (job, stage) counts once, by source, stage and status."""
    return first_ends(commits, late).groupBy("source", "stage", "status").agg(F.count("*").alias("n"))


def live_rate(commits: DataFrame, length: str = "60 seconds", step: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """Commits in sliding windows by source and stage; rows later than ``late`` are not counted."""
    return commits.withWatermark("ts", late).groupBy(F.window("ts", length, step), "source", "stage").agg(F.count("*").alias("n")).select(F.col("window.end").alias("at"), "source", "stage", "n")


def live_transfer(traffic: DataFrame, seconds: int = 10, late: str = "1 minute") -> DataFrame:
    w = F.window("ts", f"{seconds} seconds", "1 second")
    return traffic.withWatermark("ts", late).groupBy(w, "direction").agg((F.sum("bytes") / seconds).alias("rate")).select(F.col("window.end").alias("at"), "direction", "rate")


def job_state(events: DataFrame) -> DataFrame:
    """Present state of each job from its events (job, seq, event, version): a new version, a retry or
    a recovery makes it pending again."""
    status = F.when(F.col("event").isin("retry", "recover", "bump", "create"), "pending").when(F.col("event") == "start", "running").otherwise(F.col("event"))
    return events.groupBy("job").agg(F.max_by(status, "seq").alias("status"), F.max("version").alias("version"))


def burst_stream(media: DataFrame, seconds: int = 2, late: str = "10 minutes") -> DataFrame:
    """Bursts of a live feed as session windows by folder and camera. Windows that only touch are
    merged, so a gap of exactly ``seconds`` still joins."""
    gap = f"{seconds} seconds" if seconds else "1 microsecond"
    feed = media.withWatermark("ts", late) if media.isStreaming else media
    return feed.groupBy(F.session_window("ts", gap), "folder", "camera").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).select("folder", "camera", F.col("session_window.start").alias("start"), "n", "first_id")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drive a stream over what is there and write its rows."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_totals(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drive a streaming aggregate over what is there; its groups as they stand at the end. Every
    batch writes all groups to a folder of its own, so a replayed batch writes the same again."""
    spark, schema = stream.sparkSession, stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")

    stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return latest(spark, path, schema)
