"""The job keeper: its steps, and a stream in parts against a replay in one go."""

import random

from pyspark.sql import functions as F

from albumlake.streaming.jobs import Job, jobs_table, keep_jobs, reclaimed, step

SCHEMA = "job long, seq long, ts string, event string, version long"


def test_steps():
    j = step(Job(), "start", 0, 100, 50)
    assert j[:4] == ("running", 1, 0, 100) and step(j, "start", 0, 120, 50) == j
    assert step(j, "beat", 0, 140, 50).seen == 140
    assert step(j, "done", 0, 151, 50)[:2] == ("pending", 1)  # silent too long: the job was taken back
    assert step(step(j, "start", 0, 151, 50), "done", 0, 160, 50)[:2] == ("done", 2)
    failed = step(j, "error", 0, 110, 50)
    assert failed.status == "error" and step(failed, "start", 0, 111, 50) == failed
    assert step(failed, "retry", 0, 112, 50).status == "pending"
    assert step(failed, "bump", 3, 113, 50)[:4] == ("pending", 0, 3, 113) and step(Job(version=3), "bump", 3, 1, 50) == Job(version=3)


def test_stream_in_parts(spark, tmp_path):
    """Timers fire between the parts; parts applied again from another checkpoint change nothing."""
    r, rows, now = random.Random(4), [], 0
    for seq in range(600):
        now += r.randrange(1, 40)
        rows.append((r.randrange(12), seq, now, r.choice("start start beat done error retry bump".split()), seq // 100))
    rows.append((99, 600, now, "start", 0))
    rows.append((100, 601, now + 100_000, "start", 0))  # moves the watermark on: 99 falls silent
    text = lambda s: f"2024-01-{1 + s // 86400:02d} {s // 3600 % 24:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    frame = lambda part: spark.createDataFrame([(j, q, text(s), e, v) for j, q, s, e, v in part], SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
    schema = frame(rows[:1]).schema
    for part in (rows[:200], rows[200:450], rows[450:]):
        frame(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        keep_jobs(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 60_000, f"{tmp_path}/jobs", f"{tmp_path}/ck", late="1 second", buckets=4)
    want, first = {}, spark.range(1).select(F.unix_millis(F.lit(text(0)).cast("timestamp"))).first()[0]
    for j, _, s, e, v in rows:
        want[j] = step(want.get(j, Job()), e, v, first + s * 1000, 60_000)
    end = first + (now + 100_000 - 1) * 1000
    want = {j: reclaimed(s, end, 60_000)[:4] for j, s in want.items()}
    got = lambda: {r["job"]: tuple(r)[1:5] for r in jobs_table(spark, f"{tmp_path}/jobs").read().collect()}
    assert got() == want and want[99][0] == "pending" and want[100][0] == "running"
    keep_jobs(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 60_000, f"{tmp_path}/jobs", f"{tmp_path}/other", late="1 second", buckets=4)
    assert got() == want
