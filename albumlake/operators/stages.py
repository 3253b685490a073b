"""Batch stages around a caller's function: models, extractors, verification."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import frame_id, sample_times
from .quality import cached_verdicts, combine_verdicts, valid_checks
from .vectors import valid_vector


def run_stage(units: DataFrame, load: Callable[[], Callable], output: str, model_version: str, value: str = "value") -> DataFrame:
    """(unit_id, file_version, model_version, result, error) of a caller's function over batches.

    ``load`` makes the function once per partition; it takes a Series and returns a list. If a batch
    fails, its rows are tried one by one, so that a bad row gets an error and stops nothing else.
    """
    wanted = f"unit_id {dict(units.dtypes)['unit_id']}, file_version long, model_version string, result {output}, error string"

    def run(batches):
        f = load()
        for pdf in batches:
            try:
                results, errors = list(f(pdf[value])), [None] * len(pdf)
                if len(results) != len(pdf):
                    raise ValueError("another number of results than rows")
            except Exception:
                results, errors = [], []
                for i in range(len(pdf)):
                    try:
                        results.append(list(f(pdf[value].iloc[i : i + 1]))[0])
                        errors.append(None)
                    except Exception as e:
                        results.append(None)
                        errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pd.DataFrame({"unit_id": pdf["unit_id"], "file_version": pdf["file_version"], "model_version": model_version, "result": pd.Series(results, index=pdf.index, dtype=object), "error": pd.Series(errors, index=pdf.index, dtype=object)})

    return units.select("unit_id", "file_version", value).mapInPandas(run, wanted)


def embedding_stage(units: DataFrame, load: Callable, dim: int, model_version: str) -> DataFrame:
    """``run_stage`` for vectors: invalid ones become errors."""
    out = run_stage(units, load, "array<double>", model_version)
    bad = F.col("error").isNull() & ~valid_vector("result", dim)
    return out.withColumn("error", F.when(bad, "invalid vector").otherwise(F.col("error"))).withColumn("result", F.when(F.col("error").isNull(), F.col("result")))


def extract_stage(files: DataFrame, load: Callable, model_version: str = "extract-1") -> DataFrame:
    """Tag maps from file contents by a caller's extractor, errors kept per file."""
    return run_stage(files, load, "map<string,string>", model_version, "content")


def verify_stage(pairs: DataFrame, cache: DataFrame, load: Callable) -> DataFrame:
    """Verdicts for all pairs: from the cache, else from a caller's function (a list of verdicts per
    pair), combined to one. A wrong number of checks is an error and gives no verdict."""
    known = cached_verdicts(pairs, cache)
    work = known.filter("verdict IS NULL").drop("verdict")
    out = f"{', '.join(f'{n} {t}' for n, t in work.dtypes)}, checks array<struct<condition:string,verdict:string>>"

    def run(batches):
        f = load()
        for pdf in batches:
            rows = []
            for conditions, asset in zip(pdf["conditions"], pdf["asset_id"]):
                try:
                    rows.append([{"condition": c, "verdict": v} for c, v in f(asset, list(conditions))])
                except Exception:
                    rows.append(None)
            yield pdf.assign(checks=rows)

    fresh = work.mapInPandas(run, out)
    fine = F.coalesce(valid_checks(), F.lit(False))
    done = fresh.withColumn("verdict", F.when(fine, combine_verdicts())).drop("checks")
    return known.filter("verdict IS NOT NULL").unionByName(done)


def explode_frames(videos: DataFrame, stages: list[str], step: int = 10_000) -> DataFrame:
    """One work row per sampled frame and stage of each video (id, version, duration_ms)."""
    frames = videos.select(F.col("id").alias("asset_id"), F.col("version").alias("file_version"), F.explode(sample_times("duration_ms", step)).alias("timestamp_ms"))
    return frames.select(frame_id("asset_id", "timestamp_ms").alias("unit_id"), "asset_id", "file_version", "timestamp_ms", F.explode(F.array(*map(F.lit, stages))).alias("stage"))


def storyboard(frames: DataFrame, n: int = 8) -> DataFrame:
    """Up to ``n`` frames of each asset, spread over its time: offsets i (total - 1) / (n - 1), rounded
    half to even, each frame once."""
    lie = Window.partitionBy("asset_id").orderBy("timestamp_ms", "unit_id")
    total = F.count("*").over(Window.partitionBy("asset_id"))
    placed = frames.withColumn("place", F.row_number().over(lie) - 1).withColumn("total", total)
    steps = F.least(F.lit(n - 1), F.greatest(F.lit(1), F.col("total") - 1))
    wanted = F.transform(F.sequence(F.lit(0), steps), lambda i: F.bround(i * (F.col("total") - 1) / steps).cast("long"))
    return placed.filter(F.array_contains(wanted, F.col("place").cast("long"))).drop("total")
