"""Functions for SQL text: ``register(spark)`` makes them known to a session."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf

from .scalars import VERSION_EXTENSIONS, VERSION_FOLDER


def exact_fold(words: pa.Array) -> pa.Array:
    """Full Unicode case folding, null as ''."""
    return pa.array([(w or "").casefold() for w in words.to_pylist()], pa.string())


#: Name and parameters, result, and what it is: expressions that are put in place of the call.
FUNCTIONS = {
    "fold(s STRING)": ("STRING", "coalesce(lower(s), '')"),
    "version_folder(s STRING)": ("STRING", f"coalesce(lower(regexp_replace(s, r'{VERSION_FOLDER}', '')), '')"),
    "version_name(s STRING)": ("STRING", f"regexp_replace(coalesce(lower(s), ''), r'{VERSION_EXTENSIONS}', '')"),
    "ancestor_folders(path STRING)": ("TABLE(depth INT, folder STRING)", "SELECT i, array_join(slice(split(path, '/'), 1, i), '/') FROM explode(sequence(1, size(split(path, '/')))) AS t(i)"),
    "frame_times(duration_ms BIGINT)": ("TABLE(timestamp_ms BIGINT)", "SELECT t FROM explode(sequence(0L, greatest(1L, coalesce(duration_ms, 0L)) - 1L, 10000L)) AS e(t)"),
}


def register(spark: SparkSession) -> None:
    """exact_fold, fold, version_folder, version_name; ancestor_folders and frame_times as tables."""
    spark.udf.register("exact_fold", arrow_udf(exact_fold, "string"))
    for name, (result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {result} RETURN {body}")
