"""Tables that one job writes for its own later steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}  # application -> its folder, where the session names none
_LEFT: dict[str, SparkSession] = {}  # folders to delete when this program ends


def shared_dir(spark: SparkSession, name: str = "tables") -> str:
    """A new folder below ``spark.checkpoint.dir``, which the driver and all executors share.

    Where that is unset, a local session (a single machine, as in tests) gets a temporary folder and
    any other is refused. What is left in the folder is deleted when the program ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
            _LEFT[_LOCAL[app]] = spark
        base = _LOCAL[app]
    path = f"{base.rstrip('/')}/albumlake-{name}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _LEFT.pop(path, None)


@atexit.register
def _tidy() -> None:
    for path, spark in list(_LEFT.items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone, and its store with it
            return


class Scratch:
    """The tables of one job. ``keep`` writes a table and reads it back, which cuts its lineage and
    survives lost executors; ``clear`` deletes those that no later plan reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = shared_dir(self.spark)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def clear(self, *but: DataFrame) -> None:
        for path, df in list(self.paths.items()):
            if not any(df is x for x in but):
                delete(self.spark, path)
                del self.paths[path]


def materialize(df: DataFrame) -> DataFrame:
    """One table written and read back, as by ``Scratch.keep``; it stays until the program ends."""
    return Scratch(df.sparkSession).keep(df)
