"""Tables that change: each state is a small JSON text that names its files, renamed into place.

A writer adds data files under new names and then publishes the state that names them. Readers see
the newest published state, whole; what a crashed writer left is in no state and is deleted with the
files that only old states name. One writer at a time: a second one that publishes the same number
fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class States:
    """The numbered states below ``folder``; ``data`` is the folder of their files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.data = spark, folder.rstrip("/"), folder.rstrip("/") + "/data"
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{below}" if below else self.folder)

    def names(self, below: str) -> list[str]:
        """Names of what lies in a folder, sorted; none if it isn't there."""
        p = self._path(below)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def numbers(self) -> list[int]:
        return [int(n[6:-5]) for n in self.names("states") if n.startswith("state-")]

    def read(self, number: int | None = None) -> tuple[int, dict]:
        """(number, state) of the newest state or the given one; (0, {}) before the first."""
        known = self.numbers()
        number = max(known, default=0) if number is None else number
        if not number:
            return 0, {}
        stream = self._fs.open(self._path(f"states/state-{number:012d}.json"))
        try:
            return number, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, number: int, state: dict) -> None:
        """Make ``state`` the state ``number``; an error if there is one already."""
        made, final = self._path(f"states/made-{uuid.uuid4().hex}"), self._path(f"states/state-{number:012d}.json")
        stream = self._fs.create(made, False)
        try:
            stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        finally:
            stream.close()
        if self._fs.exists(final) or not self._fs.rename(made, final):
            self._fs.delete(made, False)
            raise FileExistsError(f"state {number} of {self.folder} is there already")

    def retain(self, used: Callable[[dict], set[str]], keep: int = 2) -> None:
        """Delete all states but the newest ``keep``, and data that none of those uses. ``used`` gives
        the folders below ``data`` that a state names."""
        numbers = sorted(self.numbers())
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"states/state-{n:012d}.json"), False)
        wanted = set().union(*[used(self.read(n)[1]) for n in numbers[-keep:]])
        for top in self.names("data"):
            if top in wanted:
                continue
            inner = {w.split("/")[1] for w in wanted if w.startswith(top + "/")}
            for name in self.names(f"data/{top}") if inner else [""]:
                if name not in inner and (not inner or name.startswith("bucket=")):
                    self._fs.delete(self._path(f"data/{top}/{name}".rstrip("/")), True)


class KeyedTable:
    """A table of unique keys in buckets by the key's hash. A batch of changes reads and rewrites the
    buckets that its keys are in and no others, so what it writes follows the batch."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = 64, keep: int = 2):
        self.spark, self.states, self.schema, self.key, self.keep = spark, States(spark, folder), schema, key, keep
        self.buckets = self.states.read()[1].get("n", buckets)  # as many as it began with

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _read(self, state: dict, only: list[int] | None = None) -> DataFrame:
        held = state.get("buckets", {})
        paths = [f"{self.states.data}/{held[b]}/bucket={b}" for b in sorted(held) if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, number: int | None = None) -> DataFrame:
        """All rows of the newest state, or of one that is still kept."""
        return self._read(self.states.read(number)[1])

    def state(self) -> dict:
        return self.states.read()[1]

    def touched(self, changes: DataFrame) -> list[int]:
        """The buckets that the changes' keys are in: at most as many rows as there are buckets."""
        return [r[0] for r in changes.select(self.bucket()).distinct().collect()]

    def apply(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None, base: int | None = None) -> bool:
        """Publish the state after ``merge(known, changes)``, where ``known`` has the rows of the
        buckets touched. A batch that was applied before, or an older one, changes nothing: False.

        A table that is part of a larger one, whose state names a state of this one, is changed from
        that ``base`` on: what a crashed writer published here since is passed over, and the larger
        one calls ``retain`` when its own state is out.
        """
        number, state = self.states.read(base)
        number = max(self.states.numbers(), default=0)
        if batch is not None and batch <= state.get("batch", -1):
            return False
        touched, token = self.touched(changes), f"{number + 1:012d}-{uuid.uuid4().hex}"
        held = dict(state.get("buckets", {}))
        if touched:
            columns = T.StructType.fromDDL(self.schema).fieldNames()
            merged = merge(self._read(state, touched), changes).select(*columns).withColumn("bucket", self.bucket())
            merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.states.data}/{token}")
            written = {n[7:] for n in self.states.names(f"data/{token}") if n.startswith("bucket=")}
            held = {b: t for b, t in held.items() if int(b) not in touched} | {b: token for b in written}
        self.states.publish(number + 1, {"n": self.buckets, "batch": state.get("batch", -1) if batch is None else batch, "buckets": held})
        if base is None:
            self.retain(self.keep)
        return True

    def retain(self, keep: int) -> None:
        self.states.retain(lambda s: {f"{t}/bucket={b}" for b, t in s.get("buckets", {}).items()}, keep)


def newest(changes: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: that with the greatest ``order``."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_c")).select(key, *[F.col(f"_c.{c}").alias(c) for c in rest])


def change_feed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, action, before, after) between two states of a table: insert, update or delete, with the
    rows before and after as structs; rows that stayed as they were don't appear."""
    columns = [c for c in after.columns if c != key]
    old = before.select(key, F.struct(*columns).alias("before"))
    new = after.select(key, F.struct(*columns).alias("after"))
    both = old.join(new, key, "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    action = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return both.select(key, action.alias("action"), "before", "after")
