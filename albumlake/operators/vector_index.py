"""A stored approximate index of vectors: cells of an inverted file, one byte a dimension, exact re-ranking.

Rows lie in Parquet partitioned by cell, with a quantised code and the vector in columns of their
own. A search ranks the codes of the cells that its queries ask for, reads the vectors of the best
few of them only, and ranks those exactly. Changes are parts of their own: new rows in the known
cells, and marks of units whose rows in earlier parts are dead. When the rows outgrow the index by a
quarter it is built anew from what it holds.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.states import States
from .vectors import _FOUND, _SCORES, _matrix, _ranked, dot, knn

GROWTH = 1.25  # rows over those at the last build, before the index is built anew
EXACT_AFTER = 1000  # ranks beyond this come from exact search


def _centres(x: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Unit vectors that stand for at most ``cells`` groups of directions."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for i in np.unique(own):
            m = x[own == i].mean(0)
            c[i] = m / max(np.linalg.norm(m), 1e-12)
    return c


def _coded(centres, scale, names: list[str]):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("vector"))
                cell = (x @ centres.value.T).argmax(1)
                code = np.clip(np.rint(x / scale * 127), -127, 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in code], pa.binary()), pa.array(cell, pa.int32())], names=[*names, "code", "cell"])

    return run


def _cells_of(centres, probes: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                near = np.argsort(-(_matrix(b.column("vector")) @ centres.value.T), axis=1, kind="stable")[:, :probes]
                lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32), pa.array(near.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "cells"])

    return run


def _best(query: np.ndarray, unit: np.ndarray, score: np.ndarray, order: np.ndarray, k: int):
    """The ``k`` best of each query; ties go to the unit that comes first in ``order``."""
    by = np.lexsort((order[unit], -score, query))
    query, unit, score = query[by], unit[by], score[by]
    first = np.searchsorted(query, query)  # where each one's query begins
    keep = np.arange(len(query)) - first < k
    return query[keep], unit[keep], score[keep]


def _by_codes(scale: np.ndarray, k: int):
    """The ``k`` best units of a shard for each query by their codes, among the cells that it asks for."""

    def run(asked: pa.Table, units: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        order, held = np.empty(0, np.int64), 0
        if asked.num_rows and units.num_rows:
            code = np.frombuffer(b"".join(units.column("code").to_pylist()), np.int8).reshape(units.num_rows, -1)
            q = (_matrix(asked.column("vector")) * (scale / 127)).astype(np.float32)
            order, cell = np.asarray(pc.rank(units.column("unit_id"), tiebreaker="first")).astype(np.int64), units.column("cell").to_numpy()
            lists = asked.column("cells").combine_chunks()
            wanted, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), pc.list_value_length(lists).to_numpy())
            for c in np.unique(cell):
                own, asking = np.flatnonzero(cell == c), of[wanted == c]
                rows, most = code[own].astype(np.float32), min(k, len(own))
                step = max(1, _SCORES // len(own))
                for at in range(0, len(asking), step):
                    score = q[asking[at : at + step]] @ rows.T
                    least = np.partition(score, len(own) - most, axis=1)[:, len(own) - most]
                    i, j = np.nonzero(score >= least[:, None])
                    found.append((asking[at + i], own[j], score[i, j].astype(np.float64)))
                    held += len(i)
                    if held > 2 * _FOUND:  # what earlier cells gave is cut down by its size
                        found = [_best(*map(np.concatenate, zip(*found)), order, k)]
                        held = len(found[0][0])
        query, unit, score = _best(*map(np.concatenate, zip(*found)), order, k)
        return pa.table([asked.column("query_id").take(pa.array(query)), units.column("unit_id").take(pa.array(unit)), pa.array(score)], names=["query_id", "unit_id", "score"])

    return run


class VectorIndex:
    """An index in ``folder``. Units have unit_id, asset_id, a vector of norm 1 and any columns to
    filter by; a null vector isn't indexed. Readers see the newest published state."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.states = spark, States(spark, folder)

    # ---- writing ----
    def build(self, units: DataFrame, cells: int | None = None, target: float = 0.95, k: int = 20, sample: int = 20_000, trial: int = 64, rounds: int = 6, seed: int = 3, most_cells: int = 4096) -> None:
        """Write a new index of all units.

        Centres and scales are fitted on at most ``sample`` units, those with the smallest hashes;
        every unit is indexed. Of those, ``trial`` are asked for exactly: the index probes by default
        as many cells as hold ``target`` of their ``k`` nearest.
        """
        units = units.filter("vector is not null")
        picked = units.select("vector").orderBy(F.xxhash64("unit_id"), "unit_id").limit(sample).toArrow()
        n, token = units.count(), uuid.uuid4().hex
        number, _ = self.states.read()
        if not n:
            self.states.publish(number + 1, {"parts": [], "dead": [], "built": 0, "rows": 0})
            return
        x = _matrix(picked.column("vector"))
        centres = _centres(x, min(cells or max(1, round(n**0.5)), most_cells), rounds, seed)
        scale = np.maximum(np.abs(x).max(0), 1e-12)
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{self.states.data}/{token}-centres")
        state = {"parts": [self._write(units, token, centres, scale, n)], "dead": [], "built": n, "rows": n, "centres": f"{token}-centres", "scale": scale.tolist(), "columns": units.columns, "probes": len(centres)}
        state["probes"] = self._probes(state, centres, target, k, trial)
        self._publish(number + 1, state)

    def _write(self, units: DataFrame, token: str, centres: np.ndarray, scale: np.ndarray, n: int, rows: int = 65536) -> dict:
        known = self.spark.sparkContext.broadcast(centres)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema) + ", code binary, cell int"
        coded = units.mapInArrow(_coded(known, scale, units.columns), schema)
        parts = max(1, -(-n // rows), min(len(centres), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        coded.repartitionByRange(parts, "cell", F.xxhash64("unit_id")).write.partitionBy("cell").parquet(f"{self.states.data}/{token}")
        return {"token": token, "cells": sorted(int(c[5:]) for c in self.states.names(f"data/{token}") if c.startswith("cell="))}

    def _publish(self, number: int, state: dict) -> None:
        self.states.publish(number, state)
        self.states.retain(lambda s: {p["token"] for p in s["parts"]} | {*s["dead"], s.get("centres", "")})

    def _probes(self, state: dict, centres: np.ndarray, target: float, k: int, trial: int) -> int:
        rows = self._rows(state, None)
        asked = rows.orderBy(F.xxhash64("unit_id", F.lit(7)), "unit_id").limit(trial).select(F.col("unit_id").alias("query_id"), "vector")
        found = knn(rows.select("unit_id", F.col("cell").alias("asset_id"), "vector"), asked, k)
        both = found.select("query_id", F.col("asset_id").alias("cell")).join(asked, "query_id").toArrow()  # trial * k rows
        if not both.num_rows:
            return len(centres)
        rank = (-(_matrix(both.column("vector")) @ centres.T)).argsort(1, kind="stable").argsort(1, kind="stable")
        depth = np.sort(rank[np.arange(len(rank)), both.column("cell").to_numpy()])
        return int(depth[min(len(depth) - 1, int(np.ceil(target * len(depth))) - 1)]) + 1

    def apply(self, upserts: DataFrame, deletes: DataFrame | None = None) -> None:
        """Add or replace units, and remove those whose ids ``deletes`` has."""
        number, state = self.states.read()
        upserts = upserts.filter("vector is not null")
        if not state.get("built"):
            self.build(upserts)
            return
        gone = upserts.select("unit_id") if deletes is None else upserts.select("unit_id").union(deletes.select("unit_id")).distinct()
        n, token = upserts.count(), uuid.uuid4().hex
        state = dict(state)
        gone.withColumn("_before", F.lit(len(state["parts"]))).write.parquet(f"{self.states.data}/{token}-dead")
        state["dead"] = [*state["dead"], f"{token}-dead"]
        if n:
            state["parts"] = [*state["parts"], self._write(upserts.select(*state["columns"]), token, self._known(state), np.array(state["scale"]), n)]
        state["rows"] += n
        self._publish(number + 1, state)
        if state["rows"] > GROWTH * state["built"]:
            self.build(self._rows(state, None).select(*state["columns"]))

    # ---- reading ----
    def state(self) -> dict:
        return self.states.read()[1]

    def _known(self, state: dict) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.states.data}/{state['centres']}").orderBy("cell").collect()  # at most most_cells
        return np.array([r["centre"] for r in rows])

    def _rows(self, state: dict, cells: set[int] | None, where: Column | None = None) -> DataFrame:
        """The living rows of some cells: their files only, with ``where`` pushed to the scan."""
        out = None
        for i, part in enumerate(state["parts"]):
            paths = [f"{self.states.data}/{part['token']}/cell={c}" for c in part["cells"] if cells is None or c in cells]
            if paths:
                one = self.spark.read.option("basePath", f"{self.states.data}/{part['token']}").parquet(*paths)
                one = (one if where is None else one.filter(where)).withColumn("_part", F.lit(i))
                out = one if out is None else out.unionByName(one)
        if out is None:
            columns = "unit_id long, asset_id long, vector array<float>, code binary, cell int, _part int"
            return self.spark.createDataFrame([], columns)
        if state["dead"]:
            dead = self.spark.read.parquet(*[f"{self.states.data}/{d}" for d in state["dead"]]).groupBy("unit_id").agg(F.max("_before").alias("_before"))
            out = out.join(dead, "unit_id", "left").filter(F.col("_before").isNull() | (F.col("_part") >= F.col("_before"))).drop("_before")
        return out

    def rows(self, where: Column | None = None) -> DataFrame:
        """All living units with their columns."""
        state = self.state()
        return self._rows(state, None, where).drop("code", "cell", "_part")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, refine: int = 3, where: Column | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, unit_id, asset_id, score, rank): about the k nearest units of each query.

        Rows are cut down by ``where`` (over the units' columns) and ``allowed`` (asset_id) before
        ranking. Of the asked cells' codes the ``refine`` * k best are ranked by their vectors; only
        files of cells that some query asks for are read.
        """
        state = self.state()
        queries = queries.filter("vector is not null").select("query_id", "vector")
        if not state.get("built"):
            return knn(self._rows({"parts": [], "dead": []}, None), queries, k)
        known = self.spark.sparkContext.broadcast(self._known(state))
        schema = ", ".join(f"{n} {t}" for n, t in queries.dtypes) + ", cells array<int>"
        asked = queries.mapInArrow(_cells_of(known, min(probes or state["probes"], len(known.value))), schema).select(F.explode("cells").alias("cell"), "query_id", "vector")
        cells = {r[0] for r in asked.select("cell").distinct().collect()}  # at most as many as the index has
        rows = self._rows(state, cells, where)
        if allowed is not None:
            rows = rows.join(allowed.select("asset_id").distinct(), "asset_id", "left_semi")
        near = self._near(rows.select("cell", "unit_id", "code"), asked, np.array(state["scale"]), refine * k)
        few = _ranked(near.withColumn("asset_id", F.lit(0)), refine * k).select("query_id", "unit_id")
        exact = few.join(rows.select("unit_id", "asset_id", "vector"), "unit_id").join(queries.select("query_id", F.col("vector").alias("_q")), "query_id")
        return _ranked(exact.select("query_id", "unit_id", "asset_id", dot("vector", "_q").alias("score")), k)

    def _near(self, units: DataFrame, asked: DataFrame, scale: np.ndarray, k: int, rows: int = 1 << 17) -> DataFrame:
        """(query_id, unit_id, score): the ``k`` best units of each query by code in every shard. A shard
        has whole cells, or a part of a cell of more than ``rows`` units, and meets blocks of queries."""
        counts = {r["cell"]: r["count"] for r in units.groupBy("cell").count().collect()}  # a row for each cell
        tasks, n = int(self.spark.conf.get("spark.sql.shuffle.partitions")), asked.select("query_id").distinct().count()
        parts = [(c, -(-m // rows), i) for c, m in counts.items() for i in range(-(-m // rows))]
        sizes = np.zeros(max(1, -(-sum(counts.values()) // rows), min(tasks, len(parts))), np.int64)
        held = []
        for c, several, i in sorted(parts, key=lambda p: -counts[p[0]] / p[1]):
            shard = int(sizes.argmin())
            sizes[shard] += counts[c] // several
            held.append((c, several, i, shard))
        held = F.broadcast(self.spark.createDataFrame(held, "cell int, parts int, part int, shard int"))  # as many rows as cells, and parts of large ones
        blocks = max(1, -(-n // max(1, min(8192, _FOUND // k))))
        here = units.join(held, "cell").filter(F.pmod(F.xxhash64("unit_id", F.lit(17)), F.col("parts")) == F.col("part"))
        here = here.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "unit_id", "code", "cell")
        there = asked.join(held, "cell").groupBy("shard", "query_id").agg(F.collect_set("cell").alias("cells"), F.first("vector").alias("vector"))
        there = there.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(17)), F.lit(blocks)).cast("int"))
        there = there.select(*[F.col(c).alias(c) for c in there.columns])
        kind = dict(units.dtypes) | dict(asked.dtypes)
        schema = f"query_id {kind['query_id']}, unit_id {kind['unit_id']}, score double"
        return there.groupBy("shard", "block").cogroup(here.groupBy("shard", "block")).applyInArrow(_by_codes(scale, k), schema)

    def page(self, queries: DataFrame, offset: int = 0, limit: int = 200, **more) -> DataFrame:
        """Ranks offset + 1 to offset + limit: of the index, or of exact search where the page ends
        beyond rank ``EXACT_AFTER``."""
        if offset + limit <= EXACT_AFTER:
            found = self.search(queries, offset + limit, **more)
        else:
            rows, allowed = self.rows(more.get("where")), more.get("allowed")
            rows = rows if allowed is None else rows.join(allowed.select("asset_id").distinct(), "asset_id", "left_semi")
            found = knn(rows, queries, offset + limit)
        return found.filter(F.col("rank") > offset)
