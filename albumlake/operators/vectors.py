"""Vectors: validity, exact and approximate neighbours, threshold matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    """Dot product in double precision."""
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def valid_vector(v, dim: int, low: float = 0.98, high: float = 1.02) -> Column:
    """Of exact length, all finite, with a norm strictly inside the bounds."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & (norm(v) > low) & (norm(v) < high), F.lit(False))


def normalized(v) -> Column:
    """The vector over its norm; null if it is not finite or its norm is below 1e-8."""
    size = norm(v)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (size >= 1e-8)
    return F.when(fine, F.transform(v, lambda x: x.cast("double") / size))


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow column, which must be of one length, as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    span = pc.min_max(pc.list_value_length(column)).as_py()
    if column.null_count or span["min"] != span["max"]:
        raise ValueError("vectors of different lengths")
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Dot products row by row, added in the order of ``dot``."""
    total = np.zeros(len(v))
    for d in range(v.shape[1]):
        total += v[:, d] * q[:, d]
    return total


_SCORES = 1 << 20  # scores that a task has at a time
_FOUND = 1 << 20  # rows that a task finds for its queries, about


def _nearest(k: int):
    """The k best units of a block for each of a block's queries; ties go to the smaller unit."""

    def run(asked: pa.Table, units: pa.Table) -> pa.Table:
        query, unit, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if asked.num_rows and units.num_rows:
            q, v = _matrix(asked.column("vector")), _matrix(units.column("vector"))
            order = np.asarray(pc.rank(units.column("unit_id"), tiebreaker="first")).astype(np.int64)
            most = min(k, len(v))
            step = max(1, _SCORES // len(v))
            for at in range(0, len(q), step):
                score = q[at : at + step] @ v.T
                least = np.partition(score, len(v) - most, axis=1)[:, len(v) - most] - 1e-9
                for i, row in enumerate(score):
                    near = np.flatnonzero(row >= least[i])
                    fine = _exact(v[near], np.broadcast_to(q[at + i], (len(near), q.shape[1])))
                    best = np.lexsort((order[near], -fine))[:k]
                    query.append(np.full(len(best), at + i))
                    unit.append(near[best])
                    scores.append(fine[best])
        asked, units = asked.select(["query_id"]).take(np.concatenate(query)), units.select(["unit_id", "asset_id"]).take(np.concatenate(unit))
        return pa.table([*asked.columns, *units.columns, pa.array(np.concatenate(scores))], names=["query_id", "unit_id", "asset_id", "score"])

    return run


def _dealt(units: DataFrame, queries: DataFrame, block: int, rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """The queries, the units and the columns in which every block of queries meets every block of units of the same cell.

    Rows with a cell are dealt by the hash of their ids to blocks of about ``block`` queries and
    ``rows`` units; each travels once for every block of the other side. The sizes of the cells, one
    row each, are broadcast: there are as many as an index has centres, or one.
    """
    units, queries = units.filter("vector is not null"), queries.filter("vector is not null")

    def counted(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    def dealt(df: DataFrame, id: str, own: str, others: str, i: str, j: str) -> DataFrame:
        numbered = df.join(F.broadcast(sizes), "cell").withColumn(i, F.pmod(F.xxhash64(id, F.lit(17)), F.col(own)).cast("int"))
        numbered = numbered.withColumn(j, F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        return numbered.select(*[F.col(c).alias(c) for c in (*df.columns, "_i", "_j")])  # new attributes: both sides may be one table

    sizes = counted(queries, block, "_q").join(counted(units, rows, "_u"), "cell")
    left, right = dealt(queries, "query_id", "_q", "_u", "_i", "_j"), dealt(units, "unit_id", "_u", "_q", "_j", "_i")
    return left, right, ["cell", "_i", "_j"]


def _meet(units: DataFrame, queries: DataFrame, run, out: tuple[str, ...], block: int, rows: int = 32768) -> DataFrame:
    """(query_id, columns ``out`` of the units, score) of ``run`` over every block of queries and every block of units of the same cell, on executors."""
    left, right, key = _dealt(units, queries, block, rows)
    kind = dict(units.dtypes) | dict(queries.dtypes)
    schema = ", ".join(f"{n} {kind[n]}" for n in ("query_id", *out)) + ", score double"
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(run, schema)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "unit_id", "asset_id", "score", "rank")


def knn(units: DataFrame, queries: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """(query_id, unit_id, asset_id, score, rank) of the k nearest units of each query, exactly.

    Filter ``units`` first: ranking then sees only what is allowed. Any number of queries: blocks
    of them meet blocks of units as matrices, and each pair of blocks keeps its k best of a query
    before the shuffle. A block has fewer queries where each gets many rows.
    """
    whole, block = F.lit(0).alias("cell"), block or max(1, min(8192, _FOUND // k))
    hits = _meet(units.select(whole, "unit_id", "asset_id", "vector"), queries.select(whole, "query_id", "vector"), _nearest(k), ("unit_id", "asset_id"), block)
    return _ranked(hits, k)


def similar(units: DataFrame, asset_id: int, k: int, unit_id: int | None = None) -> DataFrame:
    """Nearest units to an asset's earliest unit, or the given one; the asset itself is left out."""
    own = units.filter(F.col("asset_id") == asset_id)
    own = own.filter(F.col("unit_id") == unit_id) if unit_id is not None else own.orderBy("timestamp_ms", "unit_id").limit(1)
    return knn(units.filter(F.col("asset_id") != asset_id), own.select(F.col("unit_id").alias("query_id"), "vector"), k)


def face_match(faces: DataFrame, examples: DataFrame, threshold: float = 0.363, most: int = 512) -> DataFrame:
    """(person, face_id, asset_id, score): faces whose best similarity to any example of a person
    reaches the threshold. The best counts, never the mean, and nothing is cut off.

    Each person's examples travel as one array, so a face meets each person once.
    """
    if examples.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} examples: use match_many")
    people = examples.groupBy("person").agg(F.collect_list("vector").alias("known"))
    best = F.array_max(F.transform("known", lambda e: dot(F.col("vector"), e)))
    scored = faces.select("face_id", "asset_id", "vector").join(F.broadcast(people), how="cross").withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), best)))
    return scored.filter(F.col("score") >= threshold).select("person", "face_id", "asset_id", "score")


def _reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of a block's queries and units whose score reaches the query's ``least``, some queries at a time."""
    both = pa.Table.from_batches(batches)
    asked, units = both.filter(pc.is_valid(both.column("least"))), both.filter(pc.is_null(both.column("least")))
    if not asked.num_rows or not units.num_rows:
        return
    q, v, least = _matrix(asked.column("vector")), _matrix(units.column("vector")), asked.column("least").to_numpy()
    query, unit = asked.column("id").combine_chunks(), units.column("id").combine_chunks()
    step = max(1, _SCORES // len(v))
    for at in range(0, len(q), step):
        every = q[at : at + step] @ v.T
        i, j = np.nonzero(every >= least[at : at + step, None])
        if len(i):
            columns = [query.take(pa.array(at + i)), unit.take(pa.array(j)), pa.array(every[i, j])]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "unit_id", "score"])


def match_many(units: DataFrame, queries: DataFrame, threshold: float | Column, block: int = 16384) -> DataFrame:
    """(query_id, unit_id, score) of all pairs at or above the threshold, for many queries; it may be
    an expression over the queries' columns.

    Blocks of about ``block`` queries meet blocks of as many units as matrices on executors; nothing
    goes through the driver, and the plan doesn't grow with the queries. A vector travels once for
    each block of the other side, and a task holds the pairs of some of its queries at a time.
    """
    whole, least = F.lit(0).alias("cell"), threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    asked = queries.select(whole, "query_id", "vector", least.cast("double").alias("least")).filter("least is not null")
    left, right, key = _dealt(units.select(whole, "unit_id", "vector"), asked, block, block)
    sides = left.withColumnRenamed("query_id", "id").unionByName(right.withColumnRenamed("unit_id", "id").withColumn("least", F.lit(None).cast("double")))
    kind = dict(queries.dtypes)["query_id"], dict(units.dtypes)["unit_id"]
    return sides.select(*key, "id", "vector", "least").groupBy(key).applyInArrow(_reaching, f"query_id {kind[0]}, unit_id {kind[1]}, score double")


def best_per_asset(matches: DataFrame, key: str = "asset_id") -> DataFrame:
    """One row per asset: the highest score, ties to the smaller unit."""
    best = Window.partitionBy(key).orderBy(F.desc("score"), "unit_id")
    return matches.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def ann_recall(approximate: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Mean share of the exact k nearest that the approximate ones hold."""
    both = exact.select("query_id", "unit_id").join(approximate.select("query_id", "unit_id", F.lit(1).alias("hit")), ["query_id", "unit_id"], "left")
    per = both.groupBy("query_id").agg((F.count("hit") / k).alias("recall"))
    return per.agg(F.round(F.avg("recall"), 6).alias("recall"))
