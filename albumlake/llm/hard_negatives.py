"""Hard negatives by an inverted multi-index.

Vectors become integers and scores their inner products. Two codebooks, one for each half of the
dimensions, are fitted on a bounded sample; every row is coded by its nearest word in both, and a
cell holds the rows of one pair of words. Rows are dealt to shards, anchors to blocks, and each block
meets each shard in one task. There an anchor visits cells best first: the score of its half with a
word, plus the half's length times the word's radius, bounds the half-scores of all rows of that
word, and a heap walks the two sorted lists of words in the order of the sums of their bounds (the
multi-sequence algorithm). It stops as soon as what is left can't change the result: the k-th best
score found is above the bound of all other cells, or the bound is below the window. So each shard
gives its exact first rows, and the first of all shards are the first of all.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, runs

LAST = np.iinfo(np.int64).max  # stands for a null id, which comes last


def matrix(column) -> np.ndarray:
    """The integer vectors of an Arrow column, which must be of one length, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    span = pc.min_max(pc.list_value_length(column)).as_py()
    if span["min"] != span["max"]:
        raise ValueError("vectors of different lengths have no inner product")
    return column.flatten().to_numpy().reshape(len(column), -1)


def exact(*matrices: np.ndarray) -> list[np.ndarray]:
    """The matrices in a type in which inner products of their rows are exact."""
    most = float(matrices[0].shape[1])
    for m in matrices:
        most *= float(np.abs(m.astype(np.float64)).max(initial=0))
    if most >= 2.0**63:
        raise ValueError("inner products exceed 64 bits")
    return [m.astype(np.float64 if most < 2.0**53 else np.int64) for m in matrices]


def codebook(x: np.ndarray, words: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of at most ``words`` clusters of the rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:words]].astype(np.float64)
    for _ in range(rounds):
        own = nearest(x, centres)
        for c in np.unique(own):
            centres[c] = x[own == c].mean(0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[..., : x.shape[-1] // 2], x[..., x.shape[-1] // 2 :]


class Cells:
    """The rows of one shard by cells; ``order`` has the given row of each row here."""

    def __init__(self, x: np.ndarray, codes: tuple[np.ndarray, np.ndarray], books: tuple[np.ndarray, np.ndarray]):
        self.books, n = books, len(books[1])
        key = codes[0].astype(np.int64) * n + codes[1]
        self.order = np.argsort(key, kind="stable")
        start = runs(key[self.order])
        self.at = {int(key[self.order[s]]): (int(s), int(e)) for s, e in zip(start, [*start[1:], len(key)])}
        self.n, self.words, self.radii = n, [], []
        for half, code, book in zip(halves(x), codes, books):
            away = np.sqrt(((half - book[code]) ** 2).sum(1))
            radius = np.zeros(len(book))
            np.maximum.at(radius, code, away)
            self.words.append(np.unique(code))
            self.radii.append(radius)

    def visit(self, q: np.ndarray, least: int = 256):
        """(rows, bound): cells best first, some together if small; no row that comes later has a score above ``bound``."""
        lists = []
        for half, book, word, radius in zip(halves(q), self.books, self.words, self.radii):
            bound = book[word] @ half + np.sqrt((half.astype(np.float64) ** 2).sum()) * radius[word]
            bound += 1e-9 * (np.abs(bound) + np.abs(book[word] @ half)) + 1e-3  # for what sums of floats lose
            best = np.argsort(-bound)
            lists.append((bound[best], word[best].tolist()))
        (a, first), (b, second) = lists
        heap, some, many = [(-(a[0] + b[0]), 0, 0)], [], 0
        while heap:
            _, i, j = heapq.heappop(heap)
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
            s, e = self.at.get(first[i] * self.n + second[j], (0, 0))
            if e > s:
                some.append(np.arange(s, e))
                many += e - s
            if many >= least or some and not heap:
                yield np.concatenate(some), -heap[0][0] if heap else -np.inf
                some, many = [], 0


class Best:
    """The first ``k`` of what is offered: by score, falling, then id, then row."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.row = k, *(np.empty(0, np.int64),) * 3

    @property
    def least(self) -> float:
        return self.score[-1] if len(self.score) == self.k else -np.inf

    def offer(self, score: np.ndarray, id: np.ndarray, row: np.ndarray) -> None:
        if len(score) and score.max() >= self.least:
            every = [np.concatenate(c) for c in ((self.score, score), (self.id, id), (self.row, row))]
            first = np.lexsort((every[2], every[1], -every[0]))[: self.k]
            self.score, self.id, self.row = (c[first] for c in every)


def _shard(units: pa.Table, asked: pa.Table, books):
    """Cells, vectors, ids, rows and labels of the units by cell, and the vectors of the anchors."""
    x, q = exact(matrix(units.column("vector")), matrix(asked.column("vector")))
    cells = Cells(x, (units.column("c1").to_numpy(), units.column("c2").to_numpy()), books)
    id, row, label = (units.column(c).fill_null(LAST).to_numpy()[cells.order] for c in ("vec_id", "row", "label"))
    return cells, x[cells.order], id, row, label, q


def _positives(books, k: int):
    """(anchor, row, vec_id, score): the first ``k`` other units of each anchor's label."""

    def run(asked: pa.Table, units: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64),) * 4]
        if asked.num_rows and units.num_rows:
            cells, x, id, row, label, q = _shard(units, asked, books)
            for v, own, anchor in zip(q, asked.column("label").to_numpy(), asked.column("row").to_numpy()):
                best = Best(k)
                for at, bound in cells.visit(v):
                    at = at[(label[at] == own) & (row[at] != anchor)]
                    best.offer((x[at] @ v).astype(np.int64), id[at], row[at])
                    if bound < best.least:
                        break
                out.append((np.full(len(best.row), anchor), best.row, best.id, best.score))
        return _table(out, ["anchor", "row", "vec_id", "score"])

    return run


def _negatives(books, k: int, percent: int):
    """(anchor, score, row, vec_id, negative): for each anchor and score of a positive, the first ``k`` units of other labels within the window."""

    def run(asked: pa.Table, units: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64),) * 5]
        if asked.num_rows and units.num_rows:
            cells, x, id, row, label, q = _shard(units, asked, books)
            for v, own, anchor, scores in zip(q, asked.column("label").to_numpy(), asked.column("row").to_numpy(), asked.column("scores").to_pylist()):
                windows = [(-(-percent * s // 100), s, Best(k)) for s in scores if s >= 0]  # below zero the window is empty
                todo = windows
                for at, bound in cells.visit(v) if windows else ():
                    at = at[label[at] != own]
                    score = (x[at] @ v).astype(np.int64)
                    for low, high, best in todo:
                        fits = np.flatnonzero((score >= low) & (score <= high))
                        best.offer(score[fits], id[at[fits]], row[at[fits]])
                    todo = [w for w in todo if bound >= max(w[0], w[2].least)]
                    if not todo:
                        break
                out += [(np.full(len(b.row), anchor), np.full(len(b.row), s), b.row, b.id, b.score) for _, s, b in windows]
        return _table(out, ["anchor", "score", "row", "vec_id", "negative"])

    return run


def _table(parts: list[tuple], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts)]
    return pa.table([pa.array(c, mask=c == LAST) if n == "vec_id" else pa.array(c) for n, c in zip(names, columns)], names=names)


def _coded(books, names: list[str]):
    def run(batches):
        for b in batches:
            if b.num_rows:
                codes = [pa.array(nearest(half, book), pa.int32()) for half, book in zip(halves(matrix(b.column("vector")).astype(np.float64)), books)]
                yield pa.RecordBatch.from_arrays([*b.columns, *codes], names=[*names, "c1", "c2"])

    return run


def hard_negatives(
    df: DataFrame, anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, k_positive: int = 5, k_negative: int = 5, percent: int = 80,
    words: int = 16, sample: int = 4096, shard: int = 32768, block: int = 4096,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its positives.

    Each component x becomes floor(scale * x); a score is the inner product of two such vectors, as
    an exact long (larger ones are refused). Rows with a null label (``label``, by default the column
    of that name), a null vector, or a null or non-finite component take no part; the rest must have
    vectors of one length. Anchors are the rows that meet ``anchor``. Positives: the first
    ``k_positive`` other rows of the anchor's label by score, ties by smaller id (null last, then
    any fixed order of equal ids). Negatives: of the rows with other labels and percent *
    positive_score <= 100 * score <= 100 * positive_score the first ``k_negative``, ranked from 1.
    Repeated rows and ids are rows of their own, extra columns are ignored, an empty table or one
    without anchors gives an empty result.

    The codebooks of ``words`` words each are fitted on at most ``sample`` rows, those with the
    smallest hashes; all rows are indexed and radii are those of all rows, so results are exact
    whatever the sample. A task holds ``shard`` rows and ``block`` anchors.
    """
    spark = df.sparkSession
    out, work = Scratch(spark), Scratch(spark)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = df.select(F.col(id_col).cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    whole = given.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & fine).withColumn("vector", F.transform("v", lambda x: F.floor(x * scale))).drop("v")
    rows = work.keep(whole.withColumn("row", F.monotonically_increasing_id()))

    picked = rows.select("vector").orderBy(F.xxhash64("row"), "row").limit(sample).toArrow()
    x = matrix(picked.column("vector")) if picked.num_rows else np.zeros((1, 2), np.int64)
    books = tuple(codebook(half, words) for half in halves(x.astype(np.float64)))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", c1 int, c2 int"
    coded = out.keep(rows.mapInArrow(_coded(books, rows.columns), schema))
    work.clear()

    n, asking = (coded.count(), coded.filter("asks").count())
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-n // shard), min(tasks, -(-n // 2048)), 1)
    blocks = max(1, -(-asking // block))
    own = lambda parts: F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    units = coded.select("row", "vec_id", "label", "vector", "c1", "c2", own(shards).alias("shard"), each(blocks).alias("block"))
    anchors = coded.filter("asks").select("row", "vec_id", "label", "vector")

    def met(asked: DataFrame, run, schema: str) -> DataFrame:
        asked = asked.withColumns({"block": own(blocks), "shard": each(shards)})
        asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # new attributes: both sides come from one table
        return asked.groupBy("shard", "block").cogroup(units.groupBy("shard", "block")).applyInArrow(run, schema)

    order = lambda score: [F.desc(score), F.col("vec_id").asc_nulls_last(), F.col("row")]

    first = met(anchors, _positives(books, k_positive), "anchor long, row long, vec_id long, score long")
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("anchor").orderBy(*order("score")))).filter(F.col("r") <= k_positive)
    first = out.keep(first.select("anchor", F.col("row").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = first.groupBy(F.col("anchor").alias("row")).agg(F.collect_set("positive_score").alias("scores"))
    found = met(anchors.join(scores, "row"), _negatives(books, k_negative, percent), "anchor long, score long, row long, vec_id long, negative long")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "score").orderBy(*order("negative")))).filter(F.col("rank") <= k_negative)
    pairs = first.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    same = (F.col("p.anchor") == F.col("f.anchor")) & (F.col("p.positive_score") == F.col("f.score"))
    return pairs.alias("p").join(found.alias("f"), same).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("negative").alias("negative_score"))
