"""What a task holds, asks or repeats doesn't grow with the table."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from compare import DATA
from pyspark.sql import functions as F

from albumlake.functions import scalars as S
from albumlake.llm import packing
from albumlake.operators import text_index, vector_index, vectors
from albumlake.plans import queries_search
from albumlake.streaming.jobs import Job, JobKeeper


def test_iso6709_extracts_each_part_once(spark):
    df = spark.createDataFrame([("+55.7558+037.6173+151.0/",), ("-90-180/",), ("+91+000/",), ("+10+181/",), ("+1 0+2/",), (None,)], "s string")
    p = df.select(S.parse_iso6709("s").alias("p"))
    assert [r["p"] and tuple(r["p"]) for r in p.collect()] == [(55.7558, 37.6173, 151.0), (-90.0, -180.0, None), None, None, None, None]
    assert p._jdf.queryExecution().analyzed().toString().lower().count("regexp_extract") == 3


def test_pairs_come_in_pieces():
    """Two blocks of copies of one vector: their pairs are never all in memory."""
    n = 3000
    block = lambda least: pa.record_batch([pa.array(range(n)), pa.array([[1.0, 0.0]] * n), pa.array([least] * n, pa.float64())], names=["id", "vector", "least"])
    rows = [b.num_rows for b in vectors._reaching(iter([block(0.5), block(None)]))]
    assert sum(rows) == n * n and max(rows) <= vectors._SCORES


def test_recall_of_exact_writes_few_pairs(spark, monkeypatch):
    made, match = [], vectors.match_many
    monkeypatch.setattr(vectors, "match_many", lambda *a, **b: made.append(match(*a, **b)) or made[-1])
    assert queries_search.vector_recall_of_exact(spark, DATA).first()["recall"] == 1.0
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").filter("vec_id % 50 = 0").count()
    assert 20 * n <= made[0].count() <= 30 * n


def test_codes_of_many_cells_in_bounded_memory():
    rng, cells, own, n, k = np.random.default_rng(1), 64, 100, 2000, 100
    code = rng.integers(-127, 128, (cells * own, 4)).astype(np.int8)
    units = pa.table({"unit_id": pa.array(range(cells * own)), "code": pa.array([c.tobytes() for c in code], pa.binary()), "cell": pa.array(np.repeat(np.arange(cells), own), pa.int32())})
    q = rng.normal(size=(n, 4))
    asked = pa.table({"query_id": pa.array(range(n)), "vector": pa.array(q.tolist()), "cells": pa.array([list(range(cells))] * n, pa.list_(pa.int32()))})
    tracemalloc.start()
    got = vector_index._by_codes(np.full(4, 127.0), k)(asked, units)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == n * k and peak < 400e6
    scores = q[:3].astype(np.float32) @ code.T.astype(np.float32)
    best = got.to_pandas().groupby("query_id")["unit_id"].apply(set)
    for i in range(3):
        assert set(np.argsort(-scores[i], kind="stable")[:k]) == best[i]


def test_many_neighbours_in_smaller_blocks(spark, monkeypatch):
    blocks, meet = [], vectors._meet
    monkeypatch.setattr(vectors, "_meet", lambda units, queries, run, out, block, *a: blocks.append(block) or meet(units, queries, run, out, block, *a))
    u = spark.createDataFrame([(i, i, [float(i), 1.0]) for i in range(9)], "unit_id long, asset_id long, vector array<double>")
    for k in (20, 1010):
        vectors.knn(u, u.select(F.col("unit_id").alias("query_id"), "vector"), k)
    assert blocks[0] == 8192 and blocks[1] * 1010 <= vectors._FOUND


def test_text_index_deals_by_tokens(spark, tmp_path, monkeypatch):
    """Texts and postings go to as many tasks as their tokens need, whatever Spark would join."""
    monkeypatch.setattr(text_index, "TOKENS", 500)
    asked = []
    index = text_index.TextIndex(spark, f"{tmp_path}/index")
    units = spark.range(4096).select(F.col("id").alias("unit_id"), F.concat_ws(" ", F.lit("w"), F.col("id").cast("string")).alias("search_text"))
    frame = type(units)
    monkeypatch.setattr(frame, "repartition", lambda self, *a, f=frame.repartition: asked.append(a[0]) or f(self, *a))
    index.apply(units)
    assert [a for a in asked if isinstance(a, int)] == [17, 17]
    q = spark.createDataFrame([(0, "4000")], "query_id long, q string")
    assert [r["unit_id"] for r in index.search(q).collect()] == [4000]


class Handle:
    """Timers and one state, as a processor sees them."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, *_):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.remove(t)


def test_jobs_ask_their_store_little():
    """A job's timer is told by its state: neither the timers nor whether the state exists are asked for."""
    h, keeper = Handle(), JobKeeper(50)
    keeper.init(h)
    part = lambda *e: pd.DataFrame(e, columns=["ms", "seq", "event", "version"])
    for events, timers in (([(100, 1, "start", 0)], {151}), ([(120, 2, "beat", 0)], {171}), ([(130, 4, "retry", 0), (125, 3, "beat", 0)], {176}), ([(140, 5, "done", 0)], set())):
        list(keeper.handleInputRows((1,), iter([part(e) for e in events]), None))
        assert h.timers == timers
    assert Job(*h.value)[:4] == ("done", 1, 0, 140)


def test_packing_cuts_batches_by_bytes(monkeypatch):
    """Long texts aren't tokenised five hundred at a time."""
    sizes = []

    class Memo:
        def texts(self, texts):
            sizes.append(sum(map(len, texts)))
            return np.zeros(len(texts), "<u4"), np.ones(len(texts), np.int64)

    monkeypatch.setattr(packing, "worker_memo", lambda *_: Memo())
    batch = pa.record_batch([pa.array(range(100)), pa.array(["x" * 100_000] * 100)], names=["doc_id", "text"])
    assert sum(b.num_rows for b in packing._pieces("{}", 1, 4096)(iter([batch]))) == 100
    assert max(sizes) <= 1 << 20
