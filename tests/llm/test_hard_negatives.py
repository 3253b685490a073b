"""Hard negatives against brute force over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from albumlake.llm.hard_negatives import Cells, codebook, halves, hard_negatives, nearest

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, k=5):
    """``rows``: (vec_id, label, vector, asks)."""
    fine = []
    for i, (d, label, v, asks) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.append((i, d, label, [math.floor(256 * x) for x in v], asks))
    out = []
    for i, d, label, v, asks in fine:
        if asks:
            scored = sorted(((sum(a * b for a, b in zip(v, w)), e, j, other) for j, e, other, w, _ in fine), key=lambda s: (-s[0], s[1] is None, s[1], s[2]))
            for p in [s for s in scored if s[3] == label and s[2] != i][:k]:
                negatives = [s for s in scored if s[3] != label and 80 * p[0] <= 100 * s[0] <= 100 * p[0]][:k]
                out += [(d, p[1], r + 1, s[1], p[0], s[0]) for r, s in enumerate(negatives)]
    return out


def compared(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, asks boolean, row string")
    out = hard_negatives(df, F.col("asks"), **more)
    assert out.columns == COLUMNS and [t for _, t in out.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    key = lambda r: tuple((x is None, x) for x in r)
    got, want = sorted(map(tuple, out.collect()), key=key), sorted(brute(rows), key=key)
    assert got == want
    return want


def table(n, d, seed, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(7, d))
    v = (centres[r.integers(0, 7, n)] + spread * r.normal(size=(n, d))).astype(np.float32)
    return [(i, int(r.integers(0, 4)), v[i].tolist(), i % 9 == 0) for i in range(n)]


@pytest.mark.parametrize(("d", "spread"), [(8, 0.05), (7, 1.0), (1, 1.0)])
def test_many_shards_and_blocks(spark, d, spread):
    assert len(compared(spark, table(600, d, d, spread), shard=90, block=20, words=6, sample=100)) > 100


def test_ties_repeats_nulls_and_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i % 20, i % 3, [float(i % 4), 1.0], i % 5 == 0) for i in range(60)]
    rows += [(100, None, [1.0, 1.0], True), (101, 1, None, True), (102, 1, [1.0, None], True), (103, 1, [nan, 1.0], True), (104, 1, [inf, 1.0], True), (105, 1, [-inf, 1.0], False)]
    rows += [(None, 1, [1.0, 1.0], True), (None, 2, [1.0, 1.0], None), (106, 2, [-1.0, -0.5], True), (107, 2, [0.0, 0.0], True), (108, 9, [1.0, 1.0], True)]
    assert compared(spark, rows)
    assert compared(spark, rows, shard=7, block=3, words=3)


def test_empty(spark):
    rows = [(1, 1, [1.0, 2.0], False)]
    assert compared(spark, rows) == []
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>, asks boolean")
    assert hard_negatives(df, F.col("asks")).count() == 0


def test_large_components(spark):
    big = 2.0**30 / 256
    rows = [(i, i % 2, [big * (1 + i / 64), float(i)], i == 0) for i in range(12)]
    assert compared(spark, rows)


def test_visits_best_first_and_stops_early():
    x = np.round(256 * np.array([v for _, _, v, _ in table(4000, 16, 3, 0.02)]))
    books = tuple(codebook(h, 12) for h in halves(x))
    cells = Cells(x, tuple(nearest(h, b) for h, b in zip(halves(x), books)), books)
    own, q = x[cells.order], x[5]
    seen, last = [], np.inf
    for at, bound in cells.visit(q, least=1):
        seen += at.tolist()
        rest = np.setdiff1d(np.arange(len(x)), seen)
        assert bound <= last and (not len(rest) or (own[rest] @ q).max() <= bound)
        last = bound
    assert sorted(seen) == list(range(len(x)))
    looked, best = 0, np.empty(0)
    for at, bound in cells.visit(q):
        looked += len(at)
        best = np.sort(np.concatenate((best, own[at] @ q)))[-5:]
        if bound < best[0]:
            break
    assert looked < len(x) / 2 and best.tolist() == np.sort(own @ q)[-5:].tolist()
