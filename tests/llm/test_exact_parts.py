"""Exact duplicates of huge texts and of many copies."""

import hashlib

import numpy as np
import pytest

from albumlake.llm import exact_dedup as X


def text(n, seed):
    return np.random.default_rng(seed).integers(97, 123, n).astype(np.uint8).tobytes().decode()


def test_parts_of_different_tasks_combine(spark):
    n = 3 * X.CHUNK + 5
    rows = [(i, text(n, i % 3)) for i in range(9)] + [(20, "small"), (21, "small"), (22, text(n, 0)[:-1] + "?")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: max(e for e, u in rows if u == t) for d, t in rows}
    for huge, part in ((X.HUGE, X.PART), (1000, X.CHUNK), (X.CHUNK, 2 * X.CHUNK)):
        got = X.exact_dedup(df, huge=huge, part=part).collect()
        assert {r["doc_id"]: r["keep_id"] for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
        assert {r["doc_id"]: r["text_sha256"] for r in got} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in rows}


def test_combined_fingerprints_are_those_of_the_whole(spark):
    rows = [(i, text(n, i)) for i, n in enumerate((X.CHUNK, 5 * X.CHUNK + 17, 300_000))]
    df = spark.createDataFrame([(i, i, "x", seq, bytearray(t.encode()[a : a + X.CHUNK])) for i, t in rows for seq, a in enumerate(range(0, len(t), X.CHUNK))], "row long, doc_id long, sha string, seq long, part binary")
    got = {r["row"]: (r["n_bytes"], r["h1"], r["h2"]) for r in X._combined(df.repartition(7)).collect()}
    assert got == {i: X.fingerprint(t.encode()) for i, t in rows}


@pytest.mark.parametrize("copies", [600])
def test_many_copies_of_a_long_text(spark, copies):
    """Equal chunks become one in each task, and batches are cut by bytes."""
    long = text(200_000, 4)
    df = spark.range(copies).selectExpr("id as doc_id", f"'{long}' as text").repartition(6)
    more = spark.createDataFrame([(5000, long[:-1] + "!"), (5001, long[:-1] + "!"), (5002, "alone")], "doc_id long, text string")
    got = X.exact_dedup(df.unionByName(more)).collect()
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(copies - 1, copies), (5001, 2), (5002, 1)}
    assert sum(r["kept"] for r in got) == 3


def test_collisions_among_many_copies(spark, monkeypatch):
    real = X.fingerprint
    monkeypatch.setattr(X, "fingerprint", lambda data, chunk=0: (len(data), 1, 1) if len(data) == 2 else real(data))
    rows = [(i, "cd" if i == 17 else "ab") for i in range(40)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in X.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (17, 1) if i == 17 else (39, 39) for i in range(40)}
