"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import pytest

from albumlake.llm import queries as Q
from albumlake.llm.periodic_runs import collapse, find_runs, periodic_runs, run_digest, segments


def brute(w):
    """All runs, by testing every period at every place."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(w, found):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]


def test_random_words():
    r = random.Random(5)
    for _ in range(1500):
        w = [r.randrange(r.choice([1, 2, 3, 8])) for _ in range(r.randrange(90))]
        for _ in range(r.randrange(4)):
            a, p = r.randrange(len(w) + 1), r.randrange(1, 9)
            for i in range(a, min(len(w), a + p * r.randrange(2, 9))):
                w[i] = w[a + (i - a) % p]
        found = find_runs(w)
        assert found == brute(w)
        assert collapse(w, found) == brute_collapse(w, found)


def test_segments_hold_frequent_words_only():
    w = "a b a b a b a b x c c c c c c c y d d d".split()
    ids = [sorted(set(w)).index(x) for x in w]
    import numpy as np

    assert segments(np.array(ids)) == [(0, 8), (9, 16)]
    assert segments(np.array([], int)) == []


@pytest.mark.parametrize("n", [200_000])
def test_long_texts(n):
    assert find_runs(["x"] * n) == [(0, n, 1)]
    assert find_runs([i % 777 for i in range(n)]) == [(0, n, 777)]
    r = random.Random(2)
    w = [r.randrange(2) for _ in range(n)]
    w[1000:151000] = [w[1000 + i % 5000] for i in range(150_000)]
    found = find_runs(w)
    assert (n, 5000) > max((x[1], x[2]) for x in found) > (149_999, 4999)
    assert find_runs(w[:400]) == brute(w[:400])


def digest(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(brute_collapse(words, runs))
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 4000").select("doc_id", "text")
    more = spark.createDataFrame([(10_000 + i, "w " * i + "q r s " * (i % 7)) for i in range(100)] + [(20_000, None), (20_001, ""), (None, "a a a a a a")], "doc_id long, text string")
    docs = docs.unionByName(more)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op11_periodic_runs(spark, str(tmp_path))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns[:8] == columns
    assert [t for _, t in got.dtypes[:8]] == ["bigint"] * 6 + ["string"] * 2
    want = [digest(*r) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=key) == sorted(want, key=key)
    assert sum(r[1] > 0 for r in want) > 20


def test_odd_rows(spark, odd, none):
    found = periodic_runs(odd)
    assert found.count() == odd.count() and found.filter("collapsed IS NULL OR runs IS NULL").isEmpty()
    assert run_digest(periodic_runs(none)).count() == 0
    tie = spark.createDataFrame([(1, "a a a a a a x b b b b b b"), (2, "a b " * 6 + "a")], "doc_id long, text string")
    top = {r["doc_id"]: (r["start"], r["length"], r["period"], r["exponent_milli"]) for r in run_digest(periodic_runs(tie)).collect()}
    assert top == {1: (0, 6, 1, 6000), 2: (0, 13, 2, 6500)}
