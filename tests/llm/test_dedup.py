"""Exact and near duplicates against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from albumlake.llm import exact_dedup as X
from albumlake.llm import near_dedup as N


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 40))
def test_fingerprints_compose(data, chunk):
    whole = X.chunk_hash(data)
    assert X.fingerprint(data, chunk) == (whole if data else (0, 0, 0))
    cut = len(data) // 3
    assert X.combine(X.fingerprint(data[:cut]), X.fingerprint(data[cut:])) == X.fingerprint(data)


def brute_exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    return groups


def check_exact(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    groups = brute_exact(rows)
    got = X.exact_dedup(df).collect()
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ds for t, ds in groups.items()}
    kept = defaultdict(int)
    for r in got:
        ds = by_hash[r["text_sha256"]]
        assert r["group_size"] == len(ds)
        assert r["keep_id"] == max((d for d in ds if d is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
    assert set(kept.values()) <= {1}


def test_exact(documents, odd, none):
    check_exact(documents)
    check_exact(odd)
    assert X.exact_dedup(none).count() == 0


def test_colliding_fingerprints_are_compared(spark, monkeypatch):
    rows = [(1, "ab"), (2, "cd"), (3, "ab"), (4, "ef")]
    real = X.fingerprint
    monkeypatch.setattr(X, "fingerprint", lambda data, chunk=0: (len(data), 1, 1) if len(data) == 2 else real(data))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in X.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3, 2, False), 3: (3, 2, True), 2: (2, 1, True), 4: (4, 1, True)}


def sets(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_near(rows, k, percent=80):
    s = {d: sets(t, k) for d, t in rows}
    label = {d: d for d in s}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    inverted = defaultdict(set)
    for d, x in s.items():
        for g in x:
            inverted[g].add(d)
    for d, x in s.items():
        for o in {o for g in x for o in inverted[g] if o < d}:
            both = len(x & s[o])
            if 100 * both >= percent * (len(x) + len(s[o]) - both):
                a, b = sorted((find(d), find(o)))
                label[b] = a
    return {d: (len(s[d]), find(d)) for d in s}


def test_near_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = brute_near(rows, 4)
    for r in N.near_dedup(documents, k=4).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_large_clump_and_passage(spark):
    """A group of near copies far above a node's size, and many texts that only share a passage."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(passage + [word() for _ in range(40)])) for i in range(200, 330)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near(rows, 5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_dedup(df, small=8).collect()}
    assert got == want


def test_near_edge_cases(odd, none):
    got = N.near_dedup(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert [r["component_id"] for r in by[3] + by[4] + by[5]] == [3, 4, 5] and all(r["n_shingles"] == 0 and r["kept"] for r in by[3] + by[4] + by[5])
    assert by[6][0]["component_id"] == by[7][0]["component_id"] == 6 and by[8][0]["n_shingles"] == 1
    assert sum(r["kept"] for r in by[1] + by[2]) == 1 and sum(r["kept"] for r in by[None]) == 1
    assert N.near_dedup(none).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs just at the threshold within ever larger groups of texts that share a passage, with nodes
    so small that the groups must branch: at least nine in ten pairs are found, none is false."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    rows, pairs, d = [], [], 0
    for size in (10, 60, 240):
        passage = [word() for _ in range(40)]
        for _ in range(size):
            base = passage + [word() for _ in range(140)]
            other = list(base)
            cut = rng.randrange(60, len(base) - 20)
            other[cut : cut + 14] = [word() for _ in range(14)]  # 158 of 194 shingles of five words stay
            rows += [(d, " ".join(base)), (d + 1, " ".join(other))]
            pairs.append((size, d, d + 1))
            d += 2
    want = brute_near(rows, 5)
    found = {r["doc_id"]: r["component_id"] for r in N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), small=64).collect()}
    assert all(want[a][1] == want[b][1] for _, a, b in pairs)
    assert all(want[x][1] == want[c][1] for x, c in found.items())
    for size in (10, 60, 240):
        own = [found[a] == found[b] for s, a, b in pairs if s == size]
        assert sum(own) >= 0.9 * len(own)


def test_intersections_of_all_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 60))) for _ in range(70)]
    got = N.shared_counts(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert i == j or got[i, j] == len(np.intersect1d(a, b))
    linked = got > 20
    edges = N.forest(linked)
    assert all(linked[a, b] for a, b in edges) and len(edges) < len(sets)
