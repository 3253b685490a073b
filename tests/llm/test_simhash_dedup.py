"""SimHash near-duplicates against brute force over all pairs."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from albumlake.llm import queries as Q
from albumlake.llm.simhash_dedup import grow, linked_fingerprints, links, majority, shingle_hashes, sides, simhash_dedup, vantage


def fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=2):
    """Smallest id reachable, per row (id, fingerprint)."""
    fps = sorted({f for _, f in rows})
    x = np.array(fps, np.uint64)
    best, left = {}, set(range(len(fps)))
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            near = np.flatnonzero(np.bitwise_count(x ^ x[todo.pop()]) <= radius)
            new = {int(i) for i in near} & left
            left -= new
            group |= new
            todo += new
        best.update({fps[i]: min(group) for i in group})
    least = {}
    for d, f in rows:
        if d is not None:
            least[best[f]] = min(d, least.get(best[f], d))
    return {(d, f): least.get(best[f]) for d, f in rows}


def clustered(n, seed=1):
    """Random fingerprints, half of them a few bits away from another one."""
    r = np.random.default_rng(seed)
    x = r.integers(0, 2**63, n // 2, np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << r.integers(0, 64, len(y), np.uint64)
    return np.unique(np.concatenate((x, y)))


def groups(n, pairs):
    label = list(range(n))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        label[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_hash_is_the_one_of_spark(spark):
    text = "Ärger und Ärger X"
    want = [r[0] for r in spark.createDataFrame([("Ärger und Ärger".lower().replace("ä", "Ä"),), ("und Ärger x",)], "s string").select(F.xxhash64("s")).collect()]
    assert shingle_hashes(text.encode()).view(np.int64).tolist() == want
    assert majority(np.empty(0, np.uint64)) == 0
    assert majority(np.array([3, 1, 4], np.uint64)) == 1 and majority(np.array([3, 1], np.uint64)) == 1


@pytest.mark.parametrize("radius", [0, 1, 2, 4])
def test_links_of_a_shard(radius):
    x = clustered(3000)
    every = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius, 1)).tolist()
    assert radius == 0 or every
    assert groups(len(x), links(x, radius)) == groups(len(x), every)


def test_dense_cluster_of_one_ball():
    x = np.unique(np.array([(1 << a) | (1 << b) | (1 << c) for a in range(26) for b in range(a) for c in range(b)], np.uint64))
    assert len(x) == 2600 and set(groups(len(x), links(x, 2))) == {0}


def test_what_links_shares_a_shard():
    x = clustered(6000, 4)
    nodes = grow(x[::5], 40, 2)
    leaves = [set() for _ in nodes]
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, own = todo.pop()
        point, mu, near, far = nodes[at]
        if point is None:
            leaves[at] = set(own.tolist())
        else:
            todo += [(c, own[i]) for c, i in zip((near, far), sides(x[own], (point, mu), 2))]
    assert sum(map(bool, leaves)) > 8
    for a, b in np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2, 1)).tolist():
        assert any(a in leaf and b in leaf for leaf in leaves)
    assert vantage(np.zeros(1000, np.uint64), 2) is None


def test_many_shards(spark):
    x = clustered(6000, 9)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    got = linked_fingerprints(df, 2, shard=200, sample=2000).collect()
    place = {int(v): i for i, v in enumerate(x.view(np.int64))}
    every = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2, 1)).tolist()
    assert groups(len(x), [(place[r["a"]], place[r["b"]]) for r in got]) == groups(len(x), every)


def test_query_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(90_000, None), (90_001, ""), (None, " "), (90_002, "One two"), (90_003, "one  TWO"), (90_003, "one  TWO")], "doc_id long, text string")
    long = " ".join(f"w{i * i % 1999}" for i in range(1500))
    near = spark.createDataFrame([(70_000 + i, long + " more" * i) for i in range(8)], "doc_id long, text string")
    docs = docs.unionByName(more).unionByName(near)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = Q.op13_simhash_dedup(spark, str(tmp_path))
    assert [t for _, t in out.dtypes[:3]] == ["bigint", "string", "bigint"]
    got = [tuple(r) for r in out.select("doc_id", "fingerprint", "component_id").collect()]
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in docs.collect()]
    known = brute(rows)
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted([(d, f"{f:016x}", known[d, f]) for d, f in rows], key=key)
    assert len({r[2] for r in got}) < len({r[1] for r in got})


def test_odd_rows(spark, odd, none):
    got = simhash_dedup(odd)
    assert got.count() == odd.count()
    zero = got.filter("n_shingles = 0").select("fingerprint", "component_id").distinct().collect()
    assert [tuple(r) for r in zero] == [("0" * 16, 3)]
    assert simhash_dedup(none).count() == 0
    alone = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert {r["component_id"] for r in simhash_dedup(alone).collect()} == {None}
