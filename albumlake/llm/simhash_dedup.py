"""Near-duplicates by SimHash fingerprints in vantage-point trees.

Equal fingerprints are one class. A tree of vantage points, fitted on a bounded sample, deals all
distinct fingerprints to shards: those within distance mu of a node's vantage point go to its near
side, those beyond mu - radius to its far side, so what lies in the shell between goes to both. By
the triangle inequality two fingerprints within ``radius`` are on one side of every node together:
if the nearer one is within mu and the other beyond, the nearer one is beyond mu - radius too. In a
shard the same split goes on until nodes are small enough to compare all their fingerprints, or no
vantage point makes them smaller. Each shard returns a spanning forest of its links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, pieces
from .near_dedup import components, forest

SEED, BITS = 42, 64
SMALL, TILE = 256, 1024  # fingerprints of a node that is compared whole, and of a tile of a larger one


def shingle_hashes(text: bytes, k: int = 3) -> np.ndarray:
    """64-bit hashes of the k-word shingles, repeats included, A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    start, end = np.concatenate(([0], end[:-1])).tolist(), (end - 1).tolist()
    k = min(k, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(start, end[k - 1 :])), np.uint64, len(words) - k + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed 64-bit number."""
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].astype("<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<i8")[0])


def distance(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count(x ^ y).astype(np.int64)


def vantage(x: np.ndarray, radius: int, tries: int = 12) -> tuple[np.uint64, int] | None:
    """The vantage point among some of ``x``, and its mu, whose two sides hold the fewest pairs; None
    if no choice leaves both sides smaller than nine tenths."""
    best, least = None, 2 * (0.9 * len(x)) ** 2
    for v in x[np.linspace(0, len(x) - 1, min(tries, len(x))).astype(int)]:
        within = np.cumsum(np.bincount(distance(x, v), minlength=BITS + 1)).astype(float)
        near = within[:-1]
        far = len(x) - np.concatenate((np.zeros(radius), within))[: BITS]
        cost = np.where(np.maximum(near, far) <= 0.9 * len(x), near**2 + far**2, np.inf)
        mu = int(cost.argmin())
        if cost[mu] < least:
            best, least = (v, mu), cost[mu]
    return best


def sides(x: np.ndarray, point: tuple[np.uint64, int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of what belongs to the near and to the far side."""
    d = distance(x, point[0])
    return np.flatnonzero(d <= point[1]), np.flatnonzero(d > point[1] - radius)


def grow(sample: np.ndarray, each: float, radius: int) -> list[tuple]:
    """Nodes (vantage point, mu, near child, far child) of a tree that deals to shards of about
    ``each`` of the sample; a leaf is (None, its number, 0, 0). The root comes first."""
    nodes: list[tuple] = [()]
    todo, leaves = [(0, sample)], 0
    while todo:
        at, x = todo.pop()
        point = vantage(x, radius) if len(x) > max(each, 16) else None
        if point is None:
            nodes[at], leaves = (None, leaves, 0, 0), leaves + 1
            continue
        nodes[at] = (*point, len(nodes), len(nodes) + 1)
        for child, own in zip((len(nodes), len(nodes) + 1), sides(x, point, radius)):
            nodes.append(())
            todo.append((child, x[own]))
    return nodes


def _dealt(nodes: list[tuple], radius: int):
    """(shard, fp): every fingerprint with each shard that it belongs to."""

    def run(batches):
        for batch in batches:
            x = batch.column("fp").to_numpy().view(np.uint64)
            todo = [(0, np.arange(len(x)))]
            while todo:
                at, own = todo.pop()
                point, mu, near, far = nodes[at]
                if not len(own):
                    continue
                if point is None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), mu), pa.int64()), pa.array(x[own].view(np.int64))], names=["shard", "fp"])
                else:
                    todo += [(child, own[i]) for child, i in zip((near, far), sides(x[own], (point, mu), radius))]

    return run


def _compared(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    linked = distance(x[:, None], x[None, :]) <= radius
    own = np.flatnonzero(linked.sum(1) > 1)
    return [(int(own[a]), int(own[b])) for a, b in forest(linked[np.ix_(own, own)])]


def links(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs of positions in distinct fingerprints that connect what chains of links connect."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        point = vantage(x[own], radius) if len(own) > SMALL else None
        if point is not None:
            todo += [own[i] for i in sides(x[own], point, radius)]
            continue
        tiles = [own[i : i + TILE] for i in range(0, len(own), TILE)]
        for i, a in enumerate(tiles):
            for b in tiles[i + 1 :] or [a[:0]] * (i == 0):
                both = np.concatenate((a, b))
                out += [(int(both[s]), int(both[t])) for s, t in _compared(x[both], radius)]
    return out


def spanning(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs without those that close a circle."""
    parent: dict[int, int] = {}
    out = []
    for a, b in pairs:
        ends = []
        for e in (a, b):
            while (p := parent.get(e, e)) != e:
                parent[e] = e = parent.get(p, p)
            ends.append(e)
        if ends[0] != ends[1]:
            parent[ends[0]] = ends[1]
            out.append((a, b))
    return out


def _joined(radius: int):
    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        pairs = spanning(links(fp.view(np.uint64), radius))
        a, b = (fp[np.array([p[i] for p in pairs], np.int64)] for i in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _printed(k: int):
    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                hashes = [shingle_hashes(t, k) for t in as_bytes(part.column("text"))]
                columns = [pa.array([len(h) for h in hashes], pa.int64()), pa.array([majority(h) for h in hashes], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_shingles", "fp"])

    return run


def linked_fingerprints(distinct: DataFrame, radius: int = 2, shard: int = 1 << 18, sample: int = 1 << 16) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that connect all that lie within ``radius``
    bits of each other, directly or through others.

    The tree is fitted on about ``sample`` of the fingerprints, those with the smallest hashes; each
    of its leaves is a shard of at most about ``shard`` fingerprints (more where the sample is too
    small to tell, or nothing can be split), and there are enough of them for all tasks. Each level of
    the tree copies what lies in its shells, so large shards, which a task splits on in memory, cost
    less than many.
    """
    n, tasks = distinct.count(), int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-n // shard), min(tasks, -(-n // 8192)), 1)
    share = min(1.0, sample / max(n, 1))
    some = distinct if share == 1 else distinct.filter(F.pmod(F.xxhash64("fp", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    picked = np.array([r["fp"] for r in some.select("fp").collect()], np.int64).view(np.uint64)
    nodes = grow(np.sort(picked), n / shards * share, radius)
    dealt = distinct.select("fp").mapInArrow(_dealt(nodes, radius), "shard long, fp long")
    return dealt.groupBy("shard").applyInArrow(_joined(radius), "a long, b long").distinct()


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, radius: int = 2, shard: int = 1 << 18, sample: int = 1 << 16) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id, n_shingles.

    A bit of the fingerprint is 1 if it is set in over half the hashes of the text's k-word shingles
    (repeats count; a text of fewer words is one shingle). Texts without words, null ones among
    them, have fingerprint zero, which links like any other. Fingerprints link at ``radius`` or
    fewer differing bits and ``component_id`` is the smallest doc_id that links reach, null where
    they reach rows with null ids only. Ties, repeated rows and repeated ids are rows as any other,
    very long texts are read whole, extra columns are ignored, an empty table gives an empty result.

    Equal fingerprints meet once however many rows have them. A link is never lost: what may link
    shares a shard. A shard's task holds its distinct fingerprints only; those that fall into the
    shell of a node are copied to both sides.
    """
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out, work = Scratch(df.sparkSession), Scratch(df.sparkSession)
    printed = out.keep(src.mapInArrow(_printed(k), "doc_id long, n_shingles long, fp long"))
    classes = work.keep(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(work.keep(linked_fingerprints(classes, radius, shard, sample)), work)
    named = classes.join(labels.withColumnRenamed("row", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    whole = named.groupBy("label").agg(F.min("least").alias("component_id"))
    known = out.keep(named.select("fp", "label").join(whole, "label").select("fp", "component_id"))
    work.clear()
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return printed.join(known, "fp").select("doc_id", digits.alias("fingerprint"), "component_id", "n_shingles")
