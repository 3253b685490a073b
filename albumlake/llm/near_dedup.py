"""Near-duplicates by a chosen-path set similarity join over word shingles.

A document is the set of its shingles and carries their minwise signature. Documents with equal
sets are one class. In each of several independent trees, documents branch by the values at a few
signature positions that the node chooses, about 1 / similarity of them, and nodes that are still
large branch again. A small node is compared exhaustively, by signatures first: where few pairs are
possible they are confirmed one by one, and in a denser node the full sets of the documents in
question come to one task, which counts all their intersections and returns a spanning forest of
the links. So neither pairs nor links of a group ever become rows by the square of its size. Every
few levels a pivot of each large node is compared with its other documents, and a node whose
documents are one component by then is done; nodes that are large even at the last level are
compared in pairs of blocks, each a small node. Links are always decided on the full sets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, bitmap, bitmap_bits, in_bitmap, runs, slices

WIDTH = 32  # signature positions
STRIDE, LEVELS = 3, 12  # levels between two looks at large nodes, and in all
FEW, WEIGHT = 16, 1 << 21  # nodes of more documents than this hold at most so many shingles
_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles, A-Z in lower case."""
    words = text.lower().split()
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=k)], np.uint64) if words else np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - k + 1
    s = h[:n].copy()
    for i in range(1, k):
        s *= np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
        s += h[i : i + n]
    s ^= s >> np.uint64(32)
    s *= np.uint64(0xD6E8FEB86659FD93)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise values, one row of ``WIDTH`` per set; sets must not be empty."""
    flat = np.concatenate(sets)
    start = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), WIDTH), np.uint32)
    for j, a in enumerate(_MULTIPLIERS):
        out[:, j] = np.minimum.reduceat((flat * a) >> np.uint64(32), start)
    return out.view(np.int32)


def _mark(s: np.ndarray) -> tuple[int, int]:
    """128-bit fingerprint of a set, as two signed 64-bit numbers."""
    x = xxhash.xxh3_128_digest(np.ascontiguousarray(s))
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


def _signed(k: int, names: list[str]):
    def run(batches):
        for batch in batches:
            for part in slices(batch, 300):
                sets = [shingles(t, k) for t in as_bytes(part.column("text"))]
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full).tolist() if full else ())
                marks = [_mark(s) for s in sets]
                cols = [
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([m[0] for m in marks], pa.int64()),
                    pa.array([m[1] for m in marks], pa.int64()),
                    pa.array([next(sig) if len(s) else [] for s in sets], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *cols], names=[*names, "n", "f1", "f2", "sig"])

    return run


def _wanted_sets(marked: np.ndarray, bits: int, k: int):
    def run(batches):
        sent = set()  # each class once per task, however many copies it has
        for batch in batches:
            for part in slices(batch, 200):
                rows = []
                for t in as_bytes(part.column("text")):
                    s = shingles(t, k)
                    m = _mark(s)
                    if len(s) and m not in sent and in_bitmap(marked, m[0] & (bits - 1)):
                        sent.add(m)
                        rows.append((*m, s.view(np.int64)))
                cols = list(zip(*rows)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["f1", "f2", "members"])

    return run


def _alike(na, nb, same, similarity: float):
    """Whether sizes and signatures leave the similarity possible (the latter but for about 1 in 10^5)."""
    return (np.minimum(na, nb) >= similarity * np.maximum(na, nb)) & (same >= (similarity - 0.3) * WIDTH)


def _possible(percent: int, each: int = 4):
    """What may be similar in small nodes, by signatures. Rows come sorted by node.

    A node with at most ``each`` possible pairs a row gives them as (null, a, b), a denser one its
    rows with any such pair as (node, row, null): about as much goes out as came in.
    """

    def alike(node, row, n, sig, label, start, size):
        step = max(1, (1 << 21) // (size * size))
        upper = np.triu(np.ones((size, size), bool), 1)
        for i in range(0, len(start), step):
            at = start[i : i + step, None] + np.arange(size)
            same = np.zeros((len(at), size, size), np.uint8)
            for p in range(WIDTH):
                x = sig[:, p][at]
                same += x[:, :, None] == x[:, None, :]
            m, of = n[at], label[at]
            maybe = upper & _alike(m[:, :, None], m[:, None, :], same, percent / 100) & (of[:, :, None] != of[:, None, :])
            few = maybe.sum((1, 2)) <= each * size
            g, a, b = np.nonzero(maybe & few[:, None, None])
            a, b = row[at[g, a]], row[at[g, b]]
            yield np.full(len(a), -1), np.minimum(a, b), np.maximum(a, b)
            g, r = np.nonzero((maybe.any(1) | maybe.any(2)) & ~few[:, None])
            yield node[at[g, 0]], row[at[g, r]], np.full(len(g), -1)

    def of(node, row, n, sig, label):
        start = runs(node)
        size = np.diff(np.append(start, len(node)))
        out = [(np.empty(0, np.int64),) * 3]
        for s in np.unique(size[size > 1]):  # nodes of one size at once
            out += alike(node, row, n, sig, label, start[size == s], int(s))
        node, a, b = (np.concatenate(c) for c in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(node, mask=b >= 0), pa.array(a), pa.array(b, mask=b < 0)], names=["node", "a", "b"])

    def run(batches):
        rest = None
        for batch in batches:
            sig = batch.column("sig").flatten().to_numpy().reshape(-1, WIDTH)
            node, row, n, label = (batch.column(c).to_numpy() for c in ("node", "row", "n", "label"))
            cols = [node, row, n, sig, label]
            if rest is not None:
                cols = [np.concatenate(c) for c in zip(rest, cols)]
            if not len(cols[0]):
                continue
            last = runs(cols[0])[-1]  # the last node may go on in the next batch
            rest = [c[last:].copy() for c in cols]
            yield of(*(c[:last] for c in cols))
        if rest is not None:
            yield of(*rest)

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with each other, as a square matrix."""
    m = len(sets)
    _, item, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(m), [len(s) for s in sets])
    more = df[item] > 1
    of = of[more][np.argsort(item[more], kind="stable")]  # sets by item
    df = df[df > 1]
    first, out = np.cumsum(df) - df, np.zeros((m, m), np.float32)
    for d in np.unique(df[df <= 32]):  # items of few sets: all their pairs
        at = first[df == d]
        for i in range(0, len(at), 1 << 12):
            x = of[at[i : i + (1 << 12), None] + np.arange(d)]
            out += np.bincount((x[:, :, None] * m + x[:, None, :]).ravel(), minlength=m * m).reshape(m, m)
    common, size = first[df > 32], df[df > 32]
    for i in range(0, len(common), 2048):  # others: a product of incidence matrices
        f, n = common[i : i + 2048], size[i : i + 2048]
        x = np.zeros((len(f), m), np.float32)
        x[np.repeat(np.arange(len(f)), n), of[np.repeat(f - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = 1
        out += x.T @ x
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a graph given as a matrix."""
    unseen, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        todo = [root] if unseen[root] else []
        unseen[root] = False
        while todo:
            x = todo.pop()
            new = np.flatnonzero(linked[x] & unseen)
            unseen[new] = False
            out += [(x, int(y)) for y in new]
            todo += new.tolist()
    return out


def _links(percent: int):
    """Links of a dense node, decided on its full sets."""

    def run(table: pa.Table) -> pa.Table:
        row = table.column("row").to_numpy()
        sets = [x.values.to_numpy() for x in table.column("members")]
        size = np.array([len(s) for s in sets])
        shared = shared_counts(sets)
        ends = forest(100 * shared >= percent * (size[:, None] + size[None, :] - shared))
        a, b = ([int(row[e[i]]) for e in ends] for i in (0, 1))
        return pa.table({"a": pa.array(map(min, a, b), pa.int64()), "b": pa.array(map(max, a, b), pa.int64())})

    return run


def branch(at: DataFrame, trees: int | None = None) -> DataFrame:
    """(row, n, sig[, node]) -> (node, row, n): the children that the root of each tree, or a node, chooses.

    One position, and a second for every fourth tree or node: 1.25 on average, which is 1 / 0.8.
    """
    if trees is not None:
        rng = np.random.default_rng(trees)
        chosen = [(t, int(p)) for t in range(trees) for p in rng.choice(WIDTH, 1 + (t % 4 == 3), replace=False)]
        where = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("node"), F.lit(p).alias("p")) for t, p in chosen]))
        at = at.select("row", "n", "sig", where.alias("w")).select("row", "n", "sig", "w.node", "w.p")
    else:
        pick = lambda i: F.pmod(F.xxhash64("node", F.lit(i)), F.lit(WIDTH)).cast("int")
        where = F.when(F.pmod(F.xxhash64("node"), F.lit(4)) == 0, F.array_distinct(F.array(pick(1), pick(2)))).otherwise(F.array(pick(1)))
        at = at.select("row", "n", "sig", "node", F.explode(where).alias("p"))
    return at.select(F.xxhash64("node", "p", F.get("sig", F.col("p"))).alias("node"), "row", "n")


def components(edges: DataFrame, work: Scratch) -> DataFrame:
    """(row, label) for all ends of the edges (a, b); the label is the smallest row of the component.

    Edges are contracted to labels round by round: every label moves to the smallest one next to it,
    and moves are followed twice. Only whether edges are left is asked by the driver.
    """
    own = Scratch(edges.sparkSession)
    ends = edges.select(F.col("a").alias("row")).union(edges.select("b")).distinct()
    labels = own.keep(ends.withColumn("label", F.col("row")))
    left = own.keep(edges.distinct())
    while not left.isEmpty():
        ways = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = own.keep(ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")))
        jump = step.alias("s").join(step.select(F.col("a").alias("to"), F.col("to").alias("next")), "to").select("a", F.col("next").alias("to"))
        jump = own.keep(jump)
        labels = own.keep(labels.join(jump.withColumnRenamed("a", "label"), "label", "left").select("row", F.coalesce("to", "label").alias("label")))
        moved = left
        for end in ("a", "b"):
            moved = moved.join(jump.select(F.col("a").alias(end), F.col("to").alias(f"to_{end}")), end)
        left = own.keep(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).filter("a < b").distinct())
    labels = work.keep(labels)
    own.clear()
    return labels


def mixed(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the nodes that hold more than one component."""
    at = nodes.join(labels, "row", "left").withColumn("label", F.coalesce("label", "row"))
    several = at.groupBy("node").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most")
    return nodes.join(several.select("node"), "node", "left_semi")


def in_blocks(nodes: DataFrame, counts: DataFrame, small: int) -> DataFrame:
    """Large nodes as small ones that hold all their pairs: one for every two of a node's blocks."""
    parts = F.ceil(F.greatest(2 * F.col("size") / small, 2 * F.col("weight") / WEIGHT)).cast("long")
    at = nodes.join(counts.select("node", parts.alias("parts")), "node").withColumn("own", F.pmod(F.xxhash64("row", F.lit(3)), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    at = at.select("node", "row", "n", "own", other.alias("other"))
    return at.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "row", "n")


class _Join:
    """The tables of one similarity join: ``src`` has the texts, ``reps`` a row for each class."""

    def __init__(self, src: DataFrame, reps: DataFrame, k: int, percent: int, small: int, max_bits: int, work: Scratch):
        self.src, self.reps, self.k, self.percent, self.small, self.max_bits, self.work = src, reps, k, percent, small, max_bits, work
        none = reps.sparkSession.createDataFrame([], "a long, b long")
        self.known: DataFrame | None = None
        self.edges, self.sets = none, none.select(F.col("a").alias("row"), F.array("b").alias("members"))

    def fetch(self, rows: DataFrame) -> None:
        """Read the full sets of these rows, but for those that are there."""
        wanted = self.reps.select("row", "f1", "f2").join(rows.distinct(), "row", "left_semi").join(self.sets, "row", "left_anti")
        wanted = self.work.keep(wanted)
        bits = bitmap_bits(wanted.count(), self.max_bits)
        marked = bitmap(wanted, F.col("f1").bitwiseAND(F.lit(bits - 1)), bits)
        found = self.src.select("text").mapInArrow(_wanted_sets(marked, bits, self.k), "f1 long, f2 long, members array<long>")
        new = found.join(wanted, ["f1", "f2"]).groupBy("row").agg(F.first("members").alias("members"))
        self.sets = self.sets.unionByName(self.work.keep(new))

    def add(self, edges: DataFrame) -> None:
        self.edges, self.known = self.edges.unionByName(self.work.keep(edges)), None

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
        side = lambda e, as_: self.sets.select(F.col("row").alias(e), F.col("members").alias(as_))
        both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
        shared = F.size(F.array_intersect("x", "y")).cast("long")
        return both.filter(100 * shared >= self.percent * (F.size("x") + F.size("y") - shared)).select("a", "b")

    def labels(self) -> DataFrame:
        """(row, label) of the edges found so far."""
        if self.known is None:
            self.known = components(self.edges, self.work)
        return self.known

    def stars(self, nodes: DataFrame, seed: int) -> None:
        """Link each large node's rows to a pivot: the row with the smallest hash, so that nodes with
        much the same rows have one pivot and a row meets it once. Those of its component needn't."""
        at = nodes.join(self.labels(), "row", "left").select("node", "row", F.coalesce("label", "row").alias("label"))
        pivot = at.groupBy("node").agg(F.min_by(F.struct("row", "label"), F.xxhash64("row", F.lit(seed))).alias("p"))
        pairs = at.join(pivot, "node").filter("label != p.label").select(F.least("row", "p.row").alias("a"), F.greatest("row", "p.row").alias("b")).distinct()
        part = lambda e: self.reps.select(F.col("row").alias(e), F.col("sig").alias(f"s{e}"))
        same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
        pairs = self.work.keep(pairs.join(part("a"), "a").join(part("b"), "b").filter(same >= (self.percent / 100 - 0.3) * WIDTH).select("a", "b"))
        if not pairs.isEmpty():
            self.fetch(pairs.select(F.col("a").alias("row")).union(pairs.select("b")))
            self.add(self.confirm(pairs))

    def grow(self, trees: int) -> DataFrame:
        """(node, row) of all small nodes with company; large ones branch until they are small."""
        rows, done = branch(self.reps, trees), []
        for level in range(LEVELS + 1):
            counts = self.work.keep(rows.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).filter("size > 1"))
            fits = (F.col("size") <= min(FEW, self.small)) | ((F.col("size") <= self.small) & (F.col("weight") <= WEIGHT))
            done.append(rows.join(counts.filter(fits).select("node"), "node", "left_semi").select("node", "row"))
            large = counts.filter(~fits)
            if large.isEmpty():
                break
            stay = rows.join(large.select("node"), "node", "left_semi").select("node", "row", "n")
            if level and level % STRIDE == 0:
                self.stars(stay, level)
                stay = mixed(stay, self.labels())
            if level == LEVELS:
                done.append(in_blocks(stay, large, self.small).select("node", "row"))
            else:
                rows = self.work.keep(branch(stay.select("node", "row").join(self.reps.select("row", "n", "sig"), "row")))
        return reduce(DataFrame.unionByName, done)

    def run(self, trees: int) -> DataFrame:
        """(row, label) of all rows with a link; the label is the smallest row of the component."""
        nodes = self.grow(trees)
        tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        at = nodes.join(self.reps.select("row", "n", "sig"), "row").join(self.labels(), "row", "left").withColumn("label", F.coalesce("label", "row"))
        at = at.repartition(tasks, "node").sortWithinPartitions("node")
        met = self.work.keep(at.mapInArrow(_possible(self.percent), "node long, a long, b long"))
        pairs, dense = met.filter("b IS NOT NULL").select("a", "b").distinct(), met.filter("b IS NULL").select("node", F.col("a").alias("row"))
        self.fetch(met.select(F.col("a").alias("row")).union(pairs.select("b")))
        self.add(self.confirm(pairs))
        if dense.isEmpty():
            return self.labels()
        full = mixed(dense, self.labels()).join(self.sets, "row")
        self.add(full.groupBy("node").applyInArrow(_links(self.percent), "a long, b long"))
        return self.labels()


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, trees: int = 12, small: int = 2048, max_bits: int = 1 << 27, mark: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, row.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets;
    ``component_id`` is the smallest doc_id that links reach (nulls last) and ``kept`` marks that
    row: doc_id = component_id, but exactly one row of each component even if ids repeat or are
    null. A text of fewer than ``k`` words is one shingle; a null or empty one has none and is a
    component of its own. Extra columns are ignored; an empty table gives an empty result.

    A pair at the threshold shares a child with probability .8 at each of 15 chosen positions of
    the first level, so with 12 trees nearly none are lost there; pairs that a node of more than
    ``small`` documents holds together branch on and meet in at least one tree with high
    probability. ``mark`` adds text_sha256. Neither partners nor candidates are capped. A task that
    compares a node holds the sets of at most ``small`` documents with ``WEIGHT`` shingles, or of
    ``FEW`` documents of any length.
    """
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = [F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")] if mark else []
    named = src.select(F.monotonically_increasing_id().alias("row"), "doc_id", *marks, "text")
    names = named.columns[:-1]
    schema = "row long, doc_id long" + ", text_sha256 string" * mark + ", n long, f1 long, f2 long, sig array<int>"
    out, work = Scratch(df.sparkSession), Scratch(df.sparkSession)
    signed = out.keep(named.mapInArrow(_signed(k, names), schema))
    full = signed.filter("n > 0")
    first = F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    classes = work.keep(full.groupBy("f1", "f2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"), first.alias("first")))
    reps = work.keep(full.join(classes.select(F.col("rep").alias("row")), "row", "left_semi").select("row", "n", "f1", "f2", "sig"))

    labels = _Join(src, reps, k, percent, small, max_bits, work).run(trees)
    by_class = classes.join(labels.withColumnRenamed("row", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    whole = by_class.groupBy("label").agg(F.min("least").alias("component_id"), F.min_by("first", F.struct(F.col("least").isNull(), "least", "first")).alias("keep_row"))
    known = out.keep(by_class.select("f1", "f2", "label").join(whole, "label").select("f1", "f2", "component_id", "keep_row"))
    work.clear()
    joined = signed.drop("sig").join(known, ["f1", "f2"], "left")
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("row") == F.col("keep_row")).otherwise(F.lit(True)).alias("kept"),
        *names[2:],
        "row",
    )
