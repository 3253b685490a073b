"""Exact duplicates by composable polynomial fingerprints.

Every text is cut into chunks of bytes. Each chunk gets two polynomial hashes (modulo two primes
below 2**31); hashes of neighbouring chunks combine by shifting the left one by the length of the
right one, so chunks can be hashed independently and in any order. Rows with equal (length, hashes)
are only candidates: their texts are then compared chunk by chunk, and a group in which any chunk differs
is split by the full SHA-256 of its texts. The parts of a huge text are hashed by several tasks; equal
chunks of a large group become one in each task before they meet those of others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, bitmap, bitmap_bits, in_bitmap, pieces, text_or_empty

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
CHUNK = 1 << 16
KEY = ["n_bytes", "h1", "h2"]
HUGE = 1 << 23  # bytes from which a text's parts are hashed by several tasks
PART = 64 * CHUNK  # bytes of such a part


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**(n - 1), ..., base**1, 1, each modulo prime."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n][::-1].copy()


_POWERS: list[np.ndarray] = []


def chunk_hash(data: bytes) -> tuple[int, int, int]:
    """(length, hash, hash) of one chunk of at most ``CHUNK`` bytes."""
    if not _POWERS:
        _POWERS.extend(_powers(b, p, CHUNK) for b, p in zip(BASES, PRIMES))
    a = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    return (len(a), *(int(np.dot(a, w[CHUNK - len(a) :])) % p for w, p in zip(_POWERS, PRIMES)))


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """Fingerprint of the concatenation, from the fingerprints of its two parts (associative)."""
    return (left[0] + right[0], *((a * pow(b, right[0], p) + c) % p for a, c, b, p in zip(left[1:], right[1:], BASES, PRIMES)))


def fingerprint(data: bytes, chunk: int = CHUNK) -> tuple[int, int, int]:
    view, out = memoryview(data), (0, 0, 0)
    for i in range(0, len(data), chunk):
        out = combine(out, chunk_hash(view[i : i + chunk]))
    return out


def _fingerprints(huge: int, part: int):
    """Fingerprints of texts; a huge text gives its parts instead."""
    names = ["row", "doc_id", "sha", *KEY, "seq", "part"]
    types = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.binary()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        for batch in batches:
            for some in pieces(batch):
                rows = []
                for row, doc, sha, text in zip(*(some.column(c).to_pylist() for c in ("row", "doc_id", "sha")), as_bytes(some.column("text"))):
                    if len(text) <= huge:
                        rows.append((row, doc, sha, *fingerprint(text), None, None))
                    else:
                        for seq, at in enumerate(range(0, len(text), part)):
                            yield table([(row, doc, sha, None, None, None, seq, text[at : at + part])])
                if rows:
                    yield table(rows)

    return run


def _parts(batches):
    """The fingerprint of each part, and what a hash to its left is multiplied by."""
    names = ["row", "doc_id", "sha", "seq", *KEY, "s1", "s2"]
    for batch in batches:
        for some in pieces(batch, "part"):
            f = [fingerprint(x) for x in some.column("part").to_pylist()]
            columns = [[x[i] for x in f] for i in range(3)] + [[pow(b, x[0], p) for x in f] for b, p in zip(BASES, PRIMES)]
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names[:4]), *(pa.array(c, pa.int64()) for c in columns)], names=names)


def _combined(parts: DataFrame) -> DataFrame:
    """(row, doc_id, sha, fingerprint) of whole texts from those of their parts, whichever task hashed them."""
    hashed = parts.select("row", "doc_id", "sha", "seq", "part").repartition("row", "seq").mapInArrow(_parts, "row long, doc_id long, sha string, seq long, n_bytes long, h1 long, h2 long, s1 long, s2 long")
    lists = hashed.groupBy("row", "doc_id", "sha").agg(F.array_sort(F.collect_list(F.struct("seq", *KEY, "s1", "s2"))).alias("parts"))
    zero = F.struct(*[F.lit(0).cast("long").alias(k) for k in KEY])
    add = lambda h, s, p: lambda left, x: (left[h] * x[s] + x[h]) % p
    one, two = add("h1", "s1", PRIMES[0]), add("h2", "s2", PRIMES[1])
    whole = F.aggregate("parts", zero, lambda left, x: F.struct((left["n_bytes"] + x["n_bytes"]).alias("n_bytes"), one(left, x).alias("h1"), two(left, x).alias("h2")))
    return lists.withColumn("f", whole).select("row", "doc_id", "sha", *[F.col(f"f.{k}").alias(k) for k in KEY])


def _place(sha, bits: int):
    """Place of a digest in a bitmap of at most 2**28 bits."""
    return F.conv(F.substring(sha, 1, 7), 16, 10).cast("long") % bits


def _candidate_chunks(marked: np.ndarray, bits: int, most: int = 8 << 20):
    """Chunks of the texts whose digests are marked, with the fingerprints of their texts."""
    types = [pa.int64()] * 4 + [pa.binary()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)], names=[*KEY, "seq", "chunk"])

    def run(batches):
        rows, total = [], 0
        for batch in batches:
            for some in pieces(batch):
                for sha, text in zip(some.column("sha").to_pylist(), as_bytes(some.column("text"))):
                    if in_bitmap(marked, int(sha[:7], 16) % bits):
                        key = fingerprint(text)
                        for i in range(0, len(text), CHUNK):
                            rows.append((*key, i // CHUNK, text[i : i + CHUNK]))
                            total += len(rows[-1][-1])
                            if total > most:
                                yield table(rows)
                                rows, total = [], 0
        yield table(rows)

    return run


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 27, huge: int = HUGE, part: int = PART) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, row.

    Texts are equal when byte-identical; a null text counts as empty, so null and empty texts are
    one group. Of a group the row with the largest doc_id stays (a null id is smallest); among
    repeated rows of that id exactly one stays. ``row`` is a unique number of the input row. Extra
    columns of ``df`` are ignored. An empty table gives an empty result.

    Texts of any length are read whole. One of more than ``huge`` bytes is hashed in parts of ``part``
    bytes (a multiple of the chunk) by several tasks; batches are cut by bytes, so a task holds some
    megabytes beside the text at hand.

    ``max_bits`` bounds the broadcast bitmap that keeps non-candidates out of the comparison's
    shuffle; a full bitmap lets more rows through and never changes the result.
    """
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    out, work = Scratch(df.sparkSession), Scratch(df.sparkSession)
    told = src.withColumn("sha", F.sha2("text", 256))
    schema = "row long, doc_id long, sha string, n_bytes long, h1 long, h2 long, seq long, part binary"
    first = out.keep(told.select(F.monotonically_increasing_id().alias("row"), "doc_id", "sha", "text").mapInArrow(_fingerprints(huge, part), schema))
    fps, parts = first.filter("part IS NULL").drop("seq", "part"), first.filter("part IS NOT NULL")
    if not parts.isEmpty():
        fps = fps.unionByName(out.keep(_combined(parts)))
    leader = F.max(F.struct("doc_id", "row"))
    shared = work.keep(fps.groupBy(*KEY).agg(F.count("*").alias("n"), leader.alias("leader")).filter("n > 1"))
    copies = work.keep(fps.join(shared.select(*KEY), KEY, "left_semi").select("sha"))
    bits = bitmap_bits(copies.count(), min(max_bits, 1 << 28))
    marked = bitmap(copies, _place(F.col("sha"), bits), bits)

    # Equal chunks fall together, in each task first; a place that has more than one is a difference.
    chunks = told.select("sha", "text").mapInArrow(_candidate_chunks(marked, bits), "n_bytes long, h1 long, h2 long, seq long, chunk binary")
    kinds = chunks.distinct().groupBy(*KEY, "seq").agg(F.count("*").alias("kinds"))
    broken = kinds.filter("kinds > 1").select(*KEY).distinct()
    broken = out.keep(broken)
    work.clear()
    if broken.isEmpty():
        split = fps.withColumn("part", F.lit(""))
    else:  # different texts of one fingerprint: the full digest tells them apart
        split = fps.join(broken.withColumn("bad", F.lit(True)), KEY, "left").withColumn("part", F.when(F.col("bad"), F.col("sha")).otherwise(""))
    key = [*KEY, "part"]
    groups = split.groupBy(*key).agg(F.count("*").alias("n"), leader.alias("leader")).filter("n > 1")
    return split.join(groups, key, "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("leader.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("leader.row"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "row",
    )
