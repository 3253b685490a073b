"""Periodic runs of words by recursive frequency splitting.

A run is a maximal stretch with smallest period q and a length of at least max(6, 4 q). Each of its
words occurs at least four times in it, so a word that occurs less often within a segment is in none
of the segment's runs and splits it. The parts are split by their own counts, until nothing changes.
What survives is scanned lag by lag: a run of period q holds three positions in a row, q apart, each
of which repeats after q words, so lag q looks at every q-th position only and all lags together at
about n log n. A hit inside a run of a smaller period is that run again and is passed over; any other
is extended to both sides and measured.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, pieces

LEAST, TIMES = 6, 4  # words and periods that a run has at least
RUN = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])


def segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the parts in which every word occurs at least ``TIMES`` times."""
    todo, out = [(0, len(ids))], []
    while todo:
        a, b = todo.pop()
        if b - a < LEAST:
            continue
        _, word, count = np.unique(ids[a:b], return_inverse=True, return_counts=True)
        cuts = np.flatnonzero(count[word] < TIMES)
        if not len(cuts):
            out.append((a, b))
            continue
        edge = np.concatenate(([-1], cuts, [b - a]))
        for i in np.flatnonzero(np.diff(edge) > LEAST):
            todo.append((a + int(edge[i]) + 1, a + int(edge[i + 1])))
    return sorted(out)


def _repeats(x: np.ndarray, y: np.ndarray) -> int:
    """How many first elements of two arrays are equal."""
    at, step, n = 0, 64, min(len(x), len(y))
    while at < n:
        differ = x[at : at + step] != y[at : at + step][: len(x) - at]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, step = at + len(differ), step * 2
    return n


def scan(x: np.ndarray, far: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment; ``far`` has, for each word, the end of the
    furthest run found so far that holds it."""
    out, n = [], len(x)
    for q in range(1, n // TIMES + 1):
        every = x[::q]
        again = every[1:] == every[:-1]
        if not again.any():
            continue
        at = np.flatnonzero(again[2:] & again[1:-1] & again[:-2]) * q
        at = at[far[at] <= at + 3 * q] if len(at) else at
        for more in (q // 3, 2 * q // 3, q + q // 2):
            at = at[x[at + more] == x[at + more + q]] if len(at) else at
        end = 0
        for i in at.tolist():
            if i < end:
                continue
            right = i + _repeats(x[i : n - q], x[i + q :])
            if right <= i + 2 * q:
                continue  # what lies between the three positions doesn't repeat
            left = i - _repeats(x[:i][::-1], x[q : i + q][::-1])
            end = right
            if right - left + q >= max(LEAST, TIMES * q):
                out.append((left, right - left + q, q))
                np.maximum(far[left : right + q], right + q, out=far[left : right + q])
    return out


def find_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    far, out = None, []
    for a, b in segments(ids):
        far = np.zeros(len(ids), np.int64) if far is None else far
        out += [(a + s, n, q) for s, n, q in scan(ids[a:b], far[a:b])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        depth[s + q] += 1
        depth[s + n] -= 1
    gone = np.cumsum(depth)[:-1] > 0
    return [w for w, x in zip(words, gone.tolist()) if not x]


def _found(batches):
    for batch in batches:
        for part in pieces(batch):
            words = [t.split() for t in as_bytes(part.column("text"))]
            runs = [find_runs(w) for w in words]
            flat = [r for x in runs for r in x]
            at = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            columns = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(map(len, words), pa.int64()),
                    pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(columns, fields=list(RUN))),
                    pa.array([b" ".join(collapse(w, r)) for w, r in zip(words, runs)], pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs, collapsed.

    ``runs`` has all runs (start, length, period; words counted from 0) of the whole text by start,
    then period, and ``collapsed`` the words that no run holds after its first period, with single
    spaces between. Runs of different periods may overlap. A null text counts as empty: no words, no
    runs, ''. Null ids, ties and repeated rows are rows as any other; extra columns are ignored and
    an empty table gives an empty result. A text is worked on by itself, long ones in memory of
    about 100 bytes a word, and in time that grows about as n log n.
    """
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_found, "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string")


def run_digest(found: DataFrame) -> DataFrame:
    """The run with the greatest exponent, and digests of the runs and of the collapsed text."""

    def before(x, y):
        """By length / period (compared without division), then start, then period."""
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        tie = F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"])
        return F.when(a > b, -1).when(a < b, 1).otherwise(F.signum(tie).cast("int"))

    top = found.select("*", F.get(F.array_sort("runs", before), 0).alias("top"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    written = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(written, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
