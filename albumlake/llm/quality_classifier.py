"""Quality classifier: ordinal cumulative-link regression on graded ratings.

All grades share one vector of weights over hashed text features; ordered thresholds cut its score:
P(grade <= k) = sigmoid(threshold_k - score). From these come the expected grade and the tail
probability of reaching a grade, by which documents are selected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, pieces

BITS = 18
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _bucket(name: str, share: float) -> bytes:
    """A feature for each octave of a share, from below 1 % to all."""
    return b"\x00%s:%d" % (name.encode(), int(np.ceil(np.log2(max(share, 0.0078125)))))


class Features(dict):
    """Word -> number of its hashed feature (a memo of bounded size)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        core = word.strip(_MARKS).lower()
        n = self[word] = xxhash.xxh3_64_intdigest(core or word) >> (64 - BITS)
        return n

    def of(self, text: bytes) -> np.ndarray:
        """Distinct features of a text: its words without marks and case, and buckets of its shape."""
        words = text.split()
        n = len(words) or 1
        kinds = set(words)
        upper = sum(w.isupper() for w in words)
        ended = sum(w[-1] in b"#*$%&!|<>" for w in words)
        again = sum(map(bytes.__eq__, words, words[1:]))
        lines = [x for x in text.split(b"\n") if x.strip()]
        shape = [
            _bucket("upper", upper / n),
            _bucket("marks", ended / n),
            _bucket("again", again / n),
            _bucket("kinds", len(kinds) / n),
            _bucket("lines", len(set(lines)) / (len(lines) or 1)),
            b"\x00words:%d" % len(words).bit_length(),
        ]
        numbers = set(map(self.__getitem__, kinds))
        numbers.update(xxhash.xxh3_64_intdigest(s) >> (64 - BITS) for s in shape)
        return np.fromiter(sorted(numbers), np.int32)


def _extract(batches):
    features = Features()
    for batch in batches:
        for part in pieces(batch, rows=500):
            rows = [features.of(t) for t in as_bytes(part.column("text"))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "grade", "key")), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "grade", "key", "features"])


class Ordinal:
    """Shared weights and ordered thresholds, fitted by full-batch Adam on the penalised likelihood."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    @classmethod
    def fit(cls, rows: list[np.ndarray], rated: np.ndarray, rounds: int = 250, rate: float = 0.05, penalty: float = 2e-4, least: int = 3) -> Ordinal | None:
        grades = sorted(set(rated.tolist()))
        if len(grades) < 2:
            return None
        y = np.searchsorted(grades, rated)
        n = np.array([len(r) for r in rows], np.int64)
        flat = np.concatenate(rows)
        # A feature of fewer documents says more about those than about quality.
        kept = np.bincount(flat, minlength=1 << BITS) >= least
        use = kept[flat]
        of, flat = np.repeat(np.arange(len(rows)), n)[use], flat[use]
        scale = 1 / np.sqrt(np.maximum(np.bincount(of, minlength=len(rows)), 1))
        k = len(grades) - 1
        share = np.cumsum(np.bincount(y, minlength=k + 1))[:-1] / len(y)
        cut = np.log(share / (1 - share))
        # Thresholds as a first one and logarithms of the gaps stay in order.
        p = np.concatenate([np.zeros(1 << BITS), cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])
        m, v, size = np.zeros_like(p), np.zeros_like(p), 1 << BITS
        for t in range(1, rounds + 1):
            w, gaps = p[:size], np.exp(p[size + 1 :])
            th = p[size] + np.concatenate([[0], np.cumsum(gaps)])
            score = np.bincount(of, w[flat], len(rows)) * scale
            edge = np.concatenate([[-np.inf], th, [np.inf]])
            hi, lo = _sigmoid(edge[y + 1] - score), _sigmoid(edge[y] - score)
            inside = np.maximum(hi - lo, 1e-9)
            d_hi, d_lo = hi * (1 - hi) / inside, lo * (1 - lo) / inside
            g_score = (d_hi - d_lo) / len(y)  # of the mean negative log-likelihood
            g_w = np.bincount(flat, (g_score * scale)[of], size) + penalty * w / max(1.0, np.sqrt(len(y)))
            g_th = (np.bincount(y, d_lo, k + 1)[1:] - np.bincount(y, d_hi, k + 1)[:-1]) / len(y)
            g_gap = np.cumsum(g_th[::-1])[::-1][1:] * gaps
            g = np.concatenate([g_w, [g_th.sum()], g_gap])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p -= rate * 4 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        th = p[size] + np.concatenate([[0], np.cumsum(np.exp(p[size + 1 :]))])
        return cls(grades, np.where(kept, p[:size], np.nan).astype(np.float32), th)

    def grade(self, features: np.ndarray) -> tuple[float, list[float]]:
        """Expected grade, and P(grade >= g) for each grade above the lowest."""
        w = self.weights[features]
        w = w[~np.isnan(w)]
        score = float(w.sum(dtype=np.float64)) / np.sqrt(max(len(w), 1))
        tail = 1 - _sigmoid(self.thresholds - score)
        return float(self.grades[0] + (np.diff(self.grades) * tail).sum()), tail.tolist()


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _score(model: Ordinal | None, at_least: int, names: list[str]):
    def run(batches):
        features = Features()
        for batch in batches:
            for part in pieces(batch, rows=500):
                if model is None:
                    expected, tail = [None] * part.num_rows, [None] * part.num_rows
                else:
                    level = next((i for i, g in enumerate(model.grades[1:]) if g >= at_least), len(model.grades) - 2)
                    graded = [model.grade(features.of(t)) for t in as_bytes(part.column("text"))]
                    expected, tail = [e for e, _ in graded], [t[level] for _, t in graded]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], names=[*names, "expected_grade", "tail"])

    return run


def rating(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 2 for good text without abuse, less one for either fault. Rows with nulls don't rate;
    several ratings of one document count as their lowest."""
    rated = labels.select(F.col("doc_id").cast("long"), (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))
    return rated.dropna().groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(df: DataFrame, ratings: DataFrame, max_rows: int = 12_000, max_features: int = 1 << 26) -> Ordinal | None:
    """Fit on a bounded sample of the rated rows: of the ``max_rows`` rated ids with the smallest
    hashes, the first ``max_rows`` distinct texts by the same order, as many as have ``max_features``
    features together (some hundred thousand texts of ordinary length). Whole texts of any length are read, by
    the executors, and only the sample's features come to the driver, at most 2**18 of a text."""
    order = [F.xxhash64(F.lit(11), "doc_id"), F.col("doc_id")]
    ids = ratings.orderBy(*order).limit(max_rows)
    rated = df.join(F.broadcast(ids), "doc_id").select("doc_id", "grade", F.xxhash64("text").alias("key"), "text")
    work = Scratch(df.sparkSession)
    rows = rated.mapInArrow(_extract, "doc_id long, grade int, key long, features array<int>").groupBy("doc_id", "key").agg(F.first("grade").alias("grade"), F.first("features").alias("features"))
    rows = work.keep(rows)
    sizes = rows.select(*order, "key", F.size("features").alias("n")).orderBy(*order, "key").limit(max_rows).toArrow().column("n").to_numpy()
    fits = int((np.cumsum(sizes) <= max_features).sum())
    sample = rows.orderBy(*order, "key").limit(fits).select("grade", "features").toArrow().combine_chunks()
    work.clear()
    if not sample.num_rows:
        return None
    return Ordinal.fit([x.values.to_numpy() for x in sample.column("features")], sample.column("grade").to_numpy())


def quality_classifier(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: int = 2, threshold: float = 0.5, carry: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, expected_grade, tail (P(grade >= at_least)), kept.

    ``labels`` has doc_id, quality and toxic (0 or 1); see ``rating``. Documents whose tail
    probability is below ``threshold`` aren't kept. A null text counts as empty and is graded like
    any other; with fewer than two grades to learn from, grades are null and all rows are kept.
    Null or repeated ids are ordinary rows; extra columns are ignored; an empty table gives an empty
    result. ``carry`` is a column that comes out as ``carried``.
    """
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([carry.alias("carried")] if carry is not None else []))
    model = train(src.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), rating(labels))
    names = [c for c in src.columns if c != "text" or carry is not None]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema if f.name in names) + ", expected_grade double, tail double"
    scored = src.mapInArrow(_score(model, at_least, names), schema)
    return scored.withColumn("kept", F.coalesce(F.col("tail") >= threshold, F.lit(True)))
