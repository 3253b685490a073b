"""Language identification by prediction by partial matching.

Each language has a context tree over bytes up to a fixed order. A context that has seen n symbols
of d kinds gives d / (n + d) to an escape to the next shorter context, from which the symbols
already offered are excluded; the shortest one falls back to all bytes alike. Statistics are frozen
after learning, so the code length of a byte after its history is fixed, and a text's code length is
an exact sum. Trees are sorted tables of what was seen; a piece of text looks up each of its distinct
histories once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, pieces

ORDER = 3
CHUNK = 1 << 22  # bytes of a text that are worked on at once


def grams(text: bytes) -> np.ndarray:
    """Each byte with the ``ORDER`` before it as one number; ``text`` begins with such a history."""
    s = np.frombuffer(text, np.uint8).astype(np.uint32)
    out = np.zeros(len(s) - ORDER, np.uint32)
    for k in range(ORDER + 1):
        out = out << np.uint32(8) | s[k : len(s) - ORDER + k]
    return out


def chunks(text: bytes):
    """The text in parts of bounded size, each after its history: line ends before the first."""
    padded = b"\n" * ORDER + text if len(text) <= CHUNK else None
    if padded is not None:
        yield padded
        return
    for i in range(0, len(text), CHUNK):
        yield (b"\n" * ORDER + text[: i + CHUNK] if i == 0 else text[i - ORDER : i + CHUNK])


def counted(texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the texts and how often each is there."""
    found = [np.unique(grams(c), return_counts=True) for t in texts if t for c in chunks(t)]
    if not found:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    every, where = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return every, np.bincount(where, np.concatenate([n for _, n in found])).astype(np.int64)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether there) of the wanted numbers in sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Tree:
    """The contexts of one language. Of each order: the contexts seen often enough with the bits of
    their escape, and the symbols seen after them with their bits."""

    def __init__(self, code: np.ndarray, count: np.ndarray, size: int, least: int):
        self.size, self.levels = size, []
        for order in range(ORDER + 1):
            own, where = np.unique(code % size ** (order + 1), return_inverse=True)
            n_own = np.bincount(where, count)
            context, where = np.unique(own // size, return_inverse=True)
            n, d = np.bincount(where, n_own), np.bincount(where)
            enough = n >= least
            lower = np.exp2(-self.bits(own % size**order if order else own, order - 1))
            mass = np.maximum(1 - np.bincount(where, lower, len(context)), 1e-12)  # of the symbols not seen there
            escape = -np.log2(np.maximum(d / (n + d) / mass, 1e-12))
            full = d == size  # nothing is left to escape to
            share = np.where(full[where], n_own / n[where], n_own / (n + d)[where])
            use = enough[where]
            self.levels.append((context[enough], escape[enough].astype(np.float32), own[use], -np.log2(share[use]).astype(np.float32)))

    def bits(self, code: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of the last symbol of each code after the ``order`` symbols before it."""
        out, todo = np.zeros(len(code)), np.arange(len(code))
        for k in range(order, -1, -1):
            contexts, escape, symbols, share = self.levels[k]
            now = code[todo] % self.size ** (k + 1)
            at, there = _find(symbols, now)
            out[todo[there]] += share[at[there]]
            todo, now = todo[~there], now[~there]
            at, there = _find(contexts, now // self.size)
            out[todo[there]] += escape[at[there]]
        out[todo] += 8
        return out


class ByteModel:
    """Frozen context trees of all languages, over an alphabet of the bytes seen in learning and one
    symbol for all others (which no tree tells apart)."""

    def __init__(self, texts: dict[str, list[bytes]], least: int = 2):
        self._fit({lang: counted(own) for lang, own in texts.items()}, least)

    @classmethod
    def of(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]], least: int = 2) -> ByteModel:
        """From the distinct grams of each language and their counts."""
        model = cls.__new__(cls)
        model._fit(counts, least)
        return model

    def _fit(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], least: int) -> None:
        self.langs = sorted(counts)
        seen = np.unique(np.concatenate([np.array([10], np.uint32), *[g & np.uint32(255) for g, _ in counts.values()]]))
        self.size = len(seen) + (len(seen) < 256)
        self.symbol = np.full(256, self.size - 1, np.int64)
        self.symbol[seen] = np.arange(len(seen))
        self.trees = [Tree(self.code(counts[lang][0]), counts[lang][1], self.size, least) for lang in self.langs]

    def code(self, gram: np.ndarray) -> np.ndarray:
        out = np.zeros(len(gram), np.int64)
        for k in range(ORDER, -1, -1):
            out = out * self.size + self.symbol[gram >> np.uint32(8 * k) & np.uint32(255)]
        return out

    def history(self, text: bytes) -> np.ndarray:
        """Symbols of the text after as many line ends as the longest context needs."""
        return self.symbol[np.frombuffer(b"\n" * ORDER + text, np.uint8)]

    @property
    def rows(self) -> list[np.ndarray]:
        """Row in ``bits`` of each possible history."""
        return [np.arange(self.size**ORDER) for _ in self.langs]

    @property
    def bits(self) -> list[np.ndarray]:
        """The whole code of each language written out, to look at: of a small alphabet only."""
        return [tree.bits(np.arange(self.size ** (ORDER + 1))).reshape(-1, self.size) for tree in self.trees]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        parts = [(i, c) for i, t in enumerate(texts) if t for c in chunks(t)]
        start = 0
        while start < len(parts):
            end, total = start, 0
            while end < len(parts) and (end == start or total + len(parts[end][1]) <= CHUNK):
                total += len(parts[end][1])
                end += 1
            found = [grams(c) for _, c in parts[start:end]]
            own, where = np.unique(np.concatenate(found), return_inverse=True)
            code, of = self.code(own), np.array([i for i, _ in parts[start:end]])
            first = np.cumsum([0, *map(len, found[:-1])])
            for k, tree in enumerate(self.trees):
                np.add.at(out[:, k], of, np.add.reduceat(tree.bits(code)[where], first))
            start = end
        return out


def held_out(id_col: str, of: int = 3, rest: int = 1) -> Column:
    """Whether the document is kept from learning; false for a null id, which has no checksum."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of == rest, F.lit(False))


def _counted(batches):
    for batch in batches:
        for part in pieces(batch):
            for lang, text in zip(part.column("lang").to_pylist(), as_bytes(part.column("text"))):
                gram, n = counted([text])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def learn(df: DataFrame, id_col: str, text_col: str, lang_col: str, max_docs: int, max_langs: int) -> ByteModel:
    """Context trees from a bounded sample of the labelled documents that aren't held out.

    The sample has, per language, the ``max_docs`` distinct (id, text) with the smallest hashes; their
    texts are read whole. Executors count what is in them, and only the distinct runs of four bytes of
    a language and their counts come to the driver. More than ``max_langs`` languages are refused.
    """
    labelled = df.filter(~held_out(id_col) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    labelled = labelled.select(F.col(lang_col).alias("lang"), F.xxhash64(F.lit(5), id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    distinct = labelled.groupBy("lang", "key").agg(F.lit(1).alias("one"))
    # first the smallest of each part of a language, then those of the language
    few = distinct.withColumn("r", F.row_number().over(Window.partitionBy("lang", F.pmod("key", F.lit(8))).orderBy("key"))).filter(F.col("r") <= max_docs)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).filter(F.col("r") <= max_docs)
    chosen = few.select("lang", "key").limit(max_docs * max_langs + 1).collect()
    if len({r["lang"] for r in chosen}) > max_langs or len(chosen) > max_docs * max_langs:
        raise ValueError(f"more languages than max_langs = {max_langs}")
    keys = df.sparkSession.createDataFrame(chosen, "lang string, key long")
    texts = labelled.join(F.broadcast(keys), ["lang", "key"]).groupBy("lang", "key").agg(F.first("text").alias("text"))
    seen = texts.select("lang", "text").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().combine_chunks()
    lang, gram, n = np.array(seen.column("lang").to_pylist(), object), seen.column("gram").to_numpy().astype(np.uint32), seen.column("n").to_numpy()
    counts = {x: (np.empty(0, np.uint32), np.empty(0, np.int64)) for x in {r["lang"] for r in chosen}}
    for x in counts:
        own = lang == x
        counts[x] = (gram[own], n[own])
    return ByteModel.of(counts)


def _predict(known):
    def run(batches):
        model = known.value
        for batch in batches:
            for part in pieces(batch, size=1 << 20, rows=500):
                texts = as_bytes(part.column("text"))
                bits = model.code_lengths(texts)
                letters = np.array([any(map(str.isalpha, t or "")) for t in part.column("text").to_pylist()], bool)
                if model.langs:
                    best = bits.argmin(1)
                    gap = np.minimum(bits - bits.min(1, keepdims=True), 1000)
                    score = np.where(letters, 1 / np.exp2(-gap).sum(1), 0.0)
                else:
                    best, score = np.zeros(len(texts), int), np.zeros(len(texts))
                lang = [model.langs[b] if k and model.langs else "und" for b, k in zip(best, letters)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 300, max_langs: int = 32) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (posterior of the language, 0 to 1).

    A null text, or one without a letter, is ``und`` with score 0; so is every text if there is
    nothing to learn from. Null or repeated ids are ordinary rows; equal code lengths go to the
    first language by name; extra columns are ignored; an empty table gives an empty result. The
    only bounded sample is the one that the classifier is fitted on (``learn``); texts to be
    predicted are read whole, in one pass without a shuffle.
    """
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = learn(src, "doc_id", "text", "lang", max_docs, max_langs)
    return src.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(_predict(df.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double")
