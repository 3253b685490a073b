"""Best-fit packing by planning over the histogram of lengths.

Documents become pieces of at most ``size`` tokens. Pieces are counted by length, best-fit
decreasing runs over the counts (at most ``size`` of them, however many pieces there are), and its
plan says which ranks within a length go to which sequences. Pieces then find their place by their
rank within their length.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pieces, text_or_empty

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Marks that may end a word whose tokens can be told without the tokenizer's own splitting: letters
#: that stay single when lower-cased, then marks. Such words are put together from these two parts.
_MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


def _byte_letters() -> dict[int, str]:
    """Latin-1 character -> how byte-level vocabularies spell its UTF-8: visible bytes as themselves,
    the others as characters from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    spelt = [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]
    return {c: "".join(spelt[b] for b in chr(c).encode("utf-8")) for c in range(256)}


class WordIds(dict):
    """Word -> row of its token ids in a flat array: a memo of bounded size that one worker keeps.

    White space separates tokens of this vocabulary, so a text's ids are those of its words. Words
    that differ by case share a row. Key "\\n", which is no word, is the end of a document.
    """

    def __init__(self, content: str, end_id: int, limit: int = 200_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.end_id, self.limit = Tokenizer.from_str(content), end_id, limit
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.renew()

    def renew(self) -> None:
        self.clear()
        self.ids, self.first, self.many = array("I", [self.end_id]), array("q", [0]), array("q", [1])
        self["\n"] = 0

    def add(self, word: str, ids) -> int:
        row = self[word] = len(self.first)
        self.first.append(len(self.ids))
        self.many.append(len(ids))
        self.ids.extend(ids)
        return row

    def part(self, part: str) -> int:
        """Row of a part that is one word for the model, in lower case."""
        row = self.get(part)
        if row is None:
            spelt = part if part.isascii() else part.translate(self.letters)
            row = self.add(part, [t.id for t in self.model.tokenize(spelt)])
        return row

    def of_row(self, row: int) -> array:
        first = self.first[row]
        return self.ids[first : first + self.many[row]]

    def learn(self, words) -> None:
        """Rows for words that the memo may not have."""
        for word in words:
            letters = word.rstrip(_MARKS)
            if letters and not (letters.isalpha() and (letters.isascii() or max(letters) <= "\xff")):
                self.add(word, self.tokenizer.encode(word, add_special_tokens=False).ids)
                continue
            n = len(letters)
            if n == len(word):
                self[word] = self.part(word.lower()) if n else self.add(word, ())
            elif n:
                ids = self.of_row(self.part(letters.lower()))
                self.add(word, ids + self.of_row(self.part(word[n:])))
            else:
                self.part(word)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with its end, in one array; number of ids per text."""
        if len(self) > self.limit:
            self.renew()
        words, sizes = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            # Spaces and line feeds only: any other white space is left to the tokenizer.
            own = t.replace("\n", " ").split(" ")
            words += own
            words.append("\n")
            sizes[i] = len(own) + 1
        self.learn(set(words).difference(self))
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        first, many, ids = (np.array(x) for x in (self.first, self.many, self.ids))
        n = many[rows]
        ends = np.cumsum(n)
        at = np.repeat(first[rows] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        last = np.cumsum(sizes) - 1
        return ids[at].astype("<u4"), np.diff(ends[last], prepend=0)


def worker_memo(content: str, end_id: int) -> WordIds:
    """The memo of this Python worker, which lasts over its tasks."""
    kept = sys.modules.setdefault("_albumlake_worker", SimpleNamespace(memos={})).memos
    key = (hash(content), end_id)
    if key not in kept:
        kept.clear()
        kept[key] = WordIds(content, end_id)
    return kept[key]


def _pieces(tokenizer_json: str, end_id: int, size: int):
    def run(batches):
        memo = worker_memo(tokenizer_json, end_id)
        for batch in batches:
            for part in pieces(batch, size=1 << 20, rows=500):
                ids, n = memo.texts([t or "" for t in part.column("text").to_pylist()])
                data, start, rows = memoryview(ids).cast("B"), 0, []
                for d, m in zip(part.column("doc_id").to_pylist(), n.tolist()):
                    for k, a in enumerate(range(0, m, size)):
                        b = min(a + size, m)
                        rows.append((d, k, a, b - a, zlib.crc32(data[4 * (start + a) : 4 * (start + b)])))
                    start += m
                cols = zip(*rows)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(counts: dict[int, int], size: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """length -> [(first rank, pieces a sequence, first sequence, offset), ...] by best-fit decreasing.

    Sequences with equal room are kept as ranges of numbers; a step gives every sequence of a range
    as many pieces of one length as fit, so steps depend on lengths and ranges, not on pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges (first sequence, how many)
    opened, out = 0, {}
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        rows = out[length] = []

        def put(first: int, n: int, free: int, each: int) -> None:
            nonlocal left, rank
            rows.append((rank, each, first, size - free))
            rank, left = rank + n * each, left - n * each
            if free - each * length:
                room.setdefault(free - each * length, []).append((first, n))

        for free in sorted(r for r in room if r >= length):
            each = free // length
            while left and room[free]:
                first, n = room[free].pop()
                whole = min(n, left // each)
                if whole:
                    put(first, whole, free, each)
                if whole < n and left:
                    part = left
                    put(first + whole, 1, free, part)
                    whole += 1
                if whole < n:
                    room[free].append((first + whole, n - whole))
            if not room[free]:
                del room[free]
            if not left:
                break
        each = size // length
        if left // each:
            n = left // each
            put(opened, n, size, each)
            opened += n
        if left:
            put(opened, 1, size, left)
            opened += 1
    return out


def _placed(steps: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                of = np.flatnonzero(length == n)
                p = steps[int(n)]
                at = p[np.searchsorted(p[:, 0], rank[of], "right") - 1]
                into = rank[of] - at[:, 0]
                seq[of], offset[of] = at[:, 2] + into // at[:, 1], at[:, 3] + into % at[:, 1] * n
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def best_fit_packing(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 1, salts: int = 256) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is the path of a vocabulary file that separates tokens at white space. A null
    text counts as empty: its document is the end id alone. Rows with null or repeated ids are
    documents of their own. Extra columns are ignored; an empty table gives an empty result.

    Ranks within a length are counted per (length, salt) and shifted by the counts of the salts
    before, so a length that a third of all pieces have is ranked by ``salts`` tasks. Only the
    histogram (at most ``size`` rows) and the plan made from it pass through the driver.
    """
    with open(tokenizer, encoding="utf-8") as f:
        content = f.read()
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # Salts are written with the pieces: rows that are equal in all columns get different ones too.
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(salts))
    salted = materialize(src.mapInArrow(_pieces(content, end_id, size), PIECE_SCHEMA).withColumn("salt", salt))
    counts = materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = {k: np.array(v, np.int64) for k, v in plan(histogram, size).items()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    ranked = (
        salted.withColumn("within", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
        .join(counts.select("length", "salt", before.alias("before")), ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank"))
    )
    return ranked.mapInArrow(_placed(steps), PIECE_SCHEMA + ", sequence_id long, offset long")
