"""N-gram language model scoring over Elias-Fano tries.

Training text is counted by Spark into words and word triples. Triples are dealt to shards by their
last two words; each shard becomes a trie, last word first: words, then the words before them, then
those before these. A level holds its identifiers relative to the running base of their parent's
range, which makes them one monotone sequence, and monotone pointers to the ranges of its children;
both are Elias-Fano coded with a skip value per block. A query finds the range by the pointers and
searches the successor of base + identifier in it. Smoothed probabilities are kept as 16-bit codes.
The levels are files in the shared folder, which workers map into memory instead of loading.

The model interpolates trigram, bigram and unigram by Dirichlet priors:
P1(w) = (c(w) + 1) / (N + V + 1), P2(w|v) = (c(vw) + m2 P1(w)) / (c(v) + m2) and
P3(w|uv) = (c(uvw) + m3 P2(w|v)) / (c(uv) + m3), over the words of the training texts, their end and
one class for all other words.
"""

from __future__ import annotations

import json
import mmap
import re
import sys
import uuid
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, runs, shared_dir, text_or_empty

BLOCK = 32
WINDOW = np.uint64((1 << 56) - 1)
END = xxhash.xxh3_64_intdigest(b"\n")  # no word has a separator
SHARD = 16 << 20  # bytes of training text to a shard, on average
TOKENS = 2_000_000  # tokens that a worker holds at once, but for a longer single text


#: For select in a word: bytes of ones and of high bits, and the place of the k-th one of each byte.
ONES, HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_IN_BYTE = np.array([[([i for i in range(8) if x >> i & 1] + [0] * 8)[k] for x in range(256)] for k in range(8)], np.int64).ravel()


def byte_sums(x: np.ndarray) -> np.ndarray:
    """Byte i of each result: how many ones bytes 0 to i of the word have."""
    s = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    s = (s & np.uint64(0x3333333333333333)) + ((s >> np.uint64(2)) & np.uint64(0x3333333333333333))
    s += s >> np.uint64(4)
    s &= np.uint64(0x0F0F0F0F0F0F0F0F)
    s *= ONES
    return s


def select(x: np.ndarray, k: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) one of each word; anything where it has fewer."""
    k = np.minimum(k, 63).astype(np.uint64)
    shift = np.minimum(np.bitwise_count(((k * ONES | HIGH) - sums) & HIGH), 7).astype(np.uint64) << np.uint64(3)
    k -= (sums << np.uint64(8)) >> shift & np.uint64(255)
    return shift.astype(np.int64) + _IN_BYTE[((k & np.uint64(7)) << np.uint64(8)) | (x >> shift & np.uint64(255))]


class EliasFano:
    """A non-decreasing sequence of unsigned numbers in about 2 + log2(universe / n) bits each."""

    def __init__(self, parts: dict, name: str):
        self.n, self.low_bits = (int(x) for x in parts[f"{name}.shape"])
        self.high, self.low, self.place, self.skip = (parts[f"{name}.{k}"] for k in ("high", "low", "place", "skip"))
        self.words = np.ndarray((max(len(self.low) - 7, 0),), "<u8", self.low, strides=(1,))  # from any byte on
        self.bits = np.ndarray((len(self.high) - 7,), "<u8", self.high, strides=(1,))
        self.n_bits = int(self.place[-1])

    @staticmethod
    def parts(values: np.ndarray, name: str) -> dict:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(high[-1]) + 1 if n else 0, bool)
        bits[high] = True
        rest = values & np.uint64((1 << low_bits) - 1)
        low = [np.empty(0, np.uint8)]
        for start in range(0, n, 8 * BLOCK * 128):  # whole bytes each
            part = rest[start : start + 8 * BLOCK * 128]
            each = (part[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low.append(np.packbits(each.astype(bool).ravel(), bitorder="little"))
        return {
            f"{name}.shape": np.array([n, low_bits], np.int64),
            f"{name}.high": np.concatenate([np.packbits(bits, bitorder="little"), np.zeros(8, np.uint8)]),
            f"{name}.low": np.concatenate([*low, np.zeros(8, np.uint8)]),
            f"{name}.place": np.append(high[::BLOCK], len(bits)).astype(np.int64),
            f"{name}.skip": values[::BLOCK],
        }

    def _nth(self, start: np.ndarray, r: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the r-th (from 0) one, or zero, at or after bit ``start`` of the high bits."""
        out, todo = None, None
        while out is None or len(todo):
            w = (self.bits[start >> 3] >> (start & 7).astype(np.uint64)) & WINDOW
            if zeros:
                w ^= WINDOW
            sums = byte_sums(w)
            n = (sums >> np.uint64(56)).astype(np.int64)
            place = start + select(w, r, sums)
            on = np.flatnonzero(r >= n)
            if out is None:
                out, todo = place, on
            else:
                out[todo] = place
                todo = todo[on]
            start, r = start[on] + 56, (r - n)[on]
        return out

    def _low(self, index: np.ndarray) -> np.ndarray:
        at = index * self.low_bits
        return (self.words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def _value(self, index: np.ndarray, place: np.ndarray) -> np.ndarray:
        return ((place - index).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(index)

    def access(self, index: np.ndarray) -> np.ndarray:
        return self._value(index, self._nth(self.place[index // BLOCK], index % BLOCK, False))

    def pair(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each number and the next one, which is the next one bit."""
        place = self._nth(self.place[index // BLOCK], index % BLOCK, False)
        w = (self.bits[(place + 1) >> 3] >> ((place + 1) & 7).astype(np.uint64)) & WINDOW
        after = place + 1 + np.bitwise_count(~w & (w - np.uint64(1)))
        far = w == 0
        after[far] = self._nth(place[far] + 1, np.zeros(int(far.sum()), np.int64), False)
        return self._value(index, place), self._value(index + 1, after)

    def find(self, value: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where there is none.

        From the block before it, as many zeros are passed as its high part asks for; what follows
        are the numbers with that high part, in order.
        """
        out = np.full(len(value), -1, np.int64)
        block = np.searchsorted(self.skip, value, "right") - 1
        high = (value >> np.uint64(self.low_bits)).astype(np.int64)
        todo = np.flatnonzero((block >= 0) & (high <= self.n_bits - self.n))
        start, high = self.place[block[todo]], high[todo]
        zeros = high - (start - block[todo] * BLOCK)
        place = start.copy()
        some = zeros > 0
        place[some] = self._nth(start[some], zeros[some] - 1, True) + 1
        low = value[todo] & np.uint64((1 << self.low_bits) - 1)
        while len(todo):
            one = (place < self.n_bits) & ((self.high[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0)
            todo, place, high, low = todo[one], place[one], high[one], low[one]
            known = self._low(place - high)
            same = known == low
            out[todo[same]] = (place - high)[same]
            on = known < low
            todo, place, high, low = todo[on], place[on] + 1, high[on], low[on]
        return out


def relative(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Identifiers of children, in ranges that begin at ``starts``, as one increasing sequence: each
    plus one, on top of the last number of the range before."""
    ids = ids.astype(np.uint64) + np.uint64(1)
    ends = np.append(starts[1:], len(ids))
    last = ids[ends - 1]
    return ids + np.repeat(np.cumsum(last) - last, ends - starts)


def ranges(level: EliasFano, pointers: EliasFano, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last + 1 index of the children of each parent, and the base of their numbers."""
    a, b = (x.astype(np.int64) for x in pointers.pair(parent))
    return a, b, np.where(a > 0, level.access(np.maximum(a - 1, 0)), np.uint64(0))


def child(level: EliasFano, span: tuple, ids: np.ndarray) -> np.ndarray:
    """Index in its level of the child ``ids`` within each of the ``ranges``, or -1."""
    a, b, base = span
    at = level.find(base + ids.astype(np.uint64) + np.uint64(1))
    return np.where((at >= a) & (at < b), at, -1)


def codes(x: np.ndarray, name: str, up: bool = False) -> dict:
    """16-bit codes that never overstate (or, with ``up``, never understate) the numbers."""
    low, high = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
    step = (high - low) / 65535 or 1.0
    code = np.ceil((x - low) / step) if up else np.floor((x - low) / step)
    return {f"{name}.code": np.clip(code, 0, 65535).astype(np.uint16), f"{name}.scale": np.array([low, step])}


def decoded(parts: dict, name: str, at: np.ndarray) -> np.ndarray:
    low, step = parts[f"{name}.scale"]
    return low + step * parts[f"{name}.code"][at]


def write_parts(folder: str, name: str, parts: dict) -> None:
    """Arrays as one file; complete as soon as it is there, whichever attempt wrote it."""
    head, body, at = {}, [], 0
    for k, x in parts.items():
        data = np.ascontiguousarray(x).tobytes()
        head[k] = (x.dtype.str, len(x), at)
        body.append(data + bytes(-len(data) % 8))
        at += len(body[-1])
    top = json.dumps(head).encode()
    top += b" " * (-len(top) % 8)
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    attempt = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(attempt) as f:
        f.write(len(top).to_bytes(8, "little") + top + b"".join(body))
    there = lambda: store.get_file_info(f"{path}/{name}").type == fs.FileType.File
    try:
        if not there():
            store.move(attempt, f"{path}/{name}")
            return
    except OSError:  # some stores don't move onto what another attempt has put there meanwhile
        if not there():
            raise
    store.delete_file(attempt)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))


def map_parts(folder: str, name: str) -> dict:
    """The arrays of a file, mapped into memory; where the store has no local paths, read into it."""
    store, path = _store(folder)
    if isinstance(store, fs.LocalFileSystem):
        with open(f"{path}/{name}", "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with store.open_input_file(f"{path}/{name}") as f:
            data = f.read()
    size = int.from_bytes(data[:8], "little")
    return {k: np.frombuffer(data, kind, n, 8 + size + at) for k, (kind, n, at) in json.loads(data[8 : 8 + size]).items()}


def worker_kept(key: str, make):
    """Something that this Python worker keeps over its tasks (mapped files of one model)."""
    kept = sys.modules.setdefault("_albumlake_models", SimpleNamespace(by_key={})).by_key
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


class Words:
    """Word hash -> number: shards of sorted hashes with counts; a word's number is its rank."""

    def __init__(self, folder: str, shift: int, sizes: list[int]):
        self.folder, self.shift = folder, np.uint64(shift)
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        parts = [map_parts(folder, f"words-{s}") if n else None for s, n in enumerate(sizes)]
        self.hashes = [EliasFano(p, "hash") if p else None for p in parts]
        self.counts = [p["count"] if p else None for p in parts]
        self.n = int(self.base[-1])

    def numbers(self, known: np.ndarray) -> np.ndarray:
        """The numbers of ascending hashes; the number of all words for an unknown one."""
        out = np.full(len(known), self.n, np.int64)
        cut = np.searchsorted(known >> self.shift, np.arange(len(self.hashes) + 1, dtype=np.uint64))
        for s, level in enumerate(self.hashes):
            if level is not None and cut[s] < cut[s + 1]:
                at = level.find(known[cut[s] : cut[s + 1]] - (np.uint64(s) << self.shift))
                out[cut[s] : cut[s + 1]] = np.where(at >= 0, at + self.base[s], self.n)
        return out

    def count_of(self, number: np.ndarray) -> np.ndarray:
        """Training count of each number; 0 for the unknown."""
        known, of = np.unique(number, return_inverse=True)
        out = np.zeros(len(known), np.int64)
        cut = np.searchsorted(known, self.base)
        for s, c in enumerate(self.counts):
            if c is not None and cut[s] < cut[s + 1]:
                out[cut[s] : cut[s + 1]] = c[known[cut[s] : cut[s + 1]] - self.base[s]]
        return out[of]


def hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the end of each text, in one array; where each text begins."""
    words = [t.lower().split() for t in texts]
    size = np.array([len(w) + 1 for w in words], np.int64)
    flat = np.empty(int(size.sum()), np.uint64)
    start = np.cumsum(size) - size
    for a, w in zip(start.tolist(), words):
        flat[a : a + len(w)] = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    flat[start + size - 1] = END
    return flat, start


def pools(batches, columns: list[str]):
    """Texts of batches with other columns, gathered up to ``TOKENS`` (a word has 6 bytes or so)."""
    texts, rest, size = [], {c: [] for c in columns}, 0
    for batch in batches:
        others = [batch.column(c).to_pylist() for c in columns]
        for i, t in enumerate(as_bytes(batch.column("text"))):
            texts.append(t)
            size += len(t) // 6 + 1
            for c, x in zip(columns, others):
                rest[c].append(x[i])
            if size >= TOKENS:
                yield texts, rest
                texts, rest, size = [], {c: [] for c in columns}, 0
    if texts:
        yield texts, rest


def packed(*columns: np.ndarray) -> bytes:
    """32-bit columns as one compressed blob, bytes of equal weight together."""
    raw = b"".join(np.ascontiguousarray(c.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpacked(blob: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True), np.uint8)
    return [x.T.copy().view("<u4").ravel().astype(np.int64) for x in raw.reshape(n, 4, -1)]


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "blob"])


def _count_words(shift: int):
    def run(batches):
        for texts, _ in pools(batches, []):
            h, n = np.unique(hashes(texts)[0], return_counts=True)
            shard = (h >> np.uint64(shift)).astype(np.int64)
            start = runs(shard)
            rows = []
            for a, b in zip(start, [*start[1:], len(h)]):
                rows.append((int(shard[a]), packed(h[a:b] >> np.uint64(32), h[a:b] & np.uint64(0xFFFFFFFF), n[a:b])))
            yield _blobs(rows)

    return run


def _write_words(folder: str, shift: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        cols = [np.concatenate(c) for c in zip(*(unpacked(b, 3) for b in table.column("blob").to_pylist()))]
        h = (cols[0].astype(np.uint64) << np.uint64(32)) | cols[1].astype(np.uint64)
        order = np.argsort(h, kind="stable")
        h, start = h[order], runs(h[order])
        n = np.add.reduceat(cols[2][order], start)
        write_parts(folder, f"words-{s}", {**EliasFano.parts(h[start] - (np.uint64(s) << np.uint64(shift)), "hash"), "count": n.astype(np.uint32 if n.max() < 2**32 else np.int64)})
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(start)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})

    return run


def contexts(word: np.ndarray, start: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The words one and two before each token; before a text stands ``begin``."""
    v = np.concatenate([[begin], word[:-1]])
    v[start] = begin
    u = np.concatenate([[begin], v[:-1]])
    u[start] = begin
    return v, u


def shard_of(w: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    x = (w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (v.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    x ^= x >> np.uint64(31)
    return ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % n


def _count_triples(model: dict):
    def run(batches):
        words = worker_kept(model["folder"], lambda: Words(model["folder"], model["shift"], model["sizes"]))
        for texts, _ in pools(batches, []):
            h, start = hashes(texts)
            known, w = np.unique(h, return_inverse=True)
            number = np.append(words.numbers(known), words.n + 1)  # ascending, as hashes are
            v, u = contexts(w, start, len(known))
            bits = len(known).bit_length()
            if 3 * bits < 64:  # a triple of numbers within this pool as one
                key, n = np.unique((w << 2 * bits) | (v << bits) | u, return_counts=True)
                low = (1 << bits) - 1
                w, v, u = key >> 2 * bits, (key >> bits) & low, key & low
            else:
                triple, n = np.unique(np.stack([w, v, u]), axis=1, return_counts=True)
                w, v, u = triple
            w, v, u = number[w], number[v], number[u]
            shard = shard_of(w, v, model["shards"])
            order = np.argsort(shard.astype(np.uint16) if model["shards"] <= 1 << 16 else shard, kind="stable")
            w, v, u, n, shard = w[order], v[order], u[order], n[order], shard[order]
            begin = runs(shard)
            yield _blobs([(int(shard[a]), packed(np.diff(w[a:b], prepend=0), v[a:b], u[a:b], n[a:b])) for a, b in zip(begin, [*begin[1:], len(w)])])

    return run


def _write_trie(model: dict):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        words = worker_kept(model["folder"], lambda: Words(model["folder"], model["shift"], model["sizes"]))
        each = [unpacked(b, 4) for b in table.column("blob").to_pylist()]
        w, v, u, n = (np.concatenate(c) for c in zip(*((np.cumsum(d), v, u, n) for d, v, u, n in each)))
        order = np.lexsort((u, v, w))
        w, v, u, n = w[order], v[order], u[order], n[order]
        new_w = np.concatenate([[True], w[1:] != w[:-1]])
        new_v = new_w | np.concatenate([[True], v[1:] != v[:-1]])
        new_u = new_v | np.concatenate([[True], u[1:] != u[:-1]])
        at3, at2, at1 = np.flatnonzero(new_u), np.flatnonzero(new_v), np.flatnonzero(new_w)
        n3, n2 = np.add.reduceat(n, at3), np.add.reduceat(n, at2)
        first3, first2 = np.searchsorted(at3, at2), np.searchsorted(at2, at1)
        total, m2, m3 = model["tokens"] + words.n + 1, model["m2"], model["m3"]
        p1 = (words.count_of(w[at2]) + 1) / total
        before = np.where(v[at2] == words.n + 1, model["docs"], words.count_of(v[at2]))
        p2 = (n2 + m2 * p1) / (before + m2)
        p3 = n3 + m3 * np.repeat(p2, np.diff(np.append(first3, len(at3))))
        parts = {
            **EliasFano.parts(w[at1], "w"),
            **EliasFano.parts(np.append(first2, len(at2)), "to2"),
            **EliasFano.parts(relative(v[at2], first2), "v"),
            **EliasFano.parts(np.append(first3, len(at3)), "to3"),
            **EliasFano.parts(relative(u[at3], first3), "u"),
            **codes(np.log10(p2), "p2"),
            **codes(np.log10(n2 + m3), "mass", up=True),
            **codes(np.log10(p3), "p3"),
        }
        write_parts(model["folder"], f"trie-{s}", parts)
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(at3)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})

    return run


class Tries:
    def __init__(self, model: dict):
        self.words = Words(model["folder"], model["shift"], model["sizes"])
        self.model, self.shards = model, []
        for s in range(model["shards"]):
            p = map_parts(model["folder"], f"trie-{s}") if s in model["tries"] else None
            self.shards.append(p and (p, *(EliasFano(p, k) for k in ("w", "to2", "v", "to3", "u"))))

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Per text: number of tokens, of known ones, base score and model score."""
        model, words = self.model, self.words
        h, start = hashes(texts)
        known, w = np.unique(h, return_inverse=True)
        number = np.append(words.numbers(known), words.n + 1)
        seen = words.count_of(number[:-1])
        count = seen[w]
        log1 = np.log10((seen + 1) / (model["tokens"] + words.n + 1))[w]
        v, u = contexts(w, start, len(known))
        log2 = np.log10(model["m2"]) + log1 - np.log10(np.append(seen, model["docs"]) + model["m2"])[v]
        mass = np.full(len(w), np.nan)  # of (v, w) as a context
        log3 = np.full(len(w), np.nan)
        bits = np.uint64(len(known).bit_length())
        shard = shard_of(number[w], number[v], model["shards"])
        key = (shard.astype(np.uint64) << 2 * bits) | (w.astype(np.uint64) << bits) | v.astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        cut = np.searchsorted(key >> 2 * bits, np.arange(model["shards"] + 1, dtype=np.uint64))
        for s, it in enumerate(self.shards):
            if it is None or cut[s] == cut[s + 1]:
                continue
            part, level1, to2, level2, to3, level3 = it
            of, own = order[cut[s] : cut[s + 1]], key[cut[s] : cut[s + 1]]
            pair = runs(own)  # where the tokens of each distinct (w, v) begin
            word = runs(own[pair] >> bits)  # and, among these, those of each w
            at1 = level1.find(number[w[of[pair[word]]]].astype(np.uint64))
            ok1 = np.repeat(at1 >= 0, np.diff(np.append(word, len(pair))))
            size, n2 = np.diff(np.append(pair, len(own))), np.diff(np.append(word, len(pair)))[at1 >= 0]
            span = ranges(level2, to2, at1[at1 >= 0]) if ok1.any() else ()
            at2 = np.full(len(pair), -1, np.int64)
            if ok1.any():
                at2[ok1] = child(level2, tuple(np.repeat(x, n2) for x in span), number[v[of[pair[ok1]]]])
            ok2 = at2 >= 0
            if not ok2.any():
                continue
            of, at2, n3 = of[np.repeat(ok2, size)], at2[ok2], size[ok2]
            log2[of], mass[of] = np.repeat(decoded(part, "p2", at2), n3), np.repeat(decoded(part, "mass", at2), n3)
            at3 = child(level3, tuple(np.repeat(x, n3) for x in ranges(level3, to3, at2)), number[u[of]])
            log3[of[at3 >= 0]] = decoded(part, "p3", at3[at3 >= 0])
        context = np.concatenate([[0], mass[:-1]])
        context[start] = np.log10(model["docs"] + model["m3"])
        log = np.where(np.isnan(context), log2, np.where(np.isnan(log3), np.log10(model["m3"]) + log2, log3) - context)
        size = np.diff(np.append(start, len(w)))
        return {"n_tokens": size, "n_known": np.add.reduceat((count > 0).astype(np.int64), start), "base_score": np.add.reduceat(log1, start), "score": np.add.reduceat(log, start)}


def _score(model: dict):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        tries = worker_kept(model["folder"] + "/tries", lambda: Tries(model))
        for texts, rest in pools(batches, ["doc_id", "held_out"]):
            x = tries.score(texts)
            cols = [pa.array(rest["doc_id"], pa.int64()), pa.array(rest["held_out"], pa.bool_()), pa.array(x["n_tokens"], pa.int64()), pa.array(x["n_known"], pa.int64()), pa.array(np.full(len(texts), model["tokens"]), pa.int64()), pa.array(x["base_score"]), pa.array(x["score"])]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def held_out(id_col: str, of: int = 7, rest: int = 2) -> Column:
    """Whether a document is kept from learning; false for a null id, which has no checksum."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of == rest, F.lit(False))


def build(train: DataFrame, m2: float, m3: float, shard: int = SHARD) -> dict:
    """Count ``train`` (text) and write the model's files; what comes back is small and names them."""
    spark = train.sparkSession
    docs, size = train.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    bits = max(2, size // shard).bit_length()
    folder, shift = shared_dir(spark, "model"), 64 - bits
    written = "shard int, n long, tokens long"
    found = train.mapInArrow(_count_words(shift), "shard int, blob binary").groupBy("shard").applyInArrow(_write_words(folder, shift), written).collect()
    sizes = [0] * (1 << bits)
    for r in found:
        sizes[r["shard"]] = r["n"]
    model = {"folder": folder, "shift": shift, "sizes": sizes, "shards": 1 << bits, "tokens": sum(r["tokens"] for r in found), "docs": docs, "m2": m2, "m3": m3}
    if sum(sizes) >= 2**32 - 2:
        raise ValueError("more distinct words than 32-bit numbers")
    tries = train.mapInArrow(_count_triples(model), "shard int, blob binary").groupBy("shard").applyInArrow(_write_trie(model), written).collect()
    model["tries"] = {r["shard"] for r in tries}
    return model


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", m2: float = 1000.0, m3: float = 20.0) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that aren't held out (see ``held_out``) and scores all. ``base_score`` is
    the add-one unigram score, ``score`` the model's log10 probability of the text, rounded down by
    the 16-bit codes. A null text counts as empty, which is the end token alone; null or repeated
    ids are ordinary rows, each of which counts; extra columns are ignored; an empty table gives an
    empty result. Words are told apart by 64-bit hashes.

    There is a shard for every ``SHARD`` bytes of training text, so that one fits in a task whatever
    the corpus; triples are dealt to them by a hash of their last two words, so no common word makes
    one of them large. All triples are kept, without pruning.
    """
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("held_out", held_out("doc_id"))
    train = src.filter(~F.col("held_out")).select("text")
    model = build(train, m2, m3)
    return src.mapInArrow(_score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
