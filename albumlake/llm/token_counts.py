"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. A node whose string cannot be continued pops tokens and follows
its failure link, as Aho-Corasick does; how many tokens a node pops is known beforehand, so the
greedy word-piece length of a word comes from one pass without building its pieces.
"""

from __future__ import annotations

import base64
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, pieces, text_or_empty


def read_vocabulary(path: str) -> list[bytes]:
    """Tokens of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


LONG = 256  # bytes from which a word is stepped through by itself


class Automaton:
    """Trie edges as sorted keys (node * 256 + byte), with failure links and popped-token counts."""

    def __init__(self, vocabulary: list[bytes]):
        child: dict[int, int] = {}
        token, n = {0: False}, 1
        for word in vocabulary:
            at = 0
            for c in word:
                at, above = child.get(at * 256 + c, n), at
                if at == n:
                    child[above * 256 + c], token[n], n = n, False, n + 1
            token[at] = at != 0
        fail, pops = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        below: dict[int, list] = {}
        for key, node in child.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        queue = deque([0])
        while queue:
            above = queue.popleft()
            for c, node in below.get(above, ()):
                queue.append(node)
                if token[node]:
                    fail[node], pops[node] = 0, 1
                    continue
                z, popped = fail[above], pops[above]
                while z >= 0 and int(z) * 256 + c not in child:
                    z, popped = fail[z], popped + pops[z]
                if z >= 0:
                    fail[node], pops[node] = child[int(z) * 256 + c], popped
        order = sorted(child)
        self.keys, self.nodes = np.array(order, np.int64), np.array([child[k] for k in order], np.int32)
        self.fail, self.pops = fail, pops

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child, or -1."""
        key = state.astype(np.int64) * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.nodes[at], -1)

    def length(self, word: bytes) -> int:
        """Pieces of one word of any length, in time that grows with it."""
        if not hasattr(self, "child"):
            self.child = dict(zip(self.keys.tolist(), self.nodes.tolist()))
            self.links = list(zip(self.fail.tolist(), self.pops.tolist()))
        child, links, state, count = self.child.get, self.links, 0, 0
        for c in word:
            while (to := child(state * 256 + c)) is None:
                to, popped = links[state]
                if to < 0:
                    return 1
                state, count = to, count + popped
            state = to
        while state > 0:
            state, popped = links[state]
            count += popped
        return 1 if state < 0 else count

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; a word that the vocabulary cannot spell is one (unknown) piece.

        Short words go on together, a byte of each at a time; long ones go by themselves, so that one
        long word isn't a step of all for each of its bytes.
        """
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if long:
            rest = [b"" if len(w) > LONG else w for w in words]
            out = self.lengths(rest)
            out[long] = [self.length(words[i]) for i in long]
            return out
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(words), np.uint8)
        start = (np.cumsum(size) - size)[order]
        size = size[order]
        state, count, lost = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        for j in range(int(size[0]) if len(words) else 0):
            todo = np.flatnonzero(~lost[: np.searchsorted(-size, -j)])
            byte = data[start[todo] + j]
            while len(todo):
                to = self.step(state[todo], byte)
                ok = to >= 0
                state[todo[ok]] = to[ok]
                todo, byte = todo[~ok], byte[~ok]
                stuck = self.fail[state[todo]] < 0
                lost[todo[stuck]] = True
                todo, byte = todo[~stuck], byte[~stuck]
                count[todo] += self.pops[state[todo]]
                state[todo] = self.fail[state[todo]]
        todo = np.flatnonzero(~lost & (state > 0))
        while len(todo):
            lost[todo[self.fail[state[todo]] < 0]] = True
            todo = todo[self.fail[state[todo]] >= 0]
            count[todo] += self.pops[state[todo]]
            state[todo] = self.fail[state[todo]]
            todo = todo[state[todo] > 0]
        out = np.empty(len(words), np.int64)
        out[order] = np.where(lost, 1, count)
        return out


def _counts(automaton: Automaton, marker: bytes, limit: int = 500_000):
    def run(batches):
        memo: dict[bytes, int] = {}
        for batch in batches:
            for part in pieces(batch, rows=1000):
                texts = [t.split() for t in as_bytes(part.column("text"))]
                if len(memo) > limit:
                    memo.clear()
                new = list({w for t in texts for w in t if w not in memo})
                memo.update(zip(new, automaton.lengths([marker + w for w in new]).tolist()))
                tokens = [sum(map(memo.__getitem__, t)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", marker: bytes = b" ") -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens (greedy longest-match pieces of all words).

    A word is a maximal run of bytes other than space and U+0009 to U+000D; ``marker`` stands before
    it, as the vocabulary's word starts have it. A null or empty text has 0 of both; null or
    repeated ids are ordinary rows; extra columns are ignored; an empty table gives an empty result.
    One pass over the rows without a shuffle; the automaton's size depends on the vocabulary only.
    """
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return src.mapInArrow(_counts(Automaton(read_vocabulary(vocabulary)), marker), "doc_id long, n_words long, n_tokens long")
