"""Token counts of very long words."""

import random
import time

from albumlake.llm import token_counts as T


def greedy(word, vocabulary):
    n, at, most = 0, 0, max(map(len, vocabulary))
    while at < len(word):
        size = next((k for k in range(min(most, len(word) - at), 0, -1) if word[at : at + k] in vocabulary), 0)
        if not size:
            return 1
        n, at = n + 1, at + size
    return n


def test_long_words_are_those_of_greedy_matching():
    r = random.Random(8)
    for _ in range(200):
        vocabulary = {bytes(r.choices(b"abc", k=r.randrange(1, 6))) for _ in range(12)} | ({b"a", b"b", b"c"} if r.random() < 0.7 else set())
        words = [bytes(r.choices(b"abc" if r.random() < 0.9 else b"abcd", k=r.choice([0, 1, 5, 255, 256, 257, 900]))) for _ in range(12)]
        assert T.Automaton(sorted(vocabulary)).lengths(words).tolist() == [greedy(w, vocabulary) if w else 0 for w in words]


def test_a_megabyte_takes_seconds():
    r = random.Random(1)
    vocabulary = {bytes([c]) for c in range(97, 123)} | {bytes(r.choices(range(97, 123), k=r.randrange(2, 7))) for _ in range(20_000)}
    automaton, word = T.Automaton(sorted(vocabulary)), bytes(r.choices(range(97, 123), k=1 << 20))
    began = time.process_time()
    assert automaton.lengths([word, b"abc"])[0] > 1 << 18
    assert time.process_time() - began < 2
