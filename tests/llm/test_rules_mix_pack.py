"""Quality rules, mixing and packing against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from albumlake.llm import mixing as M
from albumlake.llm import packing as P
from albumlake.llm import quality_rules as R
from albumlake.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    repeat = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), n < 50 or 100 * len(repeat) > 50 * n


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_rule_counts(which, request):
    df = request.getfixturevalue(which)
    want = Counter((r["doc_id"], *base(r["text"])) for r in df.collect())
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = R.quality_rules(df).collect()
    assert Counter(tuple(r[c] for c in cols) for r in got) == want
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_rules_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = R.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_rules_empty(none):
    assert R.quality_rules(none).count() == 0


def test_em_finds_accuracies():
    rng = random.Random(3)
    rows = Counter()
    for _ in range(4000):
        good = rng.random() < 0.8
        rows[tuple((1 if (rng.random() < a) == good else -1) if rng.random() < 0.9 else 0 for a in (0.9, 0.85, 0.8, 0.75))] += 1
    model = R.fit(sorted(rows.items()))
    assert abs(model["prior"] - 0.8) < 0.05
    r = model["rate"]
    assert r[1, 0, 1] / (r[1, 0, 1] + r[1, 0, -1]) == pytest.approx(0.9, abs=0.04)


def water(sizes, share=1.5, limit=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        full = {s for s in open_ if left * w[s] / sum(w[x] for x in open_) > limit * sizes[s]}
        if not full:
            total = sum(w[x] for x in open_)
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in full:
            target[s] = limit * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_mix(which, request):
    df = request.getfixturevalue(which)
    rows = M.mix(df).collect()
    assert len(rows) == df.count()
    sizes = Counter()
    for r in df.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    target = water(sizes)
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]], abs=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(48, 0.05 * target[s])
    again = Counter((r["doc_id"], r["taken"]) for r in M.mix(df).collect())
    assert again == Counter((r["doc_id"], r["taken"]) for r in rows)


def test_mix_of_short_texts(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(1, 3)) + str(i % 40), rng.choice("aaabbc")) for i in range(6000)] + [(None, "no id", "a")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    results = []
    for split in (df, df.repartition(5, "doc_id"), df.repartition(13).sortWithinPartitions("text")):
        got = M.mix(split, shard_words=512).collect()
        results.append(Counter(tuple(r) for r in got))
        for s in "abc":
            own = [r for r in got if r["source"] == s]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(16, 0.01 * own[0]["target"])
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert results[0] == results[1] == results[2] and sum(results[0].values()) == len(rows)


def test_mix_empty(none):
    assert M.mix(none).count() == 0


def test_sainte_lague_is_highest_quotients(spark):
    rng = random.Random(8)
    for _ in range(6):
        weights = [(i, rng.choice([0.0, 1.0, rng.random() * 50, 1000.0])) for i in range(rng.randrange(1, 9))]
        seats = rng.randrange(0, 60)
        got = [0] * len(weights)
        for _ in range(seats if any(w for _, w in weights) else 0):
            best = max(weights, key=lambda x: (x[1] / (2 * got[x[0]] + 1), -x[0]))[0]
            got[best] += 1
        df = spark.createDataFrame([(k, w, seats) for k, w in weights], "k long, w double, seats long")
        assert {r["k"]: r["won"] for r in M.sainte_lague(df, [], "w", "seats", ["k"], "won").collect()} == dict(enumerate(got))


def test_plan_fills_sequences():
    rng = random.Random(2)
    for _ in range(40):
        size = rng.choice([10, 64, 100])
        lengths = [rng.randint(1, size) for _ in range(rng.randrange(1, 300))]
        steps = P.plan(Counter(lengths), size)
        used = {}
        for n, count in Counter(lengths).items():
            p = np.array(steps[n])
            for rank in range(count):
                first, each, seq, offset = p[np.searchsorted(p[:, 0], rank, "right") - 1]
                into = rank - first
                used.setdefault(int(seq + into // each), []).append((int(offset + into % each * n), n))
        for spans in used.values():
            at = 0
            for o, n in sorted(spans):
                assert o == at
                at += n
            assert at <= size
        # best-fit decreasing one by one
        rooms = []
        for n in sorted(lengths, reverse=True):
            fit = min((r for r in rooms if r >= n), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((size if fit is None else fit) - n)
        assert len(used) == len(rooms)


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_packing(which, request):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for r in df.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[r["doc_id"], k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    rows = P.best_fit_packing(df, tokenizer_path("word_bpe_49k.json")).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in seqs.values():
        assert [o for o, _ in sorted(spans)] == np.cumsum([0, *(n for _, n in sorted(spans))])[:-1].tolist() and sum(n for _, n in spans) <= 4096
    assert len(seqs) <= math.ceil(11 / 9 * sum(r["length"] for r in rows) / 4096) + 1


def test_packing_special_words():
    memo = P.WordIds(open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read(), 1)
    texts = ["ÀÉ fooß ÿ\x85a b c <|endoftext|> don't 3.5€ \x1fzz İx Σας naïve-é", "", "  a\n\n b ", "éa 中文字 ½²"]
    ids, n = memo.texts(texts)
    want = [[*memo.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]


def test_packing_empty(none):
    assert P.best_fit_packing(none, tokenizer_path("word_bpe_49k.json")).count() == 0
