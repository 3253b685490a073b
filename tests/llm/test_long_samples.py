"""Samples that classifiers are fitted on have whole texts, however long."""

import random

import numpy as np
import pytest

from albumlake.llm import language_id as L
from albumlake.llm import quality_classifier as Q


def test_ratings_of_long_texts_only(spark):
    r = random.Random(3)
    text = lambda words: " ".join(r.choices(words.split(), k=44_000))
    good, bad = "careful study of rivers and stones and weather", "buy cheap pills now click here win"
    rows = [(i, text(good if i % 2 else bad)) for i in range(12)] + [(100 + i, good * 3 if i % 2 else bad * 3) for i in range(6)]
    assert min(len(t) for d, t in rows if d < 100) > 210_000
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    got = Q.quality_classifier(spark.createDataFrame(rows, "doc_id long, text string"), labels, at_least=2).collect()
    assert {r["doc_id"]: r["kept"] for r in got} == {d: d % 2 == 1 for d, _ in rows}


def test_sample_holds_so_many_features(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(100))) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(Q.Ordinal, "fit", classmethod(lambda cls, rows, rated, **kw: seen.append(sum(map(len, rows)))))
    Q.train(docs, Q.rating(labels), max_features=1000)
    assert 890 <= seen[0] <= 1000


def test_counts_of_parts_are_those_of_the_whole(monkeypatch):
    r = np.random.default_rng(2)
    texts = [bytes(r.integers(97, 105, n).astype(np.uint8)) for n in (1, 4, 50, 1000)]
    whole, model = L.counted(texts), L.ByteModel({"a": texts[:2], "b": texts})
    want = model.code_lengths(texts)
    monkeypatch.setattr(L, "CHUNK", 7)
    assert all((x == y).all() for x, y in zip(whole, L.counted(texts)))
    assert model.code_lengths(texts) == pytest.approx(want)


def test_language_is_learned_from_all_of_a_long_text(spark):
    """What tells the languages apart is only in the middle of long texts."""
    r = random.Random(1)
    text = lambda mark: "x " * 30_000 + " ".join(r.choices(mark.split(), k=300)) + " y" * 30_000
    a, b = "wug blick dax", "zorp quib frell"
    rows = [(i, text(a if i % 2 else b), "aa" if i % 2 else "bb") for i in range(12)] + [(100, a * 5, None), (101, b * 5, None)]
    got = {x["doc_id"]: x["lang_pred"] for x in L.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (got[100], got[101]) == ("aa", "bb")


def test_tables_follow_what_was_seen():
    r = np.random.default_rng(5)
    model = L.ByteModel({str(i): [bytes(r.integers(0, 256, 20_000).astype(np.uint8))] for i in range(4)})
    held = sum(a.nbytes for t in model.trees for level in t.levels for a in level)
    assert model.size == 256 and held < 4 * 20_000 * 4 * 24
