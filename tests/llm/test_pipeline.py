"""The pipeline's stages against brute force."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from albumlake.llm.common import materialize

from test_dedup import brute_near

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage makes of what its predecessor kept."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in C.STAGES:
        out.append((docs, docs := materialize(stage(spark, docs, SF))))
    return out


def test_classifier_stage(spark, kept):
    before, after = kept[0]
    assert after.columns == before.columns
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r["doc_id"] for r in after.collect()}
    good = [d for d, r in labels.items() if r["quality"] and not r["toxic"]]
    bad = [d for d, r in labels.items() if not r["quality"] or r["toxic"]]
    assert sum(d in left for d in good) >= 0.95 * len(good) and sum(d in left for d in bad) <= 0.1 * len(bad)


def test_dedup_stages(kept):
    before, after = kept[1]
    best = {}
    for r in before.collect():
        best[r["text"] or ""] = max(best.get(r["text"] or "", -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(best.values())
    before, after = kept[2]
    want = brute_near([(r["doc_id"], r["text"]) for r in before.collect()], 5)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, c in want.values()})


def test_mix_stage(kept):
    before, after = kept[3]
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in before.collect()}
    text = {r["doc_id"]: r["text"] for r in before.collect()}
    took = Counter()
    for r in after.collect():
        assert text[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        took[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert all(n <= 2 * size[d] for d, n in took.items())
    assert abs(sum(took.values()) - 1.5 * sum(size.values())) <= 0.05 * sum(size.values())


def test_pack_stage(kept):
    before, after = kept[4]
    assert after.filter("piece = 0").count() == before.count()
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096


def test_stages_on_odd_rows(spark, odd, none):
    for name, stage in C.STAGES:
        assert stage(spark, none, SF).count() == 0, name
        out = stage(spark, odd, SF)
        rows = out.collect()
        if name == "exact_dedup":
            assert Counter(r["text"] or "" for r in rows) == Counter({(r["text"] or "") for r in odd.collect()})
        if name != "packing":
            assert out.columns == list(C.COLUMNS)


def test_run(spark):
    assert C.run(spark, SF).count() > 0
