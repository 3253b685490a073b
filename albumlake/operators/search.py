"""Text search, rank fusion and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import TERM, query_terms
from ..functions.stemming import stems
from ..sources.scratch import materialize
from .ordering import with_ordinal

K1, B = 1.2, 0.75  # BM25


def bm25(texts: DataFrame, queries: DataFrame, limit: int | None = None, stem: bool = True) -> DataFrame:
    """(query_id, unit_id, score, rank) of the units that share a term with a query, best first.

    With ``stem``, Russian words of texts and queries meet in their stems. At most 32 terms of a query (query_id, q) count. Every text is tokenised once: what is kept of it
    is its length and, for up to 256 terms asked in all, only its tokens among them. Tables of terms
    are broadcast up to 100,000 terms and joined by shuffle beyond. Ties go to the smaller unit.
    """
    form = stems if stem else (lambda words: words)
    terms = queries.select("query_id", F.explode(F.array_distinct(form(query_terms(F.lower("q"))))).alias("term"))
    wanted = terms.select("term").distinct()
    few = [r["term"] for r in wanted.limit(257).collect()]
    small = (lambda x: F.broadcast(x)) if len(few) <= 256 or wanted.count() <= 100_000 else (lambda x: x)
    text = F.lower(F.coalesce("search_text", F.lit("")))
    words = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    # Only texts with Russian letters are stemmed; what the others need is told by one look at the text.
    tokens = F.when(text.rlike("[а-яё]"), form(words)).otherwise(words) if stem else words
    if len(few) <= 256:
        among = F.array(*[F.lit(t) for t in few]) if few else F.array().cast("array<string>")
        tokens = F.filter(tokens, lambda t: F.array_contains(among, t))
    docs = texts.select("unit_id", F.regexp_count(text, F.lit(TERM)).alias("length"), tokens.alias("tokens"))
    docs = materialize(docs)
    total = docs.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    tf = docs.select("unit_id", "length", F.explode("tokens").alias("term")).join(small(wanted), "term").groupBy("unit_id", "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    hits = tf.join(small(df), "term").crossJoin(F.broadcast(total)).join(small(terms), "term")
    scored = hits.withColumn("part", part).groupBy("query_id", "unit_id").agg(F.round(F.sum("part"), 9).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
    ranked = scored.withColumn("rank", F.row_number().over(best))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def fuse_rrf(streams: DataFrame, page: int = 200, k: int = 60) -> DataFrame:
    """(asset_id, page, score, ordinal) from hits (stream, weight, r, asset_id), r from 0.

    On page p, a stream's first hit of an asset with 200p <= r < 200p + 200 adds weight / (60 + r).
    An asset stays on the first page where it appears; pages follow each other, within them by
    falling score, then asset.
    """
    paged = streams.withColumn("page", F.floor(F.col("r") / page))
    first = paged.groupBy("stream", "page", "asset_id").agg(F.min("r").alias("r"), F.first("weight").alias("weight"))
    scored = first.groupBy("asset_id", "page").agg(F.sum(F.col("weight") / (k + F.col("r"))).alias("score"))
    own = scored.groupBy("asset_id").agg(F.min_by(F.struct("page", "score"), "page").alias("s"))
    flat = own.select("asset_id", F.col("s.page").alias("page"), F.round("s.score", 9).alias("score"))
    return with_ordinal(flat, [F.col("page").asc(), F.col("score").desc(), F.col("asset_id").asc()])


def matched_unit(hits: DataFrame) -> DataFrame:
    """Per asset the frame to show, by visual rank and else by text rank, and all matched frames.
    ``hits`` has asset_id, unit_id, stream (0 visual, 1 text) and r."""
    return hits.groupBy("asset_id").agg(
        F.min_by("unit_id", F.struct("stream", "r")).alias("unit_id"),
        F.array_sort(F.collect_set("unit_id")).alias("units"),
    )


def moments(matches: DataFrame, most: int = 12) -> DataFrame:
    """Matched frames per asset in time order: the first ``most`` for its card, with how many there
    are. (The full list is paged by position instead.)"""
    lie = Window.partitionBy("asset_id").orderBy("timestamp_ms", "unit_id")
    n = matches.groupBy("asset_id").agg(F.count("*").alias("n"))
    shown = matches.withColumn("place", F.row_number().over(lie) - 1).filter(F.col("place") < most)
    return shown.join(n, "asset_id")


def hybrid_search(visual: DataFrame, places: DataFrame, text: DataFrame, names: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Fusion of the four streams (asset_id, r): names weigh twice.

    With ``allowed`` (asset_id), only those assets take part: each stream is cut down to them and
    ranked anew before the fusion, as if it had been filtered before its ranking. Streams that were
    ranked among them already are passed without it and aren't numbered again.
    """
    out = None
    for label, df, weight in (("visual", visual, 1.0), ("place", places, 1.0), ("text", text, 1.0), ("name", names, 2.0)):
        if allowed is not None:
            kept = df.select("asset_id", "r").join(allowed.select("asset_id"), "asset_id", "left_semi")
            df = with_ordinal(kept.withColumnRenamed("r", "before"), [F.col("before").asc(), F.col("asset_id").asc()], "r")
        part = df.select(F.lit(label).alias("stream"), F.lit(weight).alias("weight"), F.col("r").cast("long").alias("r"), "asset_id")
        out = part if out is None else out.unionByName(part)
    return fuse_rrf(out)
