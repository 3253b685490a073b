"""A stored inverted table for text search, kept up to date by batches of changes.

Postings lie in buckets by the hash of their term, one row for each term and block of 1,024 unit
ids: the units, how often the term is in each and how long each is, with the largest count and the
smallest length of the block beside them. A batch adds a segment of its own and marks the units that
it replaces or deletes; beside the postings a keyed table holds each unit's length, so that number
and mean length of all texts are known without reading any. A search reads the buckets of its terms.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import TERM, query_terms
from ..functions.stemming import stems
from ..sources.scratch import Scratch
from ..sources.states import KeyedTable, States
from .search import B, K1

BLOCK = 1024  # unit ids to a block
SEGMENTS, DEAD = 8, 0.25  # segments, and dead units over living ones, before all is written anew
LENGTHS = "unit_id long, length long"
ROW = "term string, block long, units array<long>, counts array<int>, lengths array<int>, max_count int, min_length int"


WORDS = 1_000_000  # Russian words up to which a batch's table of stems is broadcast
TOKENS = 500_000  # tokens that a task counts, or postings that it sorts, about


def stemmed(words: DataFrame, russian: DataFrame | None) -> DataFrame:
    """The rows of ``words`` with the ``term`` that their ``word`` is found by; ``russian`` has a row for each distinct Russian word."""
    if russian is None:
        return words.withColumn("term", F.col("word"))
    stem = russian.select("word", F.get(stems(F.array("word")), 0).alias("term"))
    return words.join(stem, "word", "left").withColumn("term", F.coalesce("term", "word"))


class TextIndex:
    """An index in ``folder`` of units (unit_id long, unique in a batch; search_text)."""

    def __init__(self, spark: SparkSession, folder: str, stem: bool = True, buckets: int = 64):
        self.spark, self.states, self.stem = spark, States(spark, folder), stem
        self.lengths = KeyedTable(spark, f"{folder}/lengths", LENGTHS, "unit_id", buckets)
        self.buckets = self.states.read()[1].get("n_buckets", buckets)

    def state(self) -> dict:
        return self.states.read()[1]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    # ---- writing ----
    def apply(self, upserts: DataFrame, deletes: DataFrame | None = None, batch: int | None = None) -> bool:
        """Add or replace units and remove those whose ids ``deletes`` has; a batch that was applied
        before changes nothing. A batch whose writer crashed can be applied again."""
        number, state = self.states.read()
        if batch is not None and batch <= state.get("batch", -1):
            return False
        work = Scratch(self.spark)
        texts = upserts.select("unit_id", F.lower(F.coalesce("search_text", F.lit(""))).alias("text"))
        lengths = work.keep(texts.select("unit_id", F.regexp_count("text", F.lit(TERM)).cast("long").alias("length")))
        gone = lengths.select("unit_id")
        gone = work.keep(gone if deletes is None else gone.union(deletes.select("unit_id")).distinct())
        known = self.lengths.read(state.get("lengths", 0))
        touched = self.lengths.touched(gone)
        old = known.filter(self.lengths.bucket().isin(touched)).join(gone, "unit_id", "left_semi").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        new = lengths.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()

        token, segments = uuid.uuid4().hex, state.get("segments", [])
        state = {"segments": [], "dead": [], "dead_units": 0, "units": 0, "total": 0, "n_buckets": self.buckets} | state
        if old[0]:
            gone.withColumn("_before", F.lit(len(segments))).write.parquet(f"{self.states.data}/{token}-dead")
            state |= {"dead": [*state["dead"], f"{token}-dead"], "dead_units": state["dead_units"] + old[0]}
        # Texts are dealt by block once; what follows is counted within a task up to the rows of the index.
        # As many tasks as the tokens need: left to itself, Spark would join small shuffle files to tasks of gigabytes of tokens.
        dealt = texts.withColumn("block", F.floor(F.col("unit_id") / BLOCK)).repartition(max(1, -(-new[1] // TOKENS)), "block")
        tokens = dealt.select("unit_id", "block", F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("tokens"))
        key = ["block", "unit_id", "length"]
        words = tokens.select("block", "unit_id", F.size("tokens").alias("length"), F.explode("tokens").alias("word")).groupBy(*key, "word").agg(F.count("*").cast("int").alias("count"))
        postings = stemmed(words, self._russian(texts, work))
        if self.stem:
            postings = postings.groupBy(*key, "term").agg(F.sum("count").cast("int").alias("count"))
        state |= {"units": state["units"] + new[0] - old[0], "total": state["total"] + new[1] - old[1]}
        state["segments"] = [*segments, self._write(postings, token, new[1])]
        self.lengths.apply(gone, lambda held, ids: held.join(ids, "unit_id", "left_anti").unionByName(lengths), base=state.get("lengths", 0))
        state |= {"lengths": max(self.lengths.states.numbers()), "batch": state.get("batch", -1) if batch is None else batch}
        self._publish(number + 1, state)
        self.lengths.retain(2)
        if len(state["segments"]) > SEGMENTS or state["dead_units"] > DEAD * max(1, state["units"]):
            self._compact(work)
        work.clear()
        return True

    def _russian(self, texts: DataFrame, work: Scratch) -> DataFrame | None:
        """The distinct Russian words of the texts; None if there are none. Others aren't tokenised for it."""
        if not self.stem:
            return None
        letters = TERM[:-1]
        some = texts.filter(F.col("text").rlike("[а-яё]")).select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"{letters}*[а-яё]{letters}*"), F.lit(0)))).alias("word"))
        known = work.keep(some.distinct())
        n = known.count()
        return None if not n else F.broadcast(known) if n <= WORDS else known

    def _write(self, postings: DataFrame, token: str, tokens: int) -> dict:
        """Postings (block, term, unit_id, count, length) of texts of so many tokens as one segment; large buckets take several files."""
        blocks = postings.groupBy("block", "term").agg(F.array_sort(F.collect_list(F.struct("unit_id", "count", "length"))).alias("p"))
        rows = blocks.select("term", "block", F.col("p.unit_id").alias("units"), F.col("p.count").alias("counts"), F.col("p.length").alias("lengths"), F.array_max("p.count").alias("max_count"), F.array_min("p.length").alias("min_length"), self.bucket().alias("bucket"))
        files = max(1, -(-tokens // (self.buckets * TOKENS)))
        rows = rows.repartition(max(1, min(self.buckets * files, -(-tokens // TOKENS))), "bucket", F.pmod(F.xxhash64("block"), F.lit(files))).sortWithinPartitions("bucket", "term", "block")
        rows.write.partitionBy("bucket").parquet(f"{self.states.data}/{token}")
        return {"token": token, "buckets": sorted(int(n[7:]) for n in self.states.names(f"data/{token}") if n.startswith("bucket="))}

    def _compact(self, work: Scratch) -> None:
        number, state = self.states.read()
        token = uuid.uuid4().hex
        living = self._living(state, self._rows(state, None))
        state |= {"segments": [self._write(living.select("block", "term", "unit_id", "count", "length"), token, state["total"])], "dead": [], "dead_units": 0}
        self._publish(number + 1, state)

    def _publish(self, number: int, state: dict) -> None:
        self.states.publish(number, state)
        self.states.retain(lambda s: {x["token"] for x in s["segments"]} | set(s["dead"]))

    # ---- reading ----
    def _rows(self, state: dict, buckets: set[int] | None) -> DataFrame:
        """Rows of some buckets, from their files only."""
        out = self.spark.createDataFrame([], ROW).withColumn("_part", F.lit(0))
        for i, s in enumerate(state.get("segments", [])):
            paths = [f"{self.states.data}/{s['token']}/bucket={b}" for b in s["buckets"] if buckets is None or b in buckets]
            if paths:
                out = out.unionByName(self.spark.read.schema(ROW).parquet(*paths).withColumn("_part", F.lit(i)))
        return out

    def _living(self, state: dict, rows: DataFrame) -> DataFrame:
        """One row per posting, without those of units replaced or deleted since."""
        each = rows.select(*[c for c in rows.columns if c not in ("units", "counts", "lengths")], F.explode(F.arrays_zip("units", "counts", "lengths")).alias("p"))
        each = each.select("*", F.col("p.units").alias("unit_id"), F.col("p.counts").alias("count"), F.col("p.lengths").alias("length")).drop("p")
        if state.get("dead"):
            dead = self.spark.read.parquet(*[f"{self.states.data}/{d}" for d in state["dead"]]).groupBy("unit_id").agg(F.max("_before").alias("_before"))
            each = each.join(dead, "unit_id", "left").filter(F.col("_before").isNull() | (F.col("_part") >= F.col("_before"))).drop("_before")
        return each

    def asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, term): the distinct terms of queries (query_id, q), at most 32 words each."""
        words = queries.select("query_id", F.explode(query_terms(F.lower("q"))).alias("word"))
        return stemmed(words, words.select("word").distinct() if self.stem else None).select("query_id", "term").distinct()

    def postings(self, terms: DataFrame) -> DataFrame:
        """Rows of the inverted table with one of the terms; only their buckets are read."""
        state = self.state()
        buckets = {r[0] for r in terms.select(self.bucket()).distinct().collect()}  # at most as many as there are
        rows, wanted = self._rows(state, buckets), terms.select("term").distinct()
        few = wanted.limit(1001).collect()
        return rows.filter(F.col("term").isin([r["term"] for r in few])) if len(few) <= 1000 else rows.join(wanted, "term", "left_semi")

    def search(self, queries: DataFrame, limit: int | None = None) -> DataFrame:
        """(query_id, unit_id, score, rank) of the units that share a term with a query, best first;
        ties go to the smaller unit. The same rows as ``bm25`` over the texts.

        With ``limit``, blocks that can't reach the ``limit``-th best score of a query, by their
        largest counts and smallest lengths, are left out before their postings are unpacked.
        """
        state, terms = self.state(), self.asked(queries)
        n, mean = state.get("units", 0), state.get("total", 0) / max(1, state.get("units", 0))
        rows = self.postings(terms)
        living = self._living(state, rows)
        df = living.groupBy("term").agg(F.count("*").alias("df"))
        idf = df.select("term", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        asked = Scratch(self.spark).keep(terms.join(idf, "term"))  # a row for each word of a query

        def part(count, length) -> Column:
            return F.col("idf") * F.col(count) * (K1 + 1) / (F.col(count) + K1 * (1 - B + B * F.col(length) / mean))

        def scored(rows: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame:
            return self._living(state, rows).join(asked, on).groupBy("query_id", "unit_id").agg(F.round(F.sum(part("count", "length")), 9).alias("score"))

        if limit is None:
            best = scored(rows, asked, ["term"])
        else:
            bounds = rows.join(asked, "term").groupBy("query_id", "_part", "block", "term").agg(F.max(part("max_count", "min_length")).alias("b"))
            # A unit's living postings are in one segment, so a block's bound is that of one segment.
            bounds = bounds.groupBy("query_id", "_part", "block").agg(F.sum("b").alias("bound"))
            high = Window.partitionBy("query_id").orderBy(F.desc("bound"), "_part", "block")
            first = bounds.withColumn("_r", F.row_number().over(high)).filter(F.col("_r") <= 4 + limit // 64).select("query_id", "_part", "block")
            some = scored(rows.join(first, ["_part", "block"]), asked, ["term", "query_id"])
            down = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
            least = some.withColumn("_r", F.row_number().over(down)).filter(F.col("_r") == limit).select("query_id", F.col("score").alias("least"))
            left = bounds.join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-8)).select("query_id", "_part", "block")
            best = scored(rows.join(left, ["_part", "block"]), asked, ["term", "query_id"])
        down = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
        ranked = best.withColumn("rank", F.row_number().over(down))
        return ranked if limit is None else ranked.filter(F.col("rank") <= limit)
