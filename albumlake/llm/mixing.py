"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

The mix is made of blocks of equally many words. Blocks go to sources by highest quotients
target / (2k + 1), then a source's blocks go to its shards in the same way by the shards' sizes; what
a full shard can't take goes to the others. In a shard the documents lie in seeded order. Its quota
is so many whole passes and, for the rest, the blocks from a seeded one on, round the end: blocks
next to each other, because these cut few documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, word_count

#: Weights by source in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, n_docs -> the same with weight and target.

    The sources share ``share`` times all sizes by weight; a target stops at ``limit`` times its
    source's size and the excess is shared again by weight. In closed form: with sources in order
    of cap / weight, the first ones are capped and the rest get what is left in proportion. The
    windows run over one row per source, not over documents.
    """
    # Code-point order is the byte order of UTF-8, which is how Spark compares strings.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    return (
        sizes.withColumn("weight", w)
        .withColumn("cap", limit * F.col("source_size"))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("left", share * F.sum("source_size").over(everything) - F.sum("cap").over(by_level) + F.col("cap"))
        .withColumn("w_left", F.sum("weight").over(everything) - F.sum("weight").over(by_level) + F.col("weight"))
        # the level at which the rest would be filled, at the first source that isn't capped by it
        .withColumn("open", F.col("left") / F.col("w_left") < F.col("level"))
        .withColumn("fill", F.min(F.when(F.col("open"), F.struct("level", (F.col("left") / F.col("w_left")).alias("x")))).over(everything)["x"])
        .withColumn("target", F.when(F.col("fill").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("fill"))))
        .select(*sizes.columns, "weight", "target")
    )


def sainte_lague(df: DataFrame, group: list, weight: str, seats: str, tie: list, out: str, most: str | None = None) -> DataFrame:
    """Integer seats per row by highest quotients weight / (2k + 1) within each group; ``most``
    is a column with the most seats that a row can have.

    Rounding weight * seats / total misses the answer by at most a few seats per row, so only the
    seats around it are listed and ranked: 2 * reach rows for each input row, however many seats
    there are. Ties go to the row that comes first by ``tie``. A group without weight gets none.
    """
    limit = F.lit((1 << 62)) if most is None else F.col(most)
    w = Window.partitionBy(*group)
    share = F.col(weight) / F.sum(weight).over(w)
    spread = (
        df.withColumn("_share", F.coalesce(F.when(F.sum(weight).over(w) > 0, share), F.lit(0.0)))
        .withColumn("_reach", (F.ceil(F.col("_share") * F.count("*").over(w)) + 2).cast("long"))
        .withColumn("_low", F.least(limit, F.greatest(F.lit(0), F.round(F.col("_share") * F.col(seats)).cast("long") - F.col("_reach"))))
        .withColumn("_rest", F.col(seats) - F.sum("_low").over(w))
    )
    seat = F.explode(F.sequence(F.col("_low"), F.col("_low") + 2 * F.col("_reach")))
    best = Window.partitionBy(*group).orderBy(F.desc("_q"), *tie)
    open_ = (F.col("_k") < limit) & (F.col("_share") > 0)
    won = (
        spread.withColumn("_k", seat)
        .withColumn("_q", F.when(open_, F.col("_share") / (2 * F.col("_k") + 1)).otherwise(0.0))
        .withColumn("_rank", F.row_number().over(best))
        .groupBy(*df.columns)
        .agg((F.first("_low") + F.sum(F.when((F.col("_rank") <= F.col("_rest")) & (F.col("_q") > 0), 1).otherwise(0))).cast("long").alias(out))
    )
    return won


def _taken(quota: Column, size: Column, offset: Column, start: Column, length: Column) -> Column:
    """Words of a document at [start, start + length) of a shard of ``size`` words that a quota takes:
    whole passes, and the rest as a run of words from ``offset`` on that goes round the end."""
    rest = quota % size
    inside = lambda a: F.greatest(F.lit(0), F.least(start + length, a + rest) - F.greatest(start, a))
    return F.floor(quota / size) * length + inside(offset) + inside(offset - size)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, limit: int = 2, block: int = 16, shards: int = 4096, shard_words: int = 1 << 16, seed: int = 17, mark: bool = False) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, source[, text_sha256].

    ``taken`` is the number of words that the mix takes of a document, repeats counted: passes over
    the whole document and, for a document on an edge of the chosen blocks, a part of its words. A
    null text has size 0 and is never taken; null is a source like others, ordered last; a null or
    repeated doc_id is an ordinary row. Extra columns are ignored. An empty table gives an empty
    result.

    A source's shards have ``shard_words`` words or more on average, and there are ``shards`` in all
    or fewer, so a source with a third of all words has a third of them. All choices hang on the
    sources, ids and texts alone, not on how the input is split. Rows equal in all these are counted
    first and shown again at the end, so they don't meet in one task.
    """
    text = text_or_empty(text_col)
    digest = [F.sha2(text, 256).alias("text_sha256")] if mark else []
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("key"), *digest)
    rows = materialize(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")))
    everything = Window.partitionBy()
    goal = targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), share, limit)
    total = F.sum("source_size").over(everything)
    goal = goal.withColumn("seats", F.round(F.sum(F.round("target", 3)).over(everything) / block).cast("long")).select(
        "*",
        F.round(F.col("target") * 1024).cast("long").alias("parts"),  # exact sums in any order
        F.ceil(limit * F.col("source_size") / block).cast("long").alias("most"),
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(shard_words), total / shards))).cast("long").alias("n_shards"),
    )
    by_source = materialize(sainte_lague(goal, [], "parts", "seats", [F.col("source").asc_nulls_last()], "quota", "most"))

    seeded = lambda i: F.xxhash64(F.lit(seed + i), "doc_id", "key", "size")
    known = F.broadcast(by_source) if by_source.count() <= 100_000 else by_source
    dealt = rows.alias("r").join(known.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    dealt = dealt.select("r.*", "source_size", "target", "quota", F.pmod(seeded(0), F.col("n_shards")).alias("shard"), seeded(1).alias("place"))
    cells = dealt.groupBy("source", "quota", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("shard_size")).withColumn("most", F.ceil(limit * F.col("shard_size") / block).cast("long"))
    cells = sainte_lague(cells, ["source"], "shard_size", "quota", ["shard"], "blocks", "most").select("source", "shard", "shard_size", "blocks")
    lie = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "key", "size")
    laid = dealt.withColumn("start", F.sum(F.col("size") * F.col("copies")).over(lie) - F.col("size") * F.col("copies"))
    here = laid.alias("d").join(cells.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.shard") == F.col("c.shard")))
    here = here.select("d.*", "c.shard_size", "c.blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.greatest(F.lit(1), F.floor(F.col("shard_size") / block))) * block
    quota = F.least(F.col("blocks") * block, limit * F.col("shard_size"))
    taken = _taken(quota, F.col("shard_size"), first, F.col("start") + F.col("copy") * F.col("size"), F.col("size"))
    return here.select("doc_id", "size", "source_size", "target", F.when(F.col("size") == 0, F.lit(0)).otherwise(taken).cast("long").alias("taken"), "source", *(["text_sha256"] if mark else []))
