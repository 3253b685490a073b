"""Validity of results, verdicts on conditions, evaluation, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_key
from ..sources.scratch import Scratch
from .ordering import with_ordinal


def face_fault(faces_per_result: Column | None = None, most: int = 1000) -> Column:
    """Why a face (box, landmarks, confidence) is not valid, or null."""
    inside = F.forall("box", lambda x: (x >= 0) & (x <= 1))
    grown = (F.get("box", 2) > F.get("box", 0)) & (F.get("box", 3) > F.get("box", 1))
    finite = F.forall("landmarks", lambda p: (F.size(p) == 2) & F.forall(p, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    out = (
        F.when(no(F.size("box") == 4), "box")
        .when(no(inside & grown), "box range")
        .when(no((F.size("landmarks") == 5) & finite), "landmarks")
        .when(no(F.col("confidence").between(0, 1)), "confidence")
    )
    return out if faces_per_result is None else out.when(faces_per_result > most, "too many faces")


def valid_faces(faces: DataFrame, most: int = 1000) -> DataFrame:
    """Faces with the reason why they are refused (null: fine); a result with too many is refused."""
    per = faces.groupBy("asset_id").agg(F.count("*").alias("_n"))
    return faces.join(per, "asset_id").withColumn("reason", face_fault(F.col("_n"), most)).drop("_n")


def caption_fault(text: str = "description", most: int = 12_000) -> Column:
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "blank").when(F.char_length(text) > most, "too long")


def location_fault(text: str = "geo_text", vector: str = "vector") -> Column:
    """Place text and its vector come together or not at all."""
    return F.when((F.coalesce(text, F.lit("")) != "") != F.col(vector).isNotNull(), "text and vector differ")


def combine_verdicts(checks: str = "checks") -> Column:
    """Conjunction in three values: any no, else any uncertain, else yes."""
    has = lambda v: F.exists(checks, lambda c: c["verdict"] == v)
    return F.when(has("no"), "no").when(has("uncertain"), "uncertain").otherwise("yes")


def valid_checks(checks: str = "checks", conditions: str = "conditions") -> Column:
    """One check per condition, in the same order and words."""
    return F.transform(checks, lambda c: c["condition"]) == F.col(conditions)


def verdict_key() -> Column:
    """Key of a verdict: model version, asset, version, unit and conditions."""
    return canonical_key("model_version", "asset_id", "file_version", "unit_id", "conditions")


def cached_verdicts(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """Pairs with the verdict that the cache has, null where work is left."""
    known = cache.select("cache_key", "verdict").dropDuplicates(["cache_key"])
    return pairs.withColumn("cache_key", verdict_key()).join(known, "cache_key", "left")


def evaluate_retrieval(pairs: DataFrame) -> DataFrame:
    """(expected boolean, predicted yes/no/uncertain) -> tp, fp, fn, tn, precision, recall; uncertain
    counts as not yes."""
    yes = F.col("predicted") == "yes"
    c = pairs.agg(
        F.count_if(F.col("expected") & yes).alias("tp"),
        F.count_if(~F.col("expected") & yes).alias("fp"),
        F.count_if(F.col("expected") & ~yes).alias("fn"),
        F.count_if(~F.col("expected") & ~yes).alias("tn"),
    )
    ratio = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 6)
    return c.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})


def hit_at(ranked: DataFrame, positives: DataFrame, k: int = 20) -> DataFrame:
    """Queries with known positives and how many of them have one among their first k."""
    known = positives.select("query_id").distinct()
    hit = ranked.filter(F.col("rank") <= k).join(positives, ["query_id", "asset_id"], "left_semi").select("query_id", F.lit(1).alias("hit")).distinct()
    return known.join(hit, "query_id", "left").agg(F.count("*").alias("queries"), F.count("hit").alias("hits"))


def exact_percentiles(df: DataFrame, value: str, groups: list[str], shares: list[float], few: int = 4096, grid: int = 500) -> DataFrame:
    """(groups, p): the exact percentiles of each group with linear interpolation, as ``percentile``
    has them, without gathering a group.

    Each wanted rank has a range of values that holds it, at first the whole group's. While the range
    holds more than ``few`` values, approximate percentiles of what is in it (a sketch that tasks
    combine) give a range of about 3 / ``grid`` of them, and a count says how many lie below. Nulls
    don't count; a group of nulls only has a null.
    """
    work, key = Scratch(df.sparkSession), [f"_g{i}" for i in range(len(groups))]
    base = df.select(*[F.col(g).alias(k) for g, k in zip(groups, key)], F.col(value).cast("double").alias("v"))
    totals = base.groupBy(*key).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    totals = work.keep(totals.withColumn("_id", F.monotonically_increasing_id()))
    spots = F.array(*[F.struct(f(F.lit(s) * (F.col("n") - 1)).cast("long").alias("rank")) for s in shares for f in (F.floor, F.ceil)])
    ranges = totals.filter("n > 0").select("_id", *key, F.explode(F.array_distinct(spots)).alias("s"), "low", "high", F.col("n").alias("m"))
    ranges = work.keep(ranges.select("_id", *key, "s.rank", "low", "high", F.lit(0).cast("long").alias("below"), "m"))
    wide = (F.col("m") > few) & (F.col("low") < F.col("high"))

    def inside(of: DataFrame) -> DataFrame:
        """Values with each range that they are in; a few ranges a group, so their table is small beside the values."""
        same = [F.col(f"b.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
        on = [*same, F.col("b.v").between(F.col("r.low"), F.col("r.high"))]
        return base.alias("b").join(of.alias("r"), on).select("b.v", "r._id", "r.rank", "r.low", "r.high", "r.below", "r.m")

    name = ["_id", "rank"]
    for _ in range(16):
        todo = ranges.filter(wide)
        if todo.isEmpty():
            break
        marks = inside(todo).groupBy(*name).agg(F.percentile_approx("v", [i / grid for i in range(grid + 1)], 20 * grid).alias("marks"))
        at = F.floor((F.col("rank") - F.col("below")) / F.col("m") * grid).cast("int")
        nearer = todo.join(marks, name).withColumns({"low": F.get("marks", F.greatest(at - 1, F.lit(0))), "high": F.get("marks", F.least(at + 2, F.lit(grid)))}).drop("marks")
        nearer = nearer.withColumns({"low": F.when(at < 1, F.lit(float("-inf"))).otherwise(F.col("low")), "high": F.when(at + 2 >= grid, F.lit(float("nan"))).otherwise(F.col("high"))})  # nan is above all
        old = todo.select(*name, F.col("low").alias("o_low"), F.col("high").alias("o_high"))
        nearer = work.keep(nearer.join(old, name).withColumns({"low": F.greatest("low", "o_low"), "high": F.least("high", "o_high")}).drop("o_low", "o_high"))
        within = inside(nearer).groupBy(*name).agg(F.count("*").alias("_in"))
        less = inside(todo.join(nearer.select(*name, F.col("low").alias("cut")), name).withColumn("high", F.col("cut")).drop("cut")).filter(F.col("v") < F.col("high")).groupBy(*name).agg(F.count("*").alias("_less"))
        nearer = nearer.join(within, name).join(less, name, "left").withColumns({"m": F.col("_in"), "below": F.col("below") + F.coalesce("_less", F.lit(0))}).drop("_in", "_less")
        ranges = work.keep(ranges.filter(~wide).unionByName(nearer))
    values = inside(ranges.filter(F.col("low") < F.col("high"))).groupBy(*name, "below", "v").agg(F.count("*").alias("c"))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*name).orderBy("v"))
    found = values.withColumn("upto", upto).filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank"))).select(*name, "v")
    found = found.unionByName(ranges.filter(F.col("low") == F.col("high")).select(*name, F.col("low").alias("v")))
    by_rank = found.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("by"))

    def share(s: float) -> Column:
        spot = F.lit(s) * (F.col("n") - 1)
        low, high = F.floor(spot).cast("long"), F.ceil(spot).cast("long")
        a, b = F.element_at("by", low), F.element_at("by", high)
        return F.when(low == high, a).otherwise((high - spot) * a + (spot - low) * b)

    out = totals.join(by_rank, "_id", "left")
    return out.select(*[F.col(k).alias(g) for g, k in zip(groups, key)], F.array(*[share(s) for s in shares]).alias("p"))


def latency_summary(times: DataFrame, value: str, *groups: str) -> DataFrame:
    """Median and 95th percentile with linear interpolation; a hot group is spread over all tasks."""
    p = exact_percentiles(times, value, list(groups), [0.5, 0.95])
    return p.select(*groups, F.round(F.get("p", 0), 6).alias("median"), F.round(F.get("p", 1), 6).alias("p95"))


def row_digest(df: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)


def fingerprint(df: DataFrame) -> DataFrame:
    """Number of rows and an order-free sum of their hashes: equal for equal sets of rows."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(h).alias("digest"))


def table_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys that were added, removed or changed."""
    b = before.select(key, row_digest(before).alias("was"))
    a = after.select(key, row_digest(after).alias("now"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return b.join(a, key, "full_outer").select(key, state.alias("state")).filter("state IS NOT NULL")


def job_outcome(jobs: DataFrame) -> DataFrame:
    """Per job (requested, done, errors as arrays): complete, partial or failed."""
    left = F.size(F.array_except("requested", "done"))
    outcome = F.when((left == 0) & (F.size("errors") == 0), "complete").when(F.size(F.array_intersect("requested", "done")) > 0, "partial").otherwise("failed")
    return jobs.withColumn("outcome", outcome)


def session_totals(outcomes: DataFrame, receipts: DataFrame) -> DataFrame:
    """Per session: jobs by outcome, saved and discarded receipts (each job's counts once, its first),
    and completed or partial ones that await saving."""
    first = receipts.groupBy("job_id").agg(F.min_by("receipt", "at").alias("receipt"))
    rows = outcomes.join(first, "job_id", "left")
    n = lambda c, v: F.count_if(F.coalesce(F.col(c) == v, F.lit(False))).alias(v)
    waiting = F.col("outcome").isin("complete", "partial") & F.col("receipt").isNull()
    return rows.groupBy("session").agg(n("outcome", "complete"), n("outcome", "partial"), n("outcome", "failed"), n("receipt", "saved"), n("receipt", "discarded"), F.count_if(waiting).alias("awaiting"))


def retention(items: DataFrame, budget: int, extra: int = 0, order: tuple = ("used", "id"), preview: bool = False) -> DataFrame:
    """Items (id, size, pinned) with whether they are evicted so that the total fits.

    The target is 85 % of the budget once more than 95 % is used, else the budget; for previews it is
    the budget. Unpinned items go in order until the rest fits. Sizes before an item are summed over
    ranges of the order first, so no single task sees all items.
    """
    used = items.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    loose = with_ordinal(items.filter(~F.col("pinned")), [F.col(c).asc() for c in order], "_o")
    block = F.floor(F.col("_o") / 4096)
    sums = loose.groupBy(block.alias("_block")).agg(F.sum("size").alias("_sum"))
    before = sums.select("_block", (F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).alias("_base"))
    inside = F.sum("size").over(Window.partitionBy("_block").orderBy("_o")) - F.col("size")
    laid = loose.withColumn("_block", block).join(before, "_block").withColumn("freed", F.col("_base") + inside).crossJoin(F.broadcast(used))
    need = F.col("total") + extra
    target = F.lit(budget) if preview else F.when(need > 0.95 * budget, F.floor(F.lit(0.85 * budget))).otherwise(F.lit(budget))
    return laid.select("id", "size", (need - F.col("freed") > target).alias("evicted"))
