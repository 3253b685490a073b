"""Search under conditions that a model has to check: by rank, in small steps, until a page is full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .ordering import with_ordinal
from .quality import verdict_key
from .stages import verify_stage


def current_hits(hits: DataFrame, assets: DataFrame) -> DataFrame:
    """Hits (asset_id, file_version, ...) whose asset is present in that very version."""
    now = assets.filter("present").select(F.col("id").alias("asset_id"), F.col("version").alias("file_version"))
    return hits.join(now, ["asset_id", "file_version"], "left_semi")


class VerifiedSearch:
    """Ranked hits and the verdicts on them so far.

    ``hits`` have asset_id (once each), file_version, unit_id and what ``order`` names; membership and order are
    frozen at the start. ``cache`` has verdicts (cache_key, verdict) from before; ``load`` gives a
    function of an asset and the conditions that returns a (condition, verdict) for each. A failed
    check counts as uncertain. Each step's verdicts are a table of their own, so that nothing is
    asked of the model twice, whatever is read later or lost meanwhile.
    """

    def __init__(self, hits: DataFrame, assets: DataFrame, order: list, conditions: list[str], cache: DataFrame, load: Callable, model_version: str = "verify-1", step: int = 40):
        self.work = Scratch(hits.sparkSession)
        self.assets, self.cache, self.load, self.step = assets, cache.select("cache_key", "verdict"), load, step
        ask = {"model_version": F.lit(model_version), "conditions": F.array(*[F.lit(c) for c in conditions])}
        self.frozen = self.work.keep(with_ordinal(current_hits(hits, assets), order).withColumns(ask))
        self.total, self.at, self.asked, self.yes = self.frozen.count(), 0, 0, 0
        self.verdicts = self.frozen.select("asset_id", "ordinal", F.lit("").alias("verdict")).limit(0)

    def advance(self, need: int) -> None:
        """Check the next hits by rank, ``step`` at a time, until ``need`` of all are a yes or none is
        left. Verdicts in the cache are taken from there; only hits that are still current are asked."""
        while self.yes < need and self.at < self.total:
            part = self.frozen.filter((F.col("ordinal") >= self.at) & (F.col("ordinal") < self.at + self.step))
            pairs = self.work.keep(current_hits(part, self.assets).withColumn("cache_key", verdict_key()))
            known = self.work.keep(self.cache.join(pairs.select("cache_key"), "cache_key", "left_semi"))  # at most a step's rows
            done = self.work.keep(verify_stage(pairs.drop("cache_key"), known, self.load).select("asset_id", "ordinal", "cache_key", "verdict"))
            self.asked += pairs.count() - known.select("cache_key").distinct().count()
            self.verdicts = self.verdicts.unionByName(done.select("asset_id", "ordinal", F.coalesce("verdict", F.lit("uncertain")).alias("verdict")))
            self.cache = self.cache.unionByName(done.filter("verdict is not null").select("cache_key", "verdict"))
            self.yes += done.filter("verdict = 'yes'").count()
            self.at += self.step

    def page(self, offset: int = 0, limit: int = 200, verdict: str = "yes") -> DataFrame:
        """(asset_id, ordinal, verdict, place): a page of one verdict, checked as far as it takes to
        fill it; '' for any verdict so far and 'pending' for those left."""
        if verdict == "yes":
            self.advance(offset + limit)
        rows = self.frozen.join(self.verdicts.select("ordinal", "verdict"), "ordinal", "left").withColumn("verdict", F.coalesce("verdict", F.lit("pending")))
        rows = current_hits(rows, self.assets).select("asset_id", "ordinal", "verdict")
        rows = rows.filter(F.col("verdict") == verdict) if verdict else rows
        return with_ordinal(rows, [F.col("ordinal").asc()], "place").filter((F.col("place") >= offset) & (F.col("place") < offset + limit))

    def counts(self) -> dict[str, int]:
        """Hits in all, checked, asked of the model, and found to be a yes."""
        return {"candidates": self.total, "checked": min(self.at, self.total), "asked": self.asked, "yes": self.yes}
