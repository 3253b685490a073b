"""Orientation checks and rotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANGLES = (90, 180, 270)


def face_evidence(faces: DataFrame) -> DataFrame:
    """Per photo and rotation: usable faces and the strength of the six strongest."""
    usable = faces.filter((F.col("tilt") < 35) & (F.col("min_side") >= 24)).withColumn("score", F.col("confidence") * F.sqrt("area"))
    best = Window.partitionBy("photo_id", "rotation").orderBy(F.desc("score"))
    top = usable.withColumn("r", F.row_number().over(best)).filter("r <= 6").groupBy("photo_id", "rotation").agg(F.round(F.sum("score"), 5).alias("strength"))
    return usable.groupBy("photo_id", "rotation").agg(F.count("*").alias("faces")).join(top, ["photo_id", "rotation"])


def strongest(evidence: DataFrame) -> DataFrame:
    """Per photo the best rotation (the smaller of equals), its strength and that of the runner-up."""
    order = Window.partitionBy("photo_id").orderBy(F.desc("strength"), "rotation")
    r = evidence.withColumn("r", F.row_number().over(order)).filter("r <= 2")
    return r.groupBy("photo_id").agg(
        F.max(F.when(F.col("r") == 1, F.col("rotation"))).alias("best_rotation"),
        F.max(F.when(F.col("r") == 1, F.col("strength"))).alias("best_strength"),
        F.coalesce(F.max(F.when(F.col("r") == 2, F.col("strength"))), F.lit(0.0)).alias("runner_strength"),
    )


def check_group() -> Column:
    """Group of a check for review: applied, edit_errors, errors, excluded, suggestions, uncertain,
    upright."""
    turned = F.coalesce(F.col("rotation").isin(*ANGLES), F.lit(False))
    return (
        F.when(F.col("edit") == "applied", "applied")
        .when(F.col("edit") == "error", "edit_errors")
        .when(F.col("status") == "error", "errors")
        .when(F.col("status") != "done", "pending")
        .when(F.col("excluded"), "excluded")
        .when(~F.col("certain"), "uncertain")
        .when(turned, "suggestions")
        .otherwise("upright")
    )


def orientation_groups(checks: DataFrame, group: str, offset: int = 0, limit: int = 40) -> DataFrame:
    """A page (at most 40) of one group, by asset."""
    return checks.filter(check_group() == group).orderBy("asset_id").offset(offset).limit(min(limit, 40))


def orientation_stats(checks: DataFrame) -> DataFrame:
    groups = ("suggestions", "uncertain", "excluded", "upright", "errors", "applied", "edit_errors", "pending")
    g = checks.withColumn("g", check_group())
    return g.agg(*[F.count_if(F.col("g") == x).alias(x) for x in groups], F.count_if("selected").alias("selected"), F.round(F.avg("elapsed"), 6).alias("mean_elapsed"))


def rotation_batch(checks: DataFrame, edits: DataFrame) -> DataFrame:
    """Selected, done, turned and current checks without an open edit."""
    ready = checks.filter(F.col("selected") & ~F.col("excluded") & (F.col("status") == "done") & F.col("rotation").isin(*ANGLES) & (F.col("file_version") == F.col("version")))
    return ready.join(edits.filter("open").select("asset_id").distinct(), "asset_id", "left_anti").select("asset_id", "rotation")


def decide(checks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Checks after decisions (asset_id, select, exclude, angle): an angle must be a quarter turn,
    selecting needs a turn, exclusion clears the selection; a certain turn is selected by itself."""
    d = checks.join(decisions.select("asset_id", "select", "exclude", "angle"), "asset_id", "left")
    angle = F.when(F.col("angle").isin(0, *ANGLES), F.col("angle")).otherwise(F.col("rotation"))
    excluded = F.coalesce("exclude", "excluded")
    wanted = F.coalesce("select", F.col("certain") & (angle != 0))
    out = d.withColumn("rotation", angle).withColumn("excluded", excluded)
    return out.withColumn("selected", F.coalesce(wanted & ~F.col("excluded") & (F.col("rotation") != 0), F.lit(False))).drop("select", "exclude", "angle")
