"""People: profiles of example faces, matches of several people, suggestions to review."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .vectors import best_per_asset, face_match


def resolve_examples(ids: DataFrame, faces: DataFrame) -> DataFrame:
    """(position, face_id, current): each asked id once, at its first place, and whether a current
    face has it. A query with an id that isn't current is to be refused, not narrowed."""
    once = ids.groupBy("face_id").agg(F.min("position").alias("position"))
    here = faces.select("face_id", F.lit(True).alias("current")).distinct()
    return once.join(here, "face_id", "left").select("position", "face_id", F.coalesce("current", F.lit(False)).alias("current"))


@F.pandas_udf(BooleanType())
def distinct_assignment(options: pd.Series, n_groups: pd.Series) -> pd.Series:
    """Whether each group can have a face of its own: a small bipartite matching per row."""

    def fits(sets) -> bool:
        taken: dict = {}

        def place(g: int, seen: set) -> bool:
            for f in sets[g]:
                if f not in seen:
                    seen.add(f)
                    if f not in taken or place(taken[f], seen):
                        taken[f] = g
                        return True
            return False

        return all(place(g, set()) for g in range(len(sets)))

    return pd.Series([len(o) == n and fits([list(s) for s in o]) for o, n in zip(options, n_groups)])


def match_people(matches: DataFrame, n_groups: int, mode: str = "all") -> DataFrame:
    """Frames (asset_id, unit_id) that match groups of examples, from (person, face_id, asset_id, unit_id).

    ``any``: some group has a face there; ``all``: every group has one of its own in the same frame.
    Frames without a face for each group are dropped before the assignment.
    """
    per = matches.groupBy("asset_id", "unit_id", "person").agg(F.sort_array(F.collect_set("face_id")).alias("faces"))
    if mode == "any":
        return per.select("asset_id", "unit_id").distinct()
    frames = per.groupBy("asset_id", "unit_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("person", "faces"))), lambda x: x["faces"]).alias("options"))
    return frames.filter(F.size("options") == n_groups).filter(distinct_assignment("options", F.lit(n_groups))).select("asset_id", "unit_id")


def drop_rejected(matches: DataFrame, rejected: DataFrame) -> DataFrame:
    """Matches without the faces that a person's profile rejects."""
    return matches.join(rejected.select("person", "face_id"), ["person", "face_id"], "left_anti")


def merge_people(people: DataFrame, ids: DataFrame) -> DataFrame:
    """The chosen people (position, id) as one: examples in order without repeats, rejected faces
    that aren't examples, and id, name and cover of the first. Fewer than two give nothing."""
    chosen = ids.join(people, "id")
    one = chosen.agg(
        F.count("*").alias("n"),
        F.min_by(F.struct("id", "name", "cover"), "position").alias("first"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("position", "examples"))), lambda x: x["examples"])).alias("examples"),
        F.flatten(F.collect_list("rejected")).alias("rejected"),
    ).filter("n >= 2")
    examples = F.array_distinct("examples")
    return one.select("first.id", "first.name", examples.alias("examples"), F.array_sort(F.array_except("rejected", examples)).alias("rejected"), "first.cover")


def split_person(people: DataFrame, selected) -> DataFrame:
    """Each person whose selected examples are some but not all: what stays and what becomes new."""
    moved = F.array_intersect("examples", selected)
    kept = F.array_except("examples", selected)
    fine = (F.size(moved) > 0) & (F.size(kept) > 0) & (F.size(moved) == F.size(F.array_distinct(selected)))
    return people.filter(fine).select("id", kept.alias("stay"), moved.alias("move"))


def upsert_person(people: DataFrame) -> DataFrame:
    """Profiles as they are saved: a trimmed name of 120 characters, 1 to 128 distinct examples, the
    first as the cover by default. Others are left out."""
    name = F.trim(F.substring(F.trim("name"), 1, 120))
    examples = F.array_distinct("examples")
    return people.filter((name != "") & F.size(examples).between(1, 128)).select("id", name.alias("name"), examples.alias("examples"), F.coalesce("cover", F.get(examples, 0)).alias("cover"))


def boundary_pools(faces: DataFrame, examples: DataFrame, threshold: float = 0.363, low: float = 0.28, high: float = 0.48, most: int = 128) -> DataFrame:
    """Per person and side of the threshold, the faces closest to it: (person, face_id, asset_id,
    score, inside, distance). At most ``most`` a side by design of the report."""
    near = face_match(faces, examples, low).filter(F.col("score") <= high)
    sided = near.withColumn("inside", F.col("score") >= threshold).withColumn("distance", F.abs(F.col("score") - threshold))
    best = Window.partitionBy("person", "inside").orderBy("distance", F.desc("face_id"))
    return sided.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= most).drop("r")


def diverse_pick(pools: DataFrame, limit: int = 6, alike: float = 0.95) -> DataFrame:
    """Of each person's pools (with vectors), up to ``limit`` faces of different assets that don't look
    alike: half from each side, then from either. A group has at most twice the pool's size."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["distance", "face_id"]).to_dict("records")
        chosen: list[dict] = []

        def take(pool: list[dict], most: int) -> None:
            for r in pool:
                if len(chosen) >= most:
                    return
                v = np.asarray(r["vector"], float)
                if r not in chosen and all(c["asset_id"] != r["asset_id"] and float(v @ np.asarray(c["vector"], float)) <= alike for c in chosen):
                    chosen.append(r)

        take([r for r in rows if r["inside"]], limit // 2)
        take([r for r in rows if not r["inside"]], len(chosen) + limit // 2)
        take(rows, limit)
        chosen.sort(key=lambda r: (not r["inside"], r["distance"], r["face_id"]))
        out = pd.DataFrame(chosen, columns=pdf.columns)
        out["place"] = np.arange(len(out), dtype="int32")
        return out[["person", "face_id", "asset_id", "inside", "distance", "place"]]

    return pools.groupBy("person").applyInPandas(pick, "person int, face_id long, asset_id long, inside boolean, distance double, place int")


def non_maximum(boxes: DataFrame, threshold: float = 0.3, most: int = 5000) -> DataFrame:
    """Per image, boxes by falling score without those that overlap a better one too much."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "box_id"], ascending=[False, True]).head(most).reset_index(drop=True)
        b = np.stack(pdf["box"].to_numpy()).astype(float)
        area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        left, out = np.arange(len(b)), []
        while len(left):
            best, rest = left[0], left[1:]
            out.append(best)
            w = np.minimum(b[best, 2], b[rest, 2]) - np.maximum(b[best, 0], b[rest, 0])
            h = np.minimum(b[best, 3], b[rest, 3]) - np.maximum(b[best, 1], b[rest, 1])
            shared = np.maximum(w, 0) * np.maximum(h, 0)
            left = rest[shared / (area[best] + area[rest] - shared) <= threshold]
        return pdf.loc[out, ["image_id", "box_id", "score"]]

    return boxes.groupBy("image_id").applyInPandas(keep, "image_id long, box_id long, score double")


def face_search(faces: DataFrame, examples: DataFrame, rejected: DataFrame, n_groups: int, mode: str = "any") -> DataFrame:
    """Assets by falling best score of people in them, under ``match_people``."""
    matches = drop_rejected(face_match(faces, examples), rejected).join(faces.select("face_id", "unit_id"), "face_id")
    frames = match_people(matches, n_groups, mode)
    return best_per_asset(matches.join(frames, ["asset_id", "unit_id"], "left_semi").select("asset_id", "unit_id", "score"))
