"""Catalogue against listings: reconciliation, index changes, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ancestors, folder_key


def current(derived: DataFrame, assets: DataFrame, model_version: str | None = None) -> DataFrame:
    """Derived rows of the present version of their asset; stale ones vanish."""
    here = assets.filter("present").select(F.col("id").alias("asset_id"), F.col("version").alias("file_version"))
    out = derived.join(here, ["asset_id", "file_version"], "left_semi")
    return out if model_version is None else out.filter(F.col("model_version") == model_version)


def progress(inventory: DataFrame, assets: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of counts over the inventory's files: registered, metadata, scanned, unreadable, and
    done by later stage. A file counts as scanned when its metadata is there or failed."""
    a = assets.filter("present").select("path_key", F.col("id").alias("asset_id"), "version", "metadata_ready")
    here = inventory.select("path_key").join(a, "path_key", "left")
    wide = jobs.groupBy("asset_id", F.col("file_version").alias("version")).agg(
        F.bool_or((F.col("stage") == "metadata") & (F.col("status") == "error")).alias("failed"),
        *[F.bool_or((F.col("stage") == s) & (F.col("status") == "done")).alias(s) for s in ("embedding", "caption", "faces", "location")],
    )
    failed = F.coalesce("failed", F.lit(False))
    ready = F.coalesce("metadata_ready", F.lit(False))
    return here.join(wide, ["asset_id", "version"], "left").agg(
        F.count("*").alias("total"),
        F.count("asset_id").alias("registered"),
        F.count_if(ready).alias("metadata"),
        F.count_if(ready | failed).alias("scanned"),
        F.count_if(~ready & failed).alias("unreadable"),
        *[F.count_if(s).alias(s) for s in ("embedding", "caption", "faces", "location")],
    )


def in_scope(path: Column, scopes: list[str]) -> Column:
    """Below one of the folders, at a folder boundary; no scopes: everywhere."""
    out = F.lit(not scopes)
    for s in scopes:
        f = s.strip("/")
        out = out | path.startswith(f + "/") | (path == f) if f else F.lit(True)
    return out


def reconcile(catalog: DataFrame, scan: DataFrame, scopes: list[str] = (), complete: bool = True) -> DataFrame:
    """(path, action, version, present, size, mtime) of a catalogue against a listing.

    added: not known; changed: another size or time, so the version grows and derived rows go stale;
    restored: the same file after an absence, keeping its version; removed: in scope, present and
    not listed, if the listing is complete; unchanged: the others.
    """
    old = catalog.select("path", F.col("size").alias("o_size"), F.col("mtime").alias("o_mtime"), F.col("version").alias("o_version"), F.col("present").alias("o_present"))
    new = scan.select("path", F.col("size").alias("n_size"), F.col("mtime").alias("n_mtime"))
    both = old.join(new, "path", "full_outer")
    differs = (F.col("o_size") != F.col("n_size")) | (F.col("o_mtime") != F.col("n_mtime"))
    gone = F.col("n_size").isNull() & F.col("o_present") & in_scope(F.col("path"), list(scopes)) & F.lit(complete)
    action = (
        F.when(F.col("o_version").isNull(), "added")
        .when(F.col("n_size").isNotNull() & differs, "changed")
        .when(F.col("n_size").isNotNull() & ~F.col("o_present"), "restored")
        .when(gone, "removed")
        .otherwise("unchanged")
    )
    return both.withColumn("action", action).select(
        "path",
        "action",
        F.when(F.col("action") == "added", F.lit(1)).when(F.col("action") == "changed", F.col("o_version") + 1).otherwise(F.col("o_version")).cast("long").alias("version"),
        F.when(F.col("action") == "removed", F.lit(False)).when(F.col("n_size").isNotNull(), F.lit(True)).otherwise(F.col("o_present")).alias("present"),
        F.coalesce("n_size", "o_size").alias("size"),
        F.coalesce("n_mtime", "o_mtime").alias("mtime"),
    )


def guarded_reconcile(catalog: DataFrame, scan: DataFrame, scopes: list[str], available: list[str], listing_errors: int = 0) -> DataFrame:
    """Reconciliation that removes nothing unless all scopes were there and listed without errors."""
    return reconcile(catalog, scan, scopes, complete=listing_errors == 0 and set(scopes) <= set(available))


def missing_in(catalog: DataFrame, scan: DataFrame, scopes: list[str]) -> DataFrame:
    """Present files of the scopes that the listing lacks."""
    return catalog.filter(F.col("present") & in_scope(F.col("path"), list(scopes))).join(scan, "path", "left_anti")


def plan_changes(outbox: DataFrame, units: DataFrame, assets: DataFrame, embeddings: DataFrame, dim: int, model_version: str) -> DataFrame:
    """(unit_id, revision, action): upsert where the asset is present and its vector current, delete
    otherwise. A current vector of another dimension raises when the rows are read."""
    u = outbox.join(units.select(F.col("id").alias("unit_id"), "asset_id"), "unit_id", "left")
    a = assets.select(F.col("id").alias("asset_id"), "version", "present")
    e = embeddings.select("unit_id", "file_version", "model_version", F.size("vector").alias("dim"))
    joined = u.join(a, "asset_id", "left").join(e, "unit_id", "left")
    ready = F.coalesce(F.col("present") & (F.col("file_version") == F.col("version")) & (F.col("model_version") == model_version), F.lit(False))
    checked = F.when(ready & (F.col("dim") != dim), F.raise_error(F.lit("wrong dimension"))).when(ready, "upsert").otherwise("delete")
    return joined.select("unit_id", "revision", checked.alias("action"))


def auxiliary_rows(assets: DataFrame, places: DataFrame, faces: DataFrame) -> DataFrame:
    """One row per place vector and per face, each with the filter columns of its asset."""
    keep = assets.filter("present").select(F.col("id").alias("asset_id"), F.col("version").alias("file_version"), "folder", "camera", "captured_at")
    p = places.select("asset_id", "file_version", F.lit("place").alias("kind"), F.concat(F.lit("place:"), F.col("asset_id").cast("string")).alias("row_id"), "vector")
    f = faces.select("asset_id", "file_version", F.lit("face").alias("kind"), F.concat(F.lit("face:"), F.col("face_id").cast("string")).alias("row_id"), "vector")
    return p.unionByName(f).join(keep, ["asset_id", "file_version"])


def unclaimed(assets: DataFrame, jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Assets with pending stages and none running, newest first."""
    todo = jobs.filter("status = 'pending'").select("asset_id").distinct()
    busy = jobs.filter("status = 'running'").select("asset_id").distinct()
    here = assets.filter("present").select(F.col("id").alias("asset_id"))
    out = here.join(todo, "asset_id", "left_semi").join(busy, "asset_id", "left_anti")
    return out if limit is None else out.orderBy(F.desc("asset_id")).limit(limit)


def pending_work(assets: DataFrame, completed: DataFrame, stages: list[str], model_version: str) -> DataFrame:
    """(stage_order, stage, asset_id) still to be done at current versions; all stages but metadata
    wait for it. Work of an older model or file version is due again."""
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("stage_order"), F.lit(s).alias("stage")) for i, s in enumerate(stages)]))
    all_work = assets.filter("present").select(F.col("id").alias("asset_id"), F.col("version").alias("file_version"), "metadata_ready", listed.alias("s")).select("asset_id", "file_version", "metadata_ready", "s.*")
    due = all_work.filter((F.col("stage") == "metadata") | F.col("metadata_ready"))
    done = completed.filter(F.col("model_version") == model_version).select("asset_id", "file_version", "stage")
    return due.join(done, ["asset_id", "file_version", "stage"], "left_anti").select("stage_order", "stage", "asset_id")


def stage_rollup(unit_jobs: DataFrame) -> DataFrame:
    """Per asset and stage: pending while any unit is, then error if any failed, else done; elapsed
    time is summed and failures are counted in a message."""
    failed = F.count_if(F.col("status") == "error")
    open_ = F.count_if(F.col("status").isin("pending", "running"))
    out = unit_jobs.groupBy("asset_id", "stage").agg(open_.alias("open"), failed.alias("failed"), F.count("*").alias("units"), F.sum("elapsed").alias("elapsed"))
    status = F.when(F.col("open") > 0, "pending").when(F.col("failed") > 0, "error").otherwise("done")
    message = F.when((F.col("open") == 0) & (F.col("failed") > 0), F.concat_ws(" of ", F.col("failed").cast("string"), F.col("units").cast("string")))
    return out.select("asset_id", "stage", status.alias("status"), "elapsed", message.alias("message"))


def cover_folders(includes: DataFrame, new: DataFrame, exact: bool = False) -> DataFrame:
    """(folder, state) of a minimal covering set: ``added`` for new folders that nothing covers,
    ``skipped`` for covered ones, ``kept`` and ``absorbed`` for the folders there were. Each folder
    meets its own ancestors only. Folders are compared by ``folder_key``; with ``exact`` as they are
    written, so that ``a/`` is a folder of its own below ``a`` and none is the root."""
    form = F.col("folder") if exact else folder_key("folder")
    root = [] if exact else [F.array(F.lit("."))]
    key = lambda df: df.select("folder", form.alias("key")).dropDuplicates(["key"])
    old, candidates = key(includes), key(new)
    every = old.select("key").unionByName(candidates.select("key")).distinct()
    above = lambda df: df.select("folder", "key", F.explode(F.concat(*root, ancestors("key"))).alias("above"))
    covered_by = lambda df, by, strict: above(df).filter(F.col("above") != F.col("key") if strict else F.lit(True)).join(by.select(F.col("key").alias("above")), "above", "left_semi").select("key").distinct()
    by_old = covered_by(candidates, old, False)
    by_any = covered_by(candidates, every, True)
    added = candidates.join(by_old, "key", "left_anti").join(by_any, "key", "left_anti")
    absorbed = covered_by(old, added, True)
    return (
        added.select("folder", F.lit("added").alias("state"))
        .unionByName(candidates.join(added, "key", "left_anti").select("folder", F.lit("skipped").alias("state")))
        .unionByName(old.join(absorbed, "key", "left_semi").select("folder", F.lit("absorbed").alias("state")))
        .unionByName(old.join(absorbed, "key", "left_anti").select("folder", F.lit("kept").alias("state")))
    )


