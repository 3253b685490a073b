"""Catalogue-shaped tables derived from the given ones, for Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ext", F.expr("case when event_id % 50 = 0 then '.mp4' else '.jpg' end"))
    m = e.selectExpr(
        "event_id as id",
        "event_type as folder",
        "concat('cam_', cast(user_id % 2 as string)) as camera",
        "concat('IMG_', cast(event_id as string), ext) as filename",
        "ext as extension",
        "case when event_id % 47 = 0 then null else date_format(ts, 'yyyy-MM-dd HH:mm:ss') end as captured_at",
        "cast(floor(value * 1000) as bigint) as size",
        "cast(case event_id % 4 when 1 then 3000 when 3 then 3000 else 4000 end as bigint) as width",
        "cast(case event_id % 4 when 1 then 4000 when 2 then 2250 else 3000 end as bigint) as height",
        "event_id % 97 <> 0 as present",
        "event_id % 89 <> 0 as metadata_ready",
        "cast(1 as bigint) as version",
    )
    return m.selectExpr(
        "*",
        "concat(folder, '/', filename) as relative_path",
        "width * height as pixels",
        "case when width > height then 'landscape' when height > width then 'portrait' else 'square' end as orientation",
        "case when id % 10 = 0 then 55 + (id % 100) / 100d end as latitude",
        "case when id % 10 = 0 then 37 + (id % 70) / 100d end as longitude",
        "case when id % 30 = 0 then 55 + (id % 100) / 100d + 0.01d end as user_latitude",
        "case when id % 30 = 0 then 37 + (id % 70) / 100d + 0.01d end as user_longitude",
        "case when id % 10 = 0 then 'Москва' else '' end as geo_text",
        "case when id % 60 = 0 then 'Дача' else '' end as user_place",
    )


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as id", "n_name as name", "cast(n_nationkey * 37 % 180 - 90 + 0.5 as double) as latitude", "cast(n_nationkey * 91 % 360 - 180 + 0.5 as double) as longitude")


def vec_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id as unit_id", "vec_id div 3 as asset_id", "(vec_id % 3) * 10000 as timestamp_ms", "embedding as vector", "label")


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id as face_id", "vec_id div 2 as asset_id", "concat(cast(vec_id div 2 as string), ':photo') as unit_id", "embedding as vector", "label as person")


def examples(spark: SparkSession, sf_dir: str, at: str = "r <= 2") -> DataFrame:
    """Of each person the two smallest faces as examples, the third as rejected."""
    r = F.row_number().over(Window.partitionBy("person").orderBy("face_id"))
    return faces(spark, sf_dir).withColumn("r", r).filter(at).select("person", "face_id", "vector")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = examples(spark, sf_dir, "r <= 3")
    return f.groupBy("person").agg(F.sort_array(F.collect_list("face_id")).alias("f")).selectExpr("person as id", "concat('person ', cast(person as string)) as name", "slice(f, 1, 2) as examples", "slice(f, 3, 1) as rejected", "f[0] as cover")


def scan(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Two listings derived from pages: old (catalogue) and new."""
    path = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"
    p = table(spark, sf_dir, "pages").selectExpr("page_id", f"concat({path}, '/p', cast(page_id as string), '.jpg') as path", "html")
    if which == "old":
        return p.filter("page_id % 10 <> 0").selectExpr("page_id", "path", "cast(length(html) as bigint) as size", "page_id * 1000 as mtime", "cast(1 as bigint) as version", "page_id % 11 <> 0 as present")
    return p.filter("page_id % 10 <> 1").selectExpr("page_id", "path", "cast(length(html) + case when page_id % 7 = 0 then 1 else 0 end as bigint) as size", "page_id * 1000 as mtime")


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "new").selectExpr("page_id", "path", "regexp_replace(path, '/[^/]*$', '') as folder")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id div 4 as asset_id", "((conv_id % 4) * 10 + turn) * 10000 as timestamp_ms", "concat(cast(conv_id div 4 as string), ':frame:', cast(((conv_id % 4) * 10 + turn) * 10000 as string)) as unit_id", "text as description", "role", "conv_id", "turn")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as job",
        "ts",
        "case when user_id % 2 = 0 then 'local' else 'remote' end as source",
        "case event_type when 'click' then 'embedding' when 'view' then 'faces' when 'purchase' then 'caption' when 'signup' then 'location' else 'metadata' end as stage",
        "case when event_type = 'error' then 'error' else 'done' end as status",
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of the media: five stages each, with status by arithmetic."""
    stage = "explode(array('metadata', 'embedding', 'caption', 'faces', 'location'))"
    j = table(spark, sf_dir, "events").selectExpr("event_id as asset_id", "cast(case when event_id % 13 = 0 then 0 else 1 end as bigint) as file_version", f"{stage} as stage")
    return j.selectExpr("*", "case (asset_id + length(stage)) % 9 when 0 then 'pending' when 1 then 'running' when 2 then 'error' else 'done' end as status", "cast(asset_id % 7 as double) / 8 as elapsed", "'m1' as model_version")


#: Name -> (adapters that it reads, SELECT of DuckDB).
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "media": ((), """
        SELECT *, folder || '/' || filename AS relative_path, width * height AS pixels,
          CASE WHEN width > height THEN 'landscape' WHEN height > width THEN 'portrait' ELSE 'square' END AS orientation,
          CASE WHEN id % 10 = 0 THEN 55 + (id % 100) / 100::DOUBLE END AS latitude,
          CASE WHEN id % 10 = 0 THEN 37 + (id % 70) / 100::DOUBLE END AS longitude,
          CASE WHEN id % 30 = 0 THEN 55 + (id % 100) / 100::DOUBLE + 0.01::DOUBLE END AS user_latitude,
          CASE WHEN id % 30 = 0 THEN 37 + (id % 70) / 100::DOUBLE + 0.01::DOUBLE END AS user_longitude,
          CASE WHEN id % 10 = 0 THEN 'Москва' ELSE '' END AS geo_text, CASE WHEN id % 60 = 0 THEN 'Дача' ELSE '' END AS user_place
        FROM (SELECT event_id AS id, event_type AS folder, 'cam_' || (user_id % 2) AS camera,
          'IMG_' || event_id || CASE WHEN event_id % 50 = 0 THEN '.mp4' ELSE '.jpg' END AS filename,
          CASE WHEN event_id % 50 = 0 THEN '.mp4' ELSE '.jpg' END AS extension,
          CASE WHEN event_id % 47 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS captured_at,
          CAST(floor(value * 1000) AS BIGINT) AS size,
          CAST(CASE event_id % 4 WHEN 1 THEN 3000 WHEN 3 THEN 3000 ELSE 4000 END AS BIGINT) AS width,
          CAST(CASE event_id % 4 WHEN 1 THEN 4000 WHEN 2 THEN 2250 ELSE 3000 END AS BIGINT) AS height,
          event_id % 97 <> 0 AS present, event_id % 89 <> 0 AS metadata_ready, 1::BIGINT AS version FROM events)"""),
    "ready": (("media",), "SELECT * FROM media WHERE present AND metadata_ready"),
    "cities": ((), "SELECT n_nationkey::BIGINT AS id, n_name AS name, n_nationkey * 37 % 180 - 90 + 0.5::DOUBLE AS latitude, n_nationkey * 91 % 360 - 180 + 0.5::DOUBLE AS longitude FROM nation"),
    "vec_units": ((), "SELECT vec_id AS unit_id, vec_id // 3 AS asset_id, (vec_id % 3) * 10000 AS timestamp_ms, embedding::DOUBLE[] AS vector, label FROM embeddings"),
    "faces": ((), "SELECT vec_id AS face_id, vec_id // 2 AS asset_id, (vec_id // 2) || ':photo' AS unit_id, embedding::DOUBLE[] AS vector, label AS person FROM embeddings"),
    "ranked_faces": (("faces",), "SELECT *, row_number() OVER (PARTITION BY person ORDER BY face_id) AS r FROM faces"),
    "examples": (("ranked_faces",), "SELECT person, face_id, vector FROM ranked_faces WHERE r <= 2"),
    "scores": (("faces", "examples"), """
        SELECT e.person, f.face_id, f.asset_id, f.unit_id, greatest(-1, least(1, max(list_dot_product(f.vector, e.vector)))) AS score
        FROM faces f, examples e GROUP BY ALL"""),
    "people": (("ranked_faces",), """
        SELECT person AS id, 'person ' || person AS name, list(face_id ORDER BY face_id) FILTER (r <= 2) AS examples,
          list(face_id ORDER BY face_id) FILTER (r = 3) AS rejected, min(face_id) AS cover FROM ranked_faces WHERE r <= 3 GROUP BY person"""),
    "paths": ((), "SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || '/p' || page_id || '.jpg' AS path, html FROM pages"),
    "scan_old": (("paths",), "SELECT page_id, path, length(html)::BIGINT AS size, page_id * 1000 AS mtime, 1::BIGINT AS version, page_id % 11 <> 0 AS present FROM paths WHERE page_id % 10 <> 0"),
    "scan_new": (("paths",), "SELECT page_id, path, (length(html) + CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS size, page_id * 1000 AS mtime FROM paths WHERE page_id % 10 <> 1"),
    "folders": (("scan_new",), "SELECT page_id, path, regexp_replace(path, '/[^/]*$', '') AS folder FROM scan_new"),
    "clips": ((), """
        SELECT conv_id // 4 AS asset_id, ((conv_id % 4) * 10 + turn) * 10000 AS timestamp_ms,
          (conv_id // 4) || ':frame:' || (((conv_id % 4) * 10 + turn) * 10000) AS unit_id, text AS description, role, conv_id, turn FROM conversations"""),
    "commits": ((), """
        SELECT event_id AS job, ts, CASE WHEN user_id % 2 = 0 THEN 'local' ELSE 'remote' END AS source,
          CASE event_type WHEN 'click' THEN 'embedding' WHEN 'view' THEN 'faces' WHEN 'purchase' THEN 'caption' WHEN 'signup' THEN 'location' ELSE 'metadata' END AS stage,
          CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END AS status FROM events"""),
    "jobs": ((), """
        SELECT *, CASE (asset_id + length(stage)) % 9 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'error' ELSE 'done' END AS status, (asset_id % 7)::DOUBLE / 8 AS elapsed, 'm1' AS model_version
        FROM (SELECT event_id AS asset_id, CASE WHEN event_id % 13 = 0 THEN 0 ELSE 1 END::BIGINT AS file_version, unnest(['metadata', 'embedding', 'caption', 'faces', 'location']) AS stage FROM events)"""),
    "bursts": (("ready",), """
        SELECT id, 'b:' || max(first) OVER (PARTITION BY folder, camera ORDER BY captured_at, id) AS stack_key FROM (
          SELECT *, CASE WHEN gap IS NULL OR gap > 60 THEN id END AS first FROM (
            SELECT id, lower(folder) AS folder, camera, captured_at, epoch(captured_at::TIMESTAMP) - lag(epoch(captured_at::TIMESTAMP)) OVER (PARTITION BY folder, camera ORDER BY captured_at, id) AS gap
            FROM ready WHERE extension <> '.mp4' AND captured_at IS NOT NULL))"""),
}


def sql(body: str, *names: str) -> str:
    """``body`` after WITH of the named adapters and what they read."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in SQL[n][0]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if body.lstrip().startswith(", RECURSIVE "):  # the body goes on with parts of its own that recur
        return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n][1]})" for n in order) + ", " + body.lstrip()[12:]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n][1]})" for n in order) + body if order else body
