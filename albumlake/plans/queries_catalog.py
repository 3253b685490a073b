"""Filters, order, stacks, reports and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import sql as functions_sql
from ..operators import filters, geo, ordering, reports, stacks
from ..sources import listing, tables
from ..sources.scratch import shared_dir
from .adapters import cities, clips, commits, folders, jobs, media, table, vec_units
from .registry import query


# ---- sources ----
@query("""SELECT page_id, path, '.jpg' AS ext, 'jpeg' AS grp, sha256(html) AS digest FROM paths""", "paths")
def source_format_digest(spark, d):
    p = table(spark, d, "pages").selectExpr("page_id", "concat(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/p', cast(page_id as string), '.jpg') as path", "html")
    return p.select("page_id", "path", tables.format_key(F.col("path")).alias("ext"), tables.classify_format(F.col("path")).alias("grp"), tables.content_digest("html").alias("digest"))


@query("""SELECT doc_id // 3 AS unit_id, max(n_chars) AS revision FROM documents GROUP BY 1
  HAVING (doc_id // 3) % 5 <> 0 OR (doc_id // 3) % 10 = 0 ORDER BY 1""")
def source_apply_changes(spark, d):
    docs = table(spark, d, "documents").withColumn("unit_id", F.expr("doc_id div 3"))
    base = docs.groupBy("unit_id").agg((F.max("n_chars") - 1).alias("revision"))
    ups = docs.groupBy("unit_id").agg(F.max("n_chars").alias("revision")).filter("unit_id % 5 <> 0 or unit_id % 10 = 0")
    gone = base.filter("unit_id % 5 = 0 and unit_id % 10 <> 0").select("unit_id")
    once = tables.apply_changes(base, ups, gone)
    return tables.apply_changes(once, ups, gone)


@query("SELECT vec_id, (row_number() OVER (ORDER BY label, vec_id) - 1)::BIGINT AS ordinal FROM embeddings")
def source_freeze_result(spark, d):
    return ordering.freeze(table(spark, d, "embeddings").select("vec_id", "label"), [F.col("label").asc(), F.col("vec_id").asc()]).select("vec_id", "ordinal")


@query("""SELECT query_no, condition, asset_id, expected FROM (
  SELECT conv_id AS query_no, unnest(['a', 'b']) AS condition, conv_id * 10 + turn AS asset_id, turn % 2 = 0 AS expected FROM conversations)""")
def source_gold_pairs(spark, d):
    c = table(spark, d, "conversations").withColumn("a", F.expr("conv_id * 10 + turn"))
    raw = c.groupBy(F.col("conv_id").alias("query_no")).agg(F.collect_list(F.when(F.col("turn") % 2 == 0, F.col("a"))).alias("positive"), F.collect_list(F.when(F.col("turn") % 2 != 0, F.col("a"))).alias("negative"))
    raw = raw.withColumn("query", F.lit("q")).withColumn("conditions", F.array(F.lit("a"), F.lit("b")))
    return tables.explode_gold(raw).select("query_no", "condition", "asset_id", "expected")


# ---- filters ----
def filtered(name: str, where: str, **fields):
    def run(spark, d):
        return filters.Filters(**fields).apply(media(spark, d)).select("id", "folder", "captured_at")

    run.__name__ = name
    return query(f"SELECT id, folder, captured_at FROM ready WHERE {where}", "ready")(run)


filtered("filter_browsable", "true")
filtered("filter_unknown_date", "captured_at IS NULL", unknown_date=True, date_from="2024-01-05")
filtered("filter_captured_between", "captured_at >= '2024-01-05' AND captured_at < '2024-01-10'", date_from="2024-01-05", date_to="2024-01-09")
filtered("filter_media_kind", "extension = '.mp4'", media_kind="video")
filtered("filter_equals", "extension = '.jpg' AND camera = 'cam_1' AND orientation = 'portrait'", extension=".jpg", camera="cam_1", orientation="portrait")
filtered("filter_sizes", "width >= 3500 AND height >= 2500 AND size >= 5000 AND size <= 90000", min_width=3500, min_height=2500, min_bytes=5000, max_bytes=90000)
filtered("filter_megapixels", "pixels >= 10500000", min_megapixels=10.5)
filtered("filter_place", "contains(lower(geo_text), 'моск') OR contains(lower(user_place), 'моск')", place="МОСК")
filtered("filter_has_gps", "coalesce(user_latitude, latitude) IS NOT NULL", has_gps=True)
filtered("filter_in_bounds", "coalesce(user_latitude, latitude) BETWEEN 55.2 AND 55.6 AND coalesce(user_longitude, longitude) BETWEEN 37.1 AND 37.5", bounds=(37.1, 55.2, 37.5, 55.6))


@query("SELECT id FROM cities WHERE latitude BETWEEN -60 AND 60 AND (longitude >= 100 OR longitude <= -100)", "cities")
def filter_antimeridian(spark, d):
    c = cities(spark, d).withColumn("user_latitude", F.lit(None).cast("double")).withColumn("user_longitude", F.lit(None).cast("double"))
    return c.filter(filters.in_bounds(100, -60, -100, 60)).select("id")


@query("SELECT page_id, folder FROM folders WHERE folder = split_part(folder, '/', 1) || '/fr' OR starts_with(folder, split_part(folder, '/', 1) || '/fr/')", "folders")
def filter_in_folder(spark, d):
    f = folders(spark, d).withColumn("host", F.split("folder", "/")[0]).withColumn("folder_", F.col("folder"))
    rest = f.withColumn("folder", F.expr("substring(folder, length(host) + 2)"))
    return rest.filter(filters.in_folder("fr\\")).select("page_id", F.col("folder_").alias("folder"))


@query("SELECT id FROM media WHERE contains(lower(filename), 'img_77') OR contains(lower(relative_path), 'img_77')", "media")
def filter_literal_name(spark, d):
    return media(spark, d).filter(filters.literal_name("IMG_77")).select("id")


@query("SELECT id, filename FROM media WHERE contains(lower(filename), 'g_12') OR contains(lower(relative_path), 'g_12') ORDER BY id LIMIT 200", "media")
def filter_name_match(spark, d):
    return filters.name_match(media(spark, d), " G_12 ").select("id", "filename")


@query("""SELECT asset_id, file_version, count(*) AS n FROM jobs j WHERE model_version = 'm1' AND asset_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error') GROUP BY ALL""", "jobs")
def filter_current_model(spark, d):
    out = table(spark, d, "events").filter("event_type = 'error'").select(F.col("event_id").alias("asset_id"))
    return filters.current_model(jobs(spark, d), "m1", out, "asset_id").groupBy("asset_id", "file_version").agg(F.count("*").alias("n"))


@query("""SELECT m.id, f.unit_id, f.timestamp_ms, length(f.description)::BIGINT AS chars FROM (SELECT DISTINCT asset_id AS id FROM clips) m
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp_ms, unit_id) AS r FROM clips WHERE turn > 0) f ON f.asset_id = m.id AND r = 1""", "clips")
def filter_unit_view(spark, d):
    c = clips(spark, d)
    assets = c.select(F.col("asset_id").alias("id")).distinct().withColumn("description", F.lit(None).cast("string"))
    return filters.unit_view(assets, c.filter("turn > 0")).select("id", "unit_id", "timestamp_ms", F.char_length("description").cast("long").alias("chars"))


@query("SELECT asset_id, CASE WHEN turn = 0 THEN description END AS description, asset_id || ':frame:' || ((conv_id % 4) * 100000) AS unit_id FROM clips", "clips")
def filter_at_moment(spark, d):
    c = clips(spark, d)
    return filters.at_moment(c, F.concat(F.col("asset_id").cast("string"), F.lit(":frame:"), (F.col("conv_id") % 4 * 100000).cast("string"))).select("asset_id", "description", "unit_id")


@query("""SELECT DISTINCT unnest(list_transform(range(1, len(string_split(folder, '/')) + 1), lambda i: array_to_string(string_split(folder, '/')[1:i], '/'))) AS folder
  FROM folders WHERE contains(lower(folder), '/fr')""", "folders")
def filter_tree(spark, d):
    return filters.tree_filter(folders(spark, d), "/FR")


# ---- order ----
def ordered(kind: str, keys: str):
    def run(spark, d):
        m = media(spark, d).filter(filters.browsable())
        return ordering.with_ordinal(m.select("id", "captured_at", "filename"), ordering.order_by(kind)).select("id", "ordinal")

    run.__name__ = f"order_{kind}"
    return query(f"SELECT id, (row_number() OVER (ORDER BY {keys}) - 1)::BIGINT AS ordinal FROM ready", "ready")(run)


ordered("newest", "captured_at DESC NULLS LAST, id DESC")
ordered("oldest", "captured_at ASC NULLS FIRST, id ASC")
ordered("name", "lower(filename), id")
ordered("added", "id DESC")

FROZEN = "SELECT id, (row_number() OVER (ORDER BY captured_at DESC NULLS LAST, id DESC) - 1)::BIGINT AS ordinal, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'yes' WHEN 2 THEN 'no' ELSE 'uncertain' END AS verdict FROM ready"


def frozen(spark, d):
    m = media(spark, d).filter(filters.browsable()).select("id", "captured_at")
    v = F.when(F.col("id") % 4 == 1, "yes").when(F.col("id") % 4 == 2, "no").when(F.col("id") % 4 == 3, "uncertain")
    return ordering.freeze(m, ordering.order_by("newest")).withColumn("verdict", v).select("id", "ordinal", "verdict")


@query(f"SELECT id, ordinal, verdict, (SELECT count(*) FROM ready) > 600 AS has_more FROM ({FROZEN}) WHERE ordinal >= 400 AND ordinal < 600", "ready")
def order_page(spark, d):
    return ordering.page(frozen(spark, d), 400)


@query(f"""SELECT id, verdict, ordinal, n > 400 AS has_more FROM (SELECT id, verdict, (row_number() OVER (ORDER BY ordinal) - 1)::BIGINT AS ordinal, count(*) OVER () AS n FROM ({FROZEN}) WHERE verdict = 'yes') WHERE ordinal >= 200 AND ordinal < 400""", "ready")
def order_verdict_page(spark, d):
    return ordering.verdict_page(frozen(spark, d), "yes", 200).select("id", "verdict", "ordinal", "has_more")


@query(f"SELECT id, ordinal FROM ({FROZEN}) WHERE verdict IS NULL ORDER BY ordinal LIMIT 40", "ready")
def order_pending(spark, d):
    return ordering.pending(frozen(spark, d)).select("id", "ordinal")


@query("""WITH c AS (SELECT vec_id AS asset_id, vec_id AS position, vec_id % 3 <> 0 AS visible, CASE WHEN vec_id % 3 = 0 THEN vec_id + 1 END AS cover_id FROM embeddings WHERE vec_id % 5 <> 0)
  SELECT a.vec_id AS asset_id, coalesce(CASE WHEN c.visible THEN c.position END, v.position, least(a.vec_id * 2, (SELECT max(position) FROM c WHERE visible))) AS position
  FROM embeddings a LEFT JOIN c ON c.asset_id = a.vec_id LEFT JOIN c v ON v.asset_id = c.cover_id AND v.visible""")
def order_locate(spark, d):
    e = table(spark, d, "embeddings")
    cards = e.filter("vec_id % 5 <> 0").selectExpr("vec_id as asset_id", "vec_id as position", "vec_id % 3 <> 0 as visible", "case when vec_id % 3 = 0 then vec_id + 1 end as cover_id")
    return ordering.locate(e.selectExpr("vec_id as asset_id", "vec_id * 2 as old_row"), cards)


@query("SELECT asset_id, unit_id, score, (row_number() OVER (ORDER BY score DESC, asset_id, unit_id) - 1)::BIGINT AS ordinal FROM (SELECT doc_id // 2 AS asset_id, doc_id AS unit_id, n_chars AS score FROM documents)")
def order_merge_ranked(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id div 2 as asset_id", "doc_id as unit_id", "n_chars as score")
    return ordering.merge_ranked([docs.filter(f"unit_id % 3 = {i}") for i in range(3)])


@query("""SELECT * FROM (SELECT asset_id, stage, 0 AS level, '' AS moment FROM jobs WHERE status = 'error'
  UNION ALL SELECT asset_id, 'caption' AS stage, 1 AS level, (timestamp_ms // 60000) || ':' || lpad((timestamp_ms // 1000 % 60)::VARCHAR, 2, '0') AS moment FROM clips WHERE turn = 3)
  ORDER BY level, asset_id DESC, stage, moment LIMIT 500""", "jobs", "clips")
def order_error_report(spark, d):
    files = jobs(spark, d).filter("status = 'error'").select("asset_id", "stage")
    frames = clips(spark, d).filter("turn = 3").select("asset_id", F.lit("caption").alias("stage"), S.timestamp_text("timestamp_ms").alias("moment"))
    return ordering.error_report(files, frames)


# ---- stacks ----
@query("SELECT id, stack_key FROM bursts", "bursts")
def stack_bursts(spark, d):
    return stacks.burst_stacks(media(spark, d), 60)


@query("""SELECT id, 'v:' || min(id) OVER (PARTITION BY lower(folder), regexp_replace(lower(filename), '(\\.[a-z0-9]{2,5})+$', ''), captured_at, camera) AS stack_key
  FROM (SELECT *, 1 AS one FROM (SELECT * REPLACE ('IMG_' || (id // 2) || extension AS filename, substr(captured_at, 1, 10) AS captured_at) FROM ready)) WHERE extension <> '.mp4' AND captured_at IS NOT NULL""", "ready")
def stack_versions(spark, d):
    m = media(spark, d).withColumn("filename", F.expr("concat('IMG_', cast(id div 2 as string), extension)")).withColumn("captured_at", F.expr("substr(captured_at, 1, 10)"))
    return stacks.version_stacks(m)


CARDS = """SELECT *, CASE WHEN id = cover_id THEN 1 ELSE ordinal + 2 END AS choice FROM (
  SELECT *, min(ordinal) OVER k AS first, count(*) OVER k AS n, coalesce(max(CASE WHEN id % 3 = 0 AND covered THEN id END) OVER k, first_value(id) OVER (PARTITION BY stack_key ORDER BY ordinal)) AS cover_id FROM (
    SELECT o.id, o.ordinal, coalesce(b.stack_key, 'a:' || o.id) AS stack_key, o.id = max(CASE WHEN o.id % 3 = 0 THEN o.id END) OVER (PARTITION BY coalesce(b.stack_key, 'a:' || o.id)) AS covered
    FROM (SELECT id, (row_number() OVER (ORDER BY captured_at DESC NULLS LAST, id DESC) - 1)::BIGINT AS ordinal FROM ready WHERE camera = 'cam_0') o LEFT JOIN bursts b ON o.id = b.id)
  WINDOW k AS (PARTITION BY stack_key))"""


def cards(spark, d):
    m = media(spark, d)
    st = tables.materialize(stacks.burst_stacks(m, 60))
    shown = ordering.with_ordinal(m.filter(filters.browsable() & (F.col("camera") == "cam_0")).select("id", "captured_at"), ordering.order_by("newest")).select("id", "ordinal")
    covers = shown.join(st, "id").filter("id % 3 = 0").groupBy("stack_key").agg(F.max("id").alias("asset_id"))
    return stacks.stack_cards(shown, st, covers)


@query(f"SELECT id, c.stack_key, first, n, cover_id, choice, greatest(n, coalesce(whole, 0)) AS stack_total FROM ({CARDS}) c LEFT JOIN (SELECT stack_key, count(*) AS whole FROM bursts GROUP BY 1) w ON w.stack_key = c.stack_key", "ready", "bursts")
def stack_cards(spark, d):
    return cards(spark, d).select("id", "stack_key", "first", "n", "cover_id", "choice", "stack_total")


@query(f"SELECT id, stack_key, (row_number() OVER (ORDER BY first, choice) - 1)::BIGINT AS position FROM ({CARDS}) WHERE choice = 1", "ready", "bursts")
def stack_visible_cards(spark, d):
    return stacks.visible_cards(cards(spark, d)).select("id", "stack_key", "position")


@query("SELECT coalesce(kind, 'all') AS kind, count(*) AS n FROM (SELECT CASE WHEN extension = '.mp4' THEN 'video' ELSE 'photo' END AS kind FROM ready) GROUP BY ROLLUP (kind)", "ready")
def report_media_totals(spark, d):
    return stacks.media_totals(media(spark, d).filter(filters.browsable()))


# ---- reports ----
@query("""SELECT a.*, j.*, (SELECT count(*) FROM embeddings) AS outbox FROM
  (SELECT count_if(present) AS assets, count_if(present AND metadata_ready) AS ready, count_if(present AND metadata_ready AND captured_at IS NULL) AS unknown_dates FROM media) a,
  (SELECT count_if(status IN ('pending', 'running')) AS pending, count_if(status = 'error') AS errors, count_if(status = 'done' AND stage = 'metadata') AS done_metadata, count_if(status = 'done' AND stage = 'embedding') AS done_embedding,
     count_if(status = 'done' AND stage = 'caption') AS done_caption, count_if(status = 'done' AND stage = 'faces') AS done_faces, count_if(status = 'done' AND stage = 'location') AS done_location
   FROM jobs JOIN media m ON m.id = asset_id AND m.version = file_version WHERE present) j""", "media", "jobs")
def report_catalog_stats(spark, d):
    return reports.catalog_stats(media(spark, d), jobs(spark, d), table(spark, d, "embeddings"))


@query("""SELECT DISTINCT 'folder' AS facet, folder AS value FROM media WHERE present UNION ALL SELECT DISTINCT 'camera', camera FROM media WHERE present UNION ALL SELECT DISTINCT 'extension', extension FROM media WHERE present
  UNION ALL SELECT 'first_day', min(captured_at[1:10]) FROM ready UNION ALL SELECT 'last_day', max(captured_at[1:10]) FROM ready""", "ready")
def report_facets(spark, d):
    return reports.facets(media(spark, d))


@query("SELECT folder, count(*) AS n FROM ready GROUP BY 1", "ready")
def report_folder_counts(spark, d):
    return reports.folder_counts(media(spark, d))


@query("SELECT captured_at[1:7] AS month, count(*) AS n FROM ready WHERE camera = 'cam_1' GROUP BY 1", "ready")
def report_month_histogram(spark, d):
    return reports.month_histogram(media(spark, d), filters.Filters(camera="cam_1").condition())


@query("SELECT CASE WHEN extension = '.mp4' THEN 'video' ELSE 'photo' END AS kind, count(*) AS n FROM ready WHERE folder = 'click' GROUP BY 1", "ready")
def report_media_counts(spark, d):
    return reports.media_counts(media(spark, d), filters.Filters(folder="click").condition())


@query("""SELECT f AS folder, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(string_split(folder, '/')) + 1), lambda i: array_to_string(string_split(folder, '/')[1:i], '/'))) AS f FROM folders) GROUP BY 1""", "folders")
def report_folder_rollup(spark, d):
    return reports.folder_rollup(folders(spark, d).groupBy("folder").agg(F.count("*").alias("n")))


@query("""SELECT year, month, sum(n)::BIGINT AS n FROM (SELECT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY ROLLUP (year, month) HAVING year IS NOT NULL""")
def report_year_rollup(spark, d):
    months = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return reports.year_rollup(months)


@query("""WITH g AS (SELECT CASE p_size WHEN 0 THEN 'sidecars' ELSE CASE p_size % 5 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'raw' WHEN 2 THEN 'video' WHEN 3 THEN 'other_images' ELSE 'other' END END AS "group", count(*) AS n FROM part GROUP BY 1)
  SELECT * FROM g UNION ALL SELECT 'images', coalesce(sum(n), 0)::BIGINT FROM g WHERE "group" IN ('jpeg', 'raw', 'other_images')
  UNION ALL SELECT 'supported', coalesce(sum(n), 0)::BIGINT FROM g WHERE "group" IN ('jpeg', 'raw', 'other_images', 'video') UNION ALL SELECT 'files', sum(n)::BIGINT FROM g""")
def report_format_totals(spark, d):
    ext = F.element_at(F.array(*map(F.lit, (".jpg", ".cr2", ".mp4", ".png", ".txt"))), (F.col("p_size") % 5 + 1).cast("int"))
    path = F.concat(F.lit("x/f"), F.when(F.col("p_size") == 0, ".xmp").otherwise(ext))
    return reports.format_totals(table(spark, d, "part").select(tables.classify_format(path).alias("group"), F.lit(1).alias("n")).groupBy("group").agg(F.count("*").alias("n")))


@query("SELECT coalesce(verdict, 'all') AS verdict, count(*) AS n FROM (SELECT CASE id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'yes' WHEN 2 THEN 'no' ELSE 'uncertain' END AS verdict FROM ready) GROUP BY ROLLUP (verdict)", "ready")
def report_verdict_groups(spark, d):
    return reports.verdict_groups(frozen(spark, d))


@query("SELECT coalesce(captured_at[1:4], 'unknown') AS year, extension, count(*) AS n FROM media WHERE present GROUP BY ALL", "media")
def report_profile_counts(spark, d):
    return reports.profile_counts(media(spark, d))


@query("SELECT stage, count_if(status = 'done') - count_if(status = 'done' AND asset_id % 2 = 0) AS delta FROM jobs GROUP BY 1", "jobs")
def report_progress_delta(spark, d):
    j = jobs(spark, d)
    return reports.progress_delta(j.filter("asset_id % 2 = 0"), j)


@query("""SELECT source, stage, "at", sum(here) OVER (PARTITION BY source, stage ORDER BY "at" RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)::BIGINT AS n FROM
  (SELECT source, stage, epoch(date_trunc('second', ts))::BIGINT AS "at", count(*) AS here FROM commits GROUP BY ALL)""", "commits")
def report_rolling_rate(spark, d):
    return reports.rolling_rate(commits(spark, d))


@query("""SELECT direction, "at", event_id, round(sum(bytes) OVER w / greatest(0.1, least(10.0, "at" - min("at") OVER w)), 6) AS rate FROM
  (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'in' ELSE 'out' END AS direction, epoch(date_trunc('second', ts))::BIGINT AS "at", CAST(floor(value * 1000) AS BIGINT) AS bytes FROM events)
  WINDOW w AS (PARTITION BY direction ORDER BY "at" RANGE BETWEEN 10 PRECEDING AND CURRENT ROW)""")
def report_transfer_rate(spark, d):
    t = table(spark, d, "events").selectExpr("event_id", "case when user_id % 2 = 0 then 'in' else 'out' end as direction", "unix_timestamp(ts) as at", "cast(floor(value * 1000) as bigint) as bytes")
    return reports.transfer_rate(t).withColumn("rate", F.round("rate", 6))


# ---- places ----
@query("""SELECT id, city_id, city, round(2 * 6371 * asin(sqrt(least(1, pow(sin(radians(c_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(c_lat)) * pow(sin(radians(c_lon - lon) / 2), 2)))), 3) AS km FROM (
  SELECT p.id, c.id AS city_id, c.name AS city, c.latitude AS c_lat, c.longitude AS c_lon, lat, lon, row_number() OVER (PARTITION BY p.id ORDER BY
    round(cos(radians(lat)) * cos(radians(lon)) * cos(radians(c.latitude)) * cos(radians(c.longitude)) + cos(radians(lat)) * sin(radians(lon)) * cos(radians(c.latitude)) * sin(radians(c.longitude)) + sin(radians(lat)) * sin(radians(c.latitude)), 12) DESC, c.id) AS r
  FROM (SELECT event_id AS id, event_id * 13 % 170 - 85 + 0.25::DOUBLE AS lat, event_id * 29 % 350 - 175 + 0.25::DOUBLE AS lon FROM events) p, cities c) WHERE r = 1""", "cities")
def geo_nearest_city(spark, d):
    p = table(spark, d, "events").selectExpr("event_id as id", "cast(event_id * 13 % 170 - 85 + 0.25 as double) as latitude", "cast(event_id * 29 % 350 - 175 + 0.25 as double) as longitude", "cast(null as double) as user_latitude", "cast(null as double) as user_longitude", "'' as geo_text")
    return geo.nearest_city(p, cities(spark, d))


@query("""SELECT cell_y, cell_x, n, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, manual, metadata, first_id, round(cell_y * 0.25 - 90, 6) AS south, round(least(90, cell_y * 0.25 - 90 + 0.25), 6) AS north FROM (
  SELECT floor((lat + 90) / 0.25)::BIGINT AS cell_y, floor((lon + 180) / 0.25)::BIGINT AS cell_x, count(*) AS n, avg(lat) AS latitude, avg(lon) AS longitude, count_if(user_latitude IS NOT NULL) AS manual, count_if(user_latitude IS NULL) AS metadata, min(id) AS first_id
  FROM (SELECT *, coalesce(user_latitude, latitude) AS lat, coalesce(user_longitude, longitude) AS lon FROM ready) WHERE lat BETWEEN 55 AND 55.8 AND lon BETWEEN 37 AND 37.9 GROUP BY 1, 2)""", "ready")
def geo_grid(spark, d):
    g = geo.geo_grid(media(spark, d).filter(filters.browsable()), 0.25, 37, 55, 37.9, 55.8)
    return g.select("cell_y", "cell_x", "n", *[F.round(c, 6).alias(c) for c in ("latitude", "longitude")], "manual", "metadata", "first_id", F.round("south", 6).alias("south"), F.round("north", 6).alias("north"))


@query("SELECT CASE WHEN user_place <> '' THEN user_place ELSE geo_text END AS place, count(*) AS n FROM ready WHERE user_place <> '' OR geo_text <> '' GROUP BY 1", "ready")
def geo_place_labels(spark, d):
    return geo.place_labels(media(spark, d).filter(filters.browsable()))


@query("SELECT id, latitude FROM media WHERE id IN (SELECT vec_id FROM embeddings)", "media")
def geo_places_of_result(spark, d):
    return geo.places_of(media(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("asset_id"))).select("id", "latitude")


# ---- scalars ----
@query("""SELECT page_id, lower(path) AS folded, regexp_replace(lower(split_part(path, '/', -1)), '(\\.[a-z0-9]{2,5})+$', '') AS bare, CASE WHEN ms >= 3600000 THEN (ms // 3600000) || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') ELSE (ms // 60000)::VARCHAR END || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') AS moment,
  len(range(0, greatest(1, ms), 10000))::INTEGER AS n_frames, lower(regexp_replace(folder, '/+$', '')) AS key FROM (SELECT *, page_id * 123457 % 36000000 AS ms FROM folders)""", "folders")
def scalar_names_times(spark, d):
    f = folders(spark, d)
    ms = F.col("page_id") * 123457 % 36000000
    return f.select("page_id", S.fold("path").alias("folded"), S.version_name(F.element_at(F.split("path", "/"), -1)).alias("bare"), S.timestamp_text(ms).alias("moment"), F.size(S.sample_times(ms)).alias("n_frames"), S.folder_key(F.concat(F.lit("/"), F.col("folder"), F.lit("/"))).alias("key"))


@query("""SELECT event_id, CASE WHEN m < 60 AND g + m / 60::DOUBLE <= 90 THEN round((g + m / 60::DOUBLE) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END, 9) END AS lat FROM (SELECT event_id, event_id % 95 AS g, event_id % 70 AS m FROM events)""")
def scalar_coordinate(spark, d):
    e = table(spark, d, "events")
    text = F.format_string("%d %d%s", F.col("event_id") % 95, F.col("event_id") % 70, F.when(F.col("event_id") % 2 == 0, "N").otherwise("S"))
    return e.select("event_id", F.round(S.coordinate(text), 9).alias("lat"))


@query("""SELECT event_id, round(event_id % 90 + 0.5, 6)::DOUBLE AS lat, round(-(event_id % 180) - 0.25, 6)::DOUBLE AS lon, (event_id % 1000)::DOUBLE AS alt FROM events""")
def scalar_iso6709(spark, d):
    text = F.format_string("+%02d.5-%03d.25+%d/", F.col("event_id") % 90, F.col("event_id") % 180, F.col("event_id") % 1000)
    return table(spark, d, "events").select("event_id", S.parse_iso6709(text).alias("p")).select("event_id", F.round("p.latitude", 6).alias("lat"), F.round("p.longitude", 6).alias("lon"), F.col("p.altitude").alias("alt"))


@query("""SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS captured, CASE WHEN event_id % 7 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS video,
  strftime(date_trunc('month', ts), '%Y-%m-%d') AS first_day, strftime(last_day(ts), '%Y-%m-%d') AS last_day FROM events""")
def scalar_times(spark, d):
    e = table(spark, d, "events")
    raw = F.when(F.col("event_id") % 5 == 0, "0000:00:00 00:00:00").otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    iso = F.when(F.col("event_id") % 7 == 0, "1850-01-01T00:00:00Z").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    p = S.period_bounds(F.date_format("ts", "yyyy-MM"))
    return e.select("event_id", S.capture_time(raw).alias("captured"), S.video_time(iso).alias("video"), p["first_day"].cast("string").alias("first_day"), p["last_day"].cast("string").alias("last_day"))


@query("""SELECT event_id, (CASE WHEN event_id % 9 BETWEEN 5 AND 8 THEN 3000 ELSE 4000 END)::BIGINT AS width, (CASE WHEN event_id % 9 BETWEEN 5 AND 8 THEN 4000 ELSE 3000 END)::BIGINT AS height, 'Acme M' || (event_id % 3) AS camera,
  CASE WHEN event_id % 9 BETWEEN 5 AND 8 THEN 'portrait' ELSE 'landscape' END AS orientation, [1, 6, 3, 8][1 + event_id % 4] AS turned FROM events""")
def scalar_metadata(spark, d):
    e = table(spark, d, "events")
    tags = F.create_map(F.lit("Orientation"), (F.col("event_id") % 9).cast("string"), F.lit("Make"), F.lit("Acme "), F.lit("Model"), F.concat(F.lit(" M"), (F.col("event_id") % 3).cast("string")))
    m = S.normalise_metadata(tags, F.lit(4000).cast("long"), F.lit(3000).cast("long"))
    turned = F.when(F.col("event_id") % 4 == 0, F.lit(1)).otherwise(S.compose_orientation(F.lit(1), F.col("event_id") % 4 * 90))
    return e.select("event_id", m.alias("m"), turned.alias("turned")).select("event_id", "m.width", "m.height", "m.camera", "m.orientation", "turned")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 10.5 WHEN 1 THEN -20.25 END AS lat, CASE WHEN event_id % 3 = 0 THEN -12.0 END AS alt, CASE event_id % 3 WHEN 1 THEN 'Место съёмки: Рига, Латвия' ELSE '' END AS geo_text,
  CASE event_id % 3 WHEN 0 THEN 'EXIF GPS' WHEN 1 THEN 'XMP GPS; XMP/IPTC' ELSE '' END AS geo_source FROM events""")
def scalar_gps_tags(spark, d):
    kind = F.col("event_id") % 3
    none = F.create_map().cast("map<string,string>")
    pairs = lambda **k: F.create_map(*[F.lit(x) for p in k.items() for x in p])
    exif = F.when(kind == 0, pairs(GPSLatitude="10 30", GPSLatitudeRef="N", GPSLongitude="20", GPSLongitudeRef="E", GPSAltitude="12", GPSAltitudeRef="1")).otherwise(none)
    xmp = F.when(kind == 1, pairs(GPSLatitude="20,15S", GPSLongitude="30E", City="Рига", Country="Латвия")).otherwise(none)
    iptc = F.when(kind == 1, pairs(City="Рига")).otherwise(none)
    g = S.gps_from_tags(exif, xmp, iptc, none)
    return table(spark, d, "events").select("event_id", g.alias("g")).select("event_id", F.col("g.latitude").alias("lat"), F.col("g.altitude").alias("alt"), "g.geo_text", "g.geo_source")


@query("""SELECT id, coalesce(user_latitude, latitude) AS lat, CASE WHEN user_place <> '' THEN user_place ELSE geo_text END AS place, latitude IS NULL OR latitude <= 55.5 AS fine FROM media""", "media")
def scalar_effective_place(spark, d):
    m = media(spark, d)
    lat = F.when(F.col("latitude") > 55.5, F.lit(91.0)).otherwise(F.col("latitude"))
    return m.select("id", S.effective_latitude().alias("lat"), S.effective_place().alias("place"), S.valid_place(lat, F.when(lat.isNotNull(), F.col("longitude")), "user_place").alias("fine"))


@query("""SELECT doc_id, len(t)::INTEGER AS n_terms, t[1] AS first_term FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+')[1:32] AS t FROM documents)""")
def scalar_query_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", S.query_terms("text").alias("t")).select("doc_id", F.size("t").alias("n_terms"), F.get("t", 0).alias("first_term"))


@query("""SELECT conv_id, turn, sha256('{"conv_id":' || conv_id || ',"turn":' || turn || '}') AS key, conv_id || ':frame:' || turn AS unit FROM conversations""")
def scalar_keys(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", S.canonical_key("conv_id", "turn").alias("key"), S.frame_id("conv_id", "turn").alias("unit"))


@query("""SELECT vec_id, rotation, certain FROM (SELECT vec_id, CASE WHEN v < 4 THEN v * 90 WHEN b * 90 <> 0 AND s >= 0.025 THEN b * 90 END::INTEGER AS rotation, v < 4 AND vec_id % 2 = 0 AND NOT (s >= 0.06 AND s > r * 1.8 AND v <> b) AS certain
  FROM (SELECT vec_id, vec_id % 5 AS v, vec_id % 4 AS b, (vec_id % 11)::DOUBLE / 100 AS s, (vec_id % 7)::DOUBLE / 100 AS r FROM embeddings))""")
def scalar_decide_orientation(spark, d):
    e = table(spark, d, "embeddings").selectExpr("vec_id", "case vec_id % 5 when 0 then 'A' when 1 then 'B' when 2 then 'C' when 3 then 'D' else 'uncertain' end as view", "vec_id % 2 = 0 as sure", "cast(vec_id % 4 * 90 as int) as b", "vec_id % 11 / 100d as s", "vec_id % 7 / 100d as r")
    return e.select("vec_id", S.decide_orientation("view", F.lit("scene"), "sure", "b", "s", "r").alias("x")).select("vec_id", "x.rotation", "x.certain")


# ---- sources over written files, and SQL text ----
@query("SELECT c_mktsegment AS segment, c_nationkey::BIGINT AS nation, 1::BIGINT AS n_files, '.json' AS extension, false AS supported FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY ALL")
def source_file_listing(spark, d):
    """Files of a written tree, listed by folder in tasks; one folder is skipped with all below it."""
    base = shared_dir(spark, "tree")
    table(spark, d, "customer").repartition("c_mktsegment", "c_nationkey").write.partitionBy("c_mktsegment", "c_nationkey").json(f"{base}/tree")
    listing.register(spark)
    files = spark.read.format("file_listing").option("root", base).option("paths", '["tree"]').option("skip", '["tree/c_mktsegment=BUILDING"]').load()
    own = files.filter(F.col("path").rlike(r"/c_nationkey=\d+/part-[^/]*\.json$"))
    part = lambda name: F.regexp_extract("path", f"{name}=([^/]+)", 1)
    return own.groupBy(part("c_mktsegment").alias("segment"), part("c_nationkey").cast("long").alias("nation"), "extension", "supported").agg(F.count("*").alias("n_files"))


@query("SELECT id, folder, extension, version, present, camera, duration_ms, user_place FROM (SELECT *, 0::BIGINT AS duration_ms FROM media)", "media")
def source_catalog(spark, d):
    """A catalogue written by an older version, without some columns, read with their defaults."""
    base = shared_dir(spark, "catalog")
    media(spark, d).drop("duration_ms").write.parquet(f"{base}/assets")
    return tables.read_catalog(spark, base).select("id", "folder", "extension", "version", "present", "camera", "duration_ms", "user_place")


@query("SELECT unit_id::VARCHAR AS unit_id, 1::BIGINT AS file_version, 'm1' AS model_version, 64::INTEGER AS dimensions, round(vector[3], 6) AS third FROM vec_units", "vec_units")
def source_vectors(spark, d):
    base = shared_dir(spark, "vectors")
    vec_units(spark, d).selectExpr("cast(unit_id as string) as unit_id", "1L as file_version", "'m1' as model_version", "size(vector) as dimensions", "vector").write.parquet(f"{base}/embeddings")
    return tables.read_vectors(spark, base).select("unit_id", "file_version", "model_version", "dimensions", F.round(F.get("vector", 2).cast("double"), 6).alias("third"))


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, lower(n_name) AS first_alias, CASE WHEN lower(n_name) = n_name THEN 1 ELSE 2 END::INTEGER AS n_aliases, round(latitude, 6) AS latitude FROM nation JOIN cities ON id = n_nationkey", "cities")
def source_gazetteer(spark, d):
    """Cities from tab-separated text, with their distinct aliases."""
    base = shared_dir(spark, "gazetteer")
    c = cities(spark, d)
    c.select("id", "name", F.concat(F.lower("name"), F.lit(" ,"), F.col("name"), F.lit(",,"), F.col("name")).alias("aliases"), F.lit("XX").alias("country"), "latitude", "longitude").write.option("sep", "\t").csv(f"{base}/cities")
    return tables.read_gazetteer(spark, f"{base}/cities").select("id", "name", F.get("aliases", 0).alias("first_alias"), F.size("aliases").alias("n_aliases"), F.round("latitude", 6).alias("latitude"))


@query("""SELECT page_id, regexp_replace(lower(regexp_extract(path, '[^/]+$')), '(\\.[a-z0-9]{2,5})+$', '') AS bare, lower(regexp_replace(regexp_replace(path, '/[^/]*$', ''), '/(\\[?developed\\]?|web|raw|jpe?g|originals?)$', '', 'i')) AS folder,
  lower(path) AS folded, len(string_split(path, '/'))::BIGINT AS n_folders, (page_id % 7 + 1)::BIGINT AS n_times FROM paths""", "paths")
def sql_functions(spark, d):
    """The registered functions and table functions in SQL text."""
    functions_sql.register(spark)
    pages = table(spark, d, "pages").selectExpr("page_id", "concat(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/p', cast(page_id as string), '.jpg') as path")
    return spark.sql(
        """SELECT page_id, version_name(regexp_extract(path, '[^/]+$', 0)) AS bare, version_folder(regexp_replace(path, '/[^/]*$', '')) AS folder, exact_fold(path) AS folded,
             count(DISTINCT a.folder) AS n_folders, count(DISTINCT t.timestamp_ms) AS n_times
           FROM {pages} AS p, LATERAL ancestor_folders(p.path) AS a, LATERAL frame_times((p.page_id % 7) * 10000 + 5000) AS t GROUP BY page_id, path""",
        pages=pages,
    )


@query("SELECT u.unit_id::VARCHAR AS unit_id, m.id AS asset_id, m.folder, m.camera, round(u.vector[1], 6) AS first FROM vec_units u JOIN media m ON m.id = u.asset_id WHERE m.camera = 'cam_1' AND m.present AND m.width >= 4000", "vec_units", "media")
def sql_vector_table(spark, d):
    """Vectors with their assets' filter columns beside them, asked in SQL text: the filters reach the scan."""
    base, u = shared_dir(spark, "beside"), vec_units(spark, d)
    e = u.selectExpr("cast(unit_id as string) as unit_id", "1L as file_version", "'m1' as model_version", "vector")
    units = u.selectExpr("cast(unit_id as string) as id", "asset_id")
    tables.vector_rows(e, units, media(spark, d)).write.parquet(f"{base}/vectors")
    tables.vector_view(spark, f"{base}/vectors")
    return spark.sql("SELECT unit_id, asset_id, folder, camera, round(cast(vector[0] AS double), 6) AS first FROM vectors WHERE camera = 'cam_1' AND present AND width >= 4000")
