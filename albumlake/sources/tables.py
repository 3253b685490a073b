"""Tables of files, vectors, places and gold queries; snapshots and changes."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialize, shared_dir  # noqa: F401  part of this module's interface
from .states import States

#: Extensions by group.
RAW = ".3fr .arw .cr2 .cr3 .crw .dng .erf .kdc .mos .mrw .nef .nrw .orf .pef .raf .raw .rw2 .srw .x3f".split()
JPEG = ".jpg .jpeg".split()
OTHER_IMAGES = ".bmp .png .gif .tif .tiff .heic .heif .webp .avif .psd .psb .mpo .jxl .jp2 .j2k .ico .pcx .tga .ppm .pgm .pbm .pnm .dds .cpt".split()
VIDEO = ".mp4 .mov .avi .mts .m2ts .mkv .wmv .mpg .mpeg .3gp .3g2 .vob .flv .m4v .webm .tod .mod".split()
SIDECARS = ".xmp .appledouble".split()

#: Schemas of the catalogue's tables.
ASSETS = (
    "id long, source_id long, relative_path string, folder string, filename string, extension string, size long, mtime_ns long, version long, present boolean, metadata_ready boolean,"
    "width long, height long, pixels long, captured_at string, camera string, orientation string, content_hash string, description string, media_kind string, duration_ms long,"
    "latitude double, longitude double, altitude double, geo_text string, user_place string, user_latitude double, user_longitude double"
)
UNITS = "id string, asset_id long, kind string, timestamp_ms long"
EMBEDDINGS = "unit_id string, file_version long, model_version string, dimensions int, vector array<float>"
#: Columns of an asset that lie beside its vectors, so that a search filters where it scans.
BESIDE = "folder string, captured_at string, camera string, extension string, orientation string, width long, height long, pixels long, size long, present boolean, metadata_ready boolean, search_text string"
VECTORS = "unit_id string, asset_id long, version long, model_version string, vector array<float>, " + BESIDE
FACES = "id string, asset_id long, file_version long, model_version string, box array<double>, landmarks array<array<double>>, confidence double, vector array<float>"
CITIES = "id long, name string, aliases string, country string, latitude double, longitude double"
#: What an older table lacks.
DEFAULTS = {"version": 1, "present": True, "metadata_ready": False, "camera": "", "orientation": "", "description": "", "media_kind": "photo", "duration_ms": 0, "geo_text": "", "user_place": ""}


def format_key(path: Column) -> Column:
    """Lower-cased extension of a path with its dot, or ''."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def classify_format(path: Column, head: Column | None = None) -> Column:
    """Group jpeg, raw, other_images, video, sidecars or other; a '._' file that begins with the
    bytes 00 05 16 07 is a sidecar whatever its extension."""
    ext = format_key(path)
    group = F.when(ext.isin(*JPEG), "jpeg").when(ext.isin(*RAW), "raw").when(ext.isin(*OTHER_IMAGES), "other_images").when(ext.isin(*VIDEO), "video").when(ext.isin(*SIDECARS), "sidecars").otherwise("other")
    if head is None:
        return group
    double = F.regexp_extract(path, r"([^/]+)$", 1).startswith("._") & (F.substring(head, 1, 4) == F.unhex(F.lit("00051607")))
    return F.when(double, "sidecars").otherwise(group)


def scan_files(spark: SparkSession, root: str, paths: list[str] | None = None, skip: list[str] = ()) -> DataFrame:
    """path, size, modified, extension, supported of every file below the chosen folders, each once.

    Contents aren't read. A folder outside the root, or one that can't be listed, is an error and
    never an empty listing.
    """
    root = root.rstrip("/")
    chosen = [root] if paths is None else [f"{root}/{p.strip('/')}" for p in paths]
    if any(".." in p.split("/") for p in chosen):
        raise ValueError("a folder lies outside the root")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(chosen).drop("content").dropDuplicates(["path"])
    below = re.sub(r"^[A-Za-z0-9+.-]+:/+", "/", root)  # listings write file:/x for file:///x
    for s in skip:
        files = files.filter(~F.contains("path", F.lit(f"{below}/{s.strip('/')}/")))
    group = classify_format(F.col("path"))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), format_key(F.col("path")).alias("extension"), ~group.isin("sidecars", "other")).toDF("path", "size", "modified", "extension", "supported")


def content_digest(content) -> Column:
    return F.sha2(content, 256)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with the columns of ``schema``; columns that an older one lacks get their defaults."""
    df = spark.read.parquet(path)
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(DEFAULTS.get(f.name)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])


def read_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, f"{folder}/assets", ASSETS)


def read_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, f"{folder}/embeddings", EMBEDDINGS)


def vector_rows(embeddings: DataFrame, units: DataFrame, assets: DataFrame) -> DataFrame:
    """Rows of ``VECTORS``: vectors of the assets' present versions, with the assets' filter columns."""
    beside = [f.name for f in T.StructType.fromDDL(BESIDE)]
    of = units.select(F.col("id").alias("unit_id"), "asset_id")
    here = assets.select(F.col("id").alias("asset_id"), "version", *[F.col(c) if c in assets.columns else F.lit(DEFAULTS.get(c)).alias(c) for c in beside])
    joined = embeddings.join(of, "unit_id").withColumnRenamed("file_version", "version").join(here, ["asset_id", "version"])
    return joined.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(VECTORS)])


def vector_view(spark: SparkSession, path: str, name: str = "vectors") -> DataFrame:
    """A vector table with its filter columns, also as a view for SQL text."""
    df = spark.read.schema(VECTORS).parquet(path)
    df.createOrReplaceTempView(name)
    return df


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Cities from tab-separated text; aliases as a list of distinct names."""
    return spark.read.schema(CITIES).csv(path, sep="\t").withColumn("aliases", split_aliases(F.col("aliases")))


def split_aliases(aliases: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(aliases, F.lit("")), ","), lambda a: F.trim(a)), lambda a: a != ""))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(query_no, query, condition, asset_id, expected) of labelled queries in a JSON array."""
    raw = spark.read.schema("query string, conditions array<string>, positive array<long>, negative array<long>").option("multiLine", True).json(path)
    return explode_gold(raw.withColumn("query_no", F.monotonically_increasing_id()))


def explode_gold(raw: DataFrame) -> DataFrame:
    side = lambda c, yes: raw.select("query_no", "query", "conditions", F.explode(c).alias("asset_id"), F.lit(yes).alias("expected"))
    both = side("positive", True).unionByName(side("negative", False))
    return both.select("query_no", "query", F.explode("conditions").alias("condition"), "asset_id", "expected")


def apply_changes(base: DataFrame, upserts: DataFrame, deletes: DataFrame, key: str = "unit_id") -> DataFrame:
    """The table after deleting and upserting by key. Applying a batch again changes nothing."""
    gone = deletes.select(key).unionByName(upserts.select(key))
    return base.join(gone, key, "left_anti").unionByName(upserts)


def publish(df: DataFrame, folder: str) -> str:
    """Write a new snapshot and only then the state that names it: readers see the old one or the new one whole."""
    states = States(df.sparkSession, folder)
    path = f"{states.data}/snapshot-{uuid.uuid4().hex}"
    df.write.parquet(path)
    states.publish(max(states.numbers(), default=0) + 1, {"path": path})
    return path


def current_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(States(spark, folder).read()[1]["path"])
