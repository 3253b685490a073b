"""Documents to packed training sequences: classify, deduplicate twice, mix, pack.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents; rows that
repeat an id and a text count as one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from albumlake.llm.common import WORD, Scratch
from albumlake.llm.exact_dedup import exact_dedup
from albumlake.llm.mixing import mix
from albumlake.llm.near_dedup import near_dedup
from albumlake.llm.packing import best_fit_packing
from albumlake.llm.quality_classifier import quality_classifier
from albumlake.llm.queries import documents, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _mark() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def _with(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The documents with the other columns of ``chosen`` (doc_id, text_sha256, ...), one row each."""
    d, c = docs.select(*COLUMNS, _mark().alias("mark")).alias("d"), chosen.alias("c")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.mark") == F.col("c.text_sha256"))
    more = [f"c.{x}" for x in chosen.columns if x not in ("doc_id", "text_sha256")]
    return d.join(c, same).select("d.*", *more).dropDuplicates(["doc_id", "mark"]).drop("mark")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier grades as good text without abuse."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rest = F.struct("lang", "source", "n_chars")
    graded = quality_classifier(docs, labels, carry=rest)
    return graded.filter("kept").select("doc_id", "text", "carried.lang", "carried.source", "carried.n_chars")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return _with(docs, exact_dedup(docs).filter("kept").select("doc_id", "text_sha256"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones stays: five words, similarity .8."""
    return _with(docs, near_dedup(docs, mark=True).filter("kept").select("doc_id", "text_sha256"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one that it takes in part is cut after those words."""
    taken = mix(docs, mark=True).groupBy("doc_id", "text_sha256").agg(F.sum("taken").alias("taken"), F.first("size").alias("size"))
    each = _with(docs, taken.filter("taken > 0"))
    whole = F.expr("taken div size")
    rest = F.col("taken") - whole * F.col("size")
    # Parts that end where a word does; joined again they give the text's own characters.
    parts = F.split("text", rf"(?<={WORD[:-1]})(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(parts, 1, F.col("rest").cast("int")), "")
    rows = each.withColumn("rest", rest).withColumn("part", F.explode(F.concat(F.array_repeat(F.lit(False), whole.cast("int")), F.when(F.col("rest") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))))
    rows = rows.withColumn("text", F.when(F.col("part"), cut).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.when(F.col("part"), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 4096 tokens."""
    return best_fit_packing(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", classify_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A regression, a tokenizer and a packing plan are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Scratch(spark), documents(spark, sf_dir).select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.keep(docs)
            work.clear(docs)  # its predecessor has done its work
    return docs
