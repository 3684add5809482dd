"""From raw documents to packed training sequences: ``run`` applies STAGES one after another.

Every stage takes the documents that its predecessor kept, whole rows with all their columns, and all but the last return
documents. Rows travel through the operators as values of an id column, so no stage has to look its documents up again.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm import language, quality
from foliant.llm.arrow import give_back
from foliant.llm.packing import pack_documents
from foliant.llm.queries import tokenizer_path
from foliant.llm.simhash import near_duplicates
from foliant.session import cut_lineage

#: A text that the best language's statistics code in as many bits as its raw bytes is in none of the languages.
MOST_BITS = 8.0
#: Share of five-word shingles from which texts with near fingerprints are near-duplicates.
SIMILARITY = 0.8
#: Bytes of an Arrow batch between Spark and Python workers. Each task holds several, so the default of 64 MiB fills small executors;
#: the stages work on 2 MiB of text at a time.
ARROW_BYTES = "2m"
#: Words that a worker of the packing stage keeps encoded, some 100 MB. More cost fewer library calls, but the stages share their executors.
WORDS = 300_000


def _carried(docs: DataFrame) -> DataFrame:
    """Rows as values of one column, beside their text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))


def _small_batches(spark: SparkSession) -> None:
    """The stages set this for the session, as they run one after another and their plans are carried out later."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def _rows(found: DataFrame) -> DataFrame:
    return found.select("_row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from these documents. Texts that are null or have no letter go, and texts that
    no language codes in fewer bits than they have."""
    _small_batches(spark)
    model = language.train(docs, ~language.held_out())
    found = language.identify(_carried(docs), model, "_row", "text")
    return _rows(found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("bits_per_byte") < MOST_BITS)))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach the best grade with a chance of ``quality.KEEP`` or more; graded by the table ``labels``."""
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, quality.grade(F.col("quality"), F.col("toxic")))
    return _rows(quality.rate(_carried(docs), model, "_row", "text").where(F.col("p_best") >= quality.KEEP))


def _plain(docs: DataFrame) -> list:
    """The columns of a row in a form that can be hashed: maps have none, so they are written out."""
    return [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id, null being the largest. Of rows that are
    equal in all columns one stays. Columns of any name and type stay as they are."""
    _small_batches(spark)
    key = F.struct(F.col("doc_id").isNull().alias("null"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), F.xxhash64(*_plain(docs)).alias("hash"))
    keyed = docs.select(key.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    found = near_duplicates(keyed.select("_key", F.col("_row.text").alias("text")), id_column="_key", similarity=SIMILARITY, verified=True)
    stays = found.where(F.col("_key") == F.col("component_id")).select("_key").distinct()
    # Equal rows have equal keys, which the join has already brought together.
    copy = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    return _rows(keyed.join(stays.hint("merge"), "_key").withColumn("_copy", copy).where("_copy = 1"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of at most 2048 tokens, with their ids."""
    _small_batches(spark)
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, words=WORDS)


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("packing", packing),
]
ORACLE_SQL = None  # statistics of byte contexts, fitted weights and a tokenizer's ids are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next stage's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
        # The models of a stage are of no use to the next one, whose plans need the driver's memory.
        gc.collect()
        give_back()
    return docs
