"""Operators B: the contract a document must meet before any work starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.params import Limits
from foliant.schemas import INGESTIBLE_FORMATS


def bytes_violation(limits: Limits) -> Column:
    text = F.col("content").cast("string")
    size = F.length("content")
    return (
        F.when(F.col("format").isNull() | ~F.col("format").isin(*INGESTIBLE_FORMATS), "unsupported format")
        .when(F.col("content").isNull() | (size < 1) | (size > limits.max_bytes), "size limit")
        .when(~F.is_valid_utf8(text), "invalid UTF-8")
        .when(F.contains(text, F.lit("\x00")), "NUL character")
    )


def validate_bytes(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """B1: add ``violation``: format, size, strict UTF-8, no NUL; the first failing rule wins."""
    return df.withColumn("violation", bytes_violation(limits))


def structure_violation(sections: Column, chunks: Column, limits: Limits) -> Column:
    return (
        F.when(sections > limits.max_sections, "too many sections")
        .when(chunks > limits.max_chunks, "too many chunks")
        .when(chunks == 0, "no indexable text")
    )


def validate_structure(
    docs: DataFrame, sections: DataFrame, chunks: DataFrame, limits: Limits = Limits(),
    key: str = "document_version_id",
) -> DataFrame:
    """B2: add ``violation`` from the numbers of sections and chunks stored for each document.

    The counts are combined before the shuffle, so a large document costs one row per task. A document over the section limit
    has no section rows; where ``docs`` carries the ``section_count`` of its parsed row, that counts.
    """
    parsed = F.col("section_count") if "section_count" in docs.columns else F.lit(0)
    docs = docs.withColumn("_parsed", F.coalesce(parsed, F.lit(0))).drop("section_count")
    counts = sections.groupBy(key).agg(F.count("*").alias("section_count"))
    chunk_counts = chunks.groupBy(key).agg(F.count("*").alias("chunk_count"))
    joined = docs.join(counts, key, "left").join(chunk_counts, key, "left").fillna(0, ["section_count", "chunk_count"]).withColumn(
        "section_count", F.greatest("section_count", "_parsed").cast("long")).drop("_parsed")
    found = structure_violation(F.col("section_count"), F.col("chunk_count"), limits)
    earlier = F.col("violation") if "violation" in docs.columns else F.lit(None).cast("string")
    return joined.withColumn("violation", F.coalesce(earlier, found))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); the rejected rows keep only their key and the first failing rule."""
    valid = df.where(F.col("violation").isNull()).drop("violation")
    rejected = df.where(F.col("violation").isNotNull()).select("source_id", "external_document_id", "violation")
    return valid, rejected
