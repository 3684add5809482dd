"""Sources A: the configured sources as a dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import is_blank, strip
from foliant.schemas import SOURCE

# Defaults of a configured source.
DEFAULT_POLICY = "REQUIRE_VERSION_RESOLUTION"
DEFAULT_PIPELINE = "default-ingestion"


class DuplicateSourceError(ValueError):
    """Two configured sources share an id."""


def with_source_defaults(sources: DataFrame) -> DataFrame:
    pipeline = F.when(F.col("pipeline_id").isNull() | is_blank(F.col("pipeline_id")), F.lit(DEFAULT_PIPELINE))
    return sources.withColumns({
        "update_policy": F.coalesce("update_policy", F.lit(DEFAULT_POLICY)),
        "pipeline_id": pipeline.otherwise(strip(F.col("pipeline_id"))),
    })


def duplicate_sources(sources: DataFrame) -> DataFrame:
    return sources.groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1")


def source_dim(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The source dimension from configuration rows, ordered by id."""
    names = [field.split()[0] for field in SOURCE.replace("map<string,string>", "map").split(", ")]
    raw = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SOURCE)
    duplicates = sorted(i for i in {r.get("source_id") for r in rows}
                        if sum(r.get("source_id") == i for r in rows) > 1)
    if duplicates:
        raise DuplicateSourceError(f"duplicate source ids: {', '.join(duplicates)}")
    return with_source_defaults(raw).orderBy("source_id")


def resolve_source(docs: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with their source's policy and pipeline, documents of unknown sources).

    The join is a plain one: Catalyst broadcasts the dimension when its measured size allows.
    """
    known = docs.join(sources.select("source_id", "update_policy", "pipeline_id"), "source_id")
    unknown = docs.join(sources.select("source_id"), "source_id", "left_anti")
    return known, unknown
