"""Operators K: retrieval quality over a table of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.params import check_limit


def check_cases(cases: DataFrame) -> DataFrame:
    """K3: cases with a blank field. Columns: case_id, query, expected_source_id, expected_document_id."""
    blank = F.lit(False)
    for name in ("query", "expected_source_id", "expected_document_id"):
        blank = blank | F.col(name).isNull() | T.is_blank(F.col(name))
    return cases.where(blank).select("case_id", F.lit("blank field").alias("violation"))


def expected_rank(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """K1: the first rank at which a hit is the expected document, null if none. Hits join by query_id = case_id."""
    found = hits.select(
        F.col("query_id").alias("case_id"), F.col("source_id").alias("expected_source_id"),
        F.col("external_document_id").alias("expected_document_id"), "rank")
    return cases.join(found, ["case_id", "expected_source_id", "expected_document_id"], "left").groupBy("case_id").agg(
        F.min("rank").alias("rank"))


def recall_mrr(ranks: DataFrame, k: int) -> DataFrame:
    """K2: number of cases and matches, recall@k and MRR@k; unmatched cases count as 0."""
    check_limit(k)
    within = F.when(F.col("rank") <= k, F.col("rank"))
    return ranks.agg(
        F.count("*").alias("cases"), F.count(within).alias("matched"),
        F.avg(F.when(within.isNotNull(), 1.0).otherwise(0.0)).alias("recall_at_k"),
        F.avg(F.coalesce(1.0 / within, F.lit(0.0))).alias("mrr_at_k"))
