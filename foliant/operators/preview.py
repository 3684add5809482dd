"""Operators H: what ingesting a batch would change, before anything is built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.skew import top_k
from foliant.functions.rows import unnest
from foliant.operators import lexical, semantic
from foliant.operators.embeddings import Embedder
from foliant.params import (
    MIN_SCORE, PREVIEW_EXCERPT_CHARACTERS, PREVIEW_MATCHES, PREVIEW_SAMPLE_CHARACTERS, PREVIEW_SAMPLES, PREVIEW_TTL_HOURS,
)
from foliant.plans.retrieve import KnowledgeBase, attach
from foliant.session import cut_lineage, union_all

METHODS = ("SEMANTIC", "LEXICAL")


def change_summary(incoming: DataFrame, baseline: DataFrame) -> DataFrame:
    """H1: per document in ``incoming`` or ``baseline``, a multiset comparison of part texts by hash.

    Both: (document_id, content_hash), one row per part. Counts are combined before the shuffle.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("document_id", "content_hash").agg(F.count("*").alias(name))

    both = counted(incoming, "_in").join(counted(baseline, "_prev"), ["document_id", "content_hash"], "full").fillna(0, ["_in", "_prev"])
    sums = both.groupBy("document_id").agg(
        F.sum("_prev").alias("previous"), F.sum("_in").alias("incoming"), F.sum(F.least("_in", "_prev")).alias("unchanged"))
    return sums.withColumns({"added": F.col("incoming") - F.col("unchanged"), "removed": F.col("previous") - F.col("unchanged")})


def sample_positions(n: Column, m: int = PREVIEW_SAMPLES) -> Column:
    """H2: up to m evenly spaced positions of n parts: ``i * (n - 1) div (m - 1)``."""
    count = F.least(n, F.lit(m))
    spaced = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.when(count == 1, F.lit(0)).otherwise(
        F.floor(i * (n - 1) / F.greatest(count - 1, F.lit(1))).cast("int")))
    return F.when(n > 0, spaced).otherwise(F.array().cast("array<int>"))


def sample_parts(parsed: DataFrame, m: int = PREVIEW_SAMPLES) -> DataFrame:
    """H2: the sample texts of each parsed document, cut to 1000 characters. Works inside the row, without a shuffle."""
    keys = [c for c in ("document_id", "source_id", "external_document_id") if c in parsed.columns]
    parts = parsed.select(*keys, F.flatten(F.transform("sections", lambda s: s["chunks"])).alias("_parts"))
    picked = unnest(parts, [*keys, "_parts"], sample_positions(F.size("_parts"), m), "position", "sample_index")
    return picked.select(*keys, "sample_index", "position", F.substring(
        F.get("_parts", F.col("position")), 1, PREVIEW_SAMPLE_CHARACTERS).alias("sample"))


def similar_materials(samples: DataFrame, kb: KnowledgeBase, embedder: Embedder, sources: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """H3: per document and method, up to 10 chunks similar to its samples.

    Each sample asks for its top 10; hits in the document itself are dropped after that, so they may crowd others out.
    A chunk keeps its first occurrence in (sample, rank) order.
    """
    active = kb.active().within_sources(sources)
    # Both methods read the samples; written, so that their documents are parsed once.
    asked = cut_lineage(samples.select(
        F.concat_ws("\n", "document_id", F.col("sample_index").cast("string")).alias("query_id"), F.col("sample").alias("query")))
    # Samples with the same text find the same, so one of them asks for all.
    texts = asked.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(F.coalesce(F.sha2("query", 256), F.lit("none")))), " ").alias("_texts"))
    first = texts.groupBy("_texts").agg(F.min("query_id").alias("_asker"))
    askers = cut_lineage(texts.join(first, "_texts").select("query_id", "_asker"))
    queries = asked.join(askers.where(F.col("query_id") == F.col("_asker")).select("query_id"), "query_id", "left_semi")
    embedded, _ = semantic.embed_queries(queries, embedder)
    by_method = {
        "SEMANTIC": semantic.semantic_search(embedded, active.embeddings.where(semantic.model_filter(embedder)), PREVIEW_MATCHES, min_score),
        "LEXICAL": lexical.lexical_search(queries, active.postings, PREVIEW_MATCHES, active.stats, active.chunks),
    }
    hits = cut_lineage(union_all(*[hits.withColumn("method", F.lit(m)) for m, hits in by_method.items()]))
    shared = hits.withColumnRenamed("query_id", "_asker").join(askers, "_asker").drop("_asker")
    found = attach(shared, active.chunks, "method")
    parts = F.split("query_id", "\n")
    named = found.withColumns({"for_document_id": F.get(parts, F.lit(0)), "sample_index": F.get(parts, F.lit(1)).cast("int")})
    others = named.where(F.col("document_id") != F.col("for_document_id"))
    # At most samples x 10 rows per document and method, so these windows are small.
    first = Window.partitionBy("for_document_id", "method", "chunk_id").orderBy("sample_index", "rank")
    unique = others.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    place = Window.partitionBy("for_document_id", "method").orderBy("sample_index", "rank")
    return unique.withColumn("match_rank", F.row_number().over(place)).where(F.col("match_rank") <= PREVIEW_MATCHES).select(
        "for_document_id", "method", "match_rank", "document_version_id", "source_id", "external_document_id", "section_title",
        "chunk_id", F.substring("content", 1, PREVIEW_EXCERPT_CHARACTERS).alias("excerpt"), "score")


def preview_status(changes: DataFrame, force: bool = False) -> DataFrame:
    """H4: add ``status`` and ``can_confirm`` to rows with change_status and the source's update_policy."""
    change, policy = F.col("change_status"), F.col("update_policy")
    status = (
        F.when((change == "UNCHANGED") & ~F.lit(force), "UNCHANGED")
        .when((change == "CHANGED") & (policy == "REQUIRE_VERSION_RESOLUTION"), "REQUIRES_VERSION_RESOLUTION")
        .otherwise("READY"))
    return changes.withColumn("status", status).withColumn("can_confirm", F.col("status") == "READY")


def with_expiry(previews: DataFrame, now: Column, hours: int = PREVIEW_TTL_HOURS) -> DataFrame:
    return previews.withColumn("expires_at", now + F.make_interval(hours=F.lit(hours)))


def preview_freshness(previews: DataFrame, active: DataFrame, now: Column) -> DataFrame:
    """H5: add ``state``: CONFIRMED, EXPIRED, STALE (the active version moved), UNCHANGED, BLOCKED or READY.

    ``previews``: document_id, baseline_version_id, status, confirmed, expires_at. The first state that holds wins.
    """
    current = active.select("document_id", F.col("document_version_id").alias("_active"))
    state = (
        F.when(F.col("confirmed"), "CONFIRMED")
        .when(F.col("expires_at") <= now, "EXPIRED")
        .when(~F.col("_active").eqNullSafe(F.col("baseline_version_id")), "STALE")
        .when(F.col("status") == "UNCHANGED", "UNCHANGED")
        .when(F.col("status") != "READY", "BLOCKED")
        .otherwise("READY"))
    return previews.join(current, "document_id", "left").withColumn("state", state).drop("_active")


def purge_previews(previews: DataFrame, now: Column) -> DataFrame:
    """H6: drop previews that expired more than a day ago."""
    return previews.where(F.col("expires_at") >= now - F.expr("INTERVAL 1 DAY"))


def similarity_status(reports: DataFrame) -> DataFrame:
    """H7: add ``similarity_status`` from ``status`` and ``failed_methods`` (array of method names)."""
    failed = F.size("failed_methods")
    return reports.withColumn("similarity_status", F.when(F.col("status") == "UNCHANGED", "NOT_RUN_UNCHANGED")
                              .when(failed == 0, "COMPLETE").when(failed == len(METHODS), "UNAVAILABLE").otherwise("PARTIAL"))
