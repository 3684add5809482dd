"""Preview of a batch and confirmation of previews (H1-H7 composed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import ids
from foliant.operators import contract, preview as H, versions as V
from foliant.operators.embeddings import Embedder
from foliant.params import MAX_CHUNK_CHARACTERS, MIN_SCORE, Limits
from foliant.plans.ingest import decide, ingest_batch, knowledge_base, parse_documents
from foliant.plans.store import Store
from foliant.session import cut_lineage


def preview_batch(
    store: Store, docs: DataFrame, sources: DataFrame, embedder: Embedder, now: Column, limits: Limits = Limits(),
    n: int = MAX_CHUNK_CHARACTERS, min_score: float = MIN_SCORE, force: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(previews, similar materials, rejected) of incoming documents. Nothing is built.

    A preview keeps the bytes it was made from, so that confirming it ingests exactly those. Similar materials are not
    searched for unchanged documents. With ``force`` unchanged documents may be confirmed too.
    """
    decided = decide(docs, sources, store.versions(), limits, force)
    sound = F.col("violation").isNull()
    parsed = parse_documents(
        decided.withColumn("_bytes", F.col("content")).withColumn("content", F.when(sound, F.col("content")).otherwise(F.lit(b""))), limits, n)
    broken = F.when(sound, contract.structure_violation(F.col("section_count"), F.col("chunk_count"), limits))
    parsed = cut_lineage(parsed.withColumn("violation", F.coalesce("violation", broken)).withColumn("content", F.col("_bytes")).drop("_bytes", "metadata"))
    valid = parsed.where(F.col("violation").isNull())
    status = H.preview_status(valid.drop("document_version_id"), force)

    texts = F.flatten(F.transform("sections", lambda s: s["chunks"]))
    incoming = valid.select("document_id", F.explode_outer(F.transform(texts, ids.sha256_text)).alias("content_hash"))
    baseline_ids = valid.select("document_id", F.col("active_version_id").alias("document_version_id")).where("document_version_id IS NOT NULL")
    baseline = store.read("chunk").select("document_version_id", "content_hash").join(baseline_ids, "document_version_id").select(
        "document_id", "content_hash")
    summary = H.change_summary(incoming, baseline).select("document_id", F.struct(
        "previous", "incoming", "unchanged", "added", "removed").alias("changes"))

    previews = H.with_expiry(status.join(summary, "document_id"), now).select(
        ids.name_uuid("preview", F.col("document_id"), F.col("content_hash"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("preview_id"),
        "document_id", "source_id", "external_document_id", "format", "content", "content_hash",
        F.col("active_version_id").alias("baseline_version_id"), "status", "can_confirm", "changes", F.lit(False).alias("confirmed"), "expires_at")
    searched = valid.join(status.where("status <> 'UNCHANGED'").select("document_id"), "document_id", "left_semi")
    similar = H.similar_materials(H.sample_parts(searched), knowledge_base(store), embedder, sources, min_score)
    return previews, similar, parsed.where(F.col("violation").isNotNull()).select("source_id", "external_document_id", "violation")


def confirm_previews(
    store: Store, previews: DataFrame, sources: DataFrame, embedder: Embedder, now: Column, limits: Limits = Limits(),
    n: int = MAX_CHUNK_CHARACTERS, force: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(state of every preview, ingestion report of those that were READY and fresh). A preview whose content has become the ACTIVE
    version meanwhile is CONFIRMED rather than STALE."""
    active = V.active_versions(store.versions())
    stated = H.preview_freshness(previews, active, now).join(
        active.select("document_id", F.col("content_hash").alias("_active_hash")), "document_id", "left")
    stated = cut_lineage(stated.withColumn("state", F.when(
        (F.col("state") == "STALE") & (F.col("content_hash") == F.col("_active_hash")), "CONFIRMED").otherwise(F.col("state"))).drop("_active_hash"))
    ready = stated.where("state = 'READY'").select("source_id", "external_document_id", "format", "content", "content_hash")
    report = ingest_batch(store, ready, sources, embedder, limits, n, force, now)
    return stated.select("preview_id", "document_id", "state"), report
