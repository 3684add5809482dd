"""Operators G: documents and their versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import ids
from foliant.functions.rows import unnest
from foliant.functions.skew import number_rows
from foliant.session import union_all


def with_document_id(df: DataFrame) -> DataFrame:
    return df.withColumn("document_id", ids.document_id(F.col("source_id"), F.col("external_document_id")))


def register_documents(registry: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """G1: the registry plus the keys it does not know yet."""
    fresh = with_document_id(incoming.select("source_id", "external_document_id").distinct()).join(
        registry.select("document_id"), "document_id", "left_anti").withColumn("created_at", now)
    return union_all(registry, fresh.select(registry.columns))


def active_versions(versions: DataFrame) -> DataFrame:
    """The ACTIVE version of each document."""
    return versions.where(F.col("status") == "ACTIVE")


def detect_changes(incoming: DataFrame, active: DataFrame) -> DataFrame:
    """Add ``change_status`` (NEW, UNCHANGED, CHANGED) and ``active_version_id`` by document id and content hash."""
    current = active.select(
        "document_id", F.col("document_version_id").alias("active_version_id"), F.col("content_hash").alias("_hash"))
    status = F.when(F.col("_hash").isNull(), "NEW").when(F.col("_hash") == F.col("content_hash"), "UNCHANGED").otherwise("CHANGED")
    return incoming.join(current, "document_id", "left").withColumn("change_status", status).drop("_hash")


def build_decision(changes: DataFrame, force: bool | Column = False) -> DataFrame:
    """Add ``decision``. ``changes`` carries the ``update_policy`` of the source.

    Forcing turns UNCHANGED into BUILD and changes nothing else.
    """
    forced = force if isinstance(force, Column) else F.lit(force)
    status, policy = F.col("change_status"), F.col("update_policy")
    decision = (
        F.when(status == "NEW", "BUILD")
        .when((status == "UNCHANGED") & forced, "BUILD")
        .when(status == "UNCHANGED", "SKIP")
        .when(policy == "AUTHORITATIVE_SNAPSHOT", "BUILD")
        .otherwise("REQUIRE_VERSION_RESOLUTION"))
    return changes.withColumn("decision", decision)


def next_versions(builds: DataFrame, versions: DataFrame, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(new BUILDING versions, refused rows of documents that already have a BUILDING version).

    Numbers continue after the document's highest. With ``order``, a batch may bring several revisions of a document;
    they are numbered in that order by a skew-safe numbering.
    """
    building = versions.where(F.col("status") == "BUILDING").select("document_id").distinct()
    highest = versions.groupBy("document_id").agg(F.max("version_number").alias("_max"))
    refused = builds.join(building, "document_id", "left_semi")
    accepted = builds.join(building, "document_id", "left_anti")
    numbered = number_rows(accepted, ["document_id"], order, "_n") if order else accepted.withColumn("_n", F.lit(1))
    created = numbered.join(highest, "document_id", "left").withColumn(
        "version_number", F.coalesce(F.col("_max"), F.lit(0)).cast("long") + F.col("_n")).drop("_max", "_n")
    return created.withColumns({
        "document_version_id": ids.version_id(F.col("document_id"), F.col("version_number")),
        "status": F.lit("BUILDING"),
    }), refused


def current_status(events: DataFrame) -> DataFrame:
    """The latest status event of each version: status, and activated_at while ACTIVE or INACTIVE.

    Status changes are appended as events (document_version_id, document_id, status, seq, at), never by rewriting the
    version rows that hold the bytes. The aggregate combines before the shuffle.
    """
    latest = events.groupBy("document_version_id").agg(
        F.max_by("status", "seq").alias("status"),
        F.max(F.when(F.col("status") == "ACTIVE", F.col("at"))).alias("_activated"))
    keeps = F.col("status").isin("ACTIVE", "INACTIVE")
    return latest.select("document_version_id", "status", F.when(keeps, F.col("_activated")).alias("activated_at"))


def activate(versions: DataFrame, version_ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(status changes, errors) of activating ``version_ids``, one BUILDING version per document.

    BUILDING becomes ACTIVE and the former ACTIVE of the document INACTIVE. An already ACTIVE version is left alone. Any
    other status is an error. Changes are (document_id, document_version_id, status, activated_at).
    """
    asked = versions.join(version_ids.select("document_version_id").distinct(), "document_version_id", "left_semi")
    rising = asked.where(F.col("status") == "BUILDING").select("document_id", "document_version_id")
    errors = asked.where(~F.col("status").isin("BUILDING", "ACTIVE")).select(
        "document_id", "document_version_id", F.concat(F.lit("cannot activate "), F.col("status")).alias("violation"))
    raised = rising.withColumns({"status": F.lit("ACTIVE"), "activated_at": now})
    retired = active_versions(versions).join(rising.select("document_id"), "document_id", "left_semi").select(
        "document_id", "document_version_id", F.lit("INACTIVE").alias("status"), "activated_at")
    return union_all(raised, retired), errors


def fail_versions(versions: DataFrame, version_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(status changes, errors): BUILDING becomes FAILED, FAILED is left alone, anything else is an error."""
    asked = versions.join(version_ids.select("document_version_id").distinct(), "document_version_id", "left_semi")
    changed = asked.where(F.col("status") == "BUILDING").select(
        "document_id", "document_version_id", F.lit("FAILED").alias("status"))
    errors = asked.where(~F.col("status").isin("BUILDING", "FAILED")).select(
        "document_id", "document_version_id", F.concat(F.lit("cannot fail "), F.col("status")).alias("violation"))
    return changed, errors


def apply_status(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """Versions with the status (and activation time, if given) of ``changes`` put in."""
    timed = "activated_at" in changes.columns
    c = changes.select("document_version_id", F.col("status").alias("_status"),
                       (F.col("activated_at") if timed else F.lit(None).cast("timestamp")).alias("_at"))
    joined = versions.join(c, "document_version_id", "left")
    at = F.coalesce("_at", "activated_at") if timed else F.col("activated_at")
    return joined.withColumns({"status": F.coalesce("_status", "status"), "activated_at": at}).select(versions.columns)


def resumable(versions: DataFrame) -> DataFrame:
    """FAILED versions that are the newest of their document while none of the document is BUILDING.

    A grouped maximum instead of a window: a document with very many versions is combined before the shuffle.
    """
    per_document = versions.groupBy("document_id").agg(
        F.max("version_number").alias("_max"), F.max((F.col("status") == "BUILDING").cast("int")).alias("_building"))
    return versions.where(F.col("status") == "FAILED").join(per_document, "document_id").where(
        (F.col("version_number") == F.col("_max")) & (F.col("_building") == 0)).drop("_max", "_building")


def version_violations(versions: DataFrame) -> DataFrame:
    """Broken invariants as (document_id, document_version_id, violation); the id is null for a whole document."""
    status = F.col("status")
    active_at = F.col("activated_at").isNotNull()
    rules = {
        "version number not positive": F.col("version_number") <= 0,
        "unknown status": ~status.isin("BUILDING", "ACTIVE", "INACTIVE", "FAILED"),
        "content hash is not SHA-256 hex": ~F.col("content_hash").rlike(r"\A[0-9a-f]{64}\z"),
        "activation time does not fit status": active_at != status.isin("ACTIVE", "INACTIVE"),
    }
    found = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    rows = unnest(versions, ["document_id", "document_version_id"], found, "violation")
    counts = versions.groupBy("document_id").agg(
        F.sum((status == "ACTIVE").cast("int")).alias("_active"), F.sum((status == "BUILDING").cast("int")).alias("_building"))
    many = F.array_compact(F.array(
        F.when(F.col("_active") > 1, "several ACTIVE versions"), F.when(F.col("_building") > 1, "several BUILDING versions")))
    documents = unnest(counts, ["document_id", F.lit(None).cast("string").alias("document_version_id")], many, "violation")
    numbers = versions.groupBy("document_id", "version_number").agg(F.count("*").alias("n")).where("n > 1").select(
        "document_id", F.lit(None).cast("string").alias("document_version_id"), F.lit("repeated version number").alias("violation"))
    return union_all(rows, documents, numbers)


def stage_reuse(table: DataFrame, expected: DataFrame) -> DataFrame:
    """Per version in ``expected`` (document_version_id, fingerprint): has it rows, all with that fingerprint?"""
    joined = expected.join(
        table.select("document_version_id", F.col("processing_fingerprint").alias("_fp")), "document_version_id", "left")
    return joined.groupBy("document_version_id", "fingerprint").agg(
        F.count("_fp").alias("row_count"),
        F.coalesce(F.bool_and(F.col("_fp") == F.col("fingerprint")), F.lit(False)).alias("reusable"))


def embedding_reuse(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """G10 for the embed stage: every chunk has an embedding with the chunk's own expected fingerprint."""
    stored = embeddings.select("chunk_id", F.col("processing_fingerprint").alias("_fp"))
    return chunks.join(stored, "chunk_id", "left").groupBy("document_version_id").agg(
        F.count("*").alias("row_count"),
        F.bool_and(F.coalesce(F.col("_fp") == F.col("input_fingerprint"), F.lit(False))).alias("reusable"))


def stale_rows(stored: DataFrame, target: DataFrame, key: str, versions: DataFrame | None = None) -> DataFrame:
    """Stored rows that the new set of their version no longer has.

    ``versions`` names the versions that are replaced; by default those that occur in ``target``.
    """
    replaced = (target if versions is None else versions).select("document_version_id").distinct()
    return stored.join(replaced, "document_version_id", "left_semi").join(
        target.select("document_version_id", key), ["document_version_id", key], "left_anti")


def dependents(stale: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Rows that go with stale parents."""
    return children.join(stale.select(key), key, "left_semi")


def interrupted_builds(build_log: DataFrame, versions: DataFrame) -> DataFrame:
    """BUILDING versions whose latest log entry is PENDING, RUNNING or FAILED, and others left PENDING or RUNNING.

    Ordered by the time the build began. The latest entry is a grouped maximum, so a long log is combined early.
    """
    latest = build_log.groupBy("document_version_id").agg(
        F.max_by(F.struct("stage", "status"), F.struct("started_at", "stage")).alias("_last"), F.min("started_at").alias("created_at"))
    joined = latest.join(versions.select("document_version_id", F.col("status").alias("version_status")), "document_version_id")
    status = F.col("_last.status")
    cut = status.isin("PENDING", "RUNNING") | ((status == "FAILED") & (F.col("version_status") == "BUILDING"))
    return joined.where(cut).select(
        "document_version_id", F.col("_last.stage").alias("stage"), status.alias("status"), "version_status", "created_at",
    ).orderBy("created_at", "document_version_id")
