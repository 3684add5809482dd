"""Operator G13: ingest a table of documents into a store.

Plan of a batch: one pass over the documents decides, parses and chunks inside the row, and what it finds is written once with the
documents; everything later reads that written table. Sections and chunks are written to their own tables alone: cutting them once more
costs less than the room of a second copy of every text. Embedding is the dear stage, so its input plan and its vectors are written,
too. Data come first, the commit last.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import ids
from foliant.functions.rows import only
from foliant.operators import contract, embeddings as E, postings as P, sections as S, versions as V
from foliant.operators.chunks import Chunker, check_chunks, chunk_fingerprint, chunk_fingerprint_of, chunk_rows, paragraph_chunker, with_chunks
from foliant.params import CHUNKER_VERSION, COMPOSER_VERSION, MAX_CHUNK_CHARACTERS, Limits
from foliant.plans.retrieve import KnowledgeBase
from foliant.plans.stages import StageLog, has_begun
from foliant.plans.store import TABLES, Store
from foliant.session import cut_lineage, empty, union_all
from foliant.sources.tables import key_violation


@dataclass(frozen=True)
class Processing:
    """What turns sections into chunks and chunks into the texts to embed. The versions are part of the stage fingerprints: another
    chunker or composer needs another version, or stored results of the former one pass for its own."""

    chunker: Chunker | None = None
    chunker_version: str = CHUNKER_VERSION
    composer: E.Composer = E.compose
    composer_version: str = COMPOSER_VERSION


def parse_documents(
    docs: DataFrame, limits: Limits = Limits(), n: int = MAX_CHUNK_CHARACTERS, processing: Processing = Processing(),
) -> DataFrame:
    """C and D in one pass without a shuffle: adds ``sections`` (with ``chunks``), counts and stage fingerprints."""
    parsed = with_chunks(S.section_arrays(S.parse_fingerprint(S.decode_text(docs)), limits), processing.chunker or paragraph_chunker(n))
    keys = F.transform("sections", lambda s: F.concat_ws(":", s["stable_key"], ids.sha256_text(s["content"])))
    return parsed.drop("text").withColumn("chunk_fingerprint", chunk_fingerprint_of(keys, n, processing.chunker_version))


def decide(docs: DataFrame, sources: DataFrame, versions: DataFrame, limits: Limits, force: bool) -> DataFrame:
    """Add ``violation``, ``change_status``, ``decision`` and the number of the next version.

    All joins are on document_id, so the document bytes are shuffled once at most, and not at all while the version
    side is small enough for Catalyst to broadcast.
    """
    keyed = V.with_document_id(docs)
    # Written and so of known size: where few documents repeat, the joins below leave the document bytes where they are.
    copies = cut_lineage(keyed.groupBy("document_id").agg(
        F.count("*").alias("_copies"), F.coalesce((F.min("content_hash") == F.max("content_hash")) & (F.min("format") == F.max("format")), F.lit(False)).alias("_equal")
    ).where("_copies > 1"))
    # Copies with the same bytes are one document; those that differ are refused.
    equal = copies.where("_equal").select("document_id")
    keyed = union_all(
        keyed.join(equal, "document_id", "left_anti"), keyed.join(equal, "document_id", "left_semi").dropDuplicates(["document_id"]))
    repeated = copies.where("not _equal").select("document_id", "_copies")
    numbers = versions.groupBy("document_id").agg(
        F.max("version_number").alias("_max"), F.max((F.col("status") == "BUILDING").cast("int")).alias("_building"))
    # Written and so of known size, too.
    policy = cut_lineage(sources.select("source_id", "update_policy"))
    joined = V.detect_changes(keyed, V.active_versions(versions)).join(numbers, "document_id", "left").join(
        repeated, "document_id", "left").join(policy, "source_id", "left")
    violation = F.coalesce(
        key_violation(F.col("source_id"), F.col("external_document_id")),
        F.when(F.col("update_policy").isNull(), "unknown source"),
        F.when(F.col("_copies").isNotNull(), "repeated document in batch"),
        contract.bytes_violation(limits),
    )
    decided = V.build_decision(joined.withColumn("violation", violation), force)
    number = F.coalesce(F.col("_max"), F.lit(0)).cast("long") + 1
    outcome = (
        F.when(F.col("violation").isNotNull(), "REJECTED")
        .when(F.col("decision") == "SKIP", "UNCHANGED")
        .when(F.col("decision") == "REQUIRE_VERSION_RESOLUTION", "REQUIRES_VERSION_RESOLUTION")
        .when(F.col("_building") == 1, "BUILD_IN_PROGRESS")
        .otherwise("BUILD"))
    return decided.withColumns({"outcome": outcome, "version_number": number}).withColumn(
        "document_version_id", ids.version_id(F.col("document_id"), F.col("version_number"))).drop("_max", "_building", "_copies")


def _build(
    log: StageLog, parsed: DataFrame, embedder: E.Embedder, limits: Limits, n: int, now: Column, processing: Processing, kept: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stages of the versions in ``parsed`` and of those whose stored sections are ``kept`` (with chunks, as `section_rows` gives
    them); returns (complete, incomplete, embed fingerprints) by version id, from written tables."""
    store, generation = log.store, log.generation
    parsed_ids = parsed.select("document_version_id")
    outlined = S.section_arrays(S.decode_text(parsed), limits).select(
        "document_version_id", "document_id", "source_id", "external_document_id", "chunk_fingerprint", "parse_fingerprint", "sections")
    rows = S.section_rows(with_chunks(outlined, processing.chunker or paragraph_chunker(n)).drop("chunk_count"))
    expected = parsed.select("document_version_id", "document_id", "parse_fingerprint", "chunk_fingerprint")
    log.run("parse", expected.select("document_version_id", F.col("parse_fingerprint").alias("fingerprint")),
            lambda: store.write_version_partitions("section", _as(S.section_rows(outlined), "section"), generation, parsed_ids))
    sections = store.batch_rows("section", generation)
    if kept is not None:
        sections, rows = union_all(sections, _as(kept, "section")), union_all(rows, kept.select(rows.columns))
        expected = union_all(expected, kept.select(
            "document_version_id", "document_id", F.col("processing_fingerprint").alias("parse_fingerprint"), "chunk_fingerprint").distinct())
    version_ids = expected.select("document_version_id")

    cut = chunk_rows(rows.drop("processing_fingerprint")).withColumnRenamed("chunk_fingerprint", "processing_fingerprint")
    log.run("chunk", expected.select("document_version_id", F.col("chunk_fingerprint").alias("fingerprint")),
            lambda: store.write_version_partitions("chunk", cut, generation, version_ids))
    # The files of a batch's chunks also hold what texts to embed are composed of; readers of the table do not see those columns.
    chunks = store.batch_rows("chunk", generation)
    texts = _composed(store.batch_rows("chunk", generation, cut.schema), embedder, processing)
    prints = cut_lineage(version_ids.join(E.embed_fingerprint(texts), "document_version_id", "left").select(
        "document_version_id", F.col("embed_fingerprint").alias("fingerprint")))

    def embed() -> None:
        # A chunk whose stripped text is empty cannot be embedded; its version stays incomplete.
        usable = texts.where(F.col("embedding_text").isNotNull())
        # Only versions of this batch and ACTIVE versions of its documents can give vectors, so the store is cut down to them first;
        # the ids of a batch are small beside it.
        active = V.active_versions(store.versions()).select("document_version_id", "document_id").join(
            expected.select("document_id").distinct(), "document_id", "left_semi")
        stored = store.read("embedding").join(
            union_all(version_ids, active.select("document_version_id")).distinct(), "document_version_id", "left_semi")
        donors = stored.where(
            (F.col("provider") == embedder.provider) & (F.col("model") == embedder.model)
        ).select("chunk_id", "document_version_id", "processing_fingerprint").join(active, "document_version_id")
        plan = store.append("plan", E.embedding_plan(usable, stored.select("chunk_id", "processing_fingerprint"), donors), generation)
        asked = only(usable.select("chunk_id", "input_fingerprint", "embedding_text"), plan.where("action = 'COMPUTE'"), plan.where("action <> 'COMPUTE'"), ["chunk_id"])
        vectors = store.append("vector", E.embed_batch(asked, embedder, cut=lambda distinct: store.append("text", distinct, generation)), generation)
        fresh = E.embedding_rows(plan, vectors, stored, embedder, now)
        same = stored.join(plan.where("action = 'KEPT'").select("chunk_id"), "chunk_id", "left_semi")
        store.write_version_partitions("embedding", union_all(_as(fresh, "embedding"), _as(same, "embedding")), generation, version_ids)

    log.run("embed", prints, embed)
    embedded = store.batch_rows("embedding", generation)

    state = P.index_completeness(chunks, embedded)
    # A version whose stored rows break a rule stays incomplete.
    broken = union_all(
        S.check_sections(sections).select("document_version_id"), check_chunks(chunks, sections, version_ids).select("document_version_id"),
        E.check_vectors(embedded).join(chunks.select("chunk_id", "document_version_id"), "chunk_id").select("document_version_id")).distinct()
    complete = cut_lineage(state.where("complete").select("document_version_id").join(broken, "document_version_id", "left_anti"))
    incomplete = cut_lineage(version_ids.join(complete, "document_version_id", "left_anti"))
    # Every chunk of a complete version is embedded.
    indexable = only(chunks, complete, incomplete, ["document_version_id"])
    log.run("index", prints, lambda: store.write_version_partitions("posting", _as(P.build_postings(indexable), "posting"), generation, version_ids))
    return complete, incomplete, prints


def _composed(chunks: DataFrame, embedder: E.Embedder, processing: Processing) -> DataFrame:
    """Chunks with the text to embed and its fingerprint."""
    return E.input_fingerprint(E.embedding_text(chunks, composer=processing.composer), embedder, processing.composer_version)


def _as(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table in its order."""
    return df.select(*[f.split()[0] for f in _columns(TABLES[table])])


def _columns(ddl: str) -> list[str]:
    """Split a DDL string at its top-level commas."""
    out, depth, part = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [*out, part.strip()]


def _events(changes: DataFrame, generation: int, step: int, now: Column) -> DataFrame:
    return changes.select(
        "document_version_id", "document_id", "status", F.lit(generation * 4 + step).cast("long").alias("seq"), now.alias("at"))


def _finish(
    log: StageLog, building: DataFrame, complete: DataFrame, incomplete: DataFrame, prints: DataFrame, now: Column,
    before_commit: Callable[[DataFrame], None] = lambda events: None,
) -> DataFrame:
    """Status events of a batch and its commit; returns the events. ``building``: the versions under construction. The stage is
    COMPLETED after the commit, so a batch that died before it is still found as interrupted."""
    store, generation = log.store, log.generation
    if not incomplete.isEmpty():
        log.failed("index", prints.join(incomplete, "document_version_id", "left_semi"), "incomplete embeddings")
    known = store.versions().select("document_id", "document_version_id", "version_number", "status", "activated_at")
    started = building.select(
        "document_id", "document_version_id", "version_number", F.lit("BUILDING").alias("status"),
        F.lit(None).cast("timestamp").alias("activated_at"))
    everything = union_all(known.join(started.select("document_version_id"), "document_version_id", "left_anti"), started)
    raised, _ = V.activate(everything, complete, now)
    failed, _ = V.fail_versions(everything, incomplete)
    events = union_all(
        _events(started, generation, 0, now), _events(raised, generation, 1, now), _events(failed, generation, 1, now))

    def activate() -> None:
        before_commit(store.append("status_event", events, generation))
        store.commit(generation)

    log.run("activate", prints.join(complete, "document_version_id", "left_semi"), activate)
    return store.batch_rows("status_event", generation)


def _judge(decided: DataFrame, limits: Limits, n: int, processing: Processing) -> DataFrame:
    """Parse the documents that are to be built and hold them against the contract: adds counts and stage fingerprints.

    The contract holds for every new or changed document, whatever the policy makes of it.
    """
    judged = F.col("outcome").isin("BUILD", "REQUIRES_VERSION_RESOLUTION", "BUILD_IN_PROGRESS")
    parsed = parse_documents(
        decided.withColumn("_bytes", F.col("content")).withColumn("content", F.when(judged, F.col("content")).otherwise(F.lit(b""))),
        limits, n, processing)
    broken = F.when(judged, contract.structure_violation(F.col("section_count"), F.col("chunk_count"), limits))
    return (
        parsed.withColumn("violation", F.coalesce("violation", broken))
        .withColumn("outcome", F.when(F.col("violation").isNotNull(), "REJECTED").otherwise(F.col("outcome")))
        .withColumn("content", F.when(F.col("outcome") == "BUILD", F.col("_bytes")))
        .drop("_bytes", "metadata", "sections"))


def _carry_out(
    log: StageLog, parsed: DataFrame, embedder: E.Embedder, limits: Limits, n: int, now: Column, processing: Processing,
) -> DataFrame:
    """Everything after the documents of a batch are judged; returns the report."""
    store, generation = log.store, log.generation
    wanted = parsed.where(F.col("outcome") == "BUILD")
    registry = store.read("document")
    known = parsed.where(F.col("violation").isNull())
    fresh = V.register_documents(registry.limit(0), known.select("source_id", "external_document_id"), now).join(
        registry.select("document_id"), "document_id", "left_anti")
    store.append("document", _as(fresh, "document"), generation)
    store.append("document_version", _as(wanted.withColumn("created_at", now), "document_version"), generation)

    complete, incomplete, prints = _build(log, wanted, embedder, limits, n, now, processing)
    reports = []

    def report(events: DataFrame) -> None:
        final = events.where(F.col("status").isin("ACTIVE", "FAILED")).select("document_version_id", F.col("status").alias("_final"))
        joined = parsed.select("source_id", "external_document_id", "outcome", "violation", "document_version_id").join(
            final, "document_version_id", "left")
        made = F.col("outcome") == "BUILD"
        reports.append(store.append("report", joined.select(
            "source_id", "external_document_id",
            F.when(made & (F.col("_final") == "ACTIVE"), "BUILT").when(made, "FAILED").otherwise(F.col("outcome")).alias("outcome"),
            "violation", F.when(made, F.col("document_version_id")).alias("document_version_id")), generation))

    _finish(log, wanted, complete, incomplete, prints, now, report)
    store.drop_staging(generation)
    return reports[0]


def ingest_batch(
    store: Store, docs: DataFrame, sources: DataFrame, embedder: E.Embedder, limits: Limits = Limits(),
    n: int = MAX_CHUNK_CHARACTERS, force: bool = False, now: Column | None = None, processing: Processing = Processing(),
    generation: int | None = None,
) -> DataFrame:
    """Ingest documents (source_id, external_document_id, format, content, content_hash); returns the report.

    Report: one row per incoming document with ``outcome`` BUILT, UNCHANGED, REQUIRES_VERSION_RESOLUTION,
    BUILD_IN_PROGRESS, REJECTED or FAILED. Unchanged documents are not parsed. A failed version leaves the former ACTIVE one in
    place. Rows with equal keys and bytes are one document; successive revisions go into successive batches. A batch that is cut
    can be carried on by `resume_batch`. ``generation``: a number that the caller has claimed with `Store.next_generation`.
    """
    now = F.current_timestamp() if now is None else now
    generation = store.next_generation() if generation is None else generation
    decided = decide(docs, sources, store.versions(), limits, force)
    parsed = store.append("parsed", _judge(decided, limits, n, processing), generation)
    return _carry_out(StageLog(store, generation), parsed, embedder, limits, n, now, processing)


def resume_batch(
    store: Store, generation: int, embedder: E.Embedder, limits: Limits = Limits(), n: int = MAX_CHUNK_CHARACTERS,
    now: Column | None = None, processing: Processing = Processing(),
) -> DataFrame:
    """Carry on a batch that was cut before its commit; returns its report.

    Stages that were completed under the same fingerprints are kept as written. Another chunker, size or model gives other fingerprints,
    so the stages from there on run again. Documents of which another batch has meanwhile made a version are left as they are and
    reported SUPERSEDED. Only one process may resume a batch.
    """
    now = F.current_timestamp() if now is None else now
    store.refresh()
    if generation in store.commits():
        raise ValueError(f"generation {generation} is already committed")
    if not has_begun(store, generation):
        raise ValueError(f"generation {generation} was cut before its documents were judged: ingest it again")
    parsed = store.batch_rows("parsed", generation)
    if "sections" in parsed.columns:
        raise ValueError(f"generation {generation} was cut in a former layout of its tables: ingest it again")
    wanted = F.col("outcome") == "BUILD"
    judged = _judge(parsed.where(wanted).withColumn("_former", F.col("chunk_fingerprint")), limits, n, processing)
    if not judged.where(F.col("_former") != F.col("chunk_fingerprint")).isEmpty():
        parsed = store.append("reparsed", union_all(judged.select(parsed.columns), parsed.where(~wanted)), generation)
    newest = store.versions().groupBy("document_id").agg(F.max("version_number").alias("_newest"))
    overtaken = wanted & F.coalesce(F.col("_newest") >= F.col("version_number"), F.lit(False))
    current = parsed.join(newest, "document_id", "left").withColumn(
        "outcome", F.when(overtaken, "SUPERSEDED").otherwise(F.col("outcome"))).drop("_newest")
    return _carry_out(StageLog(store, generation, resumed=True), current, embedder, limits, n, now, processing)


def resume_versions(
    store: Store, version_ids: DataFrame, embedder: E.Embedder, limits: Limits = Limits(), n: int = MAX_CHUNK_CHARACTERS,
    now: Column | None = None, processing: Processing = Processing(),
) -> DataFrame:
    """Build FAILED versions again (G8 decides which may be); returns the status events written.

    Versions whose stored sections all carry the expected fingerprint are not parsed again (G10); stored vectors with the expected
    fingerprint are kept.
    """
    now = F.current_timestamp() if now is None else now
    generation = store.next_generation()
    log = StageLog(store, generation)
    chosen = V.resumable(store.versions()).join(version_ids.select("document_version_id"), "document_version_id", "left_semi")
    names = store.read("document").select("document_id", "source_id", "external_document_id")
    rows = cut_lineage(S.parse_fingerprint(chosen.select(
        "document_version_id", "document_id", "version_number", "format", "content_hash").join(names, "document_id")))
    stored = store.read("section").join(rows.select("document_version_id"), "document_version_id", "left_semi")
    reusable = cut_lineage(V.stage_reuse(stored, rows.select(
        "document_version_id", F.col("parse_fingerprint").alias("fingerprint"))).where("reusable").select("document_version_id"))

    sections = stored.join(reusable, "document_version_id", "left_semi")
    kept = sections.join(chunk_fingerprint(sections, n, processing.chunker_version), "document_version_id").join(
        rows.select("document_version_id", "document_id", "source_id", "external_document_id"), "document_version_id").withColumn(
        "chunks", (processing.chunker or paragraph_chunker(n))(F.col("content")))
    content = store.read("document_version").select("document_version_id", "content")
    unparsed = rows.join(reusable, "document_version_id", "left_anti").drop("parse_fingerprint").join(content, "document_version_id")
    parsed = store.append("parsed", parse_documents(unparsed, limits, n, processing).drop("sections"), generation)
    complete, incomplete, prints = _build(log, parsed, embedder, limits, n, now, processing, kept)
    return _finish(log, rows, complete, incomplete, prints, now)


def knowledge_base(store: Store) -> KnowledgeBase:
    """The visible tables of a store for `foliant.plans.retrieve`."""
    return KnowledgeBase(
        sections=store.read("section"), chunks=store.read("chunk"), embeddings=store.read("embedding"),
        postings=store.read("posting"), versions=store.versions())


def in_memory_base(
    docs: DataFrame, embedder: E.Embedder, limits: Limits = Limits(), n: int = MAX_CHUNK_CHARACTERS,
    indexed: bool = True,
) -> KnowledgeBase:
    """A knowledge base over documents that are all new, without a store: version 1 of each, built and ACTIVE.

    ``docs``: source_id, external_document_id, format, content, content_hash, already valid and with unique keys. The
    chunk rows are written to the checkpoint folder because embeddings and postings both read them.
    """
    keyed = V.with_document_id(docs).withColumn("document_version_id", ids.version_id(F.col("document_id"), F.lit(1)))
    sections = S.section_rows(parse_documents(keyed, limits, n))
    texts = E.input_fingerprint(E.embedding_text(chunk_rows(sections.drop("processing_fingerprint"))), embedder)
    texts = cut_lineage(texts.withColumnRenamed("chunk_fingerprint", "processing_fingerprint"))
    usable = texts.where(F.col("embedding_text").isNotNull())
    vectors = cut_lineage(E.embed_batch(usable, embedder))
    plan = usable.select("chunk_id", "document_id", "document_version_id", "source_id", "input_fingerprint").withColumns(
        {"action": F.lit("COMPUTE"), "reused_from": F.lit(None).cast("string")})
    nothing = empty(docs.sparkSession, TABLES["embedding"])
    embedded = E.embedding_rows(plan, vectors, nothing, embedder, F.lit(None).cast("timestamp"))
    postings = P.build_postings(usable)
    return KnowledgeBase(
        sections=sections, chunks=texts, embeddings=embedded, postings=cut_lineage(postings) if indexed else postings)
