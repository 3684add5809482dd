"""Ingestion end to end on a store in a temporary folder."""

import pytest
from pyspark.sql import functions as F

from foliant.operators.embeddings import HashEmbedder
from foliant.operators.fusion import OverlapScorer
from foliant.params import Limits
from foliant.plans import ingest as I, preview as P, retrieve as R, stages as G
from foliant.plans.store import Store
from foliant.sources.registry import source_dim
from foliant.sources.tables import documents_from_table

MODEL = HashEmbedder(64)


def docs(spark, *rows):
    raw = [(s, e, c if isinstance(c, bytes) else c.encode()) for s, e, c in rows]
    return documents_from_table(spark.createDataFrame(raw, "source_id string, external_document_id string, content binary"))[0]


@pytest.fixture(scope="module")
def sources(spark):
    return source_dim(spark, [
        {"source_id": "s1", "source_type": "LOCAL_FILE", "name": "One", "update_policy": "AUTHORITATIVE_SNAPSHOT"}, {"source_id": "s2", "name": "Two"}])


def outcomes(report):
    return {r.external_document_id: r.outcome for r in report.collect()}


def at(moment):
    return F.lit(moment).cast("timestamp")


def test_ingest_reuses_and_replaces(spark, sources, tmp_path):
    store = Store(spark, str(tmp_path / "kb"))
    first = docs(spark, ("s1", "a.md", "# T\n\none apple\n\ntwo bananas\n\nthree plums"), ("s2", "b.txt", "plain text"), ("zz", "c.txt", "x"),
                 ("s1", "bad.txt", b"\xc3("), ("s1", "blank.txt", "  \n"), ("s1", "twice.txt", "x"), ("s1", "twice.txt", "y"))
    report = I.ingest_batch(store, first, sources, MODEL)
    assert outcomes(report) == {"a.md": "BUILT", "b.txt": "BUILT", "c.txt": "REJECTED", "bad.txt": "REJECTED", "blank.txt": "REJECTED", "twice.txt": "REJECTED"}
    assert {r.violation for r in report.where("outcome = 'REJECTED'").collect()} == {
        "unknown source", "invalid UTF-8", "no indexable text", "repeated document in batch"}

    def computed(generation):
        return spark.read.parquet(f"{store.root}/vector/generation={generation}").count()

    assert computed(1) == 4
    # One paragraph more: one new vector. Then only the order changes: none.
    I.ingest_batch(store, docs(spark, ("s1", "a.md", "# T\n\none apple\n\nnew words\n\ntwo bananas\n\nthree plums")), sources, MODEL)
    moved = docs(spark, ("s1", "a.md", "# T\n\nthree plums\n\none apple\n\nnew words\n\ntwo bananas"), ("s2", "b.txt", "plain text changed"))
    assert outcomes(I.ingest_batch(store, moved, sources, MODEL)) == {"a.md": "BUILT", "b.txt": "REQUIRES_VERSION_RESOLUTION"}
    assert (computed(2), computed(3)) == (1, 0)
    assert outcomes(I.ingest_batch(store, moved.where("source_id = 's1'"), sources, MODEL)) == {"a.md": "UNCHANGED"}
    assert outcomes(I.ingest_batch(store, docs(spark, ("s2", "b.txt", "plain text")), sources, MODEL, force=True)) == {"b.txt": "BUILT"}

    status = sorted((r.version_number, r.status) for r in store.versions().where("format = 'MARKDOWN'").collect())
    assert status == [(1, "INACTIVE"), (2, "INACTIVE"), (3, "ACTIVE")]
    base = I.knowledge_base(store)
    assert base.active().chunks.count() == 5
    queries = spark.createDataFrame([("q", "new words", "HYBRID"), ("r", "apple", None), ("t", "plums", "ADVANCED")], "query_id string, query string, profile string")
    hits = R.retrieve(queries, base, MODEL, None, OverlapScorer(), min_score=0.1).where("rank = 1").collect()
    assert {r.query_id: r.content for r in hits} == {"q": "new words", "r": "one apple", "t": "three plums"}
    ordered = store.read_version("chunk", store.versions().where("version_number = 3")).collect()
    assert [r.content for r in ordered] == ["three plums", "one apple", "new words", "two bananas"]


def test_failed_batches_and_versions_stay_invisible(spark, sources, tmp_path):
    class Broken(HashEmbedder):
        def embed(self, texts):
            raise RuntimeError("model down")

    store = Store(spark, str(tmp_path / "kb"))
    I.ingest_batch(store, docs(spark, ("s1", "a.txt", "first")), sources, MODEL)
    with pytest.raises(Exception, match="model down"):
        I.ingest_batch(store, docs(spark, ("s1", "a.txt", "second")), sources, Broken(64))
    assert [(r.version_number, r.status) for r in store.versions().collect()] == [(1, "ACTIVE")]
    assert store.next_generation() == 3
    # The last slice of a fenced block is white space only: it cannot be embedded, so the version fails and the old one stays.
    code = "```\nabcdefgh\n"
    assert outcomes(I.ingest_batch(store, docs(spark, ("s1", "a.txt", code)), sources, MODEL, n=12)) == {"a.txt": "FAILED"}
    assert sorted((r.version_number, r.status) for r in store.versions().collect()) == [(1, "ACTIVE"), (2, "FAILED")]
    assert [r.content for r in I.knowledge_base(store).active().chunks.collect()] == ["first"]
    # With a larger chunk size the failed version can be built again.
    I.resume_versions(store, store.versions().where("status = 'FAILED'"), MODEL)
    assert sorted((r.version_number, r.status) for r in store.versions().collect()) == [(1, "INACTIVE"), (2, "ACTIVE")]
    assert [r.content for r in I.knowledge_base(store).active().chunks.collect()] == [code]


def test_limits_reject_before_anything_is_stored(spark, sources, tmp_path):
    store = Store(spark, str(tmp_path / "kb"))
    many = "\n".join(f"# h{i}\n\nx" for i in range(6))
    report = I.ingest_batch(store, docs(spark, ("s1", "a.md", many), ("s1", "b.txt", "p\n\n" * 9), ("s1", "c.txt", "y" * 300)), sources, MODEL,
                            Limits(max_bytes=200, max_sections=5, max_chunks=8))
    assert {r.external_document_id: r.violation for r in report.collect()} == {"a.md": "too many sections", "b.txt": "too many chunks", "c.txt": "size limit"}
    assert store.read("document_version").count() == 0 and store.read("section").count() == 0


def test_preview_and_confirm(spark, sources, tmp_path):
    store = Store(spark, str(tmp_path / "kb"))
    I.ingest_batch(store, docs(spark, ("s1", "a.txt", "red apples\n\ngreen pears"), ("s1", "twin.txt", "red apples\n\nmore"), ("s2", "b.txt", "blue")), sources, MODEL)
    incoming = docs(spark, ("s1", "a.txt", "red apples\n\nnew plums"), ("s1", "twin.txt", "red apples\n\nmore"), ("s2", "b.txt", "blue sky"), ("s1", "n.txt", "brand new"))
    made, similar, rejected = P.preview_batch(store, incoming, sources, MODEL, at("2024-01-01"), min_score=0.5)
    made.write.parquet(str(tmp_path / "previews"))
    previews = spark.read.parquet(str(tmp_path / "previews"))
    got = {r.external_document_id: r for r in previews.collect()}
    assert {k: r.status for k, r in got.items()} == {"a.txt": "READY", "twin.txt": "UNCHANGED", "b.txt": "REQUIRES_VERSION_RESOLUTION", "n.txt": "READY"}
    assert tuple(got["a.txt"].changes) == (2, 2, 1, 1, 1) and tuple(got["n.txt"].changes) == (0, 1, 0, 1, 0)
    assert rejected.count() == 0
    found = {(r.method, r.external_document_id, r.excerpt) for r in similar.where(F.col("for_document_id") == got["a.txt"].document_id).collect()}
    assert found == {("SEMANTIC", "twin.txt", "red apples"), ("LEXICAL", "twin.txt", "red apples")}
    assert similar.where(F.col("for_document_id") == got["twin.txt"].document_id).count() == 0

    expired, _ = P.confirm_previews(store, previews, sources, MODEL, at("2024-01-03"))
    assert {r.state for r in expired.collect()} == {"EXPIRED"}
    states, report = P.confirm_previews(store, previews, sources, MODEL, at("2024-01-01 12:00:00"))
    assert sorted(r.state for r in states.collect()) == ["BLOCKED", "READY", "READY", "UNCHANGED"]
    assert outcomes(report) == {"a.txt": "BUILT", "n.txt": "BUILT"}
    again, _ = P.confirm_previews(store, previews, sources, MODEL, at("2024-01-01 12:00:00"))
    assert sorted(r.state for r in again.collect()) == ["BLOCKED", "CONFIRMED", "CONFIRMED", "UNCHANGED"]


def test_equal_copies_are_one_document(spark, sources, tmp_path):
    store = Store(spark, str(tmp_path / "kb"))
    batch = docs(spark, ("s1", "a.txt", "same"), ("s1", "a.txt", "same"), ("s1", "b.txt", "x"), ("s1", "b.txt", "y"))
    report = I.ingest_batch(store, batch, sources, MODEL)
    assert sorted((r.external_document_id, r.outcome) for r in report.collect()) == [("a.txt", "BUILT"), ("b.txt", "REJECTED"), ("b.txt", "REJECTED")]


def test_contract_comes_before_policy(spark, sources, tmp_path):
    store = Store(spark, str(tmp_path / "kb"))
    I.ingest_batch(store, docs(spark, ("s2", "b.txt", "first")), sources, MODEL)
    report = I.ingest_batch(store, docs(spark, ("s2", "b.txt", "  \n ")), sources, MODEL)
    assert [(r.outcome, r.violation) for r in report.collect()] == [("REJECTED", "no indexable text")]


def test_answer_routes_and_reports(spark, sources, tmp_path):
    store = Store(spark, str(tmp_path / "kb"))
    I.ingest_batch(store, docs(spark, ("s1", "a.txt", "red apples"), ("s2", "b.txt", "red apples too")), sources, MODEL)
    queries = spark.createDataFrame([("1", "red apples", " s2 "), ("2", "red apples", None), ("3", " ", None), ("4", "red", "zz"), ("5", "red", " ")],
                                    "query_id string, query string, search_source_id string")
    contexts, violations = R.answer(queries, sources, I.knowledge_base(store), MODEL, min_score=0.1)
    found = {(r.query_id, r.external_document_id) for r in contexts.collect()}
    assert found == {("1", "b.txt"), ("2", "a.txt"), ("2", "b.txt")}
    assert {(r.query_id, r.violation) for r in violations.collect()} == {("3", "blank query"), ("4", "unknown source"), ("5", "blank source")}
    odd = spark.createDataFrame([("1", "red", "hybrid")], "query_id string, query string, profile string")
    with pytest.raises(Exception, match="profile unknown"):
        R.retrieve(odd, I.knowledge_base(store), MODEL, None).collect()


def test_sections_over_the_limit_are_counted(spark):
    from foliant.operators import chunks as D, contract as B, sections as S
    from foliant.operators.versions import with_document_id

    many = "\n".join(f"# h{i}\n\nx" for i in range(8))
    parsed = I.parse_documents(with_document_id(docs(spark, ("s1", "a.md", many))).withColumn("document_version_id", F.lit("v")), Limits(max_sections=5))
    sections = S.section_rows(parsed)
    row = B.validate_structure(parsed.drop("chunk_count"), sections, D.chunk_rows(sections), Limits(max_sections=5)).first()
    assert (row.section_count, row.violation) == (9, "too many sections")


def test_own_chunker_and_composer(spark, sources, tmp_path):
    store = Store(spark, str(tmp_path / "kb"))
    lines = I.Processing(lambda content: F.split(content, "\n"), "lines-1", lambda titles, content: F.upper(content), "upper-1")
    batch = docs(spark, ("s1", "a.txt", "one two\nthree"))
    I.ingest_batch(store, batch, sources, MODEL, processing=lines)
    assert sorted(r.content for r in I.knowledge_base(store).active().chunks.collect()) == ["one two", "three"]
    assert {r.embedding_text for r in spark.read.parquet(f"{store.root}/text/generation=1").collect()} == {"ONE TWO", "THREE"}
    plain = I.parse_documents(batch).first().chunk_fingerprint
    assert I.parse_documents(batch, processing=lines).first().chunk_fingerprint != plain


def flaky(dimensions, up):
    """A model that is down until the file exists."""
    import os

    class Flaky(HashEmbedder):
        def embed(self, texts):
            if not os.path.exists(up):
                raise RuntimeError("model down")
            return super().embed(texts)

    return Flaky(dimensions)


def log_of(store, generation):
    rows = G.build_log(store).where(F.col("batch_id") == str(generation)).orderBy("started_at").collect()
    return [(r.stage, r.status) for r in rows]


def files_of(store, table, generation):
    from pathlib import Path

    return sorted(str(p) for p in Path(f"{store.root}/{table}/generation={generation}").glob("part-*"))


def test_cut_batch_resumes_at_the_failed_stage(spark, sources, tmp_path):
    store, model = Store(spark, str(tmp_path / "kb")), flaky(64, str(tmp_path / "up"))
    with pytest.raises(Exception, match="model down"):
        I.ingest_batch(store, docs(spark, ("s1", "a.md", "# T\n\none apple\n\ntwo bananas")), sources, model)
    assert log_of(store, 1) == [("parse", "COMPLETED"), ("chunk", "COMPLETED"), ("embed", "FAILED")]
    assert store.versions().count() == 0
    found = G.interrupted_builds(store).collect()
    assert [(r.stage, r.status, r.version_status) for r in found] == [("embed", "FAILED", "BUILDING")]
    before = files_of(store, "section", 1), files_of(store, "chunk", 1)

    (tmp_path / "up").touch()
    assert outcomes(I.resume_batch(store, 1, model)) == {"a.md": "BUILT"}
    # The completed stages did not run again, the failed one ran twice, the later ones once.
    assert (files_of(store, "section", 1), files_of(store, "chunk", 1)) == before
    assert log_of(store, 1) == [("parse", "COMPLETED"), ("chunk", "COMPLETED"), ("embed", "FAILED"), ("embed", "COMPLETED"), ("index", "COMPLETED"),
                                ("activate", "COMPLETED")]
    assert G.interrupted_builds(store).count() == 0
    assert sorted(r.content for r in I.knowledge_base(store).active().chunks.collect()) == ["one apple", "two bananas"]
    prints = {r.stage: r.fingerprint for r in G.build_log(store).where("status = 'COMPLETED'").collect()}
    section = store.read("section").first()
    assert prints["parse"] == section.processing_fingerprint and prints["chunk"] == store.read("chunk").first().processing_fingerprint
    with pytest.raises(ValueError, match="already committed"):
        I.resume_batch(store, 1, model)


def test_a_batch_whose_driver_died_is_found(spark, sources, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "kb"))

    class Gone(BaseException):
        pass

    def die(*_):
        raise Gone

    with monkeypatch.context() as patch:
        patch.setattr(I.P, "build_postings", die)
        with pytest.raises(Gone):
            I.ingest_batch(store, docs(spark, ("s1", "a.txt", "first"), ("s1", "b.txt", "other")), sources, MODEL)
    assert {(r.stage, r.status) for r in G.interrupted_builds(store).collect()} == {("index", "RUNNING")}
    # Meanwhile another batch has built one of the documents; the stages run again for the one that is left.
    I.ingest_batch(store, docs(spark, ("s1", "a.txt", "second")), sources, MODEL)
    assert outcomes(I.resume_batch(store, 1, MODEL)) == {"a.txt": "SUPERSEDED", "b.txt": "BUILT"}
    assert sorted(r.content for r in I.knowledge_base(store).active().chunks.collect()) == ["other", "second"]
    assert store.read("document").count() == 2 and store.read("section").count() == 2
    with pytest.raises(ValueError, match="ingest it again"):
        I.resume_batch(store, 77, MODEL)


def test_resuming_under_other_settings_runs_the_stages_they_change(spark, sources, tmp_path):
    store, down = Store(spark, str(tmp_path / "kb")), flaky(64, str(tmp_path / "never"))
    with pytest.raises(Exception, match="model down"):
        I.ingest_batch(store, docs(spark, ("s1", "a.txt", "one two\nthree")), sources, down)
    before = files_of(store, "section", 1)
    lines = I.Processing(lambda content: F.split(content, "\n"), "lines-1")
    assert outcomes(I.resume_batch(store, 1, HashEmbedder(32), processing=lines)) == {"a.txt": "BUILT"}
    assert files_of(store, "section", 1) == before
    assert sorted(r.content for r in store.read("chunk").collect()) == ["one two", "three"]
    assert {r.dimensions for r in store.read("embedding").collect()} == {32}


def test_resumed_version_keeps_its_sections(spark, sources, tmp_path):
    store = Store(spark, str(tmp_path / "kb"))
    code = "```\nabcdefgh\n"
    assert outcomes(I.ingest_batch(store, docs(spark, ("s1", "a.txt", code)), sources, MODEL, n=12)) == {"a.txt": "FAILED"}
    assert log_of(store, 1)[-1] == ("index", "FAILED")
    I.resume_versions(store, store.versions(), MODEL)
    assert spark.read.parquet(f"{store.root}/parsed/generation=2").count() == 0
    assert spark.read.parquet(f"{store.root}/section/generation=2").count() == 0
    assert [r.content for r in I.knowledge_base(store).active().chunks.collect()] == [code]
    assert store.read("section").count() == 1
