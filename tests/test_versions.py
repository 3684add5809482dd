"""Lifecycle rules on small tables."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import contract as B, embeddings as E, preview as H, versions as V
from foliant.params import Limits, check_limit, check_min_score
from foliant.sources import registry as R
from foliant.sources.files import scan_files
from foliant.sources.tables import documents_from_table


def test_contract_reports_the_first_rule(spark):
    rows = [("TEXT", b"ok"), ("PDF", b""), ("TEXT", b""), ("TEXT", b"12345678901"), ("TEXT", b"\xc3("), ("MARKDOWN", b"a\x00b"), (None, b"x")]
    df = spark.createDataFrame([("s", str(i), f, c) for i, (f, c) in enumerate(rows)], "source_id string, external_document_id string, format string, content binary")
    got = {r.external_document_id: r.violation for r in B.validate_bytes(df, Limits(max_bytes=10)).collect()}
    assert got == {"0": None, "1": "unsupported format", "2": "size limit", "3": "size limit", "4": "invalid UTF-8", "5": "NUL character", "6": "unsupported format"}


def test_table_documents(spark):
    names = ["a.txt", "d\\b.MD", "/a.txt", "c:x.txt", "a/../b.txt", "a//b.txt", "a.pdf", " ", "x/./y.md", "noext"]
    df = spark.createDataFrame([("s", n, b"x") for n in names] + [(" ", "b.txt", b"x")], "source_id string, external_document_id string, content binary")
    good, bad = documents_from_table(df)
    assert sorted((r.external_document_id, r.format) for r in good.collect()) == [("a.txt", "TEXT"), ("d/b.MD", "MARKDOWN")]
    assert bad.count() == 9


def test_scan_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "A.MD").write_bytes(b"# x")
    (tmp_path / "b.txt").write_bytes(b"hello")
    (tmp_path / "big.txt").write_bytes(b"x" * 200)
    (tmp_path / "c.zip").write_bytes(b"zip")
    (tmp_path / "_intro.md").write_bytes(b"x")
    (tmp_path / "sub" / ".hid.md").write_bytes(b"x")
    same, _ = scan_files(spark, "s", f"file://{tmp_path}/", 100)
    whole = {"sub/A.MD", "b.txt", "_intro.md", "sub/.hid.md"}
    assert {r.external_document_id for r in same.collect()} == whole
    docs, rejected = scan_files(spark, "s", str(tmp_path), 100)
    got = {r.external_document_id: r for r in docs.collect()}
    assert set(got) == whole and got["sub/A.MD"].format == "MARKDOWN"
    assert got["b.txt"].metadata["fileName"] == "b.txt" and got["b.txt"].metadata["size"] == "5"
    assert {(r.external_document_id, r.violation) for r in rejected.collect()} == {
        ("big.txt", "size limit"), ("c.zip", "unsupported format")}


def test_sources(spark):
    dim = R.source_dim(spark, [{"source_id": "b"}, {"source_id": "a", "pipeline_id": "  p ", "update_policy": "AUTHORITATIVE_SNAPSHOT"}])
    assert [(r.source_id, r.update_policy, r.pipeline_id) for r in dim.collect()] == [
        ("a", "AUTHORITATIVE_SNAPSHOT", "p"), ("b", "REQUIRE_VERSION_RESOLUTION", "default-ingestion")]
    with pytest.raises(R.DuplicateSourceError):
        R.source_dim(spark, [{"source_id": "a"}, {"source_id": "a"}])
    assert R.duplicate_sources(spark.createDataFrame([("a",), ("a",), ("b",)], "source_id string")).collect()[0].source_id == "a"


VERSION = "document_id string, document_version_id string, version_number long, content_hash string, status string, activated_at timestamp"


def test_resume_rules(spark):
    rows = [("d1", "v1", 1, "h", "ACTIVE", None), ("d1", "v2", 2, "h", "FAILED", None), ("d2", "w1", 1, "h", "FAILED", None), ("d2", "w2", 2, "h", "BUILDING", None),
            ("d3", "x1", 1, "h", "FAILED", None), ("d3", "x2", 2, "h", "ACTIVE", None)]
    assert [r.document_version_id for r in V.resumable(spark.createDataFrame(rows, VERSION)).collect()] == ["v2"]


def test_activation_is_idempotent_and_strict(spark):
    versions = spark.createDataFrame([("d1", "v1", 1, "h", "ACTIVE", None), ("d1", "v2", 2, "h", "BUILDING", None), ("d2", "w1", 1, "h", "FAILED", None),
                                      ("d3", "x1", 1, "h", "ACTIVE", None)], VERSION)
    asked = spark.createDataFrame([("v2",), ("w1",), ("x1",)], "document_version_id string")
    changed, errors = V.activate(versions, asked, F.lit("2024-01-01").cast("timestamp"))
    assert {(r.document_version_id, r.status) for r in changed.collect()} == {("v2", "ACTIVE"), ("v1", "INACTIVE")}
    assert [r.document_version_id for r in errors.collect()] == ["w1"]
    assert V.version_violations(V.apply_status(versions, changed)).where("violation like 'several%'").count() == 0


def test_reuse_only_from_the_active_version_of_the_document(spark):
    targets = spark.createDataFrame([("t1", "d1", "d1v2", "s", "f1"), ("t2", "d2", "d2v1", "s", "f1"), ("t3", "d1", "d1v2", "s", "f9")],
                                    "chunk_id string, document_id string, document_version_id string, source_id string, input_fingerprint string")
    active = spark.createDataFrame([("b", "d1", "d1v1", "f1"), ("a", "d1", "d1v1", "f1")],
                                   "chunk_id string, document_id string, document_version_id string, processing_fingerprint string")
    assert [(r.chunk_id, r.reused_from) for r in E.reuse_from_active(targets, active).collect()] == [("t1", "a")]
    assert E.reuse_from_active(targets, active.withColumn("document_version_id", F.lit("d1v2"))).count() == 0


def test_vectors_are_embedded_once_per_text(spark):
    class Counting(E.HashEmbedder):
        def embed(self, texts):
            assert len(texts) == len(set(texts)) and len(texts) <= 2
            return super().embed(texts)

    df = spark.createDataFrame([("f1", "a b"), ("f1", "a b"), ("f2", "c"), ("f3", "d")], "input_fingerprint string, embedding_text string")
    got = {r.input_fingerprint: r for r in E.embed_batch(df, Counting(8), batch=2).collect()}
    assert got["f1"].n == 2 and len(got["f1"].embedding) == 8 and abs(sum(x * x for x in got["f1"].embedding) - 1) < 1e-6
    with pytest.raises(Exception, match="blank"):
        E.embed_batch(spark.createDataFrame([("f", " ")], df.schema), E.HashEmbedder(8)).collect()


def test_change_summary_counts_repeats(spark):
    incoming = spark.createDataFrame([("d", "x"), ("d", "x"), ("d", "y"), ("e", "z")], "document_id string, content_hash string")
    baseline = spark.createDataFrame([("d", "x"), ("d", "q")], "document_id string, content_hash string")
    got = {r.document_id: (r.previous, r.incoming, r.unchanged, r.added, r.removed) for r in H.change_summary(incoming, baseline).collect()}
    assert got == {"d": (2, 3, 1, 2, 1), "e": (0, 1, 0, 1, 0)}


def test_sample_positions(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (10,)], "n int").select("n", H.sample_positions(F.col("n"), 3).alias("p"))
    assert {r.n: r.p for r in df.collect()} == {0: [], 1: [0], 2: [0, 1], 3: [0, 1, 2], 10: [0, 4, 9]}


def test_parameter_ranges():
    assert check_limit(50) == 50 and check_min_score(-1.0) == -1.0
    for bad in (0, 51):
        with pytest.raises(ValueError):
            check_limit(bad)
    with pytest.raises(ValueError):
        check_min_score(1.5)
    with pytest.raises(ValueError):
        Limits(max_bytes=0)
