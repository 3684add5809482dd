"""Files as documents: the folder source, scans and streams."""

import pytest
from pyspark.sql import functions as F

from foliant.operators.embeddings import HashEmbedder
from foliant.params import Limits
from foliant.plans import stages as G, stream as S
from foliant.plans.store import Store
from foliant.sources import files as A, folder
from foliant.sources.registry import source_dim

MODEL = HashEmbedder(16)
FILES = {
    "a.md": "# A\n\none", "sub/b.txt": "two", "sub/deep/c.TXT": "three", "_x.md": "hidden one", ".y.md": "hidden two", "_sub/z.txt": "in hidden folder",
    "sub/with blank.md": "spaced", "key=1/d.txt": "keyed", "pic.png": "no text", "noext": "none", "big.txt": "x" * 50, "empty.txt": ""}


def fill(root, files=FILES):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def test_every_file_becomes_a_document_or_is_rejected(spark, tmp_path):
    documents, rejected = A.scan_files(spark, "s", fill(tmp_path), max_bytes=40)
    got = {r.external_document_id: r for r in documents.collect()}
    refused = {"pic.png": "unsupported format", "noext": "unsupported format", "big.txt": "size limit"}
    assert {k: bytes(r.content).decode() for k, r in got.items()} == {k: v for k, v in FILES.items() if k not in refused}
    assert {r.external_document_id: r.violation for r in rejected.collect()} == refused
    assert got["_x.md"].format == "MARKDOWN" and got["_x.md"].metadata["fileName"] == "_x.md" and got["_x.md"].metadata["size"] == "10"
    assert got["sub/deep/c.TXT"].format == "TEXT" and got["a.md"].metadata["lastModified"].endswith("Z")
    # A root that is a file; a root that is missing.
    one, _ = A.scan_files(spark, "s", f"{tmp_path}/_x.md")
    assert [r.external_document_id for r in one.collect()] == ["_x.md"]
    with pytest.raises(Exception, match="no such folder"):
        A.scan_files(spark, "s", f"{tmp_path}/none")[0].collect()


def test_slices_cover_every_file_once_and_read_what_they_must(tmp_path, monkeypatch):
    root = fill(tmp_path, {f"f{i % 3}/n{i}.txt": str(i) for i in range(40)} | {f"r{i}.bin": "q" for i in range(5)})
    for parts in (1, 7, 40):
        reader = folder.FolderReader({"path": root, "parts": str(parts), "extensions": "txt", "maxbytes": "1"})
        monkeypatch.setattr(folder, "BATCH_FILES", 3)
        slices = reader.partitions()
        assert len(slices) >= parts
        rows = [r for s in slices for b in reader.read(s) for r in b.to_pylist()]
        assert len(rows) == 45 and len({r["path"] for r in rows}) == 45
        assert {r["path"].split("/")[-1] for r in rows if r["content"] is not None} == {f"n{i}.txt" for i in range(10)}
    assert all(b.num_rows <= 3 for s in slices for b in reader.read(s))


@pytest.fixture(scope="module")
def sources(spark):
    return source_dim(spark, [{"source_id": "s", "source_type": "LOCAL_FILE", "name": "One", "update_policy": "AUTHORITATIVE_SNAPSHOT"}])


def active(store):
    rows = store.versions().where("status = 'ACTIVE'").select("document_version_id", "version_number").join(
        store.read("chunk").select("document_version_id", "content"), "document_version_id").collect()
    return sorted((r.content, r.version_number) for r in rows)


def test_stream_takes_new_files_and_a_repeated_batch_writes_nothing(spark, sources, tmp_path):
    store, seen = Store(spark, str(tmp_path / "kb")), []
    root, check = tmp_path / "in", str(tmp_path / "check")
    fill(root, {"a.txt": "one", "b.txt": "two", "pic.png": "p"})

    def run():
        S.ingest_stream(store, A.stream_files(spark, "s", str(root)), "inbox", sources, MODEL, check, after=seen.append).awaitTermination()

    run()
    assert active(store) == [("one", 1), ("two", 1)] and seen == [0]
    assert [(r.external_document_id, r.violation, r.micro_batch) for r in S.rejected_files(store).collect()] == [("pic.png", "unsupported format", 0)]
    run()  # nothing new
    assert seen == [0]
    fill(root, {"c.txt": "three"})
    run()
    assert active(store) == [("one", 1), ("three", 1), ("two", 1)] and seen == [0, 1]
    # The last micro-batch is delivered again, as after a driver that died before marking it as done.
    (tmp_path / "check" / "commits" / "1").unlink()
    (tmp_path / "check" / "commits" / ".1.crc").unlink(missing_ok=True)
    before = store.commits(), sorted(tuple(r) for r in S.deliveries(store).collect())
    run()
    store.refresh()
    assert seen == [0, 1, 1] and (store.commits(), sorted(tuple(r) for r in S.deliveries(store).collect())) == before
    assert active(store) == [("one", 1), ("three", 1), ("two", 1)]


def test_a_cut_micro_batch_is_carried_on(spark, sources, tmp_path):
    class Broken(HashEmbedder):
        def embed(self, texts):
            raise RuntimeError("model down")

    store = Store(spark, str(tmp_path / "kb"))
    named = A._named(spark.createDataFrame(
        [("/in/a.txt", 3, b"one")], "path string, length long, content binary").withColumn("modificationTime", F.current_timestamp()), "s", "/in")
    with pytest.raises(Exception, match="model down"):
        S.deliver(store, named, "inbox", 7, sources, Broken(16))
    assert active(store) == [] and G.interrupted_builds(store).count() == 1
    assert S.deliver(store, named, "inbox", 7, sources, MODEL) == "RESUMED"
    assert S.deliver(store, named, "inbox", 7, sources, MODEL) == "KNOWN"
    assert active(store) == [("one", 1)] and S.deliveries(store).count() == 1
    assert S.deliver(store, named, "inbox", 8, sources, MODEL, Limits(max_bytes=2)) == "COMMITTED"
    assert [(r.violation, r.micro_batch) for r in S.rejected_files(store).collect()] == [("size limit", 8)]
