"""Room that stored tables take, and who pays for it."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foliant.catalogue import stored as Q
from foliant.plans import ingest as I, retrieve as R
from foliant.plans.search_index import SearchIndex, settings
from foliant.plans.store import STAGING, Store
from test_ingest import MODEL, docs, sources  # noqa: F401


def codecs(root):
    return {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in Path(root).rglob("*.parquet") if pq.ParquetFile(f).metadata.num_row_groups}


def test_a_committed_batch_keeps_no_staging_and_tables_are_packed(spark, sources, tmp_path):  # noqa: F811
    store = Store(spark, str(tmp_path / "kb"))
    report = I.ingest_batch(store, docs(spark, ("s1", "a.txt", "red fox"), ("s1", "b.txt", "red hen")), sources, MODEL)
    assert [t for t in STAGING if store.written(t)] == ["report"] and {r.outcome for r in report.collect()} == {"BUILT"}
    index = SearchIndex(spark, str(tmp_path / "search"), buckets=4)
    index.publish(store)
    assert codecs(tmp_path / "kb" / "posting") == codecs(tmp_path / "search" / "posting") == {"ZSTD"}
    # Published postings hold ids as 16 bytes and give them back as they were.
    assert dict(spark.table(index.name("posting")).dtypes)["chunk_id"] == "binary"
    columns = ["term", "chunk_id", "document_version_id"]
    assert sorted(index.active("posting").select(columns).collect()) == sorted(store.read("posting").select(columns).collect())
    with pytest.raises(ValueError, match="not committed"):
        store.drop_staging(7)


def test_a_store_is_published_as_it_was(spark, sources, tmp_path):  # noqa: F811
    store = Store(spark, str(tmp_path / "kb"))
    for text in ("first words", "second words"):
        I.ingest_batch(store, docs(spark, ("s1", "a.txt", text)), sources, MODEL)
    index = SearchIndex(spark, str(tmp_path / "search"), buckets=4)
    assert index.publish(store.as_of(1)) == 1 and [r.content for r in index.active("chunk").collect()] == ["first words"]
    assert index.publish(store) == 2 and [r.content for r in index.active("chunk").collect()] == ["second words"]
    assert sorted(r.term for r in index.term_counts().collect()) == ["second", "words"]


def test_stored_tables_are_read_without_a_search_index(spark, monkeypatch):
    monkeypatch.setattr(Q, "SearchIndex", None)
    Q._stored.cache_clear()
    assert Q.stored_versions(spark, "/root/testdata/sf0.001").count() > 0


def test_a_batch_writes_no_text_twice_on_the_way(spark, sources, tmp_path, monkeypatch):  # noqa: F811
    store, seen = Store(spark, str(tmp_path / "kb")), {}
    append = Store.append

    def watched(self, table, df, generation):
        seen[table] = df.columns
        return append(self, table, df, generation)

    monkeypatch.setattr(Store, "append", watched)
    I.ingest_batch(store, docs(spark, ("s1", "a.md", "# T\n\nred fox\n\nred hen"), ("s1", "b.md", "# T\n\nred fox")), sources, MODEL)
    # Documents judged: the bytes, no sections or chunks of them. Texts are kept for the model alone, each of them once.
    assert "content" in seen["parsed"] and not {"sections", "text", "chunks"} & set(seen["parsed"])
    assert seen["text"] == ["input_fingerprint", "embedding_text", "n"]
    assert sorted((r.embedding_text, r.n) for r in store.batch_rows("text", 1).collect()) == [("T\n\nred fox", 2), ("T\n\nred hen", 1)]
    assert set(store.read("chunk").columns) == {c.split()[0] for c in I._columns(I.TABLES["chunk"])}


def test_documents_stay_where_they_are_while_few_repeat(spark, sources, tmp_path):  # noqa: F811
    batch = docs(spark, *[("s1", f"{i}.txt", f"text {i}") for i in range(50)], ("s1", "7.txt", "text 7"))
    decided = I.decide(batch, sources, Store(spark, str(tmp_path / "kb")).versions(), I.Limits(), False)
    assert decided.where("outcome = 'BUILD'").count() == 50
    moved = [line for line in decided.select("content", "outcome")._jdf.queryExecution().executedPlan().toString().splitlines()
             if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
    assert not moved


def test_postings_travel_to_their_buckets_only(spark, sources, tmp_path, monkeypatch):  # noqa: F811
    # A list of versions that is too long to be broadcast, as it is beside large stores, moves no rows but those it names.
    store, joins = Store(spark, str(tmp_path / "kb")), {}
    I.ingest_batch(store, docs(spark, *[("s1", f"{i}.txt", f"text {i}") for i in range(80)], ("s1", "void.txt", " \n")), sources, MODEL)
    index, write = SearchIndex(spark, str(tmp_path / "search"), buckets=4), SearchIndex._write

    def watched(self, table, df, number):
        plan = df._jdf.queryExecution().executedPlan().toString()
        joins[table] = "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
        write(self, table, df, number)

    monkeypatch.setattr(SearchIndex, "_write", watched)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="2500"):
        assert index.publish(store) == 1
    assert {t for t in ("section", "chunk", "embedding", "posting") if joins[t]} == set()
    order = ["term", "chunk_id", "source_id", "positions"]
    assert sorted(index.active("posting").select(order).collect()) == sorted(store.read("posting").select(order).collect())


def test_fields_of_hits_are_joined_without_moving_other_chunks(spark):
    chunks = spark.range(300).select(F.format_string("c%d", "id").alias("chunk_id"), *[
        F.concat_ws("-", F.lit(c), "id").alias(c) for c in R.HIT_COLUMNS])
    hits = spark.createDataFrame([("q", "c7", 1, 0.5), ("q", "gone", 2, 0.4)], "query_id string, chunk_id string, rank int, score double")
    found = R.attach(hits, chunks)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan
    assert [(r.chunk_id, r.content) for r in found.orderBy("rank").collect()] == [("c7", "content-7"), ("gone", None)]
