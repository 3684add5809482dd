"""Steps that must not move or hold more than their share as tables grow."""

from __future__ import annotations

from pyspark.sql.classic.dataframe import DataFrame

from foliant.operators import postings as P, semantic


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_made_inside_the_row(spark):
    chunks = spark.createDataFrame(
        [("c1", "v", "s", "Red fox", "the fox, the RED fox"), ("c2", "v", "s", None, "fox"), ("c3", "v", "s", "t", ""), ("c4", "v", "s", "t", None)],
        "chunk_id string, document_version_id string, source_id string, section_title string, content string")
    rows = P.build_postings(chunks)
    assert "Exchange" not in plan(rows)
    found = {(r.chunk_id, r.term): [(p.pos, p.w) for p in r.positions] for r in rows.collect()}
    assert found == {
        ("c1", "red"): [(1, "A"), (6, "B")], ("c1", "fox"): [(2, "A"), (4, "B"), (7, "B")], ("c1", "the"): [(3, "B"), (5, "B")],
        ("c2", "fox"): [(1, "B")], ("c3", "t"): [(1, "A")]}
    assert rows.columns == ["term", "chunk_id", "document_version_id", "source_id", "positions"]


def test_more_blocks_of_queries_are_not_copied_to_more_shards(spark, monkeypatch):
    # 8 blocks of 40 queries and 16 tasks on 4 cores: every query travels to 2 shards, every vector to 8 blocks.
    monkeypatch.setattr(semantic, "QUERY_ROWS", 40)
    monkeypatch.setattr(semantic, "QUERY_BYTES", 40 * 2 * 8)
    rows = spark.range(320).selectExpr("cast(id as string) AS chunk_id", "'a' AS source_id", "array(cast(1 as float), cast(id as float)) AS embedding")
    moved, carry_on = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda df, *args, **named: (moved.append(df), carry_on(df, *args, **named))[1])
    hits = semantic.semantic_search(rows.selectExpr("chunk_id AS query_id", "embedding"), rows, 2, 0.0)
    assert {r.query_id for r in hits.where("rank = 1 AND query_id = chunk_id").collect()} == {str(i) for i in range(320)}
    assert moved[0].count() <= 320 * 8 + 320 * 2


def test_a_tile_keeps_ties_by_id_and_scopes(spark, monkeypatch):
    monkeypatch.setattr(semantic, "SCORE_PAIRS", 7)
    vectors = spark.createDataFrame(
        [(f"c{i:03}", "ab"[i % 2], [1.0, 1.0] if i % 3 else [1.0, 0.5]) for i in range(300)], "chunk_id string, source_id string, embedding array<float>")
    asked = spark.createDataFrame([("all", [1.0, 1.0], None), ("b", [1.0, 1.0], ["b"]), ("none", [1.0, 1.0], ["z"])],
                                  "query_id string, embedding array<float>, source_ids array<string>")
    hits = semantic.semantic_search(asked, vectors.repartition(3), 4, 0.1).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in hits] == [
        ("all", "c001"), ("all", "c002"), ("all", "c004"), ("all", "c005"), ("b", "c001"), ("b", "c005"), ("b", "c007"), ("b", "c011")]
