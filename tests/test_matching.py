"""Text search by rows of chunks: what is proposed, what travels, and results on repeated rows."""

import numpy as np
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import embeddings as E, lexical as L, postings as P, preview as H, semantic
from foliant.plans.retrieve import HIT_COLUMNS, KnowledgeBase
from foliant.session import empty

CHUNKS = "chunk_id string, document_version_id string, source_id string, section_title string, content string"


def postings(spark, *texts):
    return P.build_postings(spark.createDataFrame([(f"c{i}", "v", "s", None, t) for i, t in enumerate(texts)], CHUNKS))


def ask(spark, *queries):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(queries)], "query_id string, query string")


def test_chunks_without_the_next_rarest_terms_are_out_before_the_look_up(spark, monkeypatch):
    # "rare" proposes 20 chunks, of which one holds "odd", too.
    held = postings(spark, *[f"rare common text {i}" for i in range(19)], "rare odd common text", *["common odd"] * 30)
    written, cut = [], L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda df: (written.append(cut(df)), written[-1])[1])
    found = L.lexical_matches(ask(spark, "common odd rare"), held)
    assert [r.chunk_id for r in found.collect()] == ["c19"]
    assert [df.count() for df in written if df.columns == ["query_id", "chunk_id"]] == [1]


def test_proposed_chunks_are_named_by_numbers(spark):
    held = postings(spark, *[f"fox {i}" for i in range(9)])
    some = L._in_chunks(held, held.where("term = '3'").select("chunk_id"))
    assert {(r.chunk_id, r.term) for r in some.collect()} == {("c3", "fox"), ("c3", "3")}
    assert "HashedRelationBroadcastMode(List(input[0, bigint" in some._jdf.queryExecution().executedPlan().toString()


def test_repeated_postings_count_once(spark):
    held = postings(spark, "red fox and red hen", "hen red fox", "fox")
    queries = ask(spark, 'red "red fox"', "fox -hen", 'hen OR "fox and red"', "nothing fox")
    once = sorted(tuple(r) for r in L.lexical_matches(queries, held).collect())
    twice = sorted(tuple(r) for r in L.lexical_matches(queries, held.union(held)).collect())
    assert once == twice and [r[:2] for r in once] == [("q0", "c0"), ("q0", "c1"), ("q1", "c2"), ("q2", "c0"), ("q2", "c1")]


def test_a_phrase_does_not_bar_chunks_before_it_is_judged(spark):
    terms = L.query_terms(L._asked(ask(spark, 'b "c a" d e f g -z')))
    rare = L.rarest_terms(terms, spark.createDataFrame([(t, n) for n, t in enumerate("abcdefg", 1)], "term string, n long"), 4)
    assert sorted((r.place, r.term) for r in rare.collect()) == [(1, "a"), (2, "b"), (4, "d"), (5, "e"), (6, "f")]


def test_postings_are_grouped_by_columns_of_many_chunks(spark, monkeypatch):
    # A border between groups of tokens falls inside and between chunks; nulls and empty texts give no rows.
    monkeypatch.setattr(P, "GROUPED_TOKENS", 3)
    rows = spark.createDataFrame([("a", "v", "s", "B a", "a b a"), ("b", "v", "s", None, None), ("c", "v", "s", None, ""), (None, "v", "s", None, "a")], CHUNKS)
    made = P.build_postings(rows.coalesce(1))
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    assert sorted([(str(r.chunk_id), r.term, [(p.pos, p.w) for p in r.positions]) for r in made.collect()]) == [
        ("None", "a", [(1, "B")]), ("a", "a", [(2, "A"), (3, "B"), (5, "B")]), ("a", "b", [(1, "A"), (4, "B")])]


def test_strip_looks_at_the_ends_only(spark):
    white = r"\p{javaWhitespace}"
    points = spark.range(1, 0x3100).where("id < 55296").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    told = points.select(F.concat("c", F.lit("x"), "c", F.lit("y "), "c").alias("t"))
    assert told.where(T.strip(F.col("t")) != F.regexp_replace("t", rf"\A{white}++|(?<!{white}){white}++\z", "")).count() == 0
    assert "regexp_replace" not in T.strip(F.col("t"))._jc.toString()


def test_a_store_without_batches_is_known_to_be_empty(spark):
    none = empty(spark, "a string, b array<struct<x: int, y: string>>, c long")
    assert none.dtypes == [("a", "string"), ("b", "array<struct<x:int,y:string>>"), ("c", "bigint")] and none.count() == 0
    assert "LocalTableScan <empty>" in none._jdf.queryExecution().executedPlan().toString()


def test_ascii_texts_have_the_vectors_of_their_tokens():
    model = E.HashEmbedder(8)
    for text in ("Fox fox 12", "Füchse FOX ½", "!?"):
        tokens = E._TOKENS.findall(text.lower()) or [text]
        want = np.bincount([model._place(t) for t in tokens], minlength=8).astype(float)
        assert np.array_equal(model.embed([text])[0], (want / np.linalg.norm(want)).astype(np.float32))


def test_samples_with_one_text_ask_once(spark, monkeypatch):
    model, seen, search = E.HashEmbedder(8), [], semantic.semantic_search
    monkeypatch.setattr(semantic, "semantic_search", lambda queries, *rest: (seen.append(queries.count()), search(queries, *rest))[1])
    texts = ["red fox", "red fox", "red fox", "blue hen"]
    chunks = spark.createDataFrame([(f"c{i}", t, f"d{i}", "v", "s", "s1", f"{i}.txt", None) for i, t in enumerate(texts)],
                                   "chunk_id string, content string, document_id string, document_version_id string, section_id string, source_id string, external_document_id string, section_title string")
    vectors = spark.createDataFrame([(f"c{i}", "s1", [float(x) for x in model.embed([t])[0]], model.provider, model.model, model.revision, 8) for i, t in enumerate(texts)],
                                    "chunk_id string, source_id string, embedding array<float>, provider string, model string, model_revision string, dimensions int")
    base = KnowledgeBase(sections=chunks, chunks=chunks.select("chunk_id", *HIT_COLUMNS), embeddings=vectors, postings=P.build_postings(chunks))
    samples = spark.createDataFrame([(f"d{i}", 0, t) for i, t in enumerate(texts)], "document_id string, sample_index int, sample string")
    found = H.similar_materials(samples, base, model, spark.createDataFrame([("s1",)], "source_id string")).collect()
    assert seen == [2]
    lexical = sorted((r.for_document_id, r.chunk_id) for r in found if r.method == "LEXICAL")
    assert lexical == [("d0", "c1"), ("d0", "c2"), ("d1", "c0"), ("d1", "c2"), ("d2", "c0"), ("d2", "c1")]
