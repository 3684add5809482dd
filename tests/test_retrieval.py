"""Search, fusion, contexts and evaluation on small tables, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import context as J, evaluation as K, fusion, lexical, postings as P, routing, semantic
from foliant.operators.embeddings import HashEmbedder, embed_batch


def vectors(spark, m, sources):
    rows = [(f"c{i:03d}", sources[i % len(sources)], [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "chunk_id string, source_id string, embedding array<float>")


def test_semantic_search_matches_numpy(spark, monkeypatch):
    rng = np.random.default_rng(1)
    corpus = rng.normal(size=(60, 8)).astype(np.float32)
    corpus[10:30] = corpus[10]  # a third of the rows are copies
    asked = np.concatenate([rng.normal(size=(6, 8)), corpus[10:11]]).astype(np.float32)
    scopes = [None, ["a"], [], ["b", "c"], ["zz"], None, ["c"]]
    queries = spark.createDataFrame([(f"q{i}", [float(x) for x in v], s) for i, (v, s) in enumerate(zip(asked, scopes))],
                                    "query_id string, embedding array<float>, source_ids array<string>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = unit(asked.astype(float)) @ unit(corpus.astype(float)).T
    want = {}
    for q, scope in enumerate(scopes):
        order = sorted((-round(scores[q, i], 9), f"c{i:03d}") for i in range(60)
                       if scores[q, i] >= 0.1 and (not scope or "abc"[i % 3] in scope))
        want[f"q{q}"] = [c for _, c in order[:7]]
    # One broadcast block, blocks bounded by rows, by bytes, and one query a block.
    for rows, held, step in ((4096, 1 << 25, 1024), (2, 1 << 25, 3), (4096, 3 * 64, 1), (1, 1 << 25, 7)):
        monkeypatch.setattr(semantic, "QUERY_ROWS", rows)
        monkeypatch.setattr(semantic, "QUERY_BYTES", held)
        monkeypatch.setattr(semantic, "SCORE_ROWS", step)
        hits = semantic.semantic_search(queries, vectors(spark, corpus, "abc").repartition(5), 7, 0.1).orderBy("query_id", "rank").collect()
        got = {q: [r.chunk_id for r in hits if r.query_id == q] for q in want}
        assert got == want


def test_small_query_sets_leave_the_vectors_in_place(spark, monkeypatch):
    queries = spark.createDataFrame([(f"q{i}", [1.0, float(i)]) for i in range(9)], "query_id string, embedding array<float>")
    corpus = vectors(spark, np.ones((40, 2)), "a")

    def below_scoring():
        plan = semantic.semantic_search(queries, corpus, 3)._jdf.queryExecution().executedPlan().toString()
        return plan[plan.index("MapInArrow"):]

    assert "Exchange" not in below_scoring()
    monkeypatch.setattr(semantic, "QUERY_ROWS", 2)
    assert below_scoring().count("Exchange") == 1


def test_semantic_search_without_queries_or_vectors(spark, monkeypatch):
    schema = "query_id string, embedding array<float>"
    none, some = spark.createDataFrame([], schema), spark.createDataFrame([(f"q{i}", [1.0, 2.0]) for i in range(5)], schema)
    corpus = vectors(spark, np.ones((4, 2)), "a")
    for rows in (4096, 2):
        monkeypatch.setattr(semantic, "QUERY_ROWS", rows)
        assert semantic.semantic_search(none, corpus, 3).count() == 0
        assert semantic.semantic_search(some, corpus.limit(0), 3).count() == 0


def test_semantic_search_refuses_mixed_dimensions(spark):
    queries = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "query_id string, embedding array<float>")
    with pytest.raises(ValueError):
        semantic.semantic_search(queries, vectors(spark, np.ones((2, 1)), "a"), 3)


def test_blank_queries_are_reported(spark):
    queries = spark.createDataFrame([("a", " x "), ("b", "  "), ("c", None)], "query_id string, query string")
    good, blank = semantic.embed_queries(queries, HashEmbedder(4))
    assert [(r.query_id, r.query) for r in good.collect()] == [("a", "x")]
    assert {r.query_id for r in blank.collect()} == {"b", "c"}


def test_model_calls_are_dealt_evenly(spark):
    class Counting(HashEmbedder):
        """Vectors of (task, texts of the call, characters of the text)."""

        def embed(self, texts):
            from pyspark import TaskContext

            return np.array([[TaskContext.get().partitionId(), len(texts), len(t)] for t in texts], dtype=np.float32)

    # Copies of one text are a third of all rows; few texts are long.
    rows = [(f"f{i}", "x" * (2000 if i % 50 == 0 else 1 + i % 7)) for i in range(1000)] + [("f3", "xxxx")] * 500
    texts = spark.createDataFrame(rows, "input_fingerprint string, embedding_text string").repartition(3)
    got = embed_batch(texts, Counting(3)).collect()
    assert len(got) == 1000 and sum(r.n for r in got) == 1500
    calls, characters = {}, {}
    for r in got:
        task, size, length = r.embedding
        calls[task], characters[task] = calls.get(task, 0) + 1 / size, characters.get(task, 0) + length
    assert len(calls) == 16 and max(calls.values()) <= 2 * sum(calls.values()) / len(calls)
    assert max(characters.values()) <= 2 * sum(characters.values()) / len(characters)
    # Few texts fill few calls, none gives no rows.
    few = embed_batch(texts.where("input_fingerprint in ('f1', 'f2', 'f3')"), Counting(3)).collect()
    assert {(r.embedding[0], r.embedding[1]) for r in few} == {(0, 3)}
    assert embed_batch(texts.limit(0), Counting(3)).count() == 0


TEXTS = ["the cat sat on the mat", "a cat and a dog", "dog on mat", "fat cat dog cat", "bird", "the the the dog", "cat-dog mat", "mat cat"]


def index(spark, titles=None):
    rows = [(f"c{i}", "v", "ab"[i % 2], (titles or {}).get(i), t) for i, t in enumerate(TEXTS)]
    return P.build_postings(spark.createDataFrame(
        rows, "chunk_id string, document_version_id string, source_id string, section_title string, content string"))


def test_boolean_queries(spark):
    asked = {
        "and": ("cat dog", {"c1", "c3", "c6"}), "phrase": ('"cat dog"', {"c3", "c6"}), "not": ("cat -dog", {"c0", "c7"}),
        "or": ("bird or sat mat", {"c0", "c4"}), "compound": ("cat-dog", {"c3", "c6"}), "notphrase": ('mat -"the mat"', {"c2", "c6", "c7"}),
        "edge": ("or cat or", set()), "none": ("zebra", set()), "quotedor": ('cat "or" dog', set()), "case": ("CAT Mat", {"c0", "c6", "c7"})}
    queries = spark.createDataFrame([(n, q) for n, (q, _) in asked.items()], "query_id string, query string")
    got = {}
    for r in lexical.lexical_matches(queries, index(spark)).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    assert got == {n: m for n, (_, m) in asked.items() if m}


def test_queries_that_only_negate(spark):
    queries = spark.createDataFrame([("n", "-cat", None), ("s", "-cat -bird", ["b"]), ("m", "bird or -mat", None)],
                                    "query_id string, query string, source_ids array<string>")
    hits = lexical.lexical_search(queries, index(spark), 3).orderBy("query_id", "rank").collect()
    got = {}
    for r in hits:
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 3)))
    assert got == {"n": [("c2", 0.0), ("c4", 0.0), ("c5", 0.0)], "s": [("c5", 0.0)], "m": [("c4", 0.286), ("c1", 0.0), ("c3", 0.0)]}


def brute_density(entries, atoms):
    """Minimal covers by trying every window. entries: sorted (pos, weight); atoms: list of sets of positions."""
    spans = []
    positions = [p for p, _ in entries]
    for lo in positions:
        for hi in positions:
            if lo <= hi and all(any(lo <= p <= hi for p in a) for a in atoms):
                spans.append((lo, hi))
    minimal = [s for s in spans if not any(t != s and s[0] <= t[0] and t[1] <= s[1] for t in spans)]
    total = 0.0
    for lo, hi in minimal:
        inside = [w for p, w in entries if lo <= p <= hi]
        total += len(inside) / sum(1 / w for w in inside) / (1 + (hi - lo) - (len(inside) - 1))
    return total


def test_cover_density_matches_brute_force(spark):
    rng = random.Random(11)
    words = ["x", "y", "z", "n", "m"]
    rows, want = [], {}
    for i in range(60):
        title, body = [rng.choice(words) for _ in range(rng.randint(0, 3))], [rng.choice(words) for _ in range(rng.randint(1, 14))]
        rows.append((f"c{i}", "v", "s", " ".join(title), " ".join(body)))
        where = {w: {p + 1 for p, t in enumerate(title + body) if t == w} for w in words}
        for name, terms in (("q1", ["x"]), ("q2", ["x", "y"]), ("q3", ["z", "x", "y"])):
            if all(where[t] for t in terms):
                entries = sorted((p, 1.0 if p <= len(title) else 0.4) for t in terms for p in where[t])
                d = brute_density(entries, [where[t] for t in terms])
                want[name, f"c{i}"] = round(d / (d + 1), 9)
    post = P.build_postings(spark.createDataFrame(rows, "chunk_id string, document_version_id string, source_id string, section_title string, content string"))
    queries = spark.createDataFrame([("q1", "x"), ("q2", "x y"), ("q3", "z x y x")], "query_id string, query string")
    got = {(r.query_id, r.chunk_id): round(r.score, 9) for r in lexical.lexical_matches(queries, post).collect()}
    assert got == want


def test_lexical_scope_and_limit(spark):
    queries = spark.createDataFrame([("all", "cat", None, 2), ("one", "cat", ["b"], 9)], "query_id string, query string, source_ids array<string>, k int")
    got = {}
    for r in lexical.lexical_search(queries, index(spark), 5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert len(got["all"]) == 2 and set(got["one"]) == {"c1", "c3", "c7"} and got["one"][0] == "c3"


def test_negation_finds_chunks_without_tokens(spark):
    texts = ["--- !!!", "apple pie", "pear"]
    chunks = spark.createDataFrame([(f"c{i}", "v", "ab"[i % 2], None, t) for i, t in enumerate(texts)],
                                   "chunk_id string, document_version_id string, source_id string, section_title string, content string")
    queries = spark.createDataFrame([("all", "-apple", None), ("one", "-apple", ["b"]), ("none", "-pear", ["a", "zz"])], "query_id string, query string, source_ids array<string>")
    hits = lexical.lexical_search(queries, P.build_postings(chunks), 5, None, chunks).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in hits] == [("all", "c0"), ("all", "c2"), ("none", "c0")]


def test_model_numbers_must_be_finite(spark):
    class Broken(HashEmbedder):
        def embed(self, texts):
            return np.full((len(texts), self.dimensions), np.nan)

    texts = spark.createDataFrame([("f", "x")], "input_fingerprint string, embedding_text string")
    with pytest.raises(Exception, match="not finite"):
        embed_batch(texts, Broken(4)).collect()


def test_backfill_indexes_only_missing_chunks(spark):
    chunks = spark.createDataFrame([("c0", "v", "s", None, "a b a"), ("c1", "v", "s", "T", "b")],
                                   "chunk_id string, document_version_id string, source_id string, section_title string, content string")
    done = P.build_postings(chunks.where("chunk_id = 'c0'"))
    got = {(r.term, tuple((p.pos, p.w) for p in r.positions)) for r in P.backfill_postings(chunks, done).collect()}
    assert got == {("t", ((1, "A"),)), ("b", ((2, "B"),))}


def test_fusion(spark):
    schema = "query_id string, chunk_id string, rank int, document_id string, document_version_id string, section_id string"
    one = spark.createDataFrame([("q", "a", 1, "d", "v", "s"), ("q", "b", 2, "d", "v", "s"), ("q", "b", 3, "d", "v", "s")], schema)
    two = spark.createDataFrame([("q", "b", 1, "d", "v", "x"), ("q", "c", 2, "d", "v", "s")], schema)
    got = [(r.chunk_id, round(r.score, 9), r["rank"], r.section_id) for r in fusion.rrf_fuse([one, two], 5).orderBy("rank").collect()]
    assert got == [("b", round(1 / 62 + 1 / 61, 9), 1, "s"), ("a", round(1 / 61, 9), 2, "s"), ("c", round(1 / 62, 9), 3, "s")]
    assert [r.chunk_id for r in fusion.fusion_violations([one, two]).collect()] == ["b"]
    assert [r.c for r in spark.createDataFrame([(1,), (5,), (20,), (60,)], "k int").select(fusion.candidate_limit(F.col("k")).alias("c")).collect()] == [4, 20, 50, 50]


def test_rerank_refuses_scores_that_are_not_finite(spark):
    class Broken(fusion.OverlapScorer):
        def score(self, query, documents):
            return [float("nan")] * len(documents)

    queries = spark.createDataFrame([("q", "x y")], "query_id string, query string")
    hits = spark.createDataFrame([("q", 1, "b", "x", 0.9), ("q", 2, "a", "y", 0.8), ("q", 3, "c", "x y", 0.1)], "query_id string, rank int, chunk_id string, content string, score double")
    assert [(r.chunk_id, r.score) for r in fusion.rerank(queries, hits, fusion.OverlapScorer(), 2).orderBy("rank").collect()] == [("c", 1.0), ("a", 0.5)]
    with pytest.raises(Exception, match="finite"):
        fusion.rerank(queries, hits, Broken(), 2).collect()


def test_routing_rules(spark):
    sources = spark.createDataFrame([("payments", "LOCAL_FILE", "Billing", "handles invoices"), ("hr-docs", "LOCAL_FILE", "People", "payments of wages")],
                                    "source_id string, source_type string, name string, description string")
    queries = spark.createDataFrame([("a", "processPayments now"), ("b", "invoices"), ("c", "People file"), ("d", "hr")], "query_id string, query string")
    got = {(r.query_id, r.source_id, r.score) for r in routing.route_sources(queries, sources).collect()}
    assert got == {("a", "payments", 4), ("c", "hr-docs", 5)}


SECTION = "section_id string, document_version_id string, title string, content string"


def test_contexts(spark):
    hits = spark.createDataFrame(
        [("q", r, "d", "v", "s1", c, "src", "e", "T", f"text {c}", score) for r, c, score in ((1, "c3", 0.5), (2, "c4", 0.9), (3, "c9", 0.1))],
        "query_id string, rank int, document_id string, document_version_id string, section_id string, chunk_id string, source_id string, external_document_id string, "
        "section_title string, content string, score double")
    sections = spark.createDataFrame([("s1", "v", "T", "whole section")], SECTION)
    chunks = spark.createDataFrame([(f"c{i}", "s1", i, f"text c{i}") for i in (5, 3, 4, 9)], "chunk_id string, section_id string, chunk_index int, content string")
    merged = J.dedupe_contexts(J.expand_section(hits, sections, 100)).collect()
    assert [(r["rank"], r.score, r.scope, r.content, r.origin_chunk_id, r.included_chunk_ids) for r in merged] == [(1, 0.9, "SECTION", "whole section", "c4", [])]
    assert {r.scope for r in J.expand_section(hits, sections, 5).collect()} == {"CHUNK"}
    window = {r.origin_chunk_id: (r.content, r.included_chunk_ids) for r in J.expand_neighbours(hits, chunks, 1).collect()}
    assert window["c4"] == ("text c3\n\ntext c4\n\ntext c5", ["c3", "c4", "c5"]) and window["c9"] == ("text c9", ["c9"])
    assert [r.violation for r in J.context_violations(hits, sections, chunks.where("chunk_id <> 'c9'")).collect()] == ["chunk missing"]


def test_evaluation(spark):
    cases = spark.createDataFrame([("c1", "q", "s", "d1"), ("c2", "q", "s", "zz"), ("c3", " ", "s", "d")],
                                  "case_id string, query string, expected_source_id string, expected_document_id string")
    hits = spark.createDataFrame([("c1", 1, "s", "d9"), ("c1", 2, "s", "d1"), ("c1", 3, "s", "d1"), ("c2", 1, "s", "d1")], "query_id string, rank int, source_id string, external_document_id string")
    assert [r.case_id for r in K.check_cases(cases).collect()] == ["c3"]
    ranks = K.expected_rank(cases.where("case_id <> 'c3'"), hits)
    assert {(r.case_id, r["rank"]) for r in ranks.collect()} == {("c1", 2), ("c2", None)}
    assert tuple(K.recall_mrr(ranks, 5).first()) == (2, 1, 0.5, 0.25)


def test_equal_covers_tie_in_any_order(spark):
    # Five covers with the same gaps; added up in the order of the text, "c2" came out above "c1" by one bit.
    def text(gaps):
        return "red " + " ".join("filler " * gap + ("fox" if i % 2 == 0 else "red") for i, gap in enumerate(gaps))

    chunks = spark.createDataFrame([("c1", "v", "s", None, text([0, 0, 1, 0, 0])), ("c2", "v", "s", None, text([0, 0, 0, 0, 1]))],
                                   "chunk_id string, document_version_id string, source_id string, section_title string, content string")
    queries = spark.createDataFrame([("q", "red fox")], "query_id string, query string")
    hits = lexical.lexical_search(queries, P.build_postings(chunks), 2).orderBy("rank").collect()
    assert [h.chunk_id for h in hits] == ["c1", "c2"] and hits[0].score == hits[1].score


def test_fusion_groups_the_channels_once(spark):
    def channel(*rows):
        return spark.createDataFrame(rows, "query_id string, chunk_id string, rank int, document_id string")

    fused = fusion.rrf_fuse([channel(("q", "a", 2, "d2"), ("q", "a", 1, "d1")), channel(("q", "a", 1, "x"), ("q", "b", 2, "y")), channel(("q", "b", 1, "z"))], 5)
    plan = fused._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [query_id") == 1
    assert [(r.chunk_id, r.document_id, round(r.score, 9)) for r in fused.orderBy("rank").collect()] == [
        ("a", "d1", round(2 / 61, 9)), ("b", "y", round(1 / 61 + 1 / 62, 9))]
