"""Queries on retrieval, contexts and evaluation (I, J, K)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.catalogue import fixtures as X, query
from foliant.catalogue import sql as Q
from foliant.catalogue.building import MODEL
from foliant.functions.skew import number_rows
from foliant.operators import chunks as D, context as J, evaluation as K, fusion, lexical, routing, sections as C, semantic
from foliant.plans import retrieve as R
from foliant.plans.ingest import in_memory_base, parse_documents
from foliant.session import union_all

SCORER = fusion.OverlapScorer()


@query("semantic_topk", """
WITH s AS (SELECT q.vec_id::VARCHAR AS query_id, d.vec_id::VARCHAR AS chunk_id,
  list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score FROM embeddings q CROSS JOIN embeddings d),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score >= 0.2)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def semantic_topk(spark, sf):
    # Every vector is a query against every vector; a vector finds itself first.
    rows = X.table(spark, sf, "embeddings")
    queries = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    corpus = rows.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("source_id"), "embedding")
    return semantic.semantic_search(queries, corpus, 5, 0.2).select(
        "query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("semantic_scoped", """
WITH s AS (SELECT q.vec_id::VARCHAR AS query_id, d.vec_id::VARCHAR AS chunk_id,
  list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings d
  ON q.label < 5 OR d.label = q.label OR d.label = q.label - 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score >= 0.1)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 3""")
def semantic_scoped(spark, sf):
    rows = X.table(spark, sf, "embeddings")
    own = F.array(F.col("label").cast("string"), (F.col("label") - 1).cast("string"))
    queries = rows.select(F.col("vec_id").alias("query_id"), "embedding", F.when(F.col("label") >= 5, own).alias("source_ids"))
    corpus = rows.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("source_id"), "embedding")
    return semantic.semantic_search(queries, corpus, 3, 0.1).select(
        "query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("semantic_model", """
WITH s AS (SELECT q.vec_id::VARCHAR AS query_id, d.vec_id::VARCHAR AS chunk_id,
  list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings d ON coalesce(d.label, 9) NOT IN (0, 1, 2, 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score >= 0.2)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def semantic_model(spark, sf):
    # By label, vectors of another provider, model, revision or length take no part in a search with the model.
    rows = X.table(spark, sf, "embeddings")
    label, other = F.col("label"), F.lit("other")
    corpus = rows.select(
        F.col("vec_id").cast("string").alias("chunk_id"), label.cast("string").alias("source_id"), "embedding",
        F.when(label == 0, other).otherwise(MODEL.provider).alias("provider"), F.when(label == 1, other).otherwise(MODEL.model).alias("model"),
        F.when(label == 2, other).otherwise(MODEL.revision).alias("model_revision"), F.when(label == 3, 32).otherwise(MODEL.dimensions).alias("dimensions"))
    queries = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    return semantic.semantic_search(queries, corpus.where(semantic.model_filter(MODEL)), 5, 0.2).select(
        "query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("lexical_terms", f"""
WITH q AS (SELECT item_id::VARCHAR AS query_id, {Q.tokens('text')} AS ts FROM benchmark)
SELECT query_id, 0::INT AS grp, row_number() OVER (PARTITION BY query_id ORDER BY min(i)) - 1 AS atom, false AS negated, 1::BIGINT AS n_terms, 0::BIGINT AS offset, term
FROM (SELECT query_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS i FROM q) GROUP BY query_id, term""")
def lexical_terms(spark, sf):
    return lexical.lexical_terms(X.passages(spark, sf)).select(
        "query_id", "grp", F.col("atom").cast("long").alias("atom"), "negated", F.col("n_terms").cast("long").alias("n_terms"),
        F.col("offset").cast("long").alias("offset"), "term")


_DOCS = "docs AS (SELECT doc_id::VARCHAR AS chunk_id, text AS content FROM documents)"


@query("lexical_search", f"""
WITH {_DOCS},{Q.lexical('docs')},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lex)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def lexical_search(spark, sf):
    hits = lexical.lexical_search(X.passages(spark, sf), X.whole_document_postings(spark, sf), 5)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_PHRASE = f"""
pd AS (SELECT doc_id, source, ' ' || array_to_string({Q.tokens('text')}, ' ') || ' ' AS t FROM documents),
pq AS (SELECT item_id::VARCHAR AS query_id, ' ' || array_to_string({Q.tokens('text')}, ' ') || ' ' AS p FROM benchmark),
phrase AS (SELECT query_id, doc_id, source FROM pq JOIN pd ON contains(t, p))"""


@query("phrase_matches", f"""
WITH {_PHRASE.lstrip()} SELECT query_id, doc_id::VARCHAR AS chunk_id FROM phrase""")
def phrase_matches(spark, sf):
    return lexical.lexical_matches(X.passages(spark, sf, phrase=True), X.whole_document_postings(spark, sf)).select("query_id", "chunk_id")


@query("boolean_matches", f"""
WITH q AS (SELECT item_id::VARCHAR AS query_id, {Q.tokens('text')} AS ts FROM benchmark),
d AS (SELECT doc_id::VARCHAR AS chunk_id, {Q.tokens('text')} AS ts, ' ' || array_to_string({Q.tokens('text')}, ' ') || ' ' AS t FROM documents)
SELECT query_id, chunk_id FROM q JOIN d ON
  (list_contains(d.ts, q.ts[1]) AND list_contains(d.ts, q.ts[-1]) AND NOT list_contains(d.ts, q.ts[2]))
  OR (contains(t, ' ' || q.ts[3] || ' ' || q.ts[4] || ' ') AND NOT contains(t, ' ' || q.ts[1] || ' ' || q.ts[2] || ' '))""")
def boolean_matches(spark, sf):
    # first last -second or "third fourth" -"first second"
    from foliant.functions.text import words

    t = words(F.col("text"))
    w = lambda i: F.element_at(t, i)
    text = F.concat(w(1), F.lit(' "'), w(-1), F.lit('" -'), w(2), F.lit(' OR "'), w(3), F.lit(" "), w(4), F.lit('" -"'), w(1), F.lit(" "), w(2), F.lit('"'))
    queries = X.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), text.alias("query"))
    return lexical.lexical_matches(queries, X.whole_document_postings(spark, sf)).select("query_id", "chunk_id")


# Sources of the questions `ask` (event_id, query).
ROUTING = """
srcs AS (SELECT 'src' || n_nationkey AS source_id, 'LOCAL_FILE' AS source_type, n_name AS name, 'Documents about ' || r_name AS description
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'EUROPE'
  UNION ALL SELECT 'conversations', 'LOCAL_FILE', 'conversations', 'Recorded talks'),
ft AS (SELECT source_id, w, unnest(list_distinct(regexp_extract_all(lower(regexp_replace(f, '([\\p{Ll}\\d])(\\p{Lu})', '\\1 \\2', 'g')), '[\\p{L}\\p{N}]+'))) AS token
  FROM (SELECT source_id, 4 AS w, source_id AS f FROM srcs UNION ALL SELECT source_id, 3, name FROM srcs
    UNION ALL SELECT source_id, 2, source_type FROM srcs UNION ALL SELECT source_id, 1, description FROM srcs)),
qt AS (SELECT event_id, unnest(list_distinct(regexp_extract_all(lower(regexp_replace(query, '([\\p{Ll}\\d])(\\p{Lu})', '\\1 \\2', 'g')), '[\\p{L}\\p{N}]+'))) AS token FROM ask),
sc AS (SELECT event_id, source_id, sum(w)::BIGINT AS score FROM qt JOIN ft USING (token) WHERE len(token) >= 3 GROUP BY ALL HAVING sum(w) >= 3),
routed AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, source_id) AS rank FROM sc QUALIFY rank <= 3)"""
_ROUTED = f"""
ask AS (SELECT event_id, 'Show' || event_type || 'Nation of src' || user_id || ' documents' AS query FROM events),{ROUTING}"""


def questions(spark, sf):
    return X.table(spark, sf, "events").select(
        "event_id", F.col("event_id").cast("string").alias("query_id"),
        F.concat(F.lit("Show"), F.col("event_type"), F.lit("Nation of src"), F.col("user_id").cast("string"), F.lit(" documents")).alias("query"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("src"), F.col("user_id").cast("string")))
        .when(F.col("event_type") == "error", " ").alias("search_source_id"))


@query("route_sources", f"WITH {_ROUTED.lstrip()} SELECT event_id::VARCHAR AS query_id, source_id, score, rank FROM routed")
def route_sources(spark, sf):
    routed = routing.route_sources(questions(spark, sf), X.sources(spark, sf))
    return routed.withColumn("rank", F.col("rank").cast("long"))


@query("query_scope", f"""
WITH {_ROUTED.lstrip()},
e AS (SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'src' || user_id WHEN 'error' THEN ' ' END AS explicit FROM events)
SELECT event_id::VARCHAR AS query_id, CASE WHEN explicit IS NULL THEN coalesce(r.list, '') WHEN explicit IN (SELECT source_id FROM srcs) THEN explicit END AS sources,
  CASE WHEN explicit = ' ' THEN 'blank source' WHEN explicit IS NOT NULL AND explicit NOT IN (SELECT source_id FROM srcs) THEN 'unknown source' END AS violation
FROM e LEFT JOIN (SELECT event_id, string_agg(source_id, ' ' ORDER BY rank) AS list FROM routed GROUP BY event_id) r USING (event_id)""")
def query_scope(spark, sf):
    good, bad = routing.query_scope(questions(spark, sf), X.sources(spark, sf))
    return union_all(
        good.select("query_id", F.array_join("source_ids", " ").alias("sources"), F.lit(None).cast("string").alias("violation")),
        bad.select("query_id", F.lit(None).cast("string").alias("sources"), "violation"))


_CHANNELS = """
c1 AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem),
c2 AS (SELECT l_orderkey, l_partkey, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_suppkey END AS l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS rank
  FROM lineitem WHERE l_discount > 0.02)"""


def channels(spark, sf):
    """Two rankings of the parts of every order: by price and, where discounted, by quantity."""
    rows = X.table(spark, sf, "lineitem")

    def ranked(df, column, supplier):
        # An order could hold any share of the lines, so they are numbered without gathering an order in one task.
        order = ["_down", "l_linenumber", "l_partkey", "l_suppkey"]
        numbered = number_rows(df.withColumn("_down", -F.col(column)).select("l_orderkey", *order, "l_returnflag"), ["l_orderkey"], order, "rank")
        return numbered.select(
            F.col("l_orderkey").cast("string").alias("query_id"), F.col("l_partkey").cast("string").alias("chunk_id"),
            F.col("rank").cast("int").alias("rank"), supplier.cast("string").alias("document_id"),
            F.lit("v").alias("document_version_id"), F.lit("s").alias("section_id"))

    return [ranked(rows, "l_extendedprice", F.col("l_suppkey")),
            ranked(rows.where("l_discount > 0.02"), "l_quantity", F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_suppkey")))]


@query("rrf_fuse", f"""
WITH {_CHANNELS.lstrip()},
o1 AS (SELECT l_orderkey, l_partkey, min(rank) AS r, arg_min(l_suppkey, rank) AS s FROM c1 GROUP BY ALL), o2 AS (SELECT l_orderkey, l_partkey, min(rank) AS r, arg_min(l_suppkey, rank) AS s FROM c2 GROUP BY ALL),
f AS (SELECT coalesce(o1.l_orderkey, o2.l_orderkey)::VARCHAR AS query_id, coalesce(o1.l_partkey, o2.l_partkey)::VARCHAR AS chunk_id, coalesce(o1.s, o2.s)::VARCHAR AS document_id,
  coalesce(1.0::DOUBLE / (60 + o1.r), 0) + coalesce(1.0::DOUBLE / (60 + o2.r), 0) AS score
  FROM o1 FULL JOIN o2 ON o1.l_orderkey = o2.l_orderkey AND o1.l_partkey = o2.l_partkey)
SELECT query_id, chunk_id, document_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
FROM f QUALIFY rank <= 3""")
def rrf_fuse(spark, sf):
    return fusion.rrf_fuse(channels(spark, sf), 3).select(
        "query_id", "chunk_id", "document_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("fusion_violations", f"""
WITH {_CHANNELS.lstrip()}
SELECT l_orderkey::VARCHAR AS query_id, l_partkey::VARCHAR AS chunk_id, 'inconsistent chunk' AS violation
FROM (SELECT l_orderkey, l_partkey, l_suppkey FROM c1 UNION ALL SELECT l_orderkey, l_partkey, l_suppkey FROM c2) GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1""")
def fusion_violations(spark, sf):
    return fusion.fusion_violations(channels(spark, sf))


@query("candidate_limit", """
SELECT l_orderkey, sum(least(50, greatest(l_quantity::INT, l_quantity::INT * 4)))::BIGINT AS total FROM lineitem GROUP BY l_orderkey""")
def candidate_limit(spark, sf):
    limit = fusion.candidate_limit(F.col("l_quantity").cast("int"))
    return X.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(limit).alias("total"))


@query("rerank", f"""
WITH opening AS (SELECT conv_id, {Q.tokens('text')} AS q FROM conversations WHERE turn = 0),
s AS (SELECT c.conv_id, c.turn, len(list_intersect(list_distinct(q), list_distinct({Q.tokens('text')})))::DOUBLE / len(list_distinct(q)) AS score
  FROM conversations c JOIN opening USING (conv_id))
SELECT conv_id::VARCHAR AS query_id, conv_id || '-' || turn AS chunk_id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, conv_id || '-' || turn) AS rank FROM s QUALIFY rank <= 3""")
def rerank(spark, sf):
    # The opening turn of a conversation is the query, its turns are the candidates.
    turns = X.table(spark, sf, "conversations")
    queries = turns.where("turn = 0").select(F.col("conv_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    hits = turns.select(
        F.col("conv_id").cast("string").alias("query_id"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"),
        F.col("text").alias("content"))
    return fusion.rerank(queries, hits, SCORER, 3).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# Profiles over V1: hashed token vectors of 64 dimensions and all-word queries, on 2400-character chunks.
def vector_sql(source: str, key: str, text: str, name: str) -> str:
    return f"""
{name}_t AS (SELECT {key} AS k, unnest({Q.tokens(text)}) AS term FROM {source}),
{name}_d AS (SELECT k, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS d, count(*) AS c FROM {name}_t GROUP BY ALL),
{name}_v AS (SELECT k, d, c / sqrt(sum(c * c) OVER (PARTITION BY k)) AS x FROM {name}_d)"""


_SEARCH = f"""{Q.V1_CHUNKS},{Q.lexical('c1')},{vector_sql('benchmark', 'item_id::VARCHAR', 'text', 'bq')},{vector_sql('c1', 'chunk_id', 'content', 'bc')},
cos AS (SELECT q.k AS query_id, c.k AS chunk_id, sum(q.x * c.x) AS score FROM bq_v q JOIN bc_v c USING (d) GROUP BY ALL)"""


def top_sql(source: str, k: int, where: str = "true") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 7) DESC, chunk_id) AS rank FROM {source} WHERE {where} QUALIFY rank <= {k})"


def fused_sql(k: int) -> str:
    return f"""(SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (
  SELECT query_id, chunk_id, rank FROM {top_sql('cos', k, 'score >= 0.35')} UNION ALL SELECT query_id, chunk_id, rank FROM {top_sql('lex', k)}) GROUP BY ALL)"""


def search(spark, sf, profile, k=5):
    base = in_memory_base(X.corpus(spark, sf), MODEL, indexed=profile != "SIMPLE")
    queries = X.passages(spark, sf)
    return R.retrieve(queries, base, MODEL, profile, SCORER, k)


def hit_rows(df):
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "document_id", "source_id", "external_document_id", F.round("score", 5).alias("score"))


@query("retrieve_simple", f"""
WITH RECURSIVE {_SEARCH.lstrip()}
SELECT query_id, rank, chunk_id, document_id, source_id, ext AS external_document_id, round(score, 5) AS score
FROM {top_sql('cos', 5, 'score >= 0.35')} JOIN c1 USING (chunk_id)""")
def retrieve_simple(spark, sf):
    return hit_rows(search(spark, sf, "SIMPLE"))


@query("retrieve_hybrid", f"""
WITH RECURSIVE {_SEARCH.lstrip()}
SELECT query_id, rank, chunk_id, document_id, source_id, ext AS external_document_id, round(score, 5) AS score
FROM {top_sql(fused_sql(5), 5)} JOIN c1 USING (chunk_id)""")
def retrieve_hybrid(spark, sf):
    return hit_rows(search(spark, sf, "HYBRID"))


@query("retrieve_advanced", f"""
WITH RECURSIVE {_SEARCH.lstrip()},
cand AS (SELECT f.query_id, f.chunk_id, len(list_intersect(list_distinct({Q.tokens('b.text')}), list_distinct({Q.tokens('c1.content')})))::DOUBLE / len(list_distinct({Q.tokens('b.text')})) AS score
  FROM {top_sql(fused_sql(20), 20)} f JOIN c1 USING (chunk_id) JOIN benchmark b ON b.item_id::VARCHAR = f.query_id)
SELECT query_id, rank, chunk_id, document_id, source_id, ext AS external_document_id, round(score, 5) AS score FROM {top_sql('cand', 5)} JOIN c1 USING (chunk_id)""")
def retrieve_advanced(spark, sf):
    return hit_rows(search(spark, sf, "ADVANCED"))


@query("hybrid_context", f"""
WITH RECURSIVE {_SEARCH.lstrip()},
h AS (SELECT t.query_id, t.rank, t.chunk_id, t.score, section_id, idx, source_id, ext FROM {top_sql(fused_sql(5), 5)} t JOIN c1 USING (chunk_id))
SELECT h.query_id, h.rank, h.chunk_id AS origin_chunk_id, 'WINDOW' AS scope, h.source_id, h.ext AS external_document_id,
  string_agg(n.content, chr(10) || chr(10) ORDER BY n.idx) AS content, string_agg(n.chunk_id, ' ' ORDER BY n.idx) AS included
FROM h JOIN c1 n ON n.section_id = h.section_id AND n.idx BETWEEN h.idx - 1 AND h.idx + 1 GROUP BY ALL""")
def hybrid_context(spark, sf):
    base = in_memory_base(X.corpus(spark, sf), MODEL)
    found = R.retrieve_context(X.passages(spark, sf), base, MODEL, "HYBRID", "NEIGHBOR_CHUNKS")
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "origin_chunk_id", "scope", "source_id", "external_document_id",
                        "content", F.array_join("included_chunk_ids", " ").alias("included"))


@query("answer_integrity", f"""
WITH RECURSIVE {_SEARCH.lstrip()},
h AS (SELECT t.query_id, t.rank, t.chunk_id, c1.source_id, ext, CASE WHEN lang = 'fr' THEN 'chunk missing' WHEN c1.idx % 3 = 1 THEN 'section missing' END AS violation
  FROM {top_sql(fused_sql(5), 5)} t JOIN c1 USING (chunk_id) JOIN v1 USING (ext))
SELECT query_id, rank, chunk_id AS origin_chunk_id, NULL::VARCHAR AS violation FROM h WHERE query_id NOT IN (SELECT query_id FROM h WHERE violation IS NOT NULL)
UNION ALL SELECT DISTINCT query_id, NULL::BIGINT, NULL::VARCHAR, violation FROM h WHERE violation IS NOT NULL""")
def answer_integrity(spark, sf):
    # An index that still finds chunks of French documents, which are gone, and second chunks whose section id leads nowhere.
    base = in_memory_base(X.corpus(spark, sf), MODEL)
    french = X.table(spark, sf, "documents").where("lang = 'fr'").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("external_document_id"))
    lost = F.when(F.col("chunk_index") % 3 == 1, F.concat(F.lit("no-"), F.col("section_id"))).otherwise(F.col("section_id"))
    broken = replace(base, chunks=base.chunks.join(french, "external_document_id", "left_anti").withColumn("section_id", lost))
    contexts, violations = R.answer(X.passages(spark, sf), X.sources(spark, sf, everywhere=True), broken, MODEL, "HYBRID", routing=False)
    nothing = {"rank": F.lit(None).cast("long"), "origin_chunk_id": F.lit(None).cast("string")}
    return union_all(
        contexts.select("query_id", F.col("rank").cast("long").alias("rank"), "origin_chunk_id", F.lit(None).cast("string").alias("violation")),
        violations.withColumns(nothing))


# Contexts: every 200-character chunk of a conversation is a hit of the conversation's query.
_TALK_HITS = f"""{Q.V3_SECTIONS},
ut AS (SELECT section_id AS uid, content FROM sec WHERE content <> ''),{Q.chunks('ut', 200)},
tc AS (SELECT s.*, c.idx, c.content AS part, {Q.uuid("'chunk'", 'uid', 'idx::VARCHAR')} AS chunk_id FROM chunk c JOIN sec s ON s.section_id = c.uid),
hits AS (SELECT *, conv_id::VARCHAR AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY chunk_id) AS rank FROM tc)"""


def talk_hits(spark, sf):
    """(hits, sections, chunks) of the conversations at 200 characters; a conversation is bounded by the size limit."""
    sections = C.section_rows(parse_documents(X.first_versions(X.conversations(spark, sf)), n=200))
    chunks = D.chunk_rows(sections)
    conv = F.regexp_extract("external_document_id", r"(\d+)", 1)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))
    hits = chunks.withColumn("query_id", conv).withColumn("rank", rank).withColumn("score", 1.0 / F.col("rank"))
    return hits.select("query_id", "rank", "chunk_id", *R.HIT_COLUMNS, "score"), sections, chunks


@query("context_chunks", f"""
WITH RECURSIVE {_TALK_HITS.lstrip()} SELECT query_id, rank, chunk_id AS origin_chunk_id, 'CHUNK' AS scope, chunk_id AS included, part AS content FROM hits""")
def context_chunks(spark, sf):
    return J.expand_chunk(talk_hits(spark, sf)[0]).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "origin_chunk_id", "scope", F.array_join("included_chunk_ids", " ").alias("included"), "content")


@query("context_sections", f"""
WITH RECURSIVE {_TALK_HITS.lstrip()},
x AS (SELECT query_id, rank, section_id, chunk_id, len(content) <= 600 AS small, content, part FROM hits)
SELECT query_id, min(rank) AS rank, arg_min(chunk_id, rank) AS origin_chunk_id, CASE WHEN small THEN 'SECTION' ELSE 'CHUNK' END AS scope,
  CASE WHEN small THEN '' ELSE arg_min(chunk_id, rank) END AS included, any_value(CASE WHEN small THEN content ELSE part END) AS content
FROM x GROUP BY query_id, small, CASE WHEN small THEN section_id ELSE chunk_id END""")
def context_sections(spark, sf):
    hits, sections, _ = talk_hits(spark, sf)
    return J.dedupe_contexts(J.expand_section(hits, sections, 600)).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "origin_chunk_id", "scope", F.array_join("included_chunk_ids", " ").alias("included"), "content")


@query("context_neighbours", f"""
WITH RECURSIVE {_TALK_HITS.lstrip()}
SELECT h.query_id, h.rank, h.chunk_id AS origin_chunk_id, 'WINDOW' AS scope, string_agg(n.chunk_id, ' ' ORDER BY n.idx) AS included,
  string_agg(n.part, chr(10) || chr(10) ORDER BY n.idx) AS content
FROM hits h JOIN tc n ON n.section_id = h.section_id AND n.idx BETWEEN h.idx - 2 AND h.idx + 2 GROUP BY h.query_id, h.rank, h.chunk_id""")
def context_neighbours(spark, sf):
    hits, _, chunks = talk_hits(spark, sf)
    return J.expand_neighbours(hits, chunks, 2).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "origin_chunk_id", "scope", F.array_join("included_chunk_ids", " ").alias("included"), "content")


@query("context_integrity", f"""
WITH RECURSIVE {_TALK_HITS.lstrip()}
SELECT query_id, chunk_id, CASE WHEN title = 'system' THEN 'section missing' WHEN title = 'user' THEN 'section in another version' ELSE 'chunk missing' END AS violation
FROM hits WHERE title IN ('system', 'user') OR idx = 1""")
def context_integrity(spark, sf):
    hits, sections, chunks = talk_hits(spark, sf)
    moved = sections.where(~F.col("title").eqNullSafe(F.lit("system"))).withColumn("document_version_id", F.when(
        F.col("title") == "user", "elsewhere").otherwise(F.col("document_version_id")))
    return J.context_violations(hits, moved, chunks.where("chunk_index <> 1"))


_CASES = f"""{_DOCS},{Q.lexical('docs')},{_PHRASE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lex QUALIFY rank <= 5),
cases AS (SELECT query_id || '/' || doc_id AS case_id, query_id, doc_id FROM phrase UNION ALL SELECT item_id || '/none', item_id::VARCHAR, -1 FROM benchmark),
ranks AS (SELECT c.case_id, min(r.rank) AS rank FROM cases c LEFT JOIN ranked r ON r.query_id = c.query_id AND r.chunk_id = c.doc_id::VARCHAR GROUP BY c.case_id)"""


def evaluated(spark, sf):
    """Ranks of the expected documents: the documents with a passage, and one case per passage that expects nothing stored."""
    postings = X.whole_document_postings(spark, sf)
    expected = lexical.lexical_matches(X.passages(spark, sf, phrase=True), postings).select(
        F.concat_ws("/", "query_id", "chunk_id").alias("case_id"), "query_id", F.col("chunk_id").alias("expected_document_id"))
    nothing = X.passages(spark, sf).select(
        F.concat_ws("/", "query_id", F.lit("none")).alias("case_id"), "query_id", F.lit("-1").alias("expected_document_id"))
    cases = union_all(expected, nothing).withColumns({"expected_source_id": F.lit("documents"), "query": F.lit("passage")})
    good = cases.join(K.check_cases(cases), "case_id", "left_anti")
    hits = lexical.lexical_search(X.passages(spark, sf), postings, 5)
    by_case = hits.join(good.select("case_id", F.col("query_id")), "query_id").select(
        F.col("case_id").alias("query_id"), "rank", F.lit("documents").alias("source_id"), F.col("chunk_id").alias("external_document_id"))
    return K.expected_rank(good, by_case)


@query("expected_rank", f"WITH {_CASES.lstrip()} SELECT case_id, rank FROM ranks")
def expected_rank(spark, sf):
    return evaluated(spark, sf).withColumn("rank", F.col("rank").cast("long"))


@query("recall_mrr", f"""
WITH {_CASES.lstrip()}
SELECT count(*) AS cases, count(rank) AS matched, round(avg((rank IS NOT NULL)::INT), 6) AS recall_at_k, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr_at_k FROM ranks""")
def recall_mrr(spark, sf):
    return K.recall_mrr(evaluated(spark, sf), 5).select(
        "cases", "matched", F.round("recall_at_k", 6).alias("recall_at_k"), F.round("mrr_at_k", 6).alias("mrr_at_k"))


@query("invalid_cases", r"""
SELECT conv_id || '-' || turn AS case_id, 'blank field' AS violation FROM conversations
WHERE text IS NULL OR regexp_full_match(text, '\s*') OR turn % 4 = 1 OR turn % 4 = 2""")
def invalid_cases(spark, sf):
    # Turns as cases: some expect no source, some a document without a name.
    turn = F.col("turn") % 4
    return K.check_cases(X.table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"), F.col("text").alias("query"),
        F.when(turn != 1, F.col("role")).alias("expected_source_id"),
        F.when(turn == 2, "  ").otherwise(F.col("conv_id").cast("string")).alias("expected_document_id")))
