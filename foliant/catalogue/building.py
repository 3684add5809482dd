"""Queries on embeddings, the index, reuse, previews and ingestion (E, F, G10-G13, H)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliant.catalogue import fixtures as X, query
from foliant.catalogue import sql as Q
from foliant.catalogue.documents import _SOURCES
from foliant.catalogue.history import _CHANGES, _DECISION, NOW, changes, now
from foliant.functions import ids
from foliant.functions.rows import unnest
from foliant.functions.text import words
from foliant.operators import chunks as D, embeddings as E, postings as P, preview as H, sections as C, versions as V
from foliant.params import CHUNKER_VERSION, COMPOSER_VERSION, PARSER_VERSION
from foliant.plans.ingest import in_memory_base, ingest_batch, knowledge_base, parse_documents
from foliant.plans.store import Store
from foliant.session import checkpoint_folder, cut_lineage, union_all

MODEL = E.HashEmbedder(64)
_IDENTITY = (f"'composer={COMPOSER_VERSION}' || chr(10) || 'provider=test' || chr(10) || 'model=token-hash' || chr(10) || 'revision=v1'"
             " || chr(10) || 'dimensions=64' || chr(10) || 'text='")


def talk_chunks(spark, sf):
    """Chunks of the conversations with embedding text and fingerprint."""
    sections = C.section_rows(parse_documents(X.first_versions(X.conversations(spark, sf))))
    return E.input_fingerprint(E.embedding_text(D.chunk_rows(sections)), MODEL)


def text_chunks(docs, number=1):
    """Chunks of text documents with embedding text and fingerprint, as version ``number``."""
    sections = C.section_rows(parse_documents(X.first_versions(docs, number)))
    return E.input_fingerprint(E.embedding_text(D.chunk_rows(sections)), MODEL)


# Conversation turns chunked at 2400 characters, with the outline path.
_TALK = f"""{Q.V3_SECTIONS},
ut AS (SELECT section_id AS uid, content FROM sec WHERE content <> ''),{Q.chunks('ut', 2400)},
tc AS (SELECT s.*, c.idx, c.content AS part, {Q.uuid("'chunk'", 'uid', 'idx::VARCHAR')} AS chunk_id,
  s.path || chr(10) || chr(10) || c.content AS embedding_text FROM chunk c JOIN sec s ON s.section_id = c.uid),
tf AS (SELECT *, sha256({_IDENTITY} || embedding_text) AS fp FROM tc)"""


@query("embedding_text", f"""
WITH RECURSIVE {_TALK.lstrip()}
SELECT chunk_id, section_id, version_id AS document_version_id, embedding_text, fp AS input_fingerprint FROM tf""")
def embedding_text(spark, sf):
    return talk_chunks(spark, sf).select("chunk_id", "section_id", "document_version_id", "embedding_text", "input_fingerprint")


@query("ancestor_titles", f"""
WITH RECURSIVE {Q.V3_SECTIONS.lstrip()},
kept AS (SELECT * FROM sec WHERE level <> 2),
up AS (
  SELECT version_id, section_id, parent_id AS above, NULL::VARCHAR AS path, NULL::VARCHAR AS violation FROM kept
  UNION ALL
  SELECT u.version_id, u.section_id, k.parent_id, CASE WHEN k.title IS NULL THEN u.path ELSE concat_ws(' > ', k.title, u.path) END,
    CASE WHEN k.section_id IS NULL THEN 'parent missing' END
  FROM up u LEFT JOIN kept k ON k.section_id = u.above AND k.version_id = u.version_id WHERE u.above IS NOT NULL AND u.violation IS NULL)
SELECT version_id AS document_version_id, section_id, CASE WHEN violation IS NULL THEN coalesce(path, '') END AS ancestors, violation
FROM up WHERE above IS NULL OR violation IS NOT NULL""")
def ancestor_titles(spark, sf):
    # Sections of level 2 are left out, so sections below them miss their parent.
    rows = C.section_rows(parse_documents(X.first_versions(X.conversations(spark, sf)))).where(F.col("level") != 2)
    good, bad = E.ancestor_titles(rows)
    return union_all(
        good.select("document_version_id", "section_id", F.array_join("ancestors", " > ").alias("ancestors"), F.lit(None).cast("string").alias("violation")),
        bad.select("document_version_id", "section_id", F.lit(None).cast("string").alias("ancestors"), "violation"))


@query("stage_fingerprints", f"""
WITH RECURSIVE {_TALK.lstrip()},
parse AS (SELECT version_id, sha256('{PARSER_VERSION}' || chr(10) || 'format=MARKDOWN' || chr(10) || 'contentHash=' || sha256(text)) AS p FROM w3),
cf AS (SELECT version_id, sha256('{CHUNKER_VERSION}' || chr(10) || 'maxCharacters=2400' ||
  string_agg(chr(10) || 'section=' || stable_key || ':' || content_hash, '' ORDER BY ord)) AS c FROM sec GROUP BY version_id),
ef AS (SELECT version_id, sha256(string_agg('section=' || stable_key || chr(10) || 'chunkIndex=' || idx || chr(10) || 'fingerprint=' || fp || chr(10), ''
  ORDER BY ord, idx)) AS e FROM tf GROUP BY version_id)
SELECT version_id AS document_version_id, p AS parse_fingerprint, c AS chunk_fingerprint, e AS embed_fingerprint
FROM parse JOIN cf USING (version_id) JOIN ef USING (version_id)""")
def stage_fingerprints(spark, sf):
    docs = X.first_versions(X.conversations(spark, sf))
    sections = C.section_rows(parse_documents(docs))
    return C.parse_fingerprint(docs).select("document_version_id", "parse_fingerprint").join(
        D.chunk_fingerprint(sections), "document_version_id").join(E.embed_fingerprint(talk_chunks(spark, sf)), "document_version_id")


# Paragraph chunks of V1 (version 1) and V2 (version 2) with fingerprints.
_TWO = f"""{Q.V1},
two AS (SELECT *, replace(text, chr(10), chr(10) || chr(10)) AS t1, replace({Q.EDITED}, chr(10), chr(10) || chr(10)) AS t2 FROM s1),
v2 AS (SELECT *, {Q.version_uuid('document_id', '2')} AS version2 FROM two),
s2 AS (SELECT *, {Q.uuid("'section'", 'version2', "'root'")} AS section2 FROM v2),
ua AS (SELECT section_id AS uid, t1 AS content FROM s2), ub AS (SELECT section2 AS uid, t2 AS content FROM s2),{Q.chunks('ua', 2400, 'a_')},{Q.chunks('ub', 2400, 'b_')},
ca AS (SELECT s.document_id, s.version_id, s.section_id, s.lang, c.content, c.idx, {Q.uuid("'chunk'", 'uid', 'idx::VARCHAR')} AS chunk_id,
  sha256({_IDENTITY} || c.content) AS fp FROM a_chunk c JOIN s2 s ON s.section_id = c.uid),
cb AS (SELECT s.document_id, s.version2 AS version_id, s.section2 AS section_id, s.lang, c.content, c.idx, {Q.uuid("'chunk'", 'uid', 'idx::VARCHAR')} AS chunk_id,
  sha256({_IDENTITY} || c.content) AS fp FROM b_chunk c JOIN s2 s ON s.section2 = c.uid)"""


def two_versions(spark, sf):
    """Chunk tables of V1 and of V2's text documents."""
    first = cut_lineage(text_chunks(X.corpus(spark, sf, paragraphs=True)).drop("title_path"))
    second = cut_lineage(text_chunks(X.revised(spark, sf, paragraphs=True).where(F.col("format") == "TEXT"), 2).drop("title_path"))
    return first, second


@query("embedding_plan", f"""
WITH RECURSIVE {_TWO.lstrip()},
donor AS (SELECT document_id, fp, min(chunk_id) AS reused_from FROM ca GROUP BY document_id, fp)
SELECT b.chunk_id, CASE WHEN b.lang = 'de' AND b.idx = 0 THEN 'KEPT' WHEN d.reused_from IS NOT NULL THEN 'REUSED' ELSE 'COMPUTE' END AS action,
  CASE WHEN NOT (b.lang = 'de' AND b.idx = 0) THEN d.reused_from END AS reused_from
FROM cb b LEFT JOIN donor d USING (document_id, fp)""")
def embedding_plan(spark, sf):
    first, second = two_versions(spark, sf)
    active = first.withColumnRenamed("input_fingerprint", "processing_fingerprint")
    german = X.table(spark, sf, "documents").where(F.col("lang") == "de").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("external_document_id"))
    existing = second.where("chunk_index = 0").join(german, "external_document_id", "left_semi").select(
        "chunk_id", F.col("input_fingerprint").alias("processing_fingerprint"))
    return E.embedding_plan(second, existing, active).select("chunk_id", "action", "reused_from")


@query("stage_reuse", f"""
WITH RECURSIVE {_TWO.lstrip()},
stored AS (SELECT version_id, CASE WHEN idx = 1 AND lang = 'es' THEN 'old' ELSE sha256(lang) END AS f FROM ca WHERE lang <> 'fr')
SELECT e.version_id AS document_version_id, e.f AS fingerprint, count(s.f) AS row_count, coalesce(bool_and(s.f = e.f), false) AS reusable
FROM (SELECT version_id, sha256(lang) AS f FROM s1) e LEFT JOIN stored s ON s.version_id = e.version_id GROUP BY e.version_id, e.f""")
def stage_reuse(spark, sf):
    langs = X.table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("external_document_id"), "lang")
    docs = X.first_versions(X.corpus(spark, sf)).join(langs, "external_document_id")
    first = text_chunks(X.corpus(spark, sf, paragraphs=True)).join(langs, "external_document_id").where("lang <> 'fr'")
    table = first.select("document_version_id", F.when((F.col("chunk_index") == 1) & (F.col("lang") == "es"), "old").otherwise(
        F.sha2("lang", 256)).alias("processing_fingerprint"))
    return V.stage_reuse(table, docs.select("document_version_id", F.sha2("lang", 256).alias("fingerprint")))


@query("embedding_reuse", f"""
WITH RECURSIVE {_TWO.lstrip()}
SELECT version_id AS document_version_id, count(*) AS row_count, bool_and(lang = 'en' OR (lang = 'fr' AND idx > 0)) AS reusable FROM cb GROUP BY version_id""")
def embedding_reuse(spark, sf):
    second = text_chunks(X.revised(spark, sf, paragraphs=True).where(F.col("format") == "TEXT"), 2)
    langs = X.table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("external_document_id"), "lang")
    stored = second.join(langs, "external_document_id").where("lang = 'en' OR (lang = 'fr' AND chunk_index > 0) OR lang = 'de'").select(
        "chunk_id", F.when(F.col("lang") == "de", "old").otherwise(F.col("input_fingerprint")).alias("processing_fingerprint"))
    return V.embedding_reuse(second, stored)


@query("stale_rows", f"""
WITH RECURSIVE {_TWO.lstrip()},
gone AS (SELECT version_id, chunk_id FROM ca WHERE lang <> 'en' AND (section_id, content) NOT IN (SELECT s2.section_id, cb.content FROM cb JOIN s2 ON s2.section2 = cb.section_id))
SELECT version_id AS document_version_id, chunk_id, 'chunk' AS kind FROM gone
UNION ALL SELECT version_id, chunk_id, 'embedding' FROM gone""")
def stale_rows(spark, sf):
    # Chunks are named by their text here: the new set of a version is the second revision's texts.
    first, second = two_versions(spark, sf)
    first_version = ids.version_id(F.col("document_id"), F.lit(1))
    stored = first.select("document_version_id", "chunk_id", "content")
    foreign = X.table(spark, sf, "documents").where("lang <> 'en'").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("external_document_id"))
    replaced = first.join(foreign, "external_document_id", "left_semi").select("document_version_id")
    target = second.join(foreign, "external_document_id", "left_semi").select(first_version.alias("document_version_id"), "content")
    stale = cut_lineage(V.stale_rows(stored, target, "content", replaced).select("document_version_id", "chunk_id"))
    children = V.dependents(stale, stored.select("document_version_id", "chunk_id"), "chunk_id")
    return union_all(stale.withColumn("kind", F.lit("chunk")), children.withColumn("kind", F.lit("embedding")))


_VECTORS = """
vec AS (SELECT vec_id::VARCHAR AS chunk_id, label, CASE WHEN label = 3 THEN 1024 ELSE 64 END AS dimensions,
  CASE WHEN label = 2 THEN ' ' ELSE 'm' END AS model, embedding FROM embeddings)"""


def vectors(spark, sf):
    """V5 as an embedding table; labels 3 and 2 carry wrong dimensions and a blank model."""
    return X.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"), "label", F.lit("p").alias("provider"),
        F.when(F.col("label") == 2, " ").otherwise("m").alias("model"), F.lit("r").alias("model_revision"),
        F.when(F.col("label") == 3, 1024).otherwise(64).alias("dimensions"), F.lit("f").alias("processing_fingerprint"),
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("document_version_id"), "embedding")


@query("check_vectors", f"""
WITH {_VECTORS.lstrip()}
SELECT chunk_id, CASE WHEN len(embedding) <> dimensions THEN 'dimension mismatch' ELSE 'blank identity' END AS violation
FROM vec WHERE len(embedding) <> dimensions OR trim(model) = ''""")
def check_vectors(spark, sf):
    return E.check_vectors(vectors(spark, sf))


@query("upsert_embeddings", f"""
WITH {_VECTORS.lstrip()}
SELECT chunk_id, label, CASE WHEN label = 1 THEN 'new' ELSE model END AS model, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM vec""")
def upsert_embeddings(spark, sf):
    old = vectors(spark, sf)
    new = old.where("label = 1").withColumn("model", F.lit("new"))
    merged = E.upsert_embeddings(old, new)
    total = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, v: a + v.cast("double"))
    return merged.select("chunk_id", "label", "model", F.round(total, 6).alias("total"))


@query("embedding_coverage", """
SELECT 'label-' || label AS document_version_id, vec_id::VARCHAR AS chunk_id, 'f' AS processing_fingerprint FROM embeddings WHERE embedding[1] > 0""")
def embedding_coverage(spark, sf):
    rows = vectors(spark, sf)
    return E.embedding_coverage(rows, rows.where(F.get("embedding", F.lit(0)) > 0))


@query("index_completeness", """
SELECT 'label-' || label AS document_version_id, count(*) AS chunk_count, count(*) FILTER (label <> 1 OR embedding[1] > 0) AS embedding_count,
  count(*) = count(*) FILTER (label <> 1 OR embedding[1] > 0) AS complete FROM embeddings GROUP BY label""")
def index_completeness(spark, sf):
    rows = vectors(spark, sf)
    return P.index_completeness(rows, rows.where((F.col("label") != 1) | (F.get("embedding", F.lit(0)) > 0)))


@query("embed_texts", f"""
WITH RECURSIVE {_TALK.lstrip()},
texts AS (SELECT fp, any_value(embedding_text) AS t, count(*) AS n FROM tf GROUP BY fp),
tok AS (SELECT fp, n, unnest({Q.tokens('t')}) AS term FROM texts),
dim AS (SELECT fp, n, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS d, count(*) AS c FROM tok GROUP BY ALL)
SELECT fp AS input_fingerprint, n, d AS dim, round(c / sqrt(sum(c * c) OVER (PARTITION BY fp)), 5) AS value FROM dim""")
def embed_texts(spark, sf):
    vectors_of = E.embed_batch(talk_chunks(spark, sf), MODEL)
    values = unnest(vectors_of, ["input_fingerprint", "n"], F.col("embedding"), "value", "dim").where(F.col("value") > 0)
    return values.select("input_fingerprint", "n", F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double"), 5).alias("value"))


_POSTINGS = f"""{_TALK},
tt AS (SELECT chunk_id, list_concat({Q.tokens("coalesce(title, '')")}, {Q.tokens('part')}) AS ts, len({Q.tokens("coalesce(title, '')")}) AS nt FROM tc),
occ AS (SELECT chunk_id, nt, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM tt)"""


@query("postings", f"""
WITH RECURSIVE {_POSTINGS.lstrip()}
SELECT term, chunk_id, string_agg(pos || CASE WHEN pos <= nt THEN 'A' ELSE 'B' END, ' ' ORDER BY pos) AS positions FROM occ GROUP BY term, chunk_id""")
def postings(spark, sf):
    rows = P.build_postings(talk_chunks(spark, sf))
    return rows.select("term", "chunk_id", F.array_join(F.transform(
        "positions", lambda p: F.concat(p["pos"].cast("string"), p["w"])), " ").alias("positions"))


@query("document_postings", f"""
WITH occ AS (SELECT doc_id::VARCHAR AS chunk_id, unnest({Q.tokens('text')}) AS term, generate_subscripts({Q.tokens('text')}, 1) AS pos FROM documents)
SELECT term, chunk_id, count(*) AS n, min(pos)::BIGINT AS first_pos, max(pos)::BIGINT AS last_pos FROM occ GROUP BY term, chunk_id""")
def document_postings(spark, sf):
    rows = X.whole_document_postings(spark, sf)
    return rows.select("term", "chunk_id", F.size("positions").cast("long").alias("n"), F.get("positions.pos", F.lit(0)).cast("long").alias("first_pos"),
                       F.element_at("positions.pos", -1).cast("long").alias("last_pos"))


@query("backfill_postings", f"""
WITH RECURSIVE {_POSTINGS.lstrip()}
SELECT chunk_id, count(DISTINCT term) AS terms FROM occ WHERE chunk_id NOT IN (SELECT chunk_id FROM tc WHERE title = 'user') GROUP BY chunk_id""")
def backfill_postings(spark, sf):
    rows = talk_chunks(spark, sf)
    done = P.build_postings(rows.where("section_title = 'user'"))
    return P.backfill_postings(rows, done).groupBy("chunk_id").agg(F.count("*").alias("terms"))


@query("term_stats", f"""
WITH occ AS (SELECT DISTINCT doc_id, unnest({Q.tokens('text')}) AS term FROM documents) SELECT term, count(*) AS n FROM occ GROUP BY term""")
def term_stats(spark, sf):
    return P.term_stats(X.whole_document_postings(spark, sf))


@query("change_summary", f"""
WITH RECURSIVE {_TWO.lstrip()},
a AS (SELECT document_id, content, count(*) AS n FROM ca GROUP BY ALL), b AS (SELECT document_id, content, count(*) AS n FROM cb GROUP BY ALL),
j AS (SELECT coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.n, 0) AS p, coalesce(b.n, 0) AS i
  FROM a FULL JOIN b ON a.document_id = b.document_id AND a.content = b.content)
SELECT document_id, sum(p)::BIGINT AS previous, sum(i)::BIGINT AS incoming, sum(least(p, i))::BIGINT AS unchanged,
  sum(i - least(p, i))::BIGINT AS added, sum(p - least(p, i))::BIGINT AS removed FROM j GROUP BY document_id""")
def change_summary(spark, sf):
    first, second = two_versions(spark, sf)
    return H.change_summary(second, first)


@query("sample_parts", f"""
WITH RECURSIVE {_TWO.lstrip()},
n AS (SELECT document_id, count(*) AS n, least(count(*), 3) AS m FROM cb GROUP BY document_id),
i AS (SELECT document_id, unnest(range(m)) AS i, n, m FROM n),
p AS (SELECT document_id, i, CASE WHEN m = 1 THEN 0 ELSE i * (n - 1) // (m - 1) END AS pos FROM i)
SELECT p.document_id, i AS sample_index, pos AS position, substr(content, 1, 1000) AS sample FROM p JOIN cb ON cb.document_id = p.document_id AND cb.idx = p.pos""")
def sample_parts(spark, sf):
    parsed = parse_documents(X.first_versions(X.revised(spark, sf, paragraphs=True).where(F.col("format") == "TEXT"), 2))
    return H.sample_parts(parsed).select(
        "document_id", F.col("sample_index").cast("long").alias("sample_index"), F.col("position").cast("long").alias("position"), "sample")


_STATUS = """CASE WHEN change_status = 'UNCHANGED' THEN 'UNCHANGED'
  WHEN change_status = 'CHANGED' AND update_policy = 'REQUIRE_VERSION_RESOLUTION' THEN 'REQUIRES_VERSION_RESOLUTION' ELSE 'READY' END"""


@query("preview_status", f"""
WITH {_CHANGES.lstrip()}
SELECT document_id, {_STATUS} AS status, {_STATUS} = 'READY' AS can_confirm FROM changes""")
def preview_status(spark, sf):
    return H.preview_status(changes(spark, sf)).select("document_id", "status", "can_confirm")


# A preview per event and document of the same user: expiry by event time, some confirmed, some baselines moved on.
_PREVIEWS = f"""
pv AS (SELECT event_id, {Q.document_uuid("'events'", "'user-' || user_id")} AS document_id, ts + INTERVAL 24 HOUR AS expires_at, event_type, value,
  CASE event_type WHEN 'view' THEN 'READY' WHEN 'click' THEN 'UNCHANGED' ELSE 'REQUIRES_VERSION_RESOLUTION' END AS status FROM events),
pb AS (SELECT *, CASE WHEN value < 10 THEN {Q.version_uuid('document_id', '1')} WHEN value < 30 THEN {Q.version_uuid('document_id', '2')} END AS baseline,
  {Q.version_uuid('document_id', '1')} AS active FROM pv)"""
MOMENT = "2024-01-20 00:00:00"


def previews(spark, sf):
    kind, value = F.col("event_type"), F.col("value")
    rows = H.with_expiry(X.table(spark, sf, "events").withColumn(
        "document_id", ids.document_id(F.lit("events"), F.concat(F.lit("user-"), F.col("user_id").cast("string")))), F.col("ts"))
    return rows.select(
        "event_id", "document_id", "expires_at",
        F.when(kind == "view", "READY").when(kind == "click", "UNCHANGED").otherwise("REQUIRES_VERSION_RESOLUTION").alias("status"),
        (value > 90).alias("confirmed"),
        F.when(value < 10, ids.version_id(F.col("document_id"), F.lit(1))).when(
            value < 30, ids.version_id(F.col("document_id"), F.lit(2))).alias("baseline_version_id"))


@query("preview_freshness", f"""
WITH {_PREVIEWS.lstrip()}
SELECT event_id, CASE WHEN value > 90 THEN 'CONFIRMED' WHEN expires_at <= TIMESTAMP '{MOMENT}' THEN 'EXPIRED'
  WHEN active IS DISTINCT FROM baseline THEN 'STALE' WHEN status = 'UNCHANGED' THEN 'UNCHANGED' WHEN status <> 'READY' THEN 'BLOCKED' ELSE 'READY' END AS state FROM pb""")
def preview_freshness(spark, sf):
    active = X.table(spark, sf, "events").select(
        ids.document_id(F.lit("events"), F.concat(F.lit("user-"), F.col("user_id").cast("string"))).alias("document_id")).distinct().withColumn(
        "document_version_id", ids.version_id(F.col("document_id"), F.lit(1)))
    return H.preview_freshness(previews(spark, sf), active, F.lit(MOMENT).cast("timestamp")).select("event_id", "state")


@query("purge_previews", f"""
WITH {_PREVIEWS.lstrip()} SELECT event_id, expires_at FROM pb WHERE expires_at >= TIMESTAMP '{MOMENT}' - INTERVAL 1 DAY""")
def purge_previews(spark, sf):
    return H.purge_previews(previews(spark, sf), F.lit(MOMENT).cast("timestamp")).select("event_id", "expires_at")


@query("similarity_status", """
SELECT event_id, CASE WHEN event_type = 'click' THEN 'NOT_RUN_UNCHANGED' WHEN value < 10 THEN 'UNAVAILABLE' WHEN value < 20 THEN 'PARTIAL' ELSE 'COMPLETE' END AS similarity_status
FROM events""")
def similarity_status(spark, sf):
    value = F.col("value")
    failed = F.when(value < 10, F.array(F.lit("SEMANTIC"), F.lit("LEXICAL"))).when(value < 20, F.array(F.lit("LEXICAL"))).otherwise(
        F.array().cast("array<string>"))
    rows = X.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "click", "UNCHANGED").otherwise("READY").alias("status"), failed.alias("failed_methods"))
    return H.similarity_status(rows).select("event_id", "similarity_status")


# Samples of V1 (query_id, for_document, sample_index, ts) and their hits among its chunks by both methods.
def _similar(samples: str) -> str:
    # Components are floats, as in stored vectors: distinct texts of equal cosine then come in the same order.
    dense = """SELECT k, list((coalesce(c, 0) / norm)::FLOAT::DOUBLE ORDER BY i) AS v FROM (SELECT k, i, c, sqrt(sum(c * c) OVER (PARTITION BY k)) AS norm FROM (SELECT DISTINCT k FROM {0}_d) CROSS JOIN
  (SELECT unnest(range(64)) AS i) LEFT JOIN {0}_d USING (k, i)) GROUP BY k"""
    counts = """{0}_d AS (SELECT k, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS i, count(*) AS c FROM {0}_t GROUP BY ALL)"""
    return f"""
spread AS (SELECT document_id, sample_index, sample_index * (n - 1) // greatest(least(n, {samples}) - 1, 1) AS idx
  FROM (SELECT document_id, n, unnest(range(least(n, {samples}))) AS sample_index FROM (SELECT document_id, count(*) AS n FROM c1 GROUP BY ALL))),
samples AS (SELECT document_id || chr(10) || sample_index AS query_id, document_id AS for_document, sample_index,
  {Q.tokens('substr(content, 1, 1000)')} AS ts FROM spread JOIN c1 USING (document_id, idx)),
sample_t AS (SELECT query_id AS k, unnest(ts) AS term FROM samples), body_t AS (SELECT chunk_id AS k, unnest({Q.tokens('content')}) AS term FROM c1),
{counts.format('sample')}, {counts.format('body')}, sample_v AS ({dense.format('sample')}), body_v AS ({dense.format('body')}),
sem AS (SELECT q.k AS query_id, c.k AS chunk_id, list_cosine_similarity(q.v, c.v) AS score FROM sample_v q CROSS JOIN body_v c),
term_set AS (SELECT query_id, list_distinct(ts) AS terms FROM samples), chunk_set AS (SELECT k AS chunk_id, list(DISTINCT term) AS terms FROM body_t GROUP BY k),
df AS (SELECT term, count(DISTINCT k) AS n FROM body_t GROUP BY term),
rare AS (SELECT k AS query_id, arg_min(term, coalesce(n, 0)) AS term FROM sample_t LEFT JOIN df USING (term) GROUP BY k),
holds AS (SELECT r.query_id, c.chunk_id FROM rare r JOIN (SELECT DISTINCT k AS chunk_id, term FROM body_t) c USING (term)
  JOIN term_set t USING (query_id) JOIN chunk_set s USING (chunk_id) WHERE list_has_all(s.terms, t.terms)),
places AS (SELECT chunk_id, unnest({Q.tokens('content')}) AS term, generate_subscripts({Q.tokens('content')}, 1) AS pos FROM c1),
e AS (SELECT query_id, chunk_id, term, pos, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pos) AS nth,
  lead(pos) OVER (PARTITION BY query_id, chunk_id, term ORDER BY pos) AS again
  FROM holds JOIN (SELECT DISTINCT k AS query_id, term FROM sample_t) USING (query_id) JOIN places USING (chunk_id, term)),
whole AS (SELECT query_id, chunk_id, max(first) AS from_pos FROM (SELECT query_id, chunk_id, term, min(pos) AS first FROM e GROUP BY ALL) GROUP BY ALL),
-- The cover that ends at a position begins at the first place whose term does not come again by then.
swept AS (SELECT query_id, chunk_id, hi, min(p) OVER (PARTITION BY query_id, chunk_id ORDER BY leaves DESC ROWS UNBOUNDED PRECEDING) AS lo
  FROM (SELECT query_id, chunk_id, pos AS p, NULL AS hi, coalesce(again, 1000000000) - 0.5 AS leaves FROM e
    UNION ALL SELECT query_id, chunk_id, NULL, pos, pos FROM e)),
cover AS (SELECT s.query_id, s.chunk_id, lo, min(hi) AS hi FROM swept s JOIN whole w ON w.query_id = s.query_id AND w.chunk_id = s.chunk_id
  WHERE hi >= from_pos GROUP BY ALL),
density AS (SELECT c.query_id, c.chunk_id, sum(0.4::DOUBLE / (1 + (hi - lo) - (b.nth - a.nth))) AS d FROM cover c
  JOIN e a ON a.query_id = c.query_id AND a.chunk_id = c.chunk_id AND a.pos = lo
  JOIN e b ON b.query_id = c.query_id AND b.chunk_id = c.chunk_id AND b.pos = hi GROUP BY ALL),
ranked AS (SELECT query_id, chunk_id, 'SEMANTIC' AS method, score FROM sem WHERE score >= 0.35
  UNION ALL SELECT query_id, chunk_id, 'LEXICAL', d / (d + 1) FROM density),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY round(score, 13) DESC, chunk_id) AS rank FROM ranked QUALIFY rank <= 10),
other AS (SELECT b.method, b.rank, b.score, s.for_document, s.sample_index, c1.* FROM best b JOIN samples s USING (query_id) JOIN c1 USING (chunk_id)
  WHERE c1.document_id <> s.for_document
  QUALIFY row_number() OVER (PARTITION BY s.for_document, method, chunk_id ORDER BY s.sample_index, b.rank) = 1)"""


@query("similar_materials", f"""
WITH RECURSIVE {Q.V1_CHUNKS.lstrip()},{_similar('3')}
SELECT for_document AS for_document_id, method, row_number() OVER (PARTITION BY for_document, method ORDER BY sample_index, rank) AS match_rank,
  version_id AS document_version_id, source_id, ext AS external_document_id, NULL::VARCHAR AS section_title, chunk_id,
  substr(content, 1, 400) AS excerpt, round(score, 5) AS score FROM other QUALIFY match_rank <= 10""")
def similar_materials(spark, sf):
    # Every document, as its next version, against the first versions of all. The words of a sample are quoted, so that none is an operator.
    docs = X.corpus(spark, sf)
    base = in_memory_base(docs, MODEL)
    parsed = parse_documents(X.first_versions(docs, 2))
    samples = H.sample_parts(parsed).withColumn("sample", F.concat(F.lit('"'), F.array_join(words(F.col("sample")), '" "'), F.lit('"')))
    return H.similar_materials(samples, base, MODEL, docs.select("source_id").distinct()).withColumns(
        {"match_rank": F.col("match_rank").cast("long"), "score": F.round("score", 5)})


@query("ingest_two_batches", f"""
WITH {_SOURCES.lstrip()},
{Q.V1.lstrip()},
{Q.V3_TEXT.lstrip()},
b AS (SELECT source_id, ext, update_policy, lang, sha256(text) AS h1, sha256({Q.EDITED}) AS h2, strlen({Q.EDITED}) AS n FROM d1 LEFT JOIN src USING (source_id))
SELECT source_id, ext AS external_document_id, CASE WHEN update_policy IS NULL OR n = 0 THEN 'REJECTED' WHEN h1 = h2 THEN 'UNCHANGED'
  WHEN update_policy = 'AUTHORITATIVE_SNAPSHOT' THEN 'BUILT' ELSE 'REQUIRES_VERSION_RESOLUTION' END AS outcome,
  CASE WHEN update_policy IS NULL THEN 'unknown source' WHEN n = 0 THEN 'size limit' END AS violation FROM b
UNION ALL SELECT source_id, ext, 'BUILT', NULL FROM d3""")
def ingest_two_batches(spark, sf):
    store = Store(spark, f"{checkpoint_folder(spark)}/store-{uuid.uuid4().hex}")
    sources = cut_lineage(X.sources(spark, sf))
    ingest_batch(store, X.corpus(spark, sf), sources, MODEL)
    report = ingest_batch(store, X.revised(spark, sf), sources, MODEL)
    return report.drop("document_version_id")
