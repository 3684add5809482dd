"""Queries on sources, contract, sections and chunks (A-D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.catalogue import fixtures as X, query
from foliant.catalogue import sql as Q
from foliant.functions import ids, text as T
from foliant.functions.rows import unnest
from foliant.operators import chunks as D, contract as B, sections as C
from foliant.params import Limits
from foliant.plans.ingest import parse_documents
from foliant.session import union_all
from foliant.sources import registry as R
from foliant.sources.files import detect_format
from foliant.sources.tables import documents_from_table


@query("content_hash", """
SELECT source AS source_id, doc_id || '.txt' AS external_document_id, 'TEXT' AS format, sha256(text) AS content_hash FROM documents""")
def content_hash(spark, sf):
    return X.corpus(spark, sf).drop("content")


_PAGE_ID = "CASE WHEN url LIKE 'https://%' THEN replace(substr(url, 9), '\\', '/') || '.md' ELSE replace(url, '\\', '/') END"


@query("table_documents", f"""
WITH p AS (SELECT page_id, {_PAGE_ID} AS id FROM pages),
b AS (SELECT *, lower(list_last(string_split(id, '.'))) AS e,
  id LIKE '/%' OR contains(id, ':') OR len(list_filter(string_split(id, '/'), lambda x: trim(x) IN ('', '.', '..'))) > 0 AS bad FROM p)
SELECT page_id, id AS external_document_id,
  CASE WHEN bad THEN 'document id is not a canonical relative path'
    WHEN e NOT IN ('txt', 'md', 'markdown') THEN 'unsupported format' END AS violation FROM b""")
def table_documents(spark, sf):
    url = F.col("url")
    external = F.when(url.startswith("https://"), F.concat(F.substr(url, F.lit(9)), F.lit(".md"))).otherwise(url)
    rows = X.table(spark, sf, "pages").select("page_id", F.lit("pages").alias("source_id"), external.alias("external_document_id"),
                                               F.col("html").cast("binary").alias("content"))
    good, bad = documents_from_table(rows)
    keep = ["page_id", "external_document_id"]
    return union_all(good.select(*keep, F.lit(None).cast("string").alias("violation")), bad.select(*keep, "violation"))


@query("document_keys", """
SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 'blank source id' WHEN n_chars % 5 IN (0, 1) THEN 'blank document id' END AS violation FROM documents""")
def document_keys(spark, sf):
    # Documents by length: some without a source, some without an id of their own.
    part = F.col("n_chars") % 5
    rows = X.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("n_chars") % 7 == 0, " \t").otherwise(F.col("source")).alias("source_id"),
        F.when(part == 1, "").when(part > 1, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("external_document_id"),
        F.col("text").cast("binary").alias("content"))
    good, bad = documents_from_table(rows)
    return union_all(good.select("doc_id", F.lit(None).cast("string").alias("violation")), bad.select("doc_id", "violation"))


@query("detect_format", r"""
WITH p AS (SELECT page_id, url || CASE WHEN contains(url, '#') THEN '.PDF' WHEN contains(url, '?') THEN '/a.Markdown' WHEN url LIKE '%/' THEN '.x.py' ELSE '' END AS name FROM pages),
e AS (SELECT *, lower(regexp_extract(name, '\.([^./]*)$', 1)) AS ext FROM p)
SELECT page_id, name, CASE WHEN ext = 'txt' THEN 'TEXT' WHEN ext IN ('md', 'markdown') THEN 'MARKDOWN' WHEN ext IN ('html', 'htm') THEN 'HTML'
  WHEN ext = 'pdf' THEN 'PDF' WHEN ext = 'docx' THEN 'DOCX'
  WHEN ext IN ('java', 'kt', 'kts', 'py', 'js', 'ts', 'cs', 'go', 'rs') THEN 'SOURCE_CODE' END AS format FROM e""")
def format_of_pages(spark, sf):
    url = F.col("url")
    ending = F.when(url.contains("#"), ".PDF").when(url.contains("?"), "/a.Markdown").when(url.endswith("/"), ".x.py").otherwise("")
    return detect_format(X.table(spark, sf, "pages").select("page_id", F.concat("url", ending).alias("name")), "name")


@query("source_dimension", """
SELECT 'src' || n_nationkey AS source_id, n_name AS name,
  CASE WHEN r_name IN ('AFRICA', 'ASIA') THEN 'AUTHORITATIVE_SNAPSHOT' ELSE 'REQUIRE_VERSION_RESOLUTION' END AS update_policy,
  'default-ingestion' AS pipeline_id
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'conversations', 'conversations', 'REQUIRE_VERSION_RESOLUTION', 'talks'""")
def source_dimension(spark, sf):
    return X.sources(spark, sf, everywhere=True).select("source_id", "name", "update_policy", "pipeline_id")


_SOURCES = """
src AS (SELECT 'src' || n_nationkey AS source_id,
  CASE WHEN r_name IN ('AFRICA', 'ASIA') THEN 'AUTHORITATIVE_SNAPSHOT' ELSE 'REQUIRE_VERSION_RESOLUTION' END AS update_policy
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'EUROPE'
  UNION ALL SELECT 'conversations', 'REQUIRE_VERSION_RESOLUTION')"""


@query("resolve_source", f"""
WITH {_SOURCES.lstrip()}
SELECT doc_id || '.txt' AS external_document_id, source AS source_id, update_policy, update_policy IS NOT NULL AS known
FROM documents LEFT JOIN src ON source = source_id""")
def resolve_source(spark, sf):
    known, unknown = R.resolve_source(X.corpus(spark, sf), X.sources(spark, sf))
    keep = ["external_document_id", "source_id"]
    return union_all(known.select(*keep, "update_policy", F.lit(True).alias("known")),
                     unknown.select(*keep, F.lit(None).cast("string").alias("update_policy"), F.lit(False).alias("known")))


@query("contract_bytes", """
SELECT source AS source_id, doc_id || '.txt' AS external_document_id,
  CASE WHEN lang = 'es' THEN 'unsupported format' WHEN strlen(text) + CASE WHEN lang IN ('de', 'fr') THEN 1 ELSE 0 END NOT BETWEEN 1 AND 3000 THEN 'size limit'
    WHEN lang = 'de' THEN 'invalid UTF-8' WHEN lang = 'fr' THEN 'NUL character' END AS violation
FROM documents""")
def contract_bytes(spark, sf):
    rows = X.table(spark, sf, "documents")
    raw = F.col("text").cast("binary")
    damage = F.when(F.col("lang") == "de", F.lit(b"\xff")).when(F.col("lang") == "fr", F.lit(b"\x00"))
    content = F.when(damage.isNotNull(), F.concat(raw, damage)).otherwise(raw)
    docs = rows.select(F.col("source").alias("source_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("external_document_id"),
                       F.when(F.col("lang") == "es", "PDF").otherwise("TEXT").alias("format"), content.alias("content"))
    good, bad = B.split_valid(B.validate_bytes(docs, Limits(max_bytes=3000)))
    keep = ["source_id", "external_document_id"]
    return union_all(good.select(*keep, F.lit(None).cast("string").alias("violation")), bad.select(*keep, "violation"))


@query("contract_structure", f"""
WITH RECURSIVE {Q.V3_SECTIONS.lstrip()},
n AS (SELECT conv_id, count(*) AS sections, count(*) FILTER (content <> '') AS chunks FROM sec GROUP BY conv_id)
SELECT 'conv-' || conv_id || '.md' AS external_document_id, sections AS section_count, chunks AS chunk_count,
  CASE WHEN sections > 7 THEN 'too many sections' WHEN chunks > 4 THEN 'too many chunks' WHEN chunks = 0 THEN 'no indexable text' END AS violation
FROM n""")
def contract_structure(spark, sf):
    docs = X.first_versions(X.conversations(spark, sf))
    sections = C.section_rows(parse_documents(docs, n=1_000_000))
    return B.validate_structure(docs, sections, D.chunk_rows(sections), Limits(max_sections=7, max_chunks=4)).select(
        "external_document_id", "section_count", "chunk_count", "violation")


@query("markdown_lines", f"""
WITH {Q.V3_TEXT.lstrip()},
l AS (SELECT ext, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM w3)
SELECT ext AS external_document_id, line_no, line, false AS in_fence FROM l""")
def markdown_lines(spark, sf):
    return C.markdown_lines(C.decode_text(X.conversations(spark, sf))).select(
        "external_document_id", F.col("line_no").cast("long").alias("line_no"), "line", "in_fence")


_FENCED = """
f AS (SELECT conv_id, turn, role, len(string_split(text, chr(10))) AS n FROM conversations),
per AS (SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN n + 3 ELSE 0 END) AS inside,
  2 + sum(2 + n + CASE WHEN role = 'assistant' THEN 3 ELSE 0 END) + count(*) - 1 AS total FROM f GROUP BY conv_id)"""


@query("fenced_lines", f"""
WITH {_FENCED.lstrip()}
SELECT 'conv-' || conv_id || '.md' AS external_document_id, total::BIGINT AS line_count, inside::BIGINT AS fenced_count FROM per""")
def fenced_lines(spark, sf):
    lines = C.markdown_lines(C.decode_text(X.conversations(spark, sf, fenced=True)))
    return lines.groupBy("external_document_id").agg(
        F.count("*").alias("line_count"), F.count(F.when(F.col("in_fence"), 1)).alias("fenced_count"))


@query("headings", f"""
WITH RECURSIVE {Q.V3_SECTIONS.lstrip()}
SELECT 'conv-' || conv_id || '.md' AS external_document_id, ord AS section_order, level, title, slug FROM heads""")
def headings(spark, sf):
    # Fenced texts begin with a line that looks like a heading and is none.
    return C.headings(C.decode_text(X.conversations(spark, sf, fenced=True))).select(
        "external_document_id", F.col("section_order").cast("long").alias("section_order"), "level", "title", "slug")


@query("sections", f"""
WITH RECURSIVE {Q.V3_SECTIONS.lstrip()}
SELECT 'conv-' || conv_id || '.md' AS external_document_id, section_id, version_id AS document_version_id, ord AS section_order,
  level, title, stable_key, parent_id, content, content_hash FROM sec""")
def sections(spark, sf):
    rows = C.section_rows(parse_documents(X.first_versions(X.conversations(spark, sf))))
    return rows.select("external_document_id", "section_id", "document_version_id", F.col("section_order").cast("long").alias("section_order"),
                       "level", "title", "stable_key", "parent_id", "content", "content_hash")


@query("text_sections", f"""
WITH {Q.V1.lstrip()}
SELECT ext AS external_document_id, 'root' AS stable_key, 0 AS level, text AS content FROM v1""")
def text_sections(spark, sf):
    return C.text_sections(C.decode_text(X.corpus(spark, sf))).select("external_document_id", "stable_key", "level", "content")


@query("section_integrity", f"""
WITH RECURSIVE {Q.V3_SECTIONS.lstrip()},
bad AS (SELECT version_id, section_id, CASE WHEN level = 5 THEN '' ELSE stable_key END AS stable_key,
  CASE WHEN level = 5 THEN section_id ELSE parent_id END AS parent_id FROM sec WHERE title IS DISTINCT FROM 'user')
SELECT version_id AS document_version_id, section_id, 'blank stable key' AS violation FROM bad WHERE stable_key = ''
UNION ALL SELECT version_id, min(section_id), 'repeated stable key' FROM bad GROUP BY version_id, stable_key HAVING count(*) > 1
UNION ALL SELECT version_id, section_id, 'section is its own parent' FROM bad WHERE section_id = parent_id
UNION ALL SELECT version_id, section_id, 'parent section missing' FROM bad WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT section_id FROM bad)""")
def section_integrity(spark, sf):
    rows = C.section_rows(parse_documents(X.first_versions(X.conversations(spark, sf))))
    system = F.col("level") == 5
    damaged = rows.where(~F.col("title").eqNullSafe(F.lit("user"))).withColumns({
        "stable_key": F.when(system, F.lit("")).otherwise(F.col("stable_key")),
        "parent_id": F.when(system, F.col("section_id")).otherwise(F.col("parent_id"))})
    return C.check_sections(damaged)


@query("paragraphs", rf"""
WITH {Q.V1.lstrip()},
l AS (SELECT ext, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM v1),
p AS (SELECT ext, i, trim(regexp_replace(line, '[\s\x{{0B}}\x{{85}}\p{{Z}}]+', ' ', 'g')) AS t FROM l)
SELECT ext AS external_document_id, row_number() OVER (PARTITION BY ext ORDER BY i) - 1 AS unit_index, 'PARAGRAPH' AS kind, t AS text
FROM p WHERE t <> ''""")
def paragraphs(spark, sf):
    units = D.paragraphs(C.text_sections(C.decode_text(X.corpus(spark, sf, paragraphs=True))))
    return units.select("external_document_id", F.col("unit_index").cast("long").alias("unit_index"), "kind", "text")


@query("code_blocks", f"""
WITH RECURSIVE f AS (SELECT conv_id, turn, '```text' || chr(10) || '# not a heading' || chr(10) || text || chr(10) || '```' AS code
  FROM conversations WHERE role = 'assistant'),
s AS (SELECT conv_id, turn, code, unnest(range(0, (len(code) + 199) // 200)) AS i FROM f),
up AS (SELECT conv_id || '-' || turn AS uid, conv_id, text AS content FROM conversations WHERE role <> 'assistant'),{Q.chunks('up', 200)},
parts AS (SELECT conv_id, 'assistant' AS kind, substr(code, i * 200 + 1, 200) AS content FROM s
  UNION ALL SELECT conv_id, 'other', c.content FROM chunk c JOIN up USING (uid))
SELECT 'conv-' || conv_id || '.md' AS external_document_id, kind, content, count(*) AS n FROM parts GROUP BY ALL""")
def code_blocks(spark, sf):
    parsed = parse_documents(X.first_versions(X.conversations(spark, sf, fenced=True)), n=200)
    chunks = D.chunk_rows(C.section_rows(parsed)).withColumn("kind", F.when(F.col("section_title") == "assistant", "assistant").otherwise("other"))
    return chunks.groupBy("external_document_id", "kind", "content").agg(F.count("*").alias("n"))


@query("chunks", f"""
WITH RECURSIVE {Q.V1_CHUNKS.lstrip()}
SELECT chunk_id, section_id, version_id AS document_version_id, idx AS chunk_index, content, sha256(content) AS content_hash,
  count(*) OVER (PARTITION BY section_id) > 1 AS split_section FROM c1""")
def chunks(spark, sf):
    rows = D.chunk_rows(C.section_rows(parse_documents(X.first_versions(X.corpus(spark, sf)))))
    return rows.select("chunk_id", "section_id", "document_version_id", F.col("chunk_index").cast("long").alias("chunk_index"),
                       "content", "content_hash", "split_section")


@query("small_chunks", f"""
WITH RECURSIVE {Q.V1.lstrip()},
u1 AS (SELECT section_id AS uid, text AS content FROM s1),{Q.chunks('u1', 120)}
SELECT uid AS section_id, idx AS chunk_index, content FROM chunk""")
def small_chunks(spark, sf):
    rows = D.chunk_rows(C.section_rows(parse_documents(X.first_versions(X.corpus(spark, sf)), n=120)))
    return rows.select("section_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content")


@query("hard_split", r"""
WITH RECURSIVE p AS (SELECT doc_id, trim(regexp_replace(text, '[\s\x{0B}\x{85}\p{Z}]+', ' ', 'g')) AS t FROM documents),
cut AS (
  SELECT doc_id, 0 AS i, t AS rest, CASE WHEN len(t) <= 100 THEN 100 WHEN strpos(reverse(substr(t, 1, 100)), ' ') BETWEEN 1 AND 99
    THEN 100 - strpos(reverse(substr(t, 1, 100)), ' ') ELSE 100 END AS take FROM p WHERE t <> ''
  UNION ALL
  SELECT doc_id, i + 1, r, CASE WHEN len(r) <= 100 THEN 100 WHEN strpos(reverse(substr(r, 1, 100)), ' ') BETWEEN 1 AND 99
    THEN 100 - strpos(reverse(substr(r, 1, 100)), ' ') ELSE 100 END
  FROM (SELECT doc_id, i, ltrim(substr(rest, take + 1)) AS r FROM cut) WHERE r <> '')
SELECT doc_id, i::BIGINT AS piece, trim(substr(rest, 1, take)) AS text FROM cut""")
def hard_split(spark, sf):
    p = X.table(spark, sf, "documents").select("doc_id", T.normalise_paragraph(F.col("text")).alias("p"))
    return unnest(p, ["doc_id"], T.hard_split(F.col("p"), 100), "text", "piece").withColumn("piece", F.col("piece").cast("long"))


@query("chunk_integrity", f"""
WITH RECURSIVE {Q.V1_CHUNKS.lstrip()},
damaged AS (SELECT *, CASE WHEN content LIKE '%a%' THEN idx ELSE -1 - idx END AS i2 FROM c1)
SELECT version_id AS document_version_id, chunk_id, 'negative chunk index' AS violation FROM damaged WHERE i2 < 0
UNION ALL SELECT version_id, chunk_id, 'section not in version' FROM damaged WHERE section_id IN (SELECT section_id FROM s1 WHERE lang = 'es')
UNION ALL SELECT version_id, NULL, 'version without chunks' FROM s1 WHERE lang = 'de' AND version_id NOT IN (SELECT version_id FROM damaged)""")
def chunk_integrity(spark, sf):
    langs = X.table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("external_document_id"), "lang")
    docs = X.first_versions(X.corpus(spark, sf))
    rows = C.section_rows(parse_documents(docs)).join(langs, "external_document_id")
    chunk = D.chunk_rows(rows.drop("lang")).withColumn("chunk_index", F.when(
        F.col("content").contains("a"), F.col("chunk_index")).otherwise(-1 - F.col("chunk_index")))
    return D.check_chunks(chunk, rows.where(F.col("lang") != "es"), docs)


@query("document_ids", f"""
WITH RECURSIVE {Q.V1.lstrip()}
SELECT ext AS external_document_id, document_id, version_id AS document_version_id, section_id FROM s1""")
def document_ids(spark, sf):
    return X.first_versions(X.corpus(spark, sf)).select(
        "external_document_id", "document_id", "document_version_id",
        ids.section_id(F.col("document_version_id"), F.lit("root")).alias("section_id"))
