"""SQL fragments for the oracle queries."""

from __future__ import annotations


def uuid(*parts: str) -> str:
    """Name-based UUID of SQL string expressions joined by line feeds."""
    digest = f"md5(concat_ws(chr(10), {', '.join(parts)}))"
    variant = f"translate(substr({digest}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')"
    return (f"concat(substr({digest}, 1, 8), '-', substr({digest}, 9, 4), '-3', substr({digest}, 14, 3), '-', {variant}, "
            f"substr({digest}, 18, 3), '-', substr({digest}, 21, 12))")


def document_uuid(source: str, external: str) -> str:
    return uuid("'document'", source, external)


def version_uuid(document: str, number: str) -> str:
    return uuid("'version'", document, f"({number})::VARCHAR")


TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def tokens(text: str) -> str:
    return TOKENS.format(text)


# V1: name, document id, version 1 and its root section.
V1 = f"""
v1 AS (SELECT source AS source_id, doc_id || '.txt' AS ext, text, lang, doc_id FROM documents),
d1 AS (SELECT *, {document_uuid('source_id', 'ext')} AS document_id FROM v1),
w1 AS (SELECT *, {version_uuid('document_id', '1')} AS version_id FROM d1),
s1 AS (SELECT *, {uuid("'section'", 'version_id', "'root'")} AS section_id FROM w1)"""

EDITED = """CASE lang
  WHEN 'fr' THEN array_to_string((string_split(text, chr(10)))[2:], chr(10))
  WHEN 'de' THEN text || chr(10) || 'Added closing line.'
  WHEN 'es' THEN array_to_string(list_reverse(string_split(text, chr(10))), chr(10))
  ELSE text END"""

MARKS = "CASE role WHEN 'user' THEN '## ' WHEN 'assistant' THEN '### ' ELSE '##### ' END"

# V3 as Markdown text.
V3_TEXT = f"""
v3 AS (SELECT 'conversations' AS source_id, 'conv-' || conv_id || '.md' AS ext, conv_id,
  '# Conversation ' || conv_id || chr(10) || chr(10) ||
  string_agg({MARKS} || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id),
d3 AS (SELECT *, {document_uuid('source_id', 'ext')} AS document_id FROM v3),
w3 AS (SELECT *, {version_uuid('document_id', '1')} AS version_id FROM d3)"""

# V3 as sections: root 0, the conversation 1, then the turns. Parents and stable keys follow from the roles.
V3_SECTIONS = f"""{V3_TEXT},
turns AS (SELECT w3.version_id, w3.conv_id, 1 + row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) AS ord, role, c.text
  FROM conversations c JOIN w3 USING (conv_id)),
placed AS (SELECT *,
  CASE role WHEN 'user' THEN 1
    WHEN 'assistant' THEN coalesce(max(ord) FILTER (role = 'user') OVER before, 1)
    ELSE coalesce(max(ord) FILTER (role IN ('user', 'assistant')) OVER before, 1) END AS parent_ord
  FROM turns WINDOW before AS (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
heads AS (
  SELECT version_id, conv_id, 1 AS ord, 1 AS level, 'Conversation ' || conv_id AS title, 0 AS parent_ord,
    'conversation-' || conv_id AS slug, '' AS content FROM w3
  UNION ALL
  SELECT version_id, conv_id, ord, CASE role WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 5 END, role, parent_ord, role, text FROM placed),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, parent_ord, slug ORDER BY ord) AS n FROM heads),
comp AS (SELECT *, slug || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS part FROM numbered),
tree AS (
  SELECT conv_id, ord, part AS stable_key, title AS path FROM comp WHERE parent_ord = 0
  UNION ALL
  SELECT c.conv_id, c.ord, t.stable_key || '/' || c.part, t.path || ' > ' || c.title
  FROM comp c JOIN tree t ON c.conv_id = t.conv_id AND c.parent_ord = t.ord),
secs AS (
  SELECT version_id, conv_id, 0 AS ord, 0 AS level, NULL::VARCHAR AS title, NULL::BIGINT AS parent_ord, 'root' AS stable_key, NULL::VARCHAR AS path, '' AS content FROM w3
  UNION ALL
  SELECT c.version_id, c.conv_id, c.ord, c.level, c.title, c.parent_ord, t.stable_key, t.path, c.content
  FROM comp c JOIN tree t ON c.conv_id = t.conv_id AND c.ord = t.ord),
keyed AS (SELECT s.*, p.stable_key AS parent_key FROM secs s LEFT JOIN secs p ON s.conv_id = p.conv_id AND s.parent_ord = p.ord),
sec AS (SELECT *, {uuid("'section'", 'version_id', 'stable_key')} AS section_id,
  CASE WHEN parent_key IS NOT NULL THEN {uuid("'section'", 'version_id', 'parent_key')} END AS parent_id, sha256(content) AS content_hash
  FROM keyed)"""


def chunks(unit: str, n: int, prefix: str = "") -> str:
    """CTEs that chunk the fence-free texts of ``unit`` (uid, content); the result is ``{prefix}chunk`` (uid, idx, content).

    Lines join to paragraphs at blank lines; white space becomes single blanks; paragraphs over n characters are cut into
    sentences and packed; sentences over n characters are cut at the last blank in each window.
    """
    p = prefix
    strong = r"([!?。！？][!?。！？.\p{Pe}\p{Pf}\"'']*)(?:\s+(\S)|([^\s!?。！？.\p{Pe}\p{Pf}\"'']))"
    stop = r"(\.[.\p{Pe}\p{Pf}\"'']*)\s+(\p{Ps}|[\p{Pi}\"'']*[\p{Lu}\p{Lt}\p{Lm}\p{Lo}])"
    return rf"""
{p}lines AS (SELECT uid, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM {unit}),
{p}flag AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY i) AS grp FROM {p}lines),
{p}para AS (SELECT uid, grp, trim(regexp_replace(string_agg(line, ' ' ORDER BY i), '[\s\x{{0B}}\x{{85}}\p{{Z}}]+', ' ', 'g')) AS t
  FROM {p}flag WHERE trim(line) <> '' GROUP BY uid, grp),
{p}marked AS (SELECT uid, grp, string_split(regexp_replace(regexp_replace(t, '{strong}', concat('\1', chr(1), '\2\3'), 'g'),
  '{stop}', concat('\1', chr(1), '\2'), 'g'), chr(1)) AS ss FROM {p}para WHERE len(t) > {n}),
{p}sent AS (SELECT uid, grp, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM {p}marked),
{p}cut AS (
  SELECT uid, grp, i, 0 AS piece, s AS rest, CASE WHEN strpos(reverse(substr(s, 1, {n})), ' ') BETWEEN 1 AND {n} - 1
    THEN {n} - strpos(reverse(substr(s, 1, {n})), ' ') ELSE {n} END AS take FROM {p}sent WHERE len(s) > {n}
  UNION ALL
  SELECT uid, grp, i, piece + 1, r, CASE WHEN len(r) <= {n} THEN {n} WHEN strpos(reverse(substr(r, 1, {n})), ' ') BETWEEN 1 AND {n} - 1
    THEN {n} - strpos(reverse(substr(r, 1, {n})), ' ') ELSE {n} END
  FROM (SELECT uid, grp, i, piece, ltrim(substr(rest, take + 1)) AS r FROM {p}cut) WHERE r <> ''),
{p}pieces AS (SELECT uid, grp, i, count(*) AS pieces FROM {p}cut GROUP BY ALL),
{p}sized AS (SELECT s.*, len(s.s) AS l, coalesce(pieces, 0) AS pieces FROM {p}sent s LEFT JOIN {p}pieces USING (uid, grp, i)),
{p}pack AS (
  SELECT uid, grp, i, 0 AS base, CASE WHEN l > {n} THEN pieces ELSE 1 END AS nxt, CASE WHEN l > {n} THEN 0 ELSE l END AS cur FROM {p}sized WHERE i = 1
  UNION ALL
  SELECT z.uid, z.grp, z.i,
    CASE WHEN l > {n} OR cur = 0 OR cur + 1 + l > {n} THEN nxt ELSE nxt - 1 END,
    CASE WHEN l > {n} THEN nxt + z.pieces WHEN cur = 0 OR cur + 1 + l > {n} THEN nxt + 1 ELSE nxt END,
    CASE WHEN l > {n} THEN 0 WHEN cur = 0 OR cur + 1 + l > {n} THEN l ELSE cur + 1 + l END
  FROM {p}pack k JOIN {p}sized z ON z.uid = k.uid AND z.grp = k.grp AND z.i = k.i + 1),
{p}pooled AS (
  SELECT uid, grp, 0 AS cno, t AS content FROM {p}para WHERE len(t) <= {n}
  UNION ALL
  SELECT k.uid, k.grp, base, string_agg(s, ' ' ORDER BY k.i) FROM {p}pack k JOIN {p}sized z ON z.uid = k.uid AND z.grp = k.grp AND z.i = k.i
  WHERE l <= {n} GROUP BY k.uid, k.grp, base
  UNION ALL
  SELECT c.uid, c.grp, base + piece, trim(substr(rest, 1, take)) FROM {p}cut c JOIN {p}pack k ON k.uid = c.uid AND k.grp = c.grp AND k.i = c.i),
{p}chunk AS (SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY grp, cno) - 1 AS idx, content FROM {p}pooled)"""


# Chunks of V1 at 2400 characters with ids.
V1_CHUNKS = f"""{V1},
u1 AS (SELECT section_id AS uid, text AS content FROM s1),{chunks('u1', 2400)},
c1 AS (SELECT s1.source_id, s1.ext, s1.document_id, s1.version_id, s1.section_id, c.idx, c.content,
  {uuid("'chunk'", 'uid', 'idx::VARCHAR')} AS chunk_id FROM chunk c JOIN s1 ON s1.section_id = c.uid)"""

# Lexical search with all words of every benchmark text over `docs` (chunk_id, content): matches and cover density.
def lexical(docs: str) -> str:
    return f"""
q AS (SELECT item_id::VARCHAR AS query_id, list_distinct({tokens('text')}) AS terms FROM benchmark),
qt AS (SELECT query_id, unnest(terms) AS term, len(terms) AS n_terms FROM q),
post AS (SELECT chunk_id, unnest({tokens('content')}) AS term, generate_subscripts({tokens('content')}, 1) AS pos FROM {docs}),
hit AS (SELECT query_id, chunk_id FROM qt JOIN post USING (term) GROUP BY query_id, chunk_id HAVING count(DISTINCT term) = any_value(n_terms)),
e AS (SELECT query_id, chunk_id, term, pos, n_terms FROM hit JOIN qt USING (query_id) JOIN post USING (chunk_id, term)),
latest AS (SELECT a.query_id, a.chunk_id, a.pos, b.term, max(b.pos) AS last, any_value(a.n_terms) AS n_terms
  FROM e a JOIN e b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND b.pos <= a.pos GROUP BY a.query_id, a.chunk_id, a.pos, b.term),
span AS (SELECT query_id, chunk_id, pos AS hi, min(last) AS lo FROM latest GROUP BY query_id, chunk_id, pos HAVING count(*) = any_value(n_terms)),
cover AS (SELECT query_id, chunk_id, lo, min(hi) AS hi FROM span GROUP BY query_id, chunk_id, lo),
sized_cover AS (SELECT c.query_id, c.chunk_id, c.lo, c.hi, count(*) AS n FROM cover c JOIN e ON e.query_id = c.query_id AND e.chunk_id = c.chunk_id
  AND e.pos BETWEEN c.lo AND c.hi GROUP BY ALL),
density AS (SELECT query_id, chunk_id, sum(0.4::DOUBLE / (1 + (hi - lo) - (n - 1))) AS d FROM sized_cover GROUP BY query_id, chunk_id),
lex AS (SELECT query_id, chunk_id, d / (d + 1) AS score FROM density)"""
