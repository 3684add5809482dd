"""The registered queries: each applies one operator to its whole table and derives the columns to be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import fill_middle, language, quality, warc
from foliant.llm.best_fit import best_fit
from foliant.llm.chunk_bpe import encode_documents
from foliant.llm.packing import pack_documents
from foliant.llm.pivot_topk import topk
from foliant.llm.registry import ORACLES, QUERIES, query, table
from foliant.llm.simhash import near_duplicates
from foliant.llm.sketches import edited_fingerprints, resemblance, sketch_text
from foliant.llm.token_counts import token_counts
from foliant.llm.training_order import read_shards, training_order
from foliant.llm.vector_codes import vector_codes

__all__ = ["ORACLES", "QUERIES"]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_language")
def op1_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = language.identify(docs, language.train(docs, ~language.held_out()))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query("op2_pivot_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""")
def op2_pivot_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op3_quality")
def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.train(docs, table(spark, sf, "labels"), quality.grade(F.col("quality"), F.col("toxic")))
    return quality.rate(docs, model).select("doc_id", "expected_grade", "p_best", (F.col("p_best") >= quality.KEEP).alias("kept"))


@query("op4_chunk_bpe")
def op4_chunk_bpe(spark: SparkSession, sf: str) -> DataFrame:
    encoded = encode_documents(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op5_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, (5 * (i // 4) + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31), 1)), 'string_agg', '') AS digest,
    min(page_id) OVER (PARTITION BY html) AS first
  FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
""")
def op5_warc(spark: SparkSession, sf: str) -> DataFrame:
    records = warc.read_records(warc.archive_pages(table(spark, sf, "pages")))
    read = F.col("payload").isNotNull()
    return records.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        F.when(read, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(read, warc.base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"), width=3)


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(table(spark, sf, "documents"), tokenizer_path("piece_bpe_32k.model"), 4096)


@query("op8_training_order")
def op8_training_order(spark: SparkSession, sf: str) -> DataFrame:
    key = 20240229
    shards = training_order(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, key=key)
    return read_shards(shards, key).drop("ids")


@query("op9_sketches")
def op9_sketches(spark: SparkSession, sf: str) -> DataFrame:
    found = edited_fingerprints(table(spark, sf, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch_text(F.col("sketch")).alias("fingerprint"),
        sketch_text(F.col("edited_sketch")).alias("edited_fingerprint"), resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = pack_documents(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op11_fill_middle", """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
d AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
    CASE WHEN len(u) = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
p AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(u[greatest(a, b) + 1:n], '') AS suf FROM d)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
""")
def op11_fill_middle(spark: SparkSession, sf: str) -> DataFrame:
    return fill_middle.with_digests(fill_middle.fill_middle_documents(table(spark, sf, "documents")))


_NEAREST = """SELECT v.vec_id, v.p, any_value(v.x) AS x, min(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + c.e) AS k
  FROM parts v JOIN {books} c USING (p) GROUP BY v.vec_id, v.p"""
_MEANS = """SELECT c.p, c.e, CASE WHEN m.p IS NULL THEN c.x ELSE m.x END AS x FROM {books} c LEFT JOIN (
  SELECT p, e, list(mean ORDER BY i) AS x FROM (
    SELECT p, k % 64 AS e, i, floor(sum(x[i]) / count(*))::BIGINT AS mean FROM (SELECT p, k, x, unnest(range(1, len(x) + 1)) AS i FROM {nearest}) GROUP BY p, e, i) GROUP BY p, e) m
  ON c.p = m.p AND c.e = m.e"""


@query("op12_vector_codes", f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, q[p * (len(q) // 16) + 1:(p + 1) * (len(q) // 16)] AS x FROM kept, range(16) r(p)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64),
c0 AS (SELECT p, e, x FROM parts JOIN firsts USING (vec_id)),
a0 AS MATERIALIZED ({_NEAREST.format(books="c0")}),
c1 AS MATERIALIZED ({_MEANS.format(books="c0", nearest="a0")}),
a1 AS MATERIALIZED ({_NEAREST.format(books="c1")}),
c2 AS MATERIALIZED ({_MEANS.format(books="c1", nearest="a1")}),
a2 AS MATERIALIZED ({_NEAREST.format(books="c2")}),
coded AS (SELECT vec_id, string_agg(printf('%02x', (k % 64)::INTEGER), '' ORDER BY p) AS code, sum(k // 64)::BIGINT AS error FROM a2 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books
""")
def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes(table(spark, sf, "embeddings"))


@query("op13_best_fit")
def op13_best_fit(spark: SparkSession, sf: str) -> DataFrame:
    return best_fit(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1).drop("ids")
