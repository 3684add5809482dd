"""Operators D: sections to chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import ids, text as T
from foliant.functions.rows import unnest
from foliant.params import CHUNKER_VERSION, MAX_CHUNK_CHARACTERS
from foliant.session import union_all

# A chunker maps a section's content to its chunks; any such column function may stand in.
Chunker = Callable[[Column], Column]


def paragraph_chunker(n: int = MAX_CHUNK_CHARACTERS) -> Chunker:
    """Paragraphs and fenced blocks, sentences packed up to n characters, longer ones cut."""
    if n < 2:
        raise ValueError("chunk size must be at least 2")
    return lambda content: T.chunk_texts(content, n)


def paragraphs(sections: DataFrame) -> DataFrame:
    """One row per normalised paragraph or verbatim fenced block."""
    units = F.transform(T.chunk_units(F.col("content")), lambda u: F.struct(
        F.when(T.is_code_unit(u), "CODE").otherwise("PARAGRAPH").alias("kind"),
        F.when(T.is_code_unit(u), u).otherwise(T.normalise_paragraph(u)).alias("text")))
    keys = [c for c in sections.columns if c not in ("content", "title_path")]
    return unnest(sections, keys, units, "_u", "unit_index").select(
        *keys, "unit_index", F.col("_u.kind").alias("kind"), F.col("_u.text").alias("text"))


def with_chunks(parsed: DataFrame, chunker: Chunker) -> DataFrame:
    """Chunk the ``sections`` array of parsed documents in place: adds ``chunks`` to each section and ``chunk_count``."""
    chunked = parsed.withColumn("sections", F.transform("sections", lambda s: s.withField("chunks", chunker(s["content"]))))
    return chunked.withColumn("chunk_count", F.aggregate(
        "sections", F.lit(0), lambda n, s: n + F.size(s["chunks"])))


def chunk_fingerprint_of(section_keys: Column, n: int, version: str = CHUNKER_VERSION) -> Column:
    """D7 for an ordered array of ``stable_key:content_hash`` strings."""
    lines = F.array_join(F.transform(section_keys, lambda k: F.concat(F.lit("\nsection="), k)), "")
    return ids.sha256_text(F.concat(F.lit(f"{version}\nmaxCharacters={n}"), lines))


def chunk_fingerprint(sections: DataFrame, n: int = MAX_CHUNK_CHARACTERS, version: str = CHUNKER_VERSION) -> DataFrame:
    """Per version, SHA-256 of chunker version, size limit and every section's key and content hash in order.

    A version has at most ``Limits.max_sections`` sections, so the collected list is bounded.
    """
    ordered = F.sort_array(F.collect_list(F.struct(
        "section_order", F.concat_ws(":", "stable_key", "content_hash").alias("key"))))
    return sections.groupBy("document_version_id").agg(ordered.alias("_s")).select(
        "document_version_id", chunk_fingerprint_of(F.col("_s.key"), n, version).alias("chunk_fingerprint"))


def chunk_rows(sections: DataFrame, chunker: Chunker | None = None) -> DataFrame:
    """Explode sections into chunk rows with index, ``split_section``, content hash and stable id.

    ``sections`` either carries a ``chunks`` array or is chunked here. A section without text gives no row.
    """
    if "chunks" not in sections.columns:
        sections = sections.withColumn("chunks", (chunker or paragraph_chunker())(F.col("content")))
    keep = [c for c in sections.columns if c not in (
        "content", "content_hash", "chunks", "processing_fingerprint", "stable_key", "parent_id", "section_order",
        "title", "level")]
    carried = ["stable_key", "section_order"]
    rows = unnest(
        sections, [*keep, *carried, F.col("title").alias("section_title"), (F.size("chunks") > 1).alias("split_section")],
        F.col("chunks"), "content", "chunk_index")
    return rows.select(
        ids.chunk_id(F.col("section_id"), F.col("chunk_index")).alias("chunk_id"),
        *keep, *carried, "section_title", "chunk_index", "content",
        ids.sha256_text(F.col("content")).alias("content_hash"), "split_section")


def check_chunks(chunks: DataFrame, sections: DataFrame, versions: DataFrame) -> DataFrame:
    """Violations of a chunk table as (document_version_id, chunk_id, violation)."""
    c = chunks.select("document_version_id", "chunk_id", "section_id", "chunk_index")
    repeated_id = (
        c.groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("document_version_id").alias("document_version_id"))
        .where("n > 1").withColumn("violation", F.lit("repeated chunk id")))
    repeated_index = (
        c.groupBy("section_id", "chunk_index").agg(
            F.count("*").alias("n"), F.min("chunk_id").alias("chunk_id"),
            F.min("document_version_id").alias("document_version_id"))
        .where("n > 1").withColumn("violation", F.lit("repeated chunk index")))
    negative = c.where("chunk_index < 0").withColumn("violation", F.lit("negative chunk index"))
    owned = c.join(sections.select("section_id", "document_version_id"), ["section_id", "document_version_id"], "left_anti")
    foreign = owned.withColumn("violation", F.lit("section not in version"))
    empty = (
        versions.select("document_version_id").join(c.select("document_version_id"), "document_version_id", "left_anti")
        .withColumn("chunk_id", F.lit(None).cast("string")).withColumn("violation", F.lit("version without chunks")))
    out = ["document_version_id", "chunk_id", "violation"]
    return union_all(*[part.select(out) for part in (repeated_id, repeated_index, negative, foreign, empty)])
