"""Operators E: embedding texts, fingerprints, reuse and vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import ids, text as T
from foliant.functions.rows import unnest
from foliant.functions.skew import salted_join
from foliant.params import COMPOSER_VERSION, EMBEDDING_BATCH, EMBEDDING_DIMENSIONS
from foliant.session import cut_lineage, union_all

# Heading levels are 1..6, so a section has at most six ancestors besides its own heading.
MAX_DEPTH = 6


# Tasks of model calls per core, and texts of a task beyond that.
TASKS_PER_CORE = 4
TASK_TEXTS = 8192


#: Runs of letters and digits of a lower-case text, and the same of one that is all ASCII.
_TOKENS, _ASCII_TOKENS = regex.compile(r"[\p{L}\p{N}]+"), re.compile(r"[a-z0-9]+")


class Embedder(Protocol):
    """What an embedding model has to offer. The object is shipped to the tasks and may load its model lazily."""

    provider: str
    model: str
    revision: str
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """One row of ``dimensions`` floats per text."""


class HashEmbedder:
    """Repeatable vectors: counts of tokens hashed to a dimension, scaled to length 1."""

    provider = "test"
    model = "token-hash"
    revision = "v1"

    def __init__(self, dimensions: int = EMBEDDING_DIMENSIONS):
        self.dimensions = dimensions
        self._places: dict[str, int] = {}

    def _place(self, token: str) -> int:
        place = self._places.get(token)
        if place is None:
            if len(self._places) > 200_000:
                self._places.clear()
            place = self._places[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dimensions
        return place

    def embed(self, texts: list[str]) -> np.ndarray:
        out, known = np.zeros((len(texts), self.dimensions), dtype=np.float64), self._places
        for i, text in enumerate(texts):
            low = text.lower()
            tokens = (_ASCII_TOKENS if low.isascii() else _TOKENS).findall(low) or [text]
            out[i] = np.bincount([known[t] if t in known else self._place(t) for t in tokens], minlength=self.dimensions)
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)


def ancestor_titles(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections with ``ancestors``, the titles from the top down to the parent; violations).

    All sections climb together, one join by (version, section id) a level: headings have no more levels than ``MAX_DEPTH``. A missing
    parent, a section id that occurs twice, or a chain longer than headings allow (a cycle) is a violation.
    """
    key = ["document_version_id", "_at"]
    nodes = sections.groupBy("document_version_id", F.col("section_id").alias("_at")).agg(
        F.min("parent_id").alias("_up"), F.min("title").alias("_title"), F.count("*").alias("_copies"))
    walked = sections.select("document_version_id", "section_id", F.col("parent_id").alias("_at"), F.array().cast("array<string>").alias("ancestors"),
                             F.lit(None).cast("string").alias("violation"))
    title = T.strip(F.coalesce("_title", F.lit("")))
    for _ in range(MAX_DEPTH + 1):
        walked = walked.join(nodes, key, "left").select(
            "document_version_id", "section_id", F.col("_up").alias("_at"),
            F.when(title != "", F.concat(F.array(title), "ancestors")).otherwise(F.col("ancestors")).alias("ancestors"),
            F.coalesce("violation", F.when(F.col("_at").isNotNull() & F.col("_copies").isNull(), "parent missing").when(
                F.col("_copies") > 1, "repeated section id")).alias("violation"))
    done = walked.withColumn("violation", F.coalesce("violation", F.when(F.col("_at").isNotNull(), "cycle")))
    resolved = done.where(F.col("violation").isNull()).select("document_version_id", "section_id", "ancestors")
    return resolved, done.where(F.col("violation").isNotNull()).select("document_version_id", "section_id", "violation")


def compose(title_path: Column, content: Column) -> Column:
    """Non-blank stripped titles joined by `` > ``, a blank line, the stripped chunk; null for a blank chunk."""
    titles = F.filter(F.transform(title_path, T.strip), lambda t: t != "")
    body = T.strip(content)
    text = F.when(F.size(titles) == 0, body).otherwise(F.concat(F.array_join(titles, " > "), F.lit("\n\n"), body))
    return F.when(body != "", text)


# A composer maps a title path and a chunk's content to the text to embed; null marks a chunk without text.
Composer = Callable[[Column, Column], Column]


def embedding_text(chunks: DataFrame, sections: DataFrame | None = None, composer: Composer = compose) -> DataFrame:
    """Add ``embedding_text`` to chunks; the title path comes with the chunk or from its section."""
    if sections is not None:
        chunks = chunks.drop("title_path").join(sections.select("section_id", "title_path"), "section_id")
    return chunks.withColumn("embedding_text", composer(F.col("title_path"), F.col("content")))


def input_fingerprint(df: DataFrame, embedder: Embedder, composer_version: str = COMPOSER_VERSION) -> DataFrame:
    """Add ``input_fingerprint``: SHA-256 of composer version, model identity and text."""
    identity = (f"composer={composer_version}\nprovider={embedder.provider}\nmodel={embedder.model}"
                f"\nrevision={embedder.revision}\ndimensions={embedder.dimensions}\ntext=")
    return df.withColumn("input_fingerprint", ids.sha256_text(F.concat(F.lit(identity), F.col("embedding_text"))))


def embed_fingerprint(chunks: DataFrame) -> DataFrame:
    """Per version, SHA-256 over (stable_key, chunk_index, input_fingerprint) in document order.

    A version has at most ``Limits.max_chunks`` chunks, so the collected list is bounded.
    """
    line = F.concat(F.lit("section="), F.col("stable_key"), F.lit("\nchunkIndex="), F.col("chunk_index").cast("string"),
                    F.lit("\nfingerprint="), F.col("input_fingerprint"), F.lit("\n"))
    ordered = F.sort_array(F.collect_list(F.struct("section_order", "chunk_index", line.alias("line"))))
    return chunks.groupBy("document_version_id").agg(ordered.alias("_c")).select(
        "document_version_id", ids.sha256_text(F.array_join("_c.line", "")).alias("embed_fingerprint"))


def reuse_from_active(targets: DataFrame, active: DataFrame) -> DataFrame:
    """For each target chunk, the lowest chunk id with an equal fingerprint in the ACTIVE version of its document.

    ``targets``: chunk_id, document_id, document_version_id, input_fingerprint. ``active``: the chunks of ACTIVE versions
    with their stored fingerprints. Adds ``reused_from``; only ids travel here, vectors are joined afterwards.
    """
    donors = active.groupBy("document_id", F.col("processing_fingerprint").alias("input_fingerprint")).agg(
        F.min("chunk_id").alias("reused_from"), F.first("document_version_id").alias("_donor_version"))
    return targets.join(donors, ["document_id", "input_fingerprint"]).where(
        F.col("_donor_version") != F.col("document_version_id")).drop("_donor_version")


def embedding_plan(chunks: DataFrame, existing: DataFrame, active: DataFrame) -> DataFrame:
    """E5: each chunk is KEPT (own stored fingerprint equal), REUSED (E6, with ``reused_from``) or COMPUTE."""
    targets = chunks.select("chunk_id", "document_id", "document_version_id", "source_id", "input_fingerprint")
    own = existing.select("chunk_id", F.col("processing_fingerprint").alias("_own"))
    donors = reuse_from_active(targets, active).select("chunk_id", "reused_from")
    kept = F.col("_own") == F.col("input_fingerprint")
    planned = targets.join(own, "chunk_id", "left").join(donors, "chunk_id", "left")
    return planned.withColumn("action", F.when(kept, "KEPT").when(F.col("reused_from").isNotNull(), "REUSED").otherwise(
        "COMPUTE")).withColumn("reused_from", F.when(F.col("action") == "REUSED", F.col("reused_from"))).drop("_own")


def _dealt(distinct: DataFrame, batch: int) -> DataFrame:
    """The texts of a written table, in as many partitions as their calls can fill. Neighbours in the order of size inside a written
    partition go to different tasks. Partitions are asked for by number, so adaptive execution does not merge them."""
    count = distinct.count()
    tasks = max(1, min(-(-count // batch), max(TASKS_PER_CORE * distinct.sparkSession.sparkContext.defaultParallelism, -(-count // TASK_TEXTS))))
    # The low 33 bits number the rows of a partition; each partition begins with another task.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + F.spark_partition_id()
    ordered = distinct.sortWithinPartitions(F.desc(F.octet_length("embedding_text")), "input_fingerprint")
    return ordered.withColumn("_task", F.pmod(place, F.lit(tasks)).cast("int")).repartitionById(tasks, "_task").drop("_task")


def embed_batch(
    texts: DataFrame, embedder: Embedder, batch: int = EMBEDDING_BATCH, cut: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """Vectors of the distinct texts in ``texts`` (input_fingerprint, embedding_text).

    Equal texts share a fingerprint and are embedded once, so a text copied into a third of all chunks costs one call.
    Returns (input_fingerprint, embedding, n) where n is the number of rows that share the fingerprint. Texts are dealt to tasks by
    size, so that all make about as many calls and with about as much text; no task has less than a call's worth where another has more.
    ``cut`` writes the distinct texts and reads them back.
    """
    distinct = _dealt(cut(texts.groupBy("input_fingerprint").agg(
        F.first("embedding_text").alias("embedding_text"), F.count("*").alias("n"))), batch)
    schema = "input_fingerprint string, embedding array<float>, n long"
    dimensions = embedder.dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            values = rows.column("embedding_text").to_pylist()
            if any(v is None or not v.strip() for v in values):
                raise ValueError("embedding text must not be blank")
            parts = []
            for start in range(0, len(values), batch):
                asked = values[start:start + batch]
                got = np.asarray(embedder.embed(asked), dtype=np.float32)
                if got.shape != (len(asked), dimensions):
                    raise ValueError(f"embedder returned {got.shape}, expected {(len(asked), dimensions)}")
                if not np.isfinite(got).all():
                    raise ValueError("embedder returned a number that is not finite")
                parts.append(got)
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0, np.float32)
            offsets = np.arange(len(values) + 1, dtype=np.int32) * dimensions
            yield pa.RecordBatch.from_arrays(
                [rows.column("input_fingerprint"), pa.ListArray.from_arrays(offsets, pa.array(flat)), rows.column("n")],
                names=["input_fingerprint", "embedding", "n"])

    return distinct.mapInArrow(run, schema)


def embedding_rows(planned: DataFrame, vectors: DataFrame, stored: DataFrame, embedder: Embedder, now: Column) -> DataFrame:
    """Rows for the embedding table: COMPUTE chunks take the new vectors, REUSED chunks copy the donor's row.

    A fingerprint shared by many chunks is a heavy key of the first join; ``vectors.n`` tells which ones are.
    """
    owner = ["chunk_id", "document_version_id", "source_id"]
    compute = planned.where("action = 'COMPUTE'").select(*owner, "input_fingerprint")
    computed = salted_join(
        compute, vectors.select("input_fingerprint", "embedding"), "input_fingerprint", F.col("chunk_id"), vectors)
    computed = computed.select(
        *owner, F.lit(embedder.provider).alias("provider"), F.lit(embedder.model).alias("model"),
        F.lit(embedder.revision).alias("model_revision"), F.lit(embedder.dimensions).alias("dimensions"),
        F.col("input_fingerprint").alias("processing_fingerprint"), "embedding", now.alias("created_at"))
    reused = planned.where("action = 'REUSED'").select(
        F.col("chunk_id").alias("_target"), "document_version_id", "source_id", F.col("reused_from").alias("chunk_id"))
    copied = stored.select(
        "chunk_id", "provider", "model", "model_revision", "dimensions", "processing_fingerprint", "embedding",
    ).join(reused, "chunk_id").drop("chunk_id").withColumnRenamed("_target", "chunk_id").withColumn(
        "created_at", now)
    return union_all(computed, copied)


def check_vectors(embeddings: DataFrame) -> DataFrame:
    """Violations: vector length differs from the declared dimensions, a number that is not finite, or a blank identity field."""
    blank = F.lit(False)
    for name in ("provider", "model", "model_revision", "processing_fingerprint"):
        blank = blank | F.col(name).isNull() | T.is_blank(F.col(name))
    found = (
        F.when(F.col("embedding").isNull() | (F.size("embedding") == 0), "empty vector")
        .when(F.size("embedding") != F.col("dimensions"), "dimension mismatch")
        .when(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "number not finite")
        .when(blank, "blank identity"))
    return embeddings.select("chunk_id", found.alias("violation")).where(F.col("violation").isNotNull())


def upsert_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per chunk, the new row wins."""
    return union_all(old.join(new.select("chunk_id"), "chunk_id", "left_anti"), new)


def embedding_coverage(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The stored fingerprint of every embedded chunk with its version."""
    return chunks.select("document_version_id", "chunk_id").join(
        embeddings.select("chunk_id", "processing_fingerprint"), "chunk_id")
