"""Operators F: the retrieval index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T

#: Tokens that a task groups at a time; a chunk with more is grouped on its own.
GROUPED_TOKENS = 1 << 17


def index_completeness(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """per version the numbers of chunks and of embedded chunks, and whether the version may be indexed."""
    joined = chunks.select("document_version_id", "chunk_id").join(
        embeddings.select("chunk_id", F.lit(1).alias("_e")), "chunk_id", "left")
    return joined.groupBy("document_version_id").agg(
        F.count("*").alias("chunk_count"), F.count("_e").alias("embedding_count")).withColumn(
        "complete", F.col("chunk_count") == F.col("embedding_count"))


def build_postings(chunks: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """one row per (chunk, term) with the positions of the term and their weight (A title, B content).

    Content positions continue after the title's. Only embedded chunks are indexed when ``embeddings`` is given. A chunk is one row of
    bounded size, so its tokens are grouped where it lies, by columns of many chunks at a time: nothing is shuffled, and the postings of a
    chunk stay together.
    """
    if embeddings is not None:
        chunks = chunks.join(embeddings.select("chunk_id"), "chunk_id", "left_semi")
    title, body = T.words(F.coalesce("section_title", F.lit(""))), T.words(F.col("content"))
    split = chunks.select("chunk_id", "document_version_id", "source_id", F.size(title).alias("titles"), F.concat(title, body).alias("terms"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in split.schema if f.name not in ("titles", "terms"))
    return split.mapInArrow(_by_term, f"term string, {kept}, positions array<struct<pos: int, w: string>>")


def _by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (term, positions) from the tokens of a title and of the text after it, in the order of terms inside a chunk."""
    for rows in batches:
        sizes = pc.fill_null(pc.list_value_length(rows.column("terms")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = (np.cumsum(sizes) - sizes) // GROUPED_TOKENS
        borders = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
        for start, end in zip(borders, borders[1:]):
            some, size = rows.slice(start, end - start), sizes[start:end]
            tokens = some.column("terms").flatten()
            if not len(tokens):
                continue
            row = np.repeat(np.arange(len(size)), size)
            position = np.arange(1, len(tokens) + 1) - np.repeat(np.cumsum(size) - size, size)
            coded = tokens.dictionary_encode()
            by_name = pc.sort_indices(coded.dictionary).to_numpy()
            place = np.empty(len(by_name), np.int64)
            place[by_name] = np.arange(len(by_name))
            # Stable, so the positions of a term stay in order.
            key = row * len(by_name) + place[coded.indices.to_numpy()]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            position, owner = position[order], row[order]
            titles = some.column("titles").to_numpy(zero_copy_only=False)
            weight = pa.array(["A", "B"]).take(pa.array((position > titles[owner]).astype(np.int8)))
            positions = pa.ListArray.from_arrays(
                pa.array(np.append(first, len(key)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(position.astype(np.int32)), weight], names=["pos", "w"]))
            kept = some.drop_columns(["titles", "terms"]).take(pa.array(owner[first]))
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(by_name[key[first] % len(by_name)])), *kept.columns, positions], names=["term", *kept.schema.names, "positions"])


def backfill_postings(chunks: DataFrame, postings: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """postings of the chunks that have none yet, to be appended."""
    missing = chunks.join(postings.select("chunk_id"), "chunk_id", "left_anti")
    return build_postings(missing, embeddings)


def term_stats(postings: DataFrame) -> DataFrame:
    """number of chunks per term; combined before the shuffle, so frequent terms cost one row per task."""
    return postings.groupBy("term").agg(F.count("*").alias("n"))
