"""Operator G13 as a stream: every micro-batch of files is one batch of a store.

Structured Streaming delivers a micro-batch again when the driver died before it was marked as done. The number of the store's
batch is therefore kept per (stream, micro-batch): a delivery whose batch is committed writes nothing, one whose batch was cut is
carried on from the stage it had reached.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.embeddings import Embedder
from foliant.params import Limits
from foliant.plans.ingest import ingest_batch, resume_batch
from foliant.plans.stages import has_begun
from foliant.plans.store import Store
from foliant.sources.files import split_files

DELIVERIES = "stream string, micro_batch long, generation long"
REJECTED = "source_id string, external_document_id string, violation string"


def _folder(store: Store, table: str) -> str:
    return f"{store.root}/{table}"


def deliveries(store: Store) -> DataFrame:
    """(stream, micro_batch, generation): which batches of the store a micro-batch has been given, the latest with the largest number."""
    return store.spark.read.schema(DELIVERIES).parquet(_folder(store, "delivery")) if store._exists("delivery") else (
        store.spark.createDataFrame([], DELIVERIES))


def rejected_files(store: Store) -> DataFrame:
    """Files that streams could not take as documents, by micro-batch."""
    schema = f"{REJECTED}, stream string, micro_batch long"
    return store.spark.read.schema(schema).parquet(_folder(store, "rejected_file")) if store._exists("rejected_file") else (
        store.spark.createDataFrame([], schema))


def deliver(
    store: Store, files: DataFrame, stream: str, micro_batch: int, sources: DataFrame, embedder: Embedder,
    limits: Limits = Limits(), **options,
) -> str:
    """Take one micro-batch of named files into the store, once; returns COMMITTED, RESUMED or KNOWN. ``options`` go to `ingest_batch`;
    a batch that is carried on takes those of them that `resume_batch` has."""
    store.refresh()
    given = deliveries(store).where((F.col("stream") == stream) & (F.col("micro_batch") == micro_batch)).agg(F.max("generation")).first()[0]
    if given in store.commits():
        return "KNOWN"
    if given is not None and has_begun(store, given):
        resume_batch(store, given, embedder, limits, **{k: v for k, v in options.items() if k != "force"})
        return "RESUMED"
    generation = store.next_generation()
    row = store.spark.createDataFrame([(stream, micro_batch, generation)], DELIVERIES)
    row.coalesce(1).write.mode("append").parquet(_folder(store, "delivery"))
    documents, rejected = split_files(files, limits.max_bytes)
    # One folder per micro-batch, written over by a repeated delivery.
    rejected.select(*[part.split()[0] for part in REJECTED.split(", ")]).write.mode("overwrite").parquet(
        f"{_folder(store, 'rejected_file')}/stream={stream}/micro_batch={micro_batch}")
    ingest_batch(store, documents, sources, embedder, limits, generation=generation, **options)
    return "COMMITTED"


def ingest_stream(
    store: Store, files: DataFrame, stream: str, sources: DataFrame, embedder: Embedder, checkpoint: str,
    limits: Limits = Limits(), after: Callable[[int], None] = lambda micro_batch: None, every: str | None = None, **options,
) -> StreamingQuery:
    """Start taking a stream of named files (`stream_files`) into a store. By default everything available is taken and the query ends;
    ``every`` is the interval of a query that goes on. ``after`` runs at the end of each batch, for example to publish a search index."""
    def run(batch: DataFrame, micro_batch: int) -> None:
        deliver(store, batch, stream, micro_batch, sources, embedder, limits, **options)
        after(micro_batch)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).queryName(stream).trigger(**trigger).start()
