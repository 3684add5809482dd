"""Views over the given tables that stand in for documents, histories and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import ids
from foliant.functions.skew import number_rows
from foliant.functions.text import words
from foliant.operators.postings import build_postings
from foliant.params import Limits
from foliant.session import cut_lineage, spread, union_all
from foliant.sources.registry import with_source_defaults
from foliant.sources.tables import with_content_hash


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of texts to parse."""
    return spread(table(spark, sf, name))


def _documents(df: DataFrame) -> DataFrame:
    """doc columns from source_id, external_document_id, format and text."""
    return with_content_hash(df.withColumn("content", F.col("text").cast("binary")).drop("text"))


def corpus(spark: SparkSession, sf: str, paragraphs: bool = False) -> DataFrame:
    """V1: ``documents`` as text files. ``paragraphs`` doubles every line feed."""
    text = F.replace("text", F.lit("\n"), F.lit("\n\n")) if paragraphs else F.col("text")
    return _documents(texts(spark, sf, "documents").select(
        F.col("source").alias("source_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("external_document_id"),
        F.lit("TEXT").alias("format"), text.alias("text")))


def revised(spark: SparkSession, sf: str, paragraphs: bool = False) -> DataFrame:
    """V2: the next revision of V1, and every conversation as a new document."""
    return union_all(edited(spark, sf, paragraphs), conversations(spark, sf))


def edited(spark: SparkSession, sf: str, paragraphs: bool = False) -> DataFrame:
    """The next revision of V1, edited by language: en the same bytes, fr without the first line, de with a line more, es with the
    lines reversed."""
    lines = F.split("text", "\n", -1)
    changed = (
        F.when(F.col("lang") == "fr", F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n"))
        .when(F.col("lang") == "de", F.concat(F.col("text"), F.lit("\nAdded closing line.")))
        .when(F.col("lang") == "es", F.array_join(F.reverse(lines), "\n"))
        .otherwise(F.col("text")))
    text = F.replace(changed, F.lit("\n"), F.lit("\n\n")) if paragraphs else changed
    return _documents(texts(spark, sf, "documents").select(
        F.col("source").alias("source_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("external_document_id"),
        F.lit("TEXT").alias("format"), text.alias("text")))


def conversations(spark: SparkSession, sf: str, fenced: bool = False) -> DataFrame:
    """V3: one Markdown document per conversation; user turns are level 2, assistant turns 3, system turns 5.

    A conversation over the document size limit is refused by the contract whatever it says, so it is not put together: it
    becomes a document without content. Only lists of bounded size are collected. ``fenced`` puts assistant texts into fenced
    blocks that begin with a line that looks like a heading.
    """
    turns = table(spark, sf, "conversations")
    marks = F.when(F.col("role") == "user", "## ").when(F.col("role") == "assistant", "### ").otherwise("##### ")
    text = F.col("text")
    if fenced:
        text = F.when(F.col("role") == "assistant", F.concat(F.lit("```text\n# not a heading\n"), text, F.lit("\n```"))).otherwise(text)
    part = F.concat(marks, F.col("role"), F.lit("\n\n"), text)
    title = F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"))
    sizes = turns.groupBy("conv_id").agg((F.sum(F.octet_length(part) + 2) - 2).alias("_size")).withColumn(
        "_small", F.col("_size") + F.octet_length(title) <= Limits().max_bytes)
    ordered = F.sort_array(F.collect_list(F.struct("turn", part.alias("part"))))
    body = turns.join(sizes.where("_small").select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(ordered.alias("_t"))
    whole = F.concat(title, F.array_join("_t.part", "\n\n"))
    body = union_all(body, sizes.where("not _small").select("conv_id", F.lit(None).cast(body.schema["_t"].dataType).alias("_t")))
    return _documents(body.select(
        F.lit("conversations").alias("source_id"), F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit(".md")).alias("external_document_id"),
        F.lit("MARKDOWN").alias("format"), whole.alias("text")))


def first_versions(docs: DataFrame, number: int = 1) -> DataFrame:
    """Documents with the ids of their document and of version ``number``."""
    return docs.withColumn("document_id", ids.document_id(F.col("source_id"), F.col("external_document_id"))).withColumn(
        "document_version_id", ids.version_id(F.col("document_id"), F.lit(number)))


def history(spark: SparkSession, sf: str) -> DataFrame:
    """V4: the events of a user in order are the versions of one document. A user may own most of the events."""
    events = table(spark, sf, "events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("external_document_id"), "ts", "event_id", "event_type", "value",
        ids.document_id(F.lit("events"), F.concat(F.lit("user-"), F.col("user_id").cast("string"))).alias("document_id"))
    return number_rows(events, ["document_id"], ["ts", "event_id"], "version_number")


def version_table(spark: SparkSession, sf: str) -> DataFrame:
    """V4 as a version table: the newest version is FAILED, BUILDING or ACTIVE by its event type, older ones INACTIVE or FAILED."""
    rows = history(spark, sf)
    newest = rows.groupBy("document_id").agg(F.max("version_number").alias("_newest"))
    kind = F.col("event_type")
    status = F.when(kind == "error", "FAILED").when(F.col("version_number") < F.col("_newest"), "INACTIVE").when(
        kind == "click", "BUILDING").otherwise("ACTIVE")
    return rows.join(newest, "document_id").withColumn("status", status).select(
        ids.version_id(F.col("document_id"), F.col("version_number")).alias("document_version_id"), "document_id", "version_number",
        F.sha2(kind, 256).alias("content_hash"), "status",
        F.when(F.col("status").isin("ACTIVE", "INACTIVE"), F.col("ts")).alias("activated_at"), F.col("ts").alias("created_at"),
        (F.col("version_number") == F.col("_newest")).alias("newest"), "value", F.col("event_type"))


def sources(spark: SparkSession, sf: str, everywhere: bool = False) -> DataFrame:
    """Source dimension from nation and region: Africa and Asia are authoritative. Europe is configured only with ``everywhere``, so
    that documents of unknown sources exist."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey).where(F.lit(everywhere) | (F.col("r_name") != "EUROPE")).select(
        F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source_id"), F.lit("LOCAL_FILE").alias("source_type"),
        F.col("n_name").alias("name"), F.concat(F.lit("Documents about "), F.col("r_name")).alias("description"),
        F.when(F.col("r_name").isin("AFRICA", "ASIA"), "AUTHORITATIVE_SNAPSHOT").alias("update_policy"),
        F.lit(None).cast("string").alias("pipeline_id"))
    extra = spark.range(1).select(
        F.lit("conversations").alias("source_id"), F.lit("LOCAL_FILE").alias("source_type"), F.lit("conversations").alias("name"),
        F.lit("Recorded talks").alias("description"), F.lit(None).cast("string").alias("update_policy"),
        F.lit("talks").alias("pipeline_id"))
    return with_source_defaults(union_all(rows, extra))


def passages(spark: SparkSession, sf: str, phrase: bool = False) -> DataFrame:
    """V6: every benchmark text as a query: all its words AND-ed (each quoted, so that none is an operator), or one phrase."""
    tokens = words(F.col("text"))
    query = F.concat(F.lit('"'), F.array_join(tokens, " " if phrase else '" "'), F.lit('"'))
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), query.alias("query"))


def whole_document_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Postings with a whole document as one chunk, for passages that cross chunk borders. Written out, as an index is."""
    return cut_lineage(build_postings(texts(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("document_version_id"),
        F.col("source").alias("source_id"), F.lit(None).cast("string").alias("section_title"), F.col("text").alias("content"))))
