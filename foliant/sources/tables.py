"""Sources A: documents that already lie in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import is_blank


def with_content_hash(df: DataFrame) -> DataFrame:
    """Lower-case hex SHA-256 of the raw bytes."""
    return df.withColumn("content_hash", F.sha2("content", 256))


def key_violation(source_id: Column, external_document_id: Column) -> Column:
    """A5: both halves of a document key are non-blank."""
    def missing(c: Column) -> Column:
        return c.isNull() | is_blank(c)

    return F.when(missing(source_id), "blank source id").when(missing(external_document_id), "blank document id")


def canonical_violation(external_document_id: Column) -> Column:
    """A4: a document id is a relative path without colon, NUL, blank, ``.`` or ``..`` parts."""
    bad_part = F.exists(F.split(external_document_id, "/", -1), lambda p: is_blank(p) | p.isin(".", ".."))
    bad = external_document_id.startswith("/") | external_document_id.rlike(r"[:\x00]") | bad_part
    return F.when(bad, "document id is not a canonical relative path")


def documents_from_table(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4: (documents, rejected) of a table with source_id, external_document_id and content.

    Back slashes become slashes first. Only text and Markdown extensions are accepted here.
    """
    named = df.withColumn("external_document_id", F.translate("external_document_id", "\\", "/"))
    ext = F.lower(F.element_at(F.split("external_document_id", r"\.", -1), -1))
    fmt = F.when(ext == "txt", "TEXT").when(ext.isin("md", "markdown"), "MARKDOWN")
    checked = named.withColumn("format", fmt).withColumn("violation", F.coalesce(
        key_violation(F.col("source_id"), F.col("external_document_id")),
        canonical_violation(F.col("external_document_id")),
        F.when(F.col("format").isNull(), "unsupported format"),
    ))
    documents = with_content_hash(checked.where(F.col("violation").isNull()).drop("violation"))
    rejected = checked.where(F.col("violation").isNotNull()).drop("content", "format")
    return documents, rejected
