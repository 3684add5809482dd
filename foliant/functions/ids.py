"""Deterministic ids: name-based (MD5, version 3) UUIDs as lower-case strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_uuid(*parts: Column | str) -> Column:
    """Version-3 UUID of the parts joined by line feeds; strings are literals."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    digest = F.md5(F.concat_ws("\n", *columns).cast("binary"))
    # RFC 9562: the version nibble becomes 3, the top two bits of the variant nibble become 10.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-3"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def document_id(source_id: Column, external_document_id: Column) -> Column:
    return name_uuid("document", source_id, external_document_id)


def version_id(document: Column, version_number: Column) -> Column:
    return name_uuid("version", document, version_number)


def section_id(version: Column, stable_key: Column) -> Column:
    return name_uuid("section", version, stable_key)


def chunk_id(section: Column, chunk_index: Column) -> Column:
    return name_uuid("chunk", section, chunk_index)


def sha256_text(text: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes of a string."""
    return F.sha2(text.cast("binary"), 256)
