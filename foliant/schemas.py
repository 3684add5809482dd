"""Table schemas of the engine."""

from __future__ import annotations

SOURCE = (
    "source_id string, source_type string, name string, description string, "
    "update_policy string, pipeline_id string, configuration map<string,string>"
)
DOCUMENT = "document_id string, source_id string, external_document_id string, created_at timestamp"
DOCUMENT_VERSION = (
    "document_version_id string, document_id string, version_number long, format string, "
    "content_hash string, content binary, status string, created_at timestamp, activated_at timestamp"
)
SECTION = (
    "section_id string, document_version_id string, stable_key string, parent_id string, "
    "section_order int, title string, level int, content string, content_hash string, "
    "title_path array<string>, processing_fingerprint string"
)
CHUNK = (
    "chunk_id string, section_id string, document_version_id string, document_id string, "
    "source_id string, external_document_id string, section_title string, chunk_index int, "
    "content string, content_hash string, split_section boolean, processing_fingerprint string"
)
EMBEDDING = (
    "chunk_id string, document_version_id string, source_id string, provider string, model string, model_revision string, dimensions int, "
    "processing_fingerprint string, embedding array<float>, created_at timestamp"
)
POSTING = (
    "term string, chunk_id string, document_version_id string, source_id string, "
    "positions array<struct<pos:int,w:string>>"
)
PREVIEW = (
    "preview_id string, source_id string, external_document_id string, format string, content binary, "
    "content_hash string, baseline_version_id string, status string, can_confirm boolean, "
    "force_reindex boolean, changes struct<previous:long,incoming:long,unchanged:long,added:long,removed:long>, "
    "expires_at timestamp"
)
BUILD_LOG = (
    "batch_id string, document_version_id string, stage string, status string, fingerprint string, "
    "started_at timestamp, completed_at timestamp, error string"
)

# Membership of the string-typed enumerations.
VERSION_STATUSES = ("BUILDING", "ACTIVE", "INACTIVE", "FAILED")
CHANGE_STATUSES = ("NEW", "UNCHANGED", "CHANGED")
BUILD_DECISIONS = ("BUILD", "SKIP", "REQUIRE_VERSION_RESOLUTION")
UPDATE_POLICIES = ("AUTHORITATIVE_SNAPSHOT", "REQUIRE_VERSION_RESOLUTION")
FORMATS = ("TEXT", "MARKDOWN", "HTML", "PDF", "DOCX", "SOURCE_CODE")
INGESTIBLE_FORMATS = ("TEXT", "MARKDOWN")
