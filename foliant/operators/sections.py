"""Operators C: documents to sections.

A document is one row of at most ``Limits.max_bytes``, so sectioning works inside the row: two regular expressions find
the headings outside fences, one fold over the headings derives parents and stable keys. No shuffle is needed before
the sections are exploded.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from foliant.functions import ids, text as T
from foliant.functions.rows import unnest
from foliant.params import PARSER_VERSION, Limits
from foliant.session import union_all

ROOT = "root"


def decode_text(df: DataFrame) -> DataFrame:
    """Add ``text``."""
    return df.withColumn("text", T.decode_text(F.col("content")))


def markdown_lines(df: DataFrame) -> DataFrame:
    """One row per line of ``text`` with its number and whether it lies in a fenced block."""
    rest = [c for c in df.columns if c not in ("text", "content")]
    return unnest(df, rest, T.fence_lines(F.col("text")), "_l", "line_no").select(
        *rest, "line_no", F.col("_l.line").alias("line"), F.col("_l.in_fence").alias("in_fence"))


@F.pandas_udf(ArrayType(StringType()))
def _nfkc(titles: pd.Series) -> pd.Series:
    return titles.map(lambda ts: None if ts is None else [unicodedata.normalize("NFKC", t) for t in ts])


def _heads(df: DataFrame) -> DataFrame:
    """Add ``_pieces`` (text before each heading) and ``_titles``, ``_levels``, ``_slugs`` of the headings."""
    markdown = F.col("format") == "MARKDOWN"
    pieces = df.withColumn("_pieces", F.when(markdown, T.markdown_pieces(F.col("text"))).otherwise(F.array("text")))
    heads = (
        pieces.withColumn("_heads", F.slice("_pieces", F.lit(2), F.greatest(F.size("_pieces") - 1, F.lit(0))))
        .withColumn("_levels", F.transform("_heads", T.heading_level))
        .withColumn("_titles", F.transform("_heads", T.heading_title))
    )
    # Only titles with characters outside ASCII can change under NFKC; the others never reach Python.
    foreign = F.exists("_titles", lambda t: t.rlike(r"[^\x00-\x7F]"))
    return heads.withColumn("_normal", F.coalesce(_nfkc(F.when(foreign, F.col("_titles"))), F.col("_titles"))).withColumn(
        "_slugs", F.transform("_normal", T.slug)).drop("_heads", "_normal")


def _outline() -> Column:
    """Fold over the headings: index of the parent, stable key and title path of every section; index 0 is the root.

    ``latest[l]`` is the index of the latest heading of level l, so the nearest earlier heading above level L is the
    largest of latest[0..L-1]. A repeated base key gets ``#2``, ``#3`` and so on; ``root`` is taken from the start.
    """
    start = F.struct(
        F.array([F.lit(0)] + [F.lit(-1)] * 6).alias("latest"),
        F.array(F.lit(-1)).alias("parents"),
        F.array(F.lit(ROOT)).alias("bases"),
        F.array(F.lit(ROOT)).alias("keys"),
        F.array(F.array().cast("array<string>")).alias("paths"),
    )
    numbered = F.zip_with(
        F.arrays_zip(F.col("_levels").alias("level"), F.col("_slugs").alias("slug")), F.col("_titles"),
        lambda h, t: F.struct(h["level"].alias("level"), h["slug"].alias("slug"), t.alias("title")),
    )

    def step(acc: Column, h: Column) -> Column:
        index = F.size(acc["keys"])
        parent = F.array_max(F.slice(acc["latest"], F.lit(1), h["level"]))
        base = F.when(parent == 0, h["slug"]).otherwise(F.concat(F.get(acc["keys"], parent), F.lit("/"), h["slug"]))
        earlier = F.size(acc["bases"]) - F.size(F.array_remove(acc["bases"], base))
        key = F.when(earlier == 0, base).otherwise(F.concat(base, F.lit("#"), (earlier + 1).cast("string")))
        above = F.get(acc["paths"], parent)
        path = F.when(F.coalesce(h["title"], F.lit("")) == "", above).otherwise(F.concat(above, F.array(h["title"])))
        return F.struct(
            F.transform(acc["latest"], lambda v, level: F.when(level == h["level"], index).otherwise(v)).alias("latest"),
            F.concat(acc["parents"], F.array(parent)).alias("parents"),
            F.concat(acc["bases"], F.array(base)).alias("bases"),
            F.concat(acc["keys"], F.array(key)).alias("keys"),
            F.concat(acc["paths"], F.array(path)).alias("paths"),
        )

    return F.aggregate(numbered, start, step)


def headings(df: DataFrame) -> DataFrame:
    """C4: one row per heading outside fences: order within the document, level, title, slug."""
    rest = [c for c in df.columns if c not in ("text", "content")]
    rows = F.arrays_zip(F.col("_levels").alias("level"), F.col("_titles").alias("title"), F.col("_slugs").alias("slug"))
    return unnest(_heads(df), rest, rows, "_h", "_i").select(
        *rest, (F.col("_i") + 1).alias("section_order"),
        F.col("_h.level").alias("level"), F.col("_h.title").alias("title"), F.col("_h.slug").alias("slug"))


def section_arrays(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """C2-C8 inside the row: add ``section_count`` and ``sections``, an array of structs in document order.

    The fold over headings runs only for documents within the section limit; the others get a null array and are
    refused by the contract on ``section_count``.
    """
    heads = _heads(df).withColumn("section_count", F.size("_pieces"))
    within = F.col("section_count") <= limits.max_sections
    outlined = heads.withColumn("_outline", F.when(within, _outline()))

    def section(piece: Column, i: Column) -> Column:
        parent = F.get(F.col("_outline.parents"), i)
        body = T.trim_blank_lines(T.without_marks(T.after_first_line(piece)))
        first = F.when(F.col("format") == "MARKDOWN", T.trim_blank_lines(T.without_marks(piece))).otherwise(piece)
        return F.struct(
            F.get(F.col("_outline.keys"), i).alias("stable_key"),
            F.when(i > 0, F.get(F.col("_outline.keys"), parent)).alias("parent_key"),
            F.when(i > 0, F.get(F.col("_titles"), i - 1)).alias("title"),
            F.when(i > 0, F.get(F.col("_levels"), i - 1)).otherwise(0).alias("level"),
            F.get(F.col("_outline.paths"), i).alias("title_path"),
            F.when(i > 0, body).otherwise(first).alias("content"),
        )

    return outlined.withColumn("sections", F.when(within, F.transform("_pieces", section))).drop(
        "_pieces", "_levels", "_titles", "_slugs", "_outline")


def text_sections(df: DataFrame) -> DataFrame:
    """The single root section of a TEXT document, content untrimmed."""
    rest = [c for c in df.columns if c not in ("text", "content")]
    return df.select(*rest, F.lit(ROOT).alias("stable_key"), F.lit(None).cast("string").alias("title"),
                     F.lit(0).alias("level"), F.col("text").alias("content"))


def parse_fingerprint(df: DataFrame) -> DataFrame:
    """C11: SHA-256 of parser version, format and content hash."""
    source = F.concat(F.lit(f"{PARSER_VERSION}\nformat="), F.col("format"), F.lit("\ncontentHash="), F.col("content_hash"))
    return df.withColumn("parse_fingerprint", ids.sha256_text(source))


def section_rows(parsed: DataFrame) -> DataFrame:
    """Explode ``sections`` into rows with ids, parent ids, order and content hash."""
    version = F.col("document_version_id")
    keep = [c for c in parsed.columns if c not in ("sections", "section_count", "text", "content", "content_hash",
                                                   "format", "parse_fingerprint")]
    rows = unnest(
        parsed, [*keep, F.col("parse_fingerprint").alias("processing_fingerprint")], F.col("sections"), "_s", "section_order")
    return rows.select(
        *keep,
        ids.section_id(version, F.col("_s.stable_key")).alias("section_id"),
        F.col("_s.stable_key").alias("stable_key"),
        F.when(F.col("_s.parent_key").isNotNull(), ids.section_id(version, F.col("_s.parent_key"))).alias("parent_id"),
        "section_order",
        F.col("_s.title").alias("title"),
        F.col("_s.level").alias("level"),
        F.col("_s.content").alias("content"),
        ids.sha256_text(F.col("_s.content")).alias("content_hash"),
        F.col("_s.title_path").alias("title_path"),
        *([F.col("_s.chunks").alias("chunks")] if "chunks" in parsed.schema["sections"].dataType.elementType.names else []),
        "processing_fingerprint",
    )


def check_sections(sections: DataFrame) -> DataFrame:
    """Violations of a section table as (document_version_id, section_id, violation)."""
    s = sections.select("document_version_id", "section_id", "stable_key", "parent_id")
    out = ["document_version_id", "section_id", "violation"]
    blank = s.where(F.col("stable_key").isNull() | T.is_blank(F.col("stable_key"))).withColumn(
        "violation", F.lit("blank stable key"))
    repeated = (
        s.groupBy("document_version_id", "stable_key").agg(F.count("*").alias("n"), F.min("section_id").alias("section_id"))
        .where("n > 1").withColumn("violation", F.lit("repeated stable key"))
    )
    own = s.where(F.col("parent_id") == F.col("section_id")).withColumn("violation", F.lit("section is its own parent"))
    parents = s.select(F.col("section_id").alias("parent_id"), F.col("document_version_id").alias("_v"))
    linked = s.where(F.col("parent_id").isNotNull()).join(parents, "parent_id", "left")
    missing = linked.where(F.col("_v").isNull()).withColumn("violation", F.lit("parent section missing"))
    foreign = linked.where(F.col("_v") != F.col("document_version_id")).withColumn(
        "violation", F.lit("parent section in another version"))
    return union_all(*[part.select(out) for part in (blank, repeated, own, missing, foreign)])
