"""Sources A: files under a root folder."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.params import Limits
from foliant.sources.folder import FolderSource
from foliant.sources.tables import with_content_hash

# Format of each recognised file extension.
EXTENSION_FORMATS = {
    "txt": "TEXT",
    "md": "MARKDOWN",
    "markdown": "MARKDOWN",
    "html": "HTML",
    "htm": "HTML",
    "pdf": "PDF",
    "docx": "DOCX",
    "java": "SOURCE_CODE",
    "kt": "SOURCE_CODE",
    "kts": "SOURCE_CODE",
    "py": "SOURCE_CODE",
    "js": "SOURCE_CODE",
    "ts": "SOURCE_CODE",
    "cs": "SOURCE_CODE",
    "go": "SOURCE_CODE",
    "rs": "SOURCE_CODE",
}


def format_of(name: Column) -> Column:
    """Format by the extension of the last path part; null when it is not recognised."""
    extension = F.lower(F.regexp_extract(name, r"\.([^./]*)\z", 1))
    formats = sorted(set(EXTENSION_FORMATS.values()))
    return F.coalesce(*[
        F.when(extension.isin([e for e, f in EXTENSION_FORMATS.items() if f == fmt]), F.lit(fmt)) for fmt in formats
    ])


def detect_format(df: DataFrame, name: str = "external_document_id") -> DataFrame:
    """A2: add ``format``; null marks an unrecognised extension."""
    return df.withColumn("format", format_of(F.col(name)))


def file_metadata(df: DataFrame) -> DataFrame:
    """A3: add a ``metadata`` map to the columns of a binaryFile scan."""
    return df.withColumn("metadata", F.create_map(
        F.lit("fileName"), F.element_at(F.split("path", "/"), -1),
        F.lit("size"), F.col("length").cast("string"),
        F.lit("lastModified"), F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
    ))


def qualified(spark: SparkSession, root: str) -> str:
    """The root with scheme and authority, as tasks have to open it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def _named(files: DataFrame, source_id: str, base: str) -> DataFrame:
    """Add source_id, external_document_id (the path below ``base``) and format to listed files."""
    # Paths may be spelled with one or three slashes after the scheme.
    plain = F.regexp_replace("path", "^file:/+", "/")
    under = re.sub("^file:/+", "/", base).rstrip("/") + "/"
    # A root that is itself a file is known by its name.
    relative = F.when(F.startswith(plain, F.lit(under)), F.substr(plain, F.lit(len(under) + 1))).otherwise(F.element_at(F.split("path", "/"), -1))
    return detect_format(files.withColumns({"source_id": F.lit(source_id), "external_document_id": relative}))


def split_files(named: DataFrame, max_bytes: int = Limits().max_bytes) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected) of named files."""
    usable = (F.col("length") <= max_bytes) & F.col("format").isNotNull()
    documents = with_content_hash(file_metadata(named.where(usable))).select(
        "source_id", "external_document_id", "format", "content", "content_hash", "metadata")
    rejected = named.where(~usable).select("source_id", "external_document_id", F.when(
        F.col("format").isNull(), "unsupported format").otherwise("size limit").alias("violation"))
    return documents, rejected


def scan_files(
    spark: SparkSession, source_id: str, root: str, max_bytes: int = Limits().max_bytes
) -> tuple[DataFrame, DataFrame]:
    """A1: (documents, rejected) of all files under ``root``, names that begin with "_" or "." included.

    The driver lists the root only; tasks list and read the folders below it. An oversized or unrecognised file is listed but never read.
    """
    spark.dataSource.register(FolderSource)
    base = qualified(spark, root)

    def listed(content: str) -> DataFrame:
        files = spark.read.format("foliant_files").option("parts", str(spark.sparkContext.defaultParallelism)).option(
            "maxBytes", str(max_bytes)).option("extensions", ",".join(EXTENSION_FORMATS)).option("content", content).load(base)
        return _named(files, source_id, base)

    return split_files(listed("true"), max_bytes)[0], split_files(listed("false"), max_bytes)[1]


def stream_files(spark: SparkSession, source_id: str, root: str, files_per_batch: int = 1000) -> DataFrame:
    """A1 as a stream: named files of a folder as they arrive, for `foliant.plans.stream`. A file that is replaced arrives again.

    This is Spark's file stream, which keeps the list of seen files and leaves out names that begin with "_" or ".".
    """
    base = qualified(spark, root)
    files = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option(
        "maxFilesPerTrigger", str(files_per_batch)).load(base)
    return _named(files, source_id, base)
