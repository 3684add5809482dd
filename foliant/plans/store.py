"""Operators A9, A10: the table store.

Tables are append-only Parquet folders partitioned by ``generation``, the number of the batch that wrote the rows. A
batch writes all its tables first; then one small ``commit`` file makes the generation visible in every table at once.
When a version is written again, the rows of its latest committed generation replace the earlier ones for readers.
Nothing is rewritten, so a lost executor or a failed batch leaves the visible state as it was.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import schemas
from foliant.operators.versions import current_status
from foliant.session import empty, writer

# Tables whose rows belong to a document version and are replaced together with it.
VERSIONED = ("section", "chunk", "embedding", "posting")
TABLES = {
    "document": schemas.DOCUMENT,
    "document_version": (
        "document_version_id string, document_id string, version_number long, format string, content_hash string, "
        "content binary, created_at timestamp"),
    "status_event": "document_version_id string, document_id string, status string, seq long, at timestamp",
    "section": schemas.SECTION,
    "chunk": schemas.CHUNK,
    "embedding": schemas.EMBEDDING,
    "posting": schemas.POSTING,
    "build_log": schemas.BUILD_LOG,
    "manifest": "document_version_id string, table_name string",
}
# Batch-local tables with a schema of their own: written once to cut lineage, never read by later batches. All but the report, which
# is handed out, are dropped when the batch is committed.
STAGING = ("parsed", "reparsed", "plan", "report")
# The record of a batch's model calls, which stays: the distinct texts that were sent and the vectors that came back.
CALLS = ("text", "vector")


class Store:
    """A folder of tables on storage that every executor reaches. ``upto``: see only the batches up to that one (see `as_of`)."""

    def __init__(self, spark: SparkSession, root: str, upto: int | None = None):
        self.spark, self.root, self._upto = spark, root.rstrip("/"), upto
        self._commits: list[int] | None = None

    def as_of(self, generation: int) -> Store:
        """The store as it was when ``generation`` was committed, to read from."""
        return Store(self.spark, self.root, generation)

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _exists(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def commits(self) -> list[int]:
        """Committed generations: one number per batch. Read once, so that a batch works on one snapshot; see `refresh`."""
        if self._commits is None:
            self._commits = []
            if self._exists("commit"):
                rows = self.spark.read.schema("generation long, at timestamp").parquet(self._path("commit")).select("generation")
                self._commits = sorted(r[0] for r in rows.distinct().collect() if self._upto is None or r[0] <= self._upto)
        return self._commits

    def refresh(self) -> None:
        """Look at the commits of other writers again."""
        self._commits = None

    def written(self, table: str) -> list[int]:
        """Generations that have a folder in a table, committed or not."""
        if not self._exists(table):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(table))
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        names = [s.getPath().getName() for s in found]
        return [int(n.split("=")[1]) for n in names if n.startswith("generation=")]

    def next_generation(self) -> int:
        """A number above every one ever used, so that leftovers of a failed batch can never become visible. It is claimed by
        creating a file, which only one writer can do, so batches that run at once get different numbers."""
        self.refresh()
        number = max([0, *self.commits(), *[g for t in [*TABLES, *STAGING, *CALLS, "claim"] for g in self.written(t)]]) + 1
        while not self._claim(number):
            number += 1
        return number

    def _claim(self, number: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path('claim')}/generation={number}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            system.create(path, False).close()
        except Py4JJavaError:
            if system.exists(path):
                return False
            raise
        return True

    def append(self, table: str, df: DataFrame, generation: int) -> DataFrame:
        """Write one batch's rows of a table and return them as read back, which cuts the lineage. What an earlier attempt of the same
        batch left there is written over."""
        if table not in (*TABLES, *STAGING, *CALLS):
            raise ValueError(f"unknown table {table}")
        if generation in self.commits():
            raise ValueError(f"generation {generation} is already committed")
        path = f"{self._path(table)}/generation={generation}"
        writer(df).mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_staging(self, generation: int) -> None:
        """Free the room of a committed batch's own tables. Nobody reads them again: only a batch without a commit is resumed."""
        if generation not in self.commits():
            raise ValueError(f"generation {generation} is not committed")
        for table in STAGING:
            if table != "report":
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(table)}/generation={generation}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def batch_rows(self, table: str, generation: int, schema=None) -> DataFrame:
        """What one batch wrote to a table, committed or not."""
        known = schema or TABLES.get(table)
        reader = self.spark.read.schema(known) if known else self.spark.read
        return reader.parquet(f"{self._path(table)}/generation={generation}")

    def commit(self, generation: int) -> None:
        """Make the generation visible. A single file, moved into place at once."""
        self.spark.range(1).select(F.lit(generation).cast("long").alias("generation"), F.current_timestamp().alias("at")).coalesce(
            1).write.mode("append").parquet(self._path("commit"))
        self.refresh()

    def with_generation(self, table: str) -> DataFrame:
        """Rows of committed generations with their ``generation``; the filter prunes partitions."""
        schema = TABLES[table]
        committed = self.commits()
        if not committed or not self._exists(table):
            return empty(self.spark, schema + ", generation long")
        rows = self.spark.read.schema(schema + ", generation long").option("basePath", self._path(table)).parquet(self._path(table))
        return rows.where(F.col("generation").isin(committed))

    def read(self, table: str) -> DataFrame:
        """The visible rows of a table."""
        rows = self.with_generation(table)
        if table not in VERSIONED:
            return rows.drop("generation")
        written = self.with_generation("manifest").where(F.col("table_name") == table)
        # Versions written more than once are few, so the superseded pairs are a small anti-join side in most stores.
        latest = written.groupBy("document_version_id").agg(F.max("generation").alias("_latest"), F.count("*").alias("_n")).where(
            "_n > 1").drop("_n")
        superseded = written.join(latest, "document_version_id").where(F.col("generation") < F.col("_latest")).select(
            "document_version_id", "generation")
        return rows.join(superseded, ["document_version_id", "generation"], "left_anti").drop("generation")

    def write_version_partitions(self, table: str, df: DataFrame, generation: int, versions: DataFrame | None = None) -> DataFrame:
        """The rows of each version in ``df`` become its only visible rows once the generation is committed.

        ``versions`` names versions whose new set may be empty; by default the versions that occur in ``df``.
        """
        written = self.append(table, df, generation)
        ids = (versions if versions is not None else written).select("document_version_id").distinct()
        writer(ids).mode("overwrite").parquet(f"{self._path('manifest')}/generation={generation}/table_name={table}")
        return written

    def versions(self) -> DataFrame:
        """Versions with their current status, without the document bytes."""
        rows = self.read("document_version").drop("content")
        return rows.join(current_status(self.read("status_event")), "document_version_id")

    def read_version(self, table: str, version_ids: DataFrame) -> DataFrame:
        """A10: the visible rows of some versions, sections by order, chunks by (section order, index)."""
        ids = version_ids.select("document_version_id").distinct()
        rows = self.read(table).join(ids, "document_version_id", "left_semi")
        if table == "section":
            return rows.orderBy("document_version_id", "section_order")
        if table == "chunk":
            order = self.read("section").join(ids, "document_version_id", "left_semi").select("section_id", "section_order")
            return rows.join(order, "section_id").orderBy("document_version_id", "section_order", "chunk_index")
        return rows
