"""Session helpers: settings the engine relies on, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

# Time zone for repeatable timestamps, AQE for run-time join and partition choices.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("foliant")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a plain scan that has fewer partitions than the cluster has cores.

    A file of a single row group cannot be split by the scan, and parsing text costs far more than moving it once. A scan
    with enough partitions is left as it is, so large inputs are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    partitions = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if partitions < cores else df


def union_all(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Union by column name.

    Spark 4.1 lets a union report the common partitioning of its children. Where adaptive execution reuses one of them
    with another partition layout, a following aggregate then skips its shuffle and splits groups. The report is
    switched off for the session; all that is lost is a shuffle saved now and then.
    """
    first.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(DataFrame.unionByName, rest, first)


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    """A table without rows that the optimizer knows to be empty, so that joins with it fall away."""
    fields = _parse_datatype_string(ddl).fields
    return spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).limit(0)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests on one machine) does the session get a folder of its own; on a
    cluster a folder of the driver would be another one on each executor, so there it is an error.
    """
    context = spark.sparkContext
    setting = "spark.checkpoint.dir"
    named = spark.conf.get(setting, None) or context.getConf().get(setting, None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError(f"{setting} is unset: the cluster has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="foliant-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def writer(df: DataFrame) -> DataFrameWriter:
    """A writer of tables in zstandard: texts and ids take about two thirds of the room that Spark's default gives them."""
    return df.write.option("compression", "zstd")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the shared checkpoint folder and read it back.

    The data outlive any executor, and the read-back table is columnar with known size, so later steps prune columns and
    choose joins by it.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    writer(df).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
