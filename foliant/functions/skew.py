"""Helpers for keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import cut_lineage

# A key is heavy when it holds more than 1/SLOTS of all rows, so there are fewer than SLOTS heavy keys: a proven bound
# for collecting and broadcasting them.
SLOTS = 2048
MIN_HEAVY_ROWS = 100_000


def heavy_keys(counts: DataFrame, key: str, count: str = "n", min_rows: int = MIN_HEAVY_ROWS) -> list[tuple]:
    """(key, salts) of the heavy keys, from one row per key with its number of rows."""
    total, largest = counts.agg(F.sum(count), F.max(count)).first()
    if not total or largest <= min_rows:
        return []
    threshold = max(min_rows, -(-total // SLOTS))
    heavy = counts.where(F.col(count) > threshold).select(
        key, F.ceil(F.col(count) / threshold).cast("int").alias("salts"))
    return [tuple(row) for row in heavy.collect()]


def salted_join(
    big: DataFrame, small: DataFrame, key: str, spread: Column, counts: DataFrame, count: str = "n",
    min_rows: int = MIN_HEAVY_ROWS,
) -> DataFrame:
    """Inner equi-join in which the rows of a heavy key of ``big`` are spread over several tasks.

    ``spread`` is a column of ``big`` that differs between the rows of one key. ``counts`` has one row per key of
    ``big``. Without heavy keys this is the plain join.
    """
    heavy = heavy_keys(counts, key, count, min_rows)
    if not heavy:
        return big.join(small, key)
    salts = F.broadcast(big.sparkSession.createDataFrame(
        heavy, f"{key} {big.schema[key].dataType.simpleString()}, _salts int"))
    salted_big = (
        big.join(salts, key, "left")
        .withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int")))
        .drop("_salts")
    )
    salted_small = (
        small.join(salts, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return salted_big.join(salted_small, [key, "_salt"]).drop("_salt")


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """1-based position of each row among the rows of its key, where one key may hold most of the rows.

    Rows are range-partitioned by (keys, order), so a heavy key covers several partitions of normal size. The partition
    of each row is written out, rows are numbered inside (partition, key), and the rows of a key in earlier partitions
    are added. Only keys that cross a partition border need that addition: fewer than two rows per partition, hence
    the broadcast. ``order`` must be unique within a key.
    """
    ranged = cut_lineage(
        df.repartitionByRange(*[F.col(c) for c in keys + order]).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part", *keys).orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part", *keys).count()
        .withColumn("_before", F.sum("count").over(earlier))
        .where(F.col("_before") > 0)
        .drop("count")
    )
    return (
        ranged.withColumn("_local", F.row_number().over(local))
        .join(F.broadcast(offsets), ["_part", *keys], "left")
        .withColumn(name, F.col("_local").cast("long") + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_part", "_local", "_before")
    )


def top_k(df: DataFrame, key: str, order: list[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """The first k rows per key with their rank.

    A constant bound lets Catalyst cut each task's share to k rows before the shuffle (WindowGroupLimit), so a key with
    most of the rows sends only k rows per task.
    """
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)
