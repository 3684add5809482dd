"""Turning arrays into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list, array: Column, item: str, position: str | None = None) -> DataFrame:
    """``keep`` columns plus one row per array element (and its 0-based position).

    Exploding a computed array makes Catalyst infer a filter on its size and push that below the projection, so the whole
    expression runs twice. The outer variant infers nothing; its rows for empty arrays are dropped here.
    """
    place = position or "_position"
    rows = df.select(*keep, F.posexplode_outer(array).alias(place, item)).where(F.col(place).isNotNull())
    return rows if position else rows.drop(place)


def only(rows: DataFrame, wanted: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is in ``wanted``. Every key of ``rows`` is in one of the written tables ``wanted`` and ``others``.

    Mostly nearly all rows or hardly any are wanted, so the shorter table decides and is small enough to be broadcast: the rows stay
    where they are, however long the other table has become.
    """
    few = others.count() < wanted.count()
    return rows.join(others.select(*key), key, "left_anti") if few else rows.join(wanted.select(*key), key, "left_semi")
