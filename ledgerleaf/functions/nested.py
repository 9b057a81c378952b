"""Rows from nested arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, array: str | Column, at: str, item: str, *keep: str | Column) -> DataFrame:
    """One row an element: the columns ``keep``, the element's 0-based place ``at`` and the element ``item``.

    The outer form, as for the other Spark makes the array once more to find out whether it is empty.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(at, item)).where(F.col(at).isNotNull())
