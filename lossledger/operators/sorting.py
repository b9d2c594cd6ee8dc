"""Sorting and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..sources.lookup import limited


def sort_ascending(df: DataFrame, columns: list[str]) -> DataFrame:
    """Report order: range-partitioned global sort."""
    return df.orderBy(*columns)


def top_n(
    df: DataFrame, by: str, n: int, ascending: bool = False, tie_break: tuple[str, ...] = ()
) -> DataFrame:
    """The first n rows, NULLs last in both directions."""
    key = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return df.orderBy(key, *[F.col(c) for c in tie_break]).limit(n)


def preview_limited(df: DataFrame, n=None, default: int = fixed.DEFAULT_ROW_LIMIT) -> DataFrame:
    """The rows of a preview: the limit as given, ``default`` where none or junk is given."""
    return limited(df, n, default)
