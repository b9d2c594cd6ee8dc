"""Point lookups and single-table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import where as where_clause


def row_limit(n=None, default: int | None = None) -> int | None:
    """The limit as given; ``default`` (none) for missing, non-numeric or non-positive limits."""
    try:
        value = int(n)
    except (TypeError, ValueError):
        return default
    return value if value > 0 else default


def limited(df: DataFrame, n=None, default: int | None = None) -> DataFrame:
    """At most ``row_limit(n, default)`` rows; all of them where there is no limit."""
    value = row_limit(n, default)
    return df if value is None else df.limit(value)


def query(
    df: DataFrame,
    where: dict | None = None,
    columns: list[str] | None = None,
    order_by: str | None = None,
    order_desc: bool = False,
    limit=None,
    tie_break: tuple[str, ...] = (),
) -> DataFrame:
    """Filter, project, order and limit one table."""
    out = df.filter(where_clause(where)) if where else df
    if order_by:
        key = F.col(order_by)
        out = out.orderBy(
            key.desc_nulls_last() if order_desc else key.asc_nulls_last(),
            *[F.col(c) for c in tie_break],
        )
    if columns:
        out = out.select(*columns)
    return limited(out, limit)


def column_named(df: DataFrame, name: str) -> str:
    """The frame's own spelling of a column name given in any case."""
    match = [c for c in df.columns if c.lower() == name.lower()]
    if not match:
        raise ValueError(f"no column {name!r} in {df.columns}")
    return match[0]


def by_ids(df: DataFrame, key: str, ids) -> DataFrame:
    """Rows for a list of ids (pushed down as IN) or for a frame of ids (semi-join)."""
    column = column_named(df, key)
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).alias("__id"))
        return df.join(wanted, F.col(column) == F.col("__id"), "left_semi")
    return df.filter(F.col(column).isin(list(ids)))
