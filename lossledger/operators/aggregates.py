"""Grouped and whole-table aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY, net_loss, share_pct

_FUNCTIONS = {
    "sum": F.sum,
    "mean": F.avg,
    "count": F.count,
    "max": F.max,
    "min": F.min,
    "nunique": F.countDistinct,
}


def aggregate(fn: str, column: str, condition: Column | None = None) -> Column:
    """One named aggregate, over all rows or over the rows that satisfy a condition."""
    if fn not in _FUNCTIONS:
        raise ValueError(f"aggregate {fn!r}: use one of {sorted(_FUNCTIONS)}")
    source = F.col(column)
    return _FUNCTIONS[fn](source if condition is None else F.when(condition, source))


def group_by(df: DataFrame, by: list[str], metrics: list[Column]) -> DataFrame:
    """Aliased metrics per group; NULL keys form a group of their own."""
    return df.groupBy(*by).agg(*metrics)


def money_sum(column: str, condition: Column | None = None) -> Column:
    """Sum with an all-NULL group as zero."""
    return F.coalesce(aggregate("sum", column, condition), F.lit(0).cast(MONEY))


def derived_metric(op: str, left: Column, right: Column) -> Column:
    """Arithmetic on metrics; a division by zero gives NULL."""
    if op == "add":
        return left + right
    if op == "sub":
        return left - right
    if op == "mul":
        return left * right
    if op in ("div", "safe_div"):
        return F.try_divide(left.cast("double"), right.cast("double"))
    raise ValueError(f"derived metric {op!r}: use add, sub, mul, div or safe_div")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key under a total order.

    The rank filter is applied map-side before the shuffle, so repeated keys leave at most
    one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def top_k_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their position ``rn``; limited map-side too."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("cnt"))


def top_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """Most frequent non-NULL values."""
    return (
        counts(df.filter(F.col(column).isNotNull()), column)
        .orderBy(F.desc("cnt"), F.asc(column))
        .limit(n)
    )


def distinct_values(df: DataFrame, column: str, contains: str | None = None, limit: int = 50) -> DataFrame:
    """Distinct values in order, optionally with a substring in any case."""
    values = df.select(column).filter(F.col(column).isNotNull())
    if contains:
        values = values.filter(F.lower(F.col(column)).contains(contains.lower()))
    return values.distinct().orderBy(column).limit(limit)


def top_category(df: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent value with its share; NULL when every value of more than
    50 rows is unique."""
    top = top_values(df, column, 1)
    total = df.agg(F.count(F.lit(1))).scalar()
    meaningful = ~((F.col("cnt") == 1) & (total > 50))
    return top.select(
        F.when(meaningful, F.col(column)).alias("label"),
        F.when(meaningful, F.col("cnt")).alias("cnt"),
        F.when(meaningful, share_pct(F.col("cnt"), total, 0)).alias("pct"),
    )


def headline(
    df: DataFrame, key: str, loss: str, recovery: str, is_automatic: Column
) -> DataFrame:
    """Rows, distinct incidents, totals and automatic registrations in one aggregation."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct(key).alias("incidents"),
        money_sum(loss).alias("loss"),
        money_sum(recovery).alias("recovery"),
        F.count_if(is_automatic).alias("automatic"),
    )


def months_of_year(df: DataFrame, ts: str) -> DataFrame:
    """Count per month of the year with all twelve months present."""
    months = df.sparkSession.range(1, 13).select(F.format_string("%02d", "id").alias("month"))
    counted = df.groupBy(F.date_format(ts, "MM").alias("month")).agg(F.count(ts).alias("cnt"))
    return months.join(counted, "month", "left").fillna(0, ["cnt"])


def loss_totals(df: DataFrame, amount: str, is_direct: Column) -> DataFrame:
    """Total and direct loss from typed impact rows."""
    return df.agg(
        money_sum(amount).alias("total_loss"), money_sum(amount, is_direct).alias("direct_loss")
    )


def with_net_loss(df: DataFrame, loss: str, recovery: str, clamp: bool = True) -> DataFrame:
    return df.withColumn("net_loss", net_loss(F.col(loss), F.col(recovery), clamp))


def summary(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Of an aggregate result: number of groups, the largest group, the grand total."""
    return df.agg(
        F.count(F.lit(1)).alias("groups"),
        F.max_by(group, F.struct(F.col(metric), F.col(group))).alias("top_group"),
        F.max(metric).alias("top_value"),
        F.sum(metric).alias("total"),
    )


def bars(df: DataFrame, group: str, metric: str, n: int = 8) -> DataFrame:
    """The n largest groups with their share of the largest, clipped to 0..1."""
    top = df.orderBy(F.desc(metric), F.asc(group)).limit(n)
    largest = F.max(metric).over(Window.partitionBy(F.lit(1)))
    share = F.coalesce(F.try_divide(F.col(metric).cast("double"), largest.cast("double")), F.lit(0.0))
    return top.withColumn(
        "bar", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), 4)
    )
