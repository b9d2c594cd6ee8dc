"""Ranking inside groups, for top-N and for whole groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage

_METHODS = {
    "row_number": F.row_number,
    "rank": F.rank,
    "dense_rank": F.dense_rank,
}


def _ordered(column: str, descending: bool) -> Column:
    return F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()


def _with_ranks(df: DataFrame, ranks: DataFrame, keys: list[str], rank_col: str) -> DataFrame:
    """Join ranks of distinct (group, value) pairs back to the rows; NULL matches NULL.

    There is one row per pair on the side of the ranks, so a value that fills the table is
    split by the adaptive skew handling, or the ranks are small enough to be broadcast.
    """
    side = ranks.select(*[F.col(c).alias(f"__{c}") for c in keys], rank_col)
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(side, same).drop(*[f"__{c}" for c in keys])


def rank_top_n(
    df: DataFrame,
    partition_by: list[str],
    order_by: str,
    top_n: int,
    method: str = "row_number",
    descending: bool = True,
    tie_break: tuple[str, ...] = (),
    rank_col: str = "rank",
) -> DataFrame:
    """Rows ranked no lower than ``top_n`` in their group.

    The limit is applied in every task before the shuffle, so a hot group costs each task
    only its own best rows. Ties of ``rank`` and ``dense_rank`` can be any number of rows, so
    these rank the distinct values, of which ``top_n`` per group are enough.
    """
    if method not in _METHODS:
        raise ValueError(f"method {method!r}: use row_number, rank or dense_rank")
    order = _ordered(order_by, descending)
    groups = partition_by or [F.lit(1)]
    if method == "row_number":
        w = Window.partitionBy(*groups).orderBy(order, *[F.col(c) for c in tie_break])
        return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= top_n)

    w = Window.partitionBy(*groups).orderBy(order)
    keys = [*partition_by, order_by]
    values = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    best = values.withColumn("__position", F.row_number().over(w)).filter(F.col("__position") <= top_n)
    if method == "rank":
        before = F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1))
        position = F.coalesce(before, F.lit(0)) + 1
    else:
        position = F.col("__position")
    ranks = best.withColumn(rank_col, position.cast("bigint")).filter(F.col(rank_col) <= top_n)
    return _with_ranks(df, ranks, keys, rank_col)


def _ranged(df: DataFrame, groups: list[str], order: list[Column], pid: str) -> DataFrame:
    """Rows in sorted ranges of similar size, each marked with the number of its range.

    The marks are used twice below, so they are fixed in the checkpoint folder: a lost
    executor must not draw new range borders.
    """
    keys = [F.col(c) for c in groups] + order
    return cut_lineage(df.repartitionByRange(*keys).withColumn(pid, F.spark_partition_id()))


def _with_offsets(ranged: DataFrame, groups: list[str], pid: str, totals: dict[str, Column]) -> DataFrame:
    """Add, for every row, the totals of all earlier ranges of its group.

    There is one row per group and range, at most groups + ranges rows in all.
    """
    per_range = ranged.groupBy(*groups, pid).agg(*[c.alias(n) for n, c in totals.items()])
    earlier = (
        Window.partitionBy(*(groups or [F.lit(1)]))
        .orderBy(pid)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_range.select(
        *[F.col(c).alias(f"__{c}") for c in groups],
        F.col(pid).alias("__pid"),
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in totals],
    )
    same = F.col(pid) == F.col("__pid")
    for c in groups:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return ranged.join(offsets, same).drop("__pid", *[f"__{c}" for c in groups])


def rank_all(
    df: DataFrame,
    partition_by: list[str],
    order_by: str,
    key: list[str],
    method: str = "row_number",
    descending: bool = True,
    rank_col: str = "rank",
) -> DataFrame:
    """Rank every row of every group, whatever the size of a group.

    A plain window puts a whole group, or with no group the whole table, into one task.
    Here the rows are cut into sorted ranges, ranked inside their range, and shifted by
    the totals of the ranges before. ``key`` makes the order total for ``row_number``.
    ``rank`` and ``dense_rank`` depend on the order value alone, so they are computed on
    the distinct values, which pre-aggregation makes small where ties are many.
    """
    if method not in _METHODS:
        raise ValueError(f"method {method!r}: use row_number, rank or dense_rank")
    order = _ordered(order_by, descending)
    pid = "__range"

    if method == "row_number":
        total_order = [order, *[F.col(k) for k in key]]
        ranged = _ranged(df, partition_by, total_order, pid)
        shifted = _with_offsets(ranged, partition_by, pid, {"__before": F.count(F.lit(1))})
        w = Window.partitionBy(*partition_by, pid).orderBy(*total_order)
        return shifted.withColumn(
            rank_col, (F.row_number().over(w) + F.col("__before")).cast("bigint")
        ).drop(pid, "__before")

    values = df.groupBy(*partition_by, order_by).agg(F.count(F.lit(1)).alias("__n"))
    ranged = _ranged(values, partition_by, [order], pid)
    shifted = _with_offsets(
        ranged, partition_by, pid, {"__rows": F.sum("__n"), "__values": F.count(F.lit(1))}
    )
    w = Window.partitionBy(*partition_by, pid).orderBy(order)
    if method == "rank":
        inside = F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        position = inside + F.col("__rows") + 1
    else:
        position = F.row_number().over(w) + F.col("__values")
    ranks = shifted.withColumn(rank_col, position.cast("bigint"))
    return _with_ranks(df, ranks, [*partition_by, order_by], rank_col)


def new_and_resumed(
    df: DataFrame, category: str, ts: str, begin: str, end: str, gap_days: int = 180
) -> DataFrame:
    """Categories first seen in the period, or seen again after a gap.

    Rows are first reduced to distinct days, so that the window over a hot category
    holds no more rows than there are days.
    """
    days = (
        df.filter(F.col(ts).isNotNull() & F.col(category).isNotNull())
        .filter(F.col(ts) < F.lit(end).cast("timestamp_ntz"))
        .select(category, F.to_date(ts).alias("day"))
        .distinct()
    )
    previous = F.lag("day").over(Window.partitionBy(category).orderBy("day"))
    gaps = days.withColumn("gap", F.datediff("day", previous)).filter(
        F.col("day") >= F.lit(begin).cast("date")
    )
    return (
        gaps.groupBy(category)
        .agg(
            F.max(F.col("gap").isNull()).alias("__new"),
            F.max("gap").alias("gap_days"),
            F.min("day").alias("__first"),
        )
        .withColumn(
            "kind",
            F.when(F.col("__new"), "new").when(F.col("gap_days") >= gap_days, "resumed"),
        )
        .filter(F.col("kind").isNotNull())
        .select(category, "kind", F.date_format("__first", "yyyy-MM-dd").alias("first_day"), "gap_days")
    )
