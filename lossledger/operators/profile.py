"""Profiles of an extract: shares, concentration, time series, control totals.

A share needs the grand total next to every group. The total is read as a scalar
subquery, never as a window without keys, which would put all groups into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.money import net_loss, share_pct
from ..functions.predicates import status_in
from ..functions.text import blank_to_null
from .aggregates import money_sum, top_k_per_group
from .lineage import cut_lineage

# Characters of a text that order texts of equal count, and how many digests are broadcast at most.
BEGINNING, MAY_BE_SHOWN = 64, 10_000


def _total(df: DataFrame, metric: Column) -> Column:
    return df.agg(metric).scalar()


def with_shares(grouped: DataFrame, whole: DataFrame, amount: str | None = None) -> DataFrame:
    """Add the percent of rows, and of the amount, to groups holding ``cnt`` and ``loss``."""
    out = grouped.withColumn("cnt_pct", share_pct(F.col("cnt"), _total(whole, F.count(F.lit(1)))))
    if amount:
        out = out.withColumn("loss_pct", share_pct(F.col("loss"), _total(whole, money_sum(amount))))
    return out


def monthly(df: DataFrame, ts: str, amount: str) -> DataFrame:
    """Count, share, loss and loss share per month; rows without a date are left out of the
    groups but stay in the totals."""
    grouped = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(F.date_format(ts, "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("cnt"), money_sum(amount).alias("loss"))
    )
    return with_shares(grouped, df, amount).orderBy("month")


def categories(df: DataFrame, columns: list[str], amount: str, top: int = 5) -> DataFrame:
    """The same four measures for the most frequent values of several columns.

    The columns are unpivoted so that one shuffle serves all of them.
    """
    long = df.select(amount, *[F.col(c).cast("string") for c in columns]).unpivot(
        [amount], list(columns), "col", "value"
    )
    grouped = (
        long.filter(F.col("value").isNotNull())
        .groupBy("col", "value")
        .agg(F.count(F.lit(1)).alias("cnt"), money_sum(amount).alias("loss"))
    )
    best = top_k_per_group(grouped, ["col"], [F.desc("cnt"), F.asc("value")], top)
    return with_shares(best, df, amount)


def without_technical_codes(column: str, prefix: str) -> Column:
    """A readable value: neither a technical code with the prefix nor digits only."""
    c = F.col(column)
    return ~(c.startswith(prefix) | c.rlike(r"^\d+$"))


def blocks(df: DataFrame, column: str, amount: str, technical_prefix: str, top: int = 5) -> DataFrame:
    """Category profile of one column with technical codes blanked out first."""
    readable = df.withColumn(
        column, F.when(without_technical_codes(column, technical_prefix), F.col(column))
    )
    return categories(readable, [column], amount, top)


def detection_channels(
    df: DataFrame,
    column: str,
    amount: str,
    client: str = fixed.CLIENT_CHANNEL,
    control: str = fixed.CONTROL_CHANNEL,
) -> DataFrame:
    """Count and loss found by clients and by external control."""
    name = F.lower(F.col(column))
    by_client, by_control = name.rlike(client), name.rlike(control)
    return df.agg(
        F.count_if(by_client).alias("client_cnt"),
        money_sum(amount, by_client).alias("client_loss"),
        F.count_if(by_control).alias("control_cnt"),
        money_sum(amount, by_control).alias("control_loss"),
    )


def largest(df: DataFrame, key: str, amount: str, status: str, n: int = 3) -> DataFrame:
    """The n largest losses with their share of the total and their status."""
    return (
        df.orderBy(F.desc_nulls_last(amount), F.asc(key))
        .limit(n)
        .select(
            key, status, amount, share_pct(F.col(amount), _total(df, F.sum(amount))).alias("loss_pct")
        )
    )


def concentration(df: DataFrame, amount: str, n: int = 10) -> DataFrame:
    """Sum of the n largest losses and its share; no row when there is no loss."""
    top = df.select(amount).orderBy(F.desc_nulls_last(amount)).limit(n)
    return (
        top.agg(F.sum(amount).alias("top_sum"))
        .withColumn("total_loss", _total(df, F.sum(amount)))
        .withColumn("top_pct", share_pct(F.col("top_sum"), F.col("total_loss")))
        .filter(F.col("total_loss") > 0)
    )


def most_frequent_pair(df: DataFrame, first: str, second: str) -> DataFrame:
    return (
        df.groupBy(first, second)
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), F.asc(first), F.asc(second))
        .limit(1)
    )


def status_groups(
    df: DataFrame,
    column: str,
    approved=fixed.APPROVED_STATUSES,
    draft=fixed.DRAFT_STATUSES,
    deleted=fixed.DELETED_STATUSES,
) -> DataFrame:
    """Count per status group; other statuses belong to none."""
    group = (
        F.when(status_in(column, approved), "approved")
        .when(status_in(column, draft), "draft")
        .when(status_in(column, deleted), "deleted")
    )
    return (
        df.select(group.alias("status_group"))
        .filter(F.col("status_group").isNotNull())
        .groupBy("status_group")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def deleted_block(
    df: DataFrame, status: str, loss: str, recovery: str, deleted=fixed.DELETED_STATUSES
) -> DataFrame:
    """Count, loss and recovery of deleted incidents."""
    is_deleted = status_in(status, deleted)
    return df.agg(
        F.count_if(is_deleted).alias("deleted_cnt"),
        money_sum(loss, is_deleted).alias("deleted_loss"),
        money_sum(recovery, is_deleted).alias("deleted_recovery"),
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), F.asc(column))
    )


def adaptive_series(df: DataFrame, ts: str, loss: str, recovery: str) -> DataFrame:
    """Count, loss and recovery per day, week or month, whichever suits the span of dates."""
    dated = df.filter(F.col(ts).isNotNull())
    days = dated.agg(F.datediff(F.max(ts), F.min(ts))).scalar()
    bucket = (
        F.when(days <= 31, F.date_trunc("day", ts))
        .when(days <= 180, F.date_trunc("week", ts))
        .otherwise(F.date_trunc("month", ts))
    )
    return (
        dated.groupBy(F.date_format(bucket, "yyyy-MM-dd").alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("cnt"),
            money_sum(loss).alias("loss"),
            money_sum(recovery).alias("recovery"),
        )
        .orderBy("bucket")
    )


def best_distribution(
    df: DataFrame, columns: list[str], low: int = 2, high: int = 12
) -> DataFrame:
    """Counts of the one column best fit for a distribution: 2 to 12 distinct values, ranked
    by a hint in its name (type, then structure, then status), then by fewer values."""

    def hint(name: str) -> int:
        if "type" in name or "тип" in name:
            return 3
        if any(part in name for part in ("tb", "тб", "struct", "орг")):
            return 2
        return 1 if "status" in name or "статус" in name else 0

    order = {c: (hint(c.lower()), i) for i, c in enumerate(columns)}
    counted = (
        df.select(*[F.col(c).cast("string") for c in columns])
        .unpivot([], list(columns), "col", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("col", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )

    def ranked(i: int):
        named = [F.when(F.col("col") == c, F.lit(order[c][i])) for c in columns]
        return F.coalesce(*named)

    chosen = (
        counted.groupBy("col")
        .agg(F.count(F.lit(1)).alias("n_values"))
        .filter(F.col("n_values").between(low, high))
        .orderBy(ranked(0).desc(), F.asc("n_values"), ranked(1).asc())
        .limit(1)
        .select("col")
    )
    return counted.join(chosen, "col", "left_semi").select("col", "value", "cnt")


def text_frequency(df: DataFrame, column: str, order: str, top: int = 200) -> DataFrame:
    """Texts counted without regard to case, most frequent first, with their share.

    The spelling shown is the one that comes first by ``order``. Digests and short beginnings are
    shuffled instead of texts: the beginning decides most ties, and only texts that may be among the
    first ``top`` are fetched, next to a broadcast list of their digests while that is short.
    """
    text = blank_to_null(F.col(column))
    digested = df.select(F.lower(text).alias("__key"), F.col(order).alias("__order")).filter(F.col("__key").isNotNull())
    grouped = cut_lineage(
        digested.select(F.sha2("__key", 256).alias("digest"), F.substring("__key", 1, BEGINNING).alias("begin"), "__order")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("cnt"), F.min("__order").alias("__order"), F.first("begin").alias("begin"))
    )
    place = F.struct((-F.col("cnt")).alias("cnt"), "begin")
    last = grouped.select(place.alias("place")).orderBy("place").limit(top).agg(F.max("place").alias("last"))
    may_be_shown = cut_lineage(grouped.filter(place <= last.scalar()).select("digest", "cnt", "__order"))
    if may_be_shown.count() <= MAY_BE_SHOWN:
        may_be_shown = F.broadcast(may_be_shown)
    texts = df.select(text.alias("display"), F.col(order).alias("__order")).filter(F.col("display").isNotNull())
    fetched = (
        texts.withColumn("digest", F.sha2(F.lower("display"), 256))
        .join(may_be_shown, ["digest", "__order"])
        .groupBy("digest", "cnt")
        .agg(F.min("display").alias("display"))
        .select(F.lower("display").alias("key"), "display", "cnt")
    )
    total = _total(grouped, F.sum("cnt"))
    return (
        fetched.orderBy(F.desc("cnt"), F.asc("key"))
        .limit(top)
        .select("key", "display", "cnt", share_pct(F.col("cnt"), total).alias("pct"))
    )


def count_shares(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Count per non-NULL key with its share of all rows."""
    grouped = (
        df.select(key.alias(name))
        .filter(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return grouped.withColumn("pct", share_pct(F.col("cnt"), _total(df, F.count(F.lit(1)))))


def period_totals(
    df: DataFrame, loss: str, recovery: str, is_automatic: Column, is_credit: Column
) -> DataFrame:
    """Control totals of the period report, one pass."""
    net = net_loss(F.col("loss"), F.col("recovery"), clamp=False)
    return df.agg(
        F.count(F.lit(1)).alias("incidents"),
        F.count_if(F.col(loss) > 0).alias("with_loss"),
        F.count_if(F.col(recovery) > 0).alias("with_recovery"),
        F.count_if(is_automatic).alias("automatic"),
        money_sum(loss).alias("loss"),
        money_sum(loss, is_credit).alias("credit_loss"),
        money_sum(loss, ~is_credit).alias("other_loss"),
        money_sum(recovery).alias("recovery"),
    ).withColumn("net", net)


def amounts_by_type(df: DataFrame, column: str, amount: str, profit: str) -> DataFrame:
    """Sum per impact type; losses carry their share of all losses, profit stands apart."""
    is_loss = F.col(column) != profit
    total = _total(df.filter(is_loss), money_sum(amount))
    return (
        df.groupBy(column)
        .agg(money_sum(amount).alias("amount"), F.count(F.lit(1)).alias("cnt"))
        .withColumn("is_profit", ~is_loss)
        .withColumn("pct", F.when(is_loss, share_pct(F.col("amount"), total)))
    )


def largest_kinds(df: DataFrame, column: str, amount: str, n: int = 3) -> DataFrame:
    return (
        df.groupBy(column)
        .agg(money_sum(amount).alias("amount"))
        .orderBy(F.desc("amount"), F.asc(column))
        .limit(n)
    )


def recovery_totals(df: DataFrame, key: str, amount: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct(key).alias("incidents"),
        money_sum(amount).alias("recovery"),
    )


def influence_levels(df: DataFrame, key: str, level: str, critical: list[str]) -> DataFrame:
    """Rows and incidents per level, with the critical levels marked."""
    return (
        df.groupBy(level)
        .agg(F.count(F.lit(1)).alias("cnt"), F.countDistinct(key).alias("incidents"))
        .withColumn("is_critical", F.col(level).isin(critical))
    )


def with_all_kinds(df: DataFrame, key: str, column: str, kinds: list[str]) -> DataFrame:
    """Keys that have every one of the given kinds."""
    return (
        df.filter(F.col(column).isin(kinds))
        .groupBy(key)
        .agg(F.countDistinct(column).alias("kinds"))
        .filter(F.col("kinds") == len(kinds))
    )


def deletions_by_user(df: DataFrame, user: str, more_than: int = 0, top: int | None = None) -> DataFrame:
    """Users with more deletions than a number, or the most active ones."""
    counted = (
        df.groupBy(user).agg(F.count(F.lit(1)).alias("deletions")).filter(F.col("deletions") > more_than)
    )
    return counted.orderBy(F.desc("deletions"), F.asc(user)).limit(top) if top else counted


def deletion_control(
    df: DataFrame, key: str, ts: str, comment: str, approved: Column, amount: str, large, min_comment: int = 10
) -> DataFrame:
    """Control points of a deletion log in one pass."""
    no_reason = F.col(comment).isNull() | (F.length(comment) < min_comment)
    return df.agg(
        F.countDistinct(key).alias("incidents"),
        F.count(ts).alias("deletions"),
        F.count_if(no_reason).alias("without_reason"),
        F.count_if(approved).alias("after_approval"),
        F.count_if(F.col(amount) > large).alias("large"),
        F.min(ts).alias("first_deletion"),
        F.max(ts).alias("last_deletion"),
    )


def dossier_net(
    impacts: DataFrame, recoveries: DataFrame, key: str, amount: str, type_column: str,
    profit: str, sid: str, recovery: str,
) -> DataFrame:
    """Losses less profit less recoveries per incident.

    Each child is summed on its own before the join: the joined report repeats every impact
    for every recovery.
    """
    is_profit = F.col(type_column) == profit
    left = impacts.groupBy(key).agg(
        F.countDistinct(sid).alias("impacts"),
        money_sum(amount, ~is_profit).alias("loss"),
        money_sum(amount, is_profit).alias("gain"),
    )
    right = recoveries.groupBy(key).agg(F.sum(recovery).alias("recovered"))
    return left.join(right, key, "left").select(
        key, "impacts", "loss", "gain",
        F.coalesce("recovered", F.lit(0)).alias("recovered"),
        (F.col("loss") - F.col("gain") - F.coalesce("recovered", F.lit(0))).alias("net"),
    )


def problem_debt(df: DataFrame, debt: str, reserve: str, pledge: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("loans"),
        F.coalesce(F.sum(debt), F.lit(0)).alias("debt"),
        F.coalesce(F.sum(reserve), F.lit(0)).alias("reserve"),
        F.coalesce(F.sum(pledge), F.lit(0)).alias("pledge"),
    )


def _numbered(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Positions 1..n of the first n rows; only those n rows meet in one task."""
    top = df.orderBy(*order).limit(n)
    w = Window.partitionBy(F.lit(1)).orderBy(*order)
    return top.withColumn("rn", F.row_number().over(w))


def ranked_batches(df: DataFrame, order: list[Column], n: int, size: int) -> DataFrame:
    """The first n rows in batches of equal size; numbering runs on across batches."""
    return _numbered(df, order, n).withColumn(
        "batch", F.ceil(F.col("rn") / F.lit(size)).cast("int")
    )


def largest_described(
    df: DataFrame, key: str, amount: str, texts: list[str], n: int = 30, size: int = 10
) -> DataFrame:
    """The n largest losses that carry a text: the first non-blank of several columns."""
    described = _numbered(df, [F.desc_nulls_last(amount), F.asc(key)], n).withColumn(
        "description", F.coalesce(*[blank_to_null(F.col(t)) for t in texts])
    )
    return (
        described.filter(F.col("description").isNotNull())
        .withColumn("batch", F.ceil(F.col("rn") / F.lit(size)).cast("int"))
        .select(key, amount, "description", "rn", "batch")
    )


def distinct_comments(df: DataFrame, column: str, limit: int = 300) -> DataFrame:
    """Distinct comments that say something, at most ``limit``."""
    nothing = ["nan", "none", "—", "-"]
    return (
        df.select(blank_to_null(F.col(column)).alias("comment"))
        .filter(F.col("comment").isNotNull() & ~F.lower("comment").isin(nothing))
        .distinct()
        .orderBy("comment")
        .limit(limit)
    )
