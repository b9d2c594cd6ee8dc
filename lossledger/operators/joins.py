"""Joins of incidents with their child tables.

No join is hinted: the sides are measured at run time and a broadcast happens only
below the session's size limit. A hot key on the many side is split by the adaptive
skew handling, because the other side has one row for it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.predicates import compare
from .lineage import stored
from .windows import rank_all


# Records of one kind in a row of a dossier.
PAGE = 1_000
# Records of one kind that a key may have to be gathered in one array.
HOT = 10_000


def with_children(
    parent: DataFrame, child: DataFrame, key: str = "incdnt_id", how: str = "inner"
) -> DataFrame:
    """One row per child; the key is kept once."""
    return parent.join(child, key, how)


def equi_join(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str] | None = None,
    left_on: str | None = None,
    right_on: str | None = None,
    how: str = "inner",
) -> DataFrame:
    """Inner, left, right or outer join on shared or differently named keys."""
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"how={how!r}: use inner, left, right or outer")
    if left_on and right_on:
        return left.join(right, left[left_on] == right[right_on], how)
    return left.join(right, on, how)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") > 1)


def has_fanout(df: DataFrame, keys: list[str]) -> bool:
    """Whether joining to this frame on the keys would multiply rows; a job of its own."""
    return not duplicate_keys(df, keys).isEmpty()


def unique_on(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows, of which each key has one; the plan fails where it runs into a repeated key.

    Keys are counted on the way into the join, map-side first, so there is no job of its own.
    """
    others = [c for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*others) if others else F.lit(1)).alias("__row"))
    message = F.concat(
        F.lit(f"right side is not unique on {keys}: aggregate it first or allow the fan-out; a key has rows: "),
        F.col("__n").cast("string"),
    )
    checked = counted.filter(F.assert_true(F.col("__n") == 1, message).isNull())
    return checked.select(*[F.col(c) if c in keys else F.col(f"__row.{c}") for c in df.columns])


def guarded_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left", allow_fanout: bool = False
) -> DataFrame:
    """Equi-join that refuses a right side with repeated keys, when it runs."""
    guarded = how in ("left", "inner") and not allow_fanout
    return equi_join(left, unique_on(right, on) if guarded else right, on, how=how)


def watched_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left", allow_fanout: bool = False
) -> tuple[DataFrame, Callable[[], dict]]:
    """A guarded join, and a function that tells after one action on it how rows grew: rows on the
    left, rows made, and whether these are more. Both counts come from the join's own run."""
    before, after = Observation(), Observation()
    rows = F.count(F.lit(1)).alias("rows")
    joined = guarded_join(left.observe(before, rows), right, on, how, allow_fanout).observe(after, rows)

    def growth() -> dict:
        counts = before.get["rows"], after.get["rows"]
        return {"left_rows": counts[0], "joined_rows": counts[1], "grew": counts[1] > counts[0]}

    return joined, growth


def child_sums(child: DataFrame, key: str, metrics: list[Column]) -> DataFrame:
    """All metrics of a child table per parent key, in one aggregation."""
    return child.groupBy(key).agg(*metrics)


def join_aggregated(
    parent: DataFrame,
    child: DataFrame,
    metrics: list[Column],
    key: str = "incdnt_id",
    condition: Column | None = None,
    how: str = "left",
) -> DataFrame:
    """Aggregate the child per key before joining, so that parent rows never multiply.

    The child is reduced map-side first: a key that holds most of the child rows
    still leaves one row per task for the shuffle.
    """
    rows = child if condition is None else child.filter(condition)
    return parent.join(child_sums(rows, key, metrics), key, how)


def having_sum(
    parent: DataFrame,
    child: DataFrame,
    amount: str,
    op: str,
    value,
    key: str = "incdnt_id",
    condition: Column | None = None,
) -> DataFrame:
    """Parents whose children sum to something that compares with the value."""
    rows = child if condition is None else child.filter(condition)
    keys = rows.groupBy(key).agg(F.sum(amount).alias("__sum")).filter(compare("__sum", op, value))
    return parent.join(keys, key, "left_semi")


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ("incdnt_id",)) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def dossier(incident: DataFrame, impacts: DataFrame, recoveries: DataFrame, key: str = "incdnt_id") -> DataFrame:
    """Main row with every impact and recovery, child columns prefixed."""
    return incident.join(prefixed(impacts, "impact_", (key,)), key, "left").join(
        prefixed(recoveries, "recovery_", (key,)), key, "left"
    )


def _placed(child: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, Callable[[Column], Column]]:
    """``(key, __place)`` of the rows with a key: their columns as a struct that sorts in order, nulls last;
    and how a record is read back from it."""
    others = [c for c in child.columns if c not in (key, *order)]
    named = [*order, *others]
    place = F.struct(*[
        part for at, c in enumerate(named) for part in (F.col(c).isNull().alias(f"null_{at}"), F.col(c).alias(f"value_{at}"))
    ])

    def record(placed: Column) -> Column:
        return F.struct(*[placed[f"value_{at}"].alias(c) for at, c in enumerate(named)])

    return child.filter(F.col(key).isNotNull()).select(key, place.alias("__place")), record


def pages_of(rows: DataFrame, key: str, name: str, page: int, record: Callable[[Column], Column]) -> DataFrame:
    """``(key, page, name)`` of placed rows: the records of a key in order, at most ``page`` to an array.

    Rows are ranked in sorted ranges, so that a key that holds a third of all rows is spread over many
    pages and tasks.
    """
    ranked = rank_all(rows, [key], "__place", [], descending=False, rank_col="__rank")
    paged = ranked.withColumn("page", F.floor((F.col("__rank") - 1) / page))
    places = F.array_sort(F.collect_list("__place"))
    return paged.groupBy(key, "page").agg(F.transform(places, record).alias(name))


def _paged_arrays(incident: DataFrame, arrays: dict[str, DataFrame], key: str, page: int) -> DataFrame:
    """The main row with the arrays of each kind joined by key, cut into pages."""
    out = incident
    for part in arrays.values():
        out = out.join(part, key, "left")
    out = out.withColumns({n: F.coalesce(n, F.array().cast(part.schema[n].dataType)) for n, part in arrays.items()})
    last = F.greatest(F.lit(1), *[F.ceil(F.size(n) / F.lit(page)) for n in arrays]) - 1
    # Whole arrays are cut before they are dealt to rows, so that no row of a long one carries it.
    pages = F.transform(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")), lambda p: F.struct(
        p.alias("page"), *[F.slice(n, (p * page + 1).cast("int"), F.lit(page)).alias(n) for n in arrays]
    ))
    return out.select(*incident.columns, F.explode(pages).alias("__page")).select(*incident.columns, "__page.*")


def nested_dossier(
    incident: DataFrame,
    children: dict[str, tuple[DataFrame, list[str]]],
    key: str = "incdnt_id",
    page: int = PAGE,
    hot: int = HOT,
) -> DataFrame:
    """The main row with every child table as an array of records in the given order.

    One row an incident, page 0; an incident with more than ``page`` children of a kind goes on on
    further pages, which repeat the main row. No children are an empty array. Records are ordered by the
    columns given, then by the others, nulls last.

    Rows of a kind are gathered by key in one shuffle, and the joins by key need none of their own. Keys
    with more than ``hot`` rows of a kind are ranked in ranges instead.
    """
    placed = {n: _placed(child, key, order) for n, (child, order) in children.items()}
    counts = [rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select(key) for rows, _ in placed.values()]
    large = stored(reduce(DataFrame.unionByName, counts).distinct())
    some = not large.isEmpty()

    def arrays(name: str) -> DataFrame:
        rows, record = placed[name]
        few = rows.join(large, key, "left_anti") if some else rows
        return few.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("__place")), record).alias(name))

    usual = incident.join(large, key, "left_anti") if some else incident
    out = _paged_arrays(usual, {n: arrays(n) for n in children}, key, page)
    if not some:
        return out
    pages = None
    for name, (rows, record) in placed.items():
        part = pages_of(rows.join(large, key, "left_semi"), key, name, page, record)
        pages = part if pages is None else pages.unionByName(part, allowMissingColumns=True)
    gathered = pages.groupBy(key, "page").agg(*[F.any_value(n, F.lit(True)).alias(n) for n in children])
    rest = incident.join(large, key, "left_semi").join(gathered, key).withColumns({
        n: F.coalesce(n, F.array().cast(gathered.schema[n].dataType)) for n in children
    })
    return out.unionByName(rest)


def dossier_counts(incident: DataFrame, children: dict[str, DataFrame], key: str = "incdnt_id") -> DataFrame:
    """Rows of every child table per incident, counted before joining."""
    out = incident.select(key)
    for name, child in children.items():
        counts = child.groupBy(key).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, key, "left")
    return out.fillna(0, list(children))


def snapshots_at_two_dates(
    cases: DataFrame,
    snapshots: DataFrame,
    loan: str,
    day: str,
    incident_day: str,
    issue_day: str,
    measures: list[str],
) -> DataFrame:
    """Each case with its loan's balances on the incident day and on the day after issue."""
    at_incident = snapshots.select(
        F.col(loan), F.col(day).alias(incident_day), *[F.col(m).alias(f"{m}_now") for m in measures]
    )
    at_issue = snapshots.select(
        F.col(loan), F.col(day).alias("__issue_next"), *[F.col(m).alias(f"{m}_then") for m in measures]
    )
    return (
        cases.join(at_incident, [loan, incident_day], "inner")
        .withColumn("__issue_next", F.date_add(F.col(issue_day), 1))
        .join(at_issue, [loan, "__issue_next"], "inner")
        .drop("__issue_next")
    )
