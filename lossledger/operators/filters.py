"""Filters that need the data to decide: tiers, fallbacks, checks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.predicates import all_of, status_in


def by_expression(df: DataFrame, expression: str) -> DataFrame:
    """A raw SQL predicate."""
    return df.filter(F.expr(expression))


def unknown_values(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """Filter values ``(col, value)`` that are missing from the value catalog."""
    return wanted.join(catalog.select("col", "value"), ["col", "value"], "left_anti")


def _word_prefixes(value: str, size: int = 5) -> list[str]:
    return [w[:size] for w in value.lower().split() if w not in fixed.TIER_NOISE_WORDS]


def tiered_match(df: DataFrame, columns: list[str], value: str) -> DataFrame:
    """Exact match on the first column that has one; else the first column in which every
    word prefix occurs; else all rows.

    The best tier present is one number, read as a scalar subquery: two scans, no shuffle
    of rows.
    """
    wanted = value.lower().strip()
    tiers = [F.lower(F.trim(F.col(c))) == wanted for c in columns]
    prefixes = _word_prefixes(wanted)
    if prefixes:
        tiers += [
            all_of([F.lower(F.col(c)).rlike(rf"(?U)\b{re.escape(p)}") for p in prefixes])
            for c in columns
        ]
    tier = reduce(
        lambda rest, item: F.when(item[1], F.lit(item[0])).otherwise(rest),
        reversed(list(enumerate(tiers))),
        F.lit(None).cast("int"),
    )
    best = df.agg(F.min(tier)).scalar()
    return df.filter(F.coalesce(tier == best, best.isNull()))


def keep_if_any(df: DataFrame, wanted: Column) -> DataFrame:
    """Rows that satisfy the condition, or every row when none does."""
    found = df.agg(F.coalesce(F.max(wanted), F.lit(False))).scalar()
    return df.filter(wanted | ~found)


def status_group(df: DataFrame, column: str, spellings=fixed.APPROVED_STATUSES) -> DataFrame:
    return keep_if_any(df, status_in(column, spellings))


def leak_check(df: DataFrame, column: str) -> DataFrame:
    """One row: distinct values left after a single-value filter, and whether that is a leak."""
    return df.agg(F.countDistinct(column).alias("distinct_values")).withColumn(
        "leak", F.col("distinct_values") > 1
    )


def probe(df: DataFrame, condition: Column, cap: int) -> DataFrame:
    """One row: how many rows a filter gives, counted no further than ``cap``."""
    return (
        df.filter(condition)
        .select(F.lit(1).alias("one"))
        .limit(cap)
        .agg(F.count("one").alias("row_count"))
        .withColumn("matched", F.col("row_count") > 0)
        .withColumn("capped", F.col("row_count") >= cap)
    )


def row_funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Rows left after each cumulative stage, counted in one pass."""
    passed, counts = F.lit(True), []
    for _, condition in stages:
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed))
    totals = df.agg(F.count(F.lit(1)).alias("n0"), *[c.alias(f"n{i}") for i, c in enumerate(counts, 1)])
    names = ["source"] + [name for name, _ in stages]
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("stage"), F.col(f"n{i}").alias("row_count"))
        for i, name in enumerate(names)
    ])
    return totals.select(F.inline(rows))
