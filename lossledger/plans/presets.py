"""The fixed reports: period filter, join, clean-up, one row per key, report order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import half_open_period
from ..functions.predicates import (
    code_prefix_in,
    contains_ignore_case,
    equals_ignore_case,
)
from ..functions.text import strip_rare_unicode
from ..operators.aggregates import first_per_key
from ..operators.filters import by_expression

ENTRY = "incdnt_entry_dt"


def _in_period(df: DataFrame, begin: str, end: str) -> DataFrame:
    return df.filter(half_open_period(F.col(ENTRY), begin, end))


def _readable(df: DataFrame, texts: list[str]) -> DataFrame:
    return df.withColumns({c: strip_rare_unicode(F.col(c)) for c in texts})


def period_report(
    incident: DataFrame,
    begin: str,
    end: str,
    unit: str,
    prefixes: list[str],
    texts: list[str] = (),
    condition: str | None = None,
) -> DataFrame:
    """Full report of a period for units whose code has one of the prefixes."""
    df = _in_period(incident, begin, end).filter(code_prefix_in(unit, prefixes))
    if condition:
        df = by_expression(df, condition)
    once = first_per_key(_readable(df, list(texts)), ["incdnt_id"], [F.col(ENTRY), F.col("incdnt_sid")])
    return once.orderBy(ENTRY, "incdnt_sid")


def _detail_report(
    incident: DataFrame, child: DataFrame, begin: str, end: str, sid: str, order: list[Column]
) -> DataFrame:
    joined = _in_period(incident, begin, end).join(child, "incdnt_id", "inner")
    once = first_per_key(joined, ["incdnt_sid", sid], order)
    return once.orderBy(ENTRY, "incdnt_sid", sid)


def impact_report(incident: DataFrame, impacts: DataFrame, begin: str, end: str, order: list[Column]) -> DataFrame:
    """Incidents of a period with each financial impact once."""
    return _detail_report(incident, impacts, begin, end, "fin_impact_sid", order)


def recovery_report(incident: DataFrame, recoveries: DataFrame, begin: str, end: str, order: list[Column]) -> DataFrame:
    """Incidents of a period with each recovery once."""
    return _detail_report(incident, recoveries, begin, end, "recovery_sid", order)


def qualitative_report(incident: DataFrame, impacts: DataFrame, begin: str, end: str, order: list[Column]) -> DataFrame:
    """Incidents of a period with each qualitative impact once."""
    return _detail_report(incident, impacts, begin, end, "nonfin_impact_sid", order)


def deleted_report(
    incident: DataFrame,
    log: DataFrame,
    begin: str,
    end: str,
    unit: str,
    prefixes: list[str],
    deleted: str,
    action: str,
    condition: str | None = None,
) -> DataFrame:
    """Deleted incidents of a period with every delete action; without one the log columns
    are NULL."""
    df = _in_period(incident, begin, end).filter(
        equals_ignore_case("incdnt_status_name", deleted) & code_prefix_in(unit, prefixes)
    )
    if condition:
        df = by_expression(df, condition)
    actions = log.filter(equals_ignore_case("stts_chng_action_name", action))
    if "incdnt_status_name" in log.columns:
        actions = actions.withColumnRenamed("incdnt_status_name", "incdnt_status_name_at_action")
    return df.join(actions, "incdnt_id", "left").orderBy(ENTRY, "incdnt_sid", "stts_chng_action_dttm")


def one_incident_report(incident: DataFrame, impacts: DataFrame, recoveries: DataFrame, sid: str) -> DataFrame:
    """One incident with every impact and every recovery: impacts times recoveries rows."""
    main = incident.filter(F.col("incdnt_sid") == sid)
    return (
        main.join(impacts, "incdnt_id", "left")
        .join(recoveries, "incdnt_id", "left")
        .orderBy(ENTRY, "incdnt_sid", "fin_impact_sid", "recovery_sid")
    )


def profiling_extract(
    incident: DataFrame,
    begin: str,
    end: str,
    status: str | None = None,
    unit: tuple[str, str] | None = None,
    block: tuple[list[str], str] | None = None,
    condition: str | None = None,
    texts: list[str] = (),
) -> DataFrame:
    """Extract for profiling with optional status, unit and block filters.

    ``unit`` is (column, text), ``block`` is (columns, text); both match a part in any case.
    """
    df = _in_period(incident, begin, end)
    if status:
        df = df.filter(equals_ignore_case("incdnt_status_name", status))
    if unit:
        df = df.filter(contains_ignore_case([unit[0]], unit[1]))
    if block:
        df = df.filter(contains_ignore_case(list(block[0]), block[1]))
    if condition:
        df = by_expression(df, condition)
    return _readable(df, list(texts)).orderBy(ENTRY, "incdnt_sid")
