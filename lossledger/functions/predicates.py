"""Filters as ``Column`` objects, built from plain values."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "gt": operator.gt, ">": operator.gt,
    "gte": operator.ge, ">=": operator.ge,
    "lt": operator.lt, "<": operator.lt,
    "lte": operator.le, "<=": operator.le,
    "ne": operator.ne, "!=": operator.ne, "<>": operator.ne,
    "eq": operator.eq, "=": operator.eq,
}


def any_of(preds: list[Column]) -> Column:
    return reduce(operator.or_, preds, F.lit(False))


def all_of(preds: list[Column]) -> Column:
    return reduce(operator.and_, preds, F.lit(True))


def compare(column: str, op: str, value) -> Column:
    """One comparison; an unknown operator is an error."""
    c = F.col(column)
    name = op.lower()
    if name == "in":
        return c.isin(list(value))
    if name == "like":
        return c.like(value)
    if name == "is" and value is None:
        return c.isNull()
    if name not in _COMPARE:
        raise ValueError(f"unknown operator {op!r} on column {column!r}")
    return _COMPARE[name](c, F.lit(value))


def where(conditions: dict) -> Column:
    """``{col: v | None | [..] | {op: v}}``, ``{col__op: v}`` and ``{"_or": [..]}``, all joined by AND."""
    preds: list[Column] = []
    for key, value in (conditions or {}).items():
        if key == "_or":
            preds.append(any_of([where(option) for option in value]))
        elif "__" in key:
            column, op = key.rsplit("__", 1)
            preds.append(compare(column, op, value))
        elif isinstance(value, dict):
            preds += [compare(key, op, v) for op, v in value.items()]
        elif isinstance(value, (list, tuple)):
            preds.append(compare(key, "in", value))
        elif value is None:
            preds.append(F.col(key).isNull())
        else:
            preds.append(compare(key, "eq", value))
    return all_of(preds)


def free_text(column: str, text: str) -> Column:
    """LIKE with the text anywhere, unless it already carries wild cards."""
    return F.col(column).like(text if "%" in text else f"%{text}%")


def equals_ignore_case(column: str, value: str) -> Column:
    return F.upper(F.col(column)) == value.upper()


def contains_ignore_case(columns: list[str], value: str) -> Column:
    return any_of([F.lower(F.col(c)).contains(value.lower()) for c in columns])


def code_prefix_in(column: str, prefixes: list[str], size: int = 4) -> Column:
    return F.substring(F.upper(F.col(column)), 1, size).isin(prefixes)


def between_text_dates(column: str, begin: str, end: str) -> Column:
    """Inclusive range over ISO date text; NULL dates never match."""
    return F.col(column).between(begin, end)


def raised_by_customer(person: str, source_type: str, source: str,
                       person_is: str, type_has: str, source_has: str) -> Column:
    """Named compound predicate: reported by, typed as, or sourced from a customer."""
    return any_of([
        F.col(person) == person_is,
        F.col(source_type).like(f"%{type_has}%"),
        F.col(source).like(f"%{source_has}%"),
    ])


def status_in(column: str, spellings) -> Column:
    """Trimmed, case-insensitive membership in a group of spellings."""
    return F.coalesce(F.lower(F.trim(F.col(column))).isin(list(spellings)), F.lit(False))


def is_flag_set(column: str) -> Column:
    """Flags stored as Y/N text."""
    return F.coalesce(F.upper(F.trim(F.col(column))) == "Y", F.lit(False))
