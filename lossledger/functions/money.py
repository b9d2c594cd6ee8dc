"""Money: parsing, conditions written as text, display forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed

MONEY = "decimal(18,2)"


def money_number(text: Column) -> Column:
    """Money text to decimal: blanks out, comma to point, other characters out, bad to 0."""
    squeezed = F.regexp_replace(text, r"(?U)\s+", "")
    digits = F.regexp_replace(F.replace(squeezed, F.lit(","), F.lit(".")), r"[^\d.\-]", "")
    return F.coalesce(digits.try_cast("decimal(28,4)"), F.lit(0).cast("decimal(28,4)"))


def amount_conditions(text: Column) -> Column:
    """Every "больше 1,5 млн" style condition in the text: array of ``struct(op, value)``."""
    t = F.lower(text)
    pattern = F.lit(
        r"(?U)(\bбольше\b|\bменьше\b|>\s*|<\s*|=)\s*(\d+(?:[\s.,]\d+)*)\s*(млрд|млн|тыс|руб|коп)?"
    )
    words, numbers, units = (F.regexp_extract_all(t, pattern, F.lit(i)) for i in (1, 2, 3))

    def condition(m: Column) -> Column:
        op = (
            F.when(m["word"].contains("больше") | m["word"].contains(">"), F.lit(">"))
            .when(m["word"].contains("меньше") | m["word"].contains("<"), F.lit("<"))
            .otherwise(F.lit("="))
        )
        number = F.replace(
            F.regexp_replace(m["number"], r"[ \u00a0]", ""), F.lit(","), F.lit(".")
        ).try_cast("decimal(20,4)")
        factor = reduce(
            lambda rest, unit: F.when(m["unit"] == unit[0], F.lit(unit[1])).otherwise(rest),
            fixed.MONEY_UNITS,
            F.lit(1),
        )
        return F.struct(op.alias("op"), (number * factor).cast("double").alias("value"))

    found = F.arrays_zip(words.alias("word"), numbers.alias("number"), units.alias("unit"))
    return F.filter(F.transform(found, condition), lambda c: c["value"].isNotNull())


def meets(amount: Column, op: Column, value: Column) -> Column:
    """Apply one parsed condition to an amount."""
    return (
        F.when(op == ">", amount > value).when(op == "<", amount < value).otherwise(amount == value)
    )


def thousands(number: Column) -> Column:
    """12658 to '12 658'; the fraction is cut off."""
    return F.translate(F.format_number(number.cast("bigint"), 0), ",", " ")


def compact_money(number: Column) -> Column:
    """1500000 to '1.5 млн', 2000 to '2 тыс', smaller amounts in full."""
    value = number.cast("double")

    # One digit after the point is always present, so only its zero is removed.
    def trimmed(size: int, unit: str) -> Column:
        text = F.translate(F.format_number(value / size, 1), ",", "")
        return F.concat(F.regexp_replace(text, r"\.0$", ""), F.lit(f" {unit}"))

    return (
        F.when(F.abs(value) >= 1_000_000_000, trimmed(1_000_000_000, "млрд"))
        .when(F.abs(value) >= 1_000_000, trimmed(1_000_000, "млн"))
        .when(
            F.abs(value) >= 1_000,
            F.concat(F.translate(F.format_number(value / 1_000, 0), ",", ""), F.lit(" тыс")),
        )
        .otherwise(thousands(value))
    )


def net_loss(loss: Column, recovery: Column, clamp: bool = True) -> Column:
    """Loss minus recovery with missing amounts as zero, not below zero when clamped."""
    zero = F.lit(0).cast(MONEY)
    net = F.coalesce(loss, zero) - F.coalesce(recovery, zero)
    return F.greatest(F.lit(0).cast(MONEY), net) if clamp else net


def share_pct(part: Column, whole: Column, digits: int = 4) -> Column:
    """Percent of the whole as a rounded double; NULL when the whole is zero."""
    return F.round(F.try_divide(part.cast("double") * 100, whole.cast("double")), digits)


def loose_types(schema) -> list[Column]:
    """Export-friendly columns: decimals as double, zoned times as naive times."""
    out = []
    for field in schema.fields:
        kind = field.dataType.typeName()
        target = {"decimal": "double", "timestamp": "timestamp_ntz"}.get(kind)
        c = F.col(field.name)
        out.append(c.cast(target).alias(field.name) if target else c)
    return out
