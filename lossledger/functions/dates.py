"""Dates: parts, tolerant parsing, and periods written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fixed

_DATE_PART_FORMATS = {
    "year": "yyyy",
    "month": "yyyy-MM",
    "day": "yyyy-MM-dd",
    "month_num": "MM",
}


def date_part(ts: Column, op: str) -> Column:
    """``year`` 2025, ``month`` 2025-03, ``quarter`` 2025-Q1, ``day``, ``month_num`` 03."""
    if op == "quarter":
        return F.concat(F.date_format(ts, "yyyy"), F.lit("-Q"), F.quarter(ts).cast("string"))
    if op not in _DATE_PART_FORMATS:
        raise ValueError(f"date part {op!r}: use year, month, quarter, day or month_num")
    return F.date_format(ts, _DATE_PART_FORMATS[op])


def tolerant_timestamp(text: Column) -> Column:
    """ISO first, then day-first forms with and without a time; anything else is NULL."""
    value = F.trim(text)
    day_first = ("d.M.yyyy HH:mm:ss", "d.M.yyyy HH:mm", "d.M.yyyy")
    return F.coalesce(
        value.try_cast("timestamp_ntz"),
        *[F.try_to_timestamp(value, F.lit(f)).cast("timestamp_ntz") for f in day_first],
    )


def half_open_period(ts: Column, begin: str, end: str) -> Column:
    """``begin <= ts < end + 1 day``; both bounds are ISO dates, ``end`` is inclusive."""
    last = F.date_add(F.lit(end).cast("date"), 1)
    return (ts >= F.lit(begin).cast("timestamp_ntz")) & (ts < last.cast("timestamp_ntz"))


def _words(words) -> Column:
    return F.split(F.lit(",".join(words)), ",")


def _position(key: Column, words) -> Column:
    """Number of the word in the list, from 1; NULL when it is not there."""
    return F.nullif(F.array_position(_words(words), key).cast("int"), F.lit(0))


def _nullif_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def _explicit_dates(t: Column) -> Column:
    """Every valid dd.mm.yyyy or yyyy-mm-dd in the text, as an array of dates."""

    def build(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(
            F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")),
            "yyyy-MM-dd",
        )

    def parts(match: Column) -> Column:
        return F.split(match, r"[.\-/]")

    day_first = F.regexp_extract_all(
        t, F.lit(r"(?U)\b(\d{1,2}[.\-/]\d{1,2}[.\-/](?:20\d\d|\d\d))\b"), F.lit(1)
    )
    iso = F.regexp_extract_all(t, F.lit(r"(?U)\b(20\d\d-\d{1,2}-\d{1,2})\b"), F.lit(1))
    found = F.concat(
        F.transform(day_first, lambda m: build(parts(m)[2], parts(m)[1], parts(m)[0])),
        F.transform(iso, lambda m: build(parts(m)[0], parts(m)[1], parts(m)[2])),
    )
    return F.array_compact(found)


def _phrase_parts(t: Column) -> dict[str, Column]:
    """What a lower-cased phrase mentions; absent parts are NULL or empty."""
    quarter = F.coalesce(
        _nullif_empty(F.regexp_extract(t, r"(?U)\bq\s*([1-4])\b", 1)).cast("int"),
        _nullif_empty(F.regexp_extract(t, r"(?U)\b([1-4])\s*-?(?:й|го|ый)?\s*кв", 1)).cast("int"),
        _position(F.regexp_extract(t, r"(?U)\b(iv|iii|ii|i)\s*кв", 1), fixed.ROMAN_QUARTERS),
        *[
            F.when(t.rlike(stem + r"(?U)\w*\s+квартал"), F.lit(number))
            for stem, number in fixed.QUARTER_WORDS
        ],
    )
    half = _position(F.regexp_extract(t, r"(?U)(перв|втор)\w*\s+полугод", 1), ("перв", "втор"))
    number = "|".join(["\\d+", *fixed.SPELLED_NUMBERS])
    days_word = "(?:дней|дня|день|суток|сутки|сут)"
    return {
        "years": F.regexp_extract_all(t, F.lit(r"(?U)\b(20\d\d)\b"), F.lit(1)),
        "months": F.regexp_extract_all(t, F.lit(f"({fixed.MONTH_PATTERN})"), F.lit(1)),
        "quarter": quarter,
        "half": half,
        "days": F.coalesce(
            _nullif_empty(F.regexp_extract(t, rf"(?U)\bпервые\s+({number})\s+{days_word}\b", 1)),
            _nullif_empty(F.regexp_extract(t, rf"(?U)\b({number})\s+первых\s+{days_word}\b", 1)),
        ),
        "dates": _explicit_dates(t),
    }


def with_period(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the period a phrase names: ``struct(start, end, label, kind)``, ``end`` exclusive.

    Order of the readings: "first N days" of a month, explicit dates, then — only with a year
    in the text — quarter, half-year, month range, month, year. NULL when none applies.
    The parts are columns of their own, so that every pattern runs once per row.
    """
    parts, values = "__parts", "__values"
    phrase = "__phrase"
    staged = df.withColumn(phrase, F.replace(F.lower(F.col(text)), F.lit("  "), F.lit(" ")))
    staged = staged.withColumn(
        parts, F.struct(*[c.alias(n) for n, c in _phrase_parts(F.col(phrase)).items()])
    )

    def part(name: str) -> Column:
        return F.col(f"{parts}.{name}")

    def month_at(i: int) -> Column:
        word = F.substring(F.try_element_at(part("months"), F.lit(i)), 1, 3)
        return _position(F.regexp_replace(word, "^ма[яе]$", "май"), [m[0] for m in fixed.MONTHS])

    staged = staged.withColumn(
        values,
        F.struct(
            F.try_element_at(part("years"), F.lit(-1)).cast("int").alias("year"),
            month_at(1).alias("first_month"),
            month_at(-1).alias("last_month"),
            part("quarter").alias("quarter"),
            part("half").alias("half"),
            F.coalesce(
                part("days").try_cast("int"), _position(part("days"), fixed.SPELLED_NUMBERS)
            ).alias("days"),
            F.array_min(part("dates")).alias("first_date"),
            F.array_max(part("dates")).alias("last_date"),
        ),
    )
    return staged.withColumn(out, _period(lambda name: F.col(f"{values}.{name}"))).drop(
        phrase, parts, values
    )


def _period(value) -> Column:
    """The period from the values found in a phrase."""
    year, days = value("year"), value("days")
    first_month, last_month = value("first_month"), value("last_month")
    first_date, last_date = value("first_date"), value("last_date")
    year_text = year.cast("string")

    def month_name(number: Column, form: int) -> Column:
        return F.element_at(_words([m[form] for m in fixed.MONTHS]), number)

    def period(start: Column, end: Column, label: Column, kind: str) -> Column:
        return F.struct(
            start.alias("start"), end.alias("end"), label.alias("label"), F.lit(kind).alias("kind")
        )

    def span(month: Column, months: int) -> Column:
        return F.add_months(_month_start(year, month), months)

    quarter_month = (value("quarter") - 1) * 3 + 1
    half_month = (value("half") - 1) * 6 + 1
    low = F.least(first_month, last_month)
    high = F.greatest(first_month, last_month)
    dmy = "dd.MM.yyyy"

    return (
        F.when(
            days.isNotNull() & year.isNotNull() & first_month.isNotNull(),
            period(
                _month_start(year, first_month),
                F.date_add(_month_start(year, first_month), days),
                F.concat_ws(
                    " ", F.lit("первые"), days.cast("string"), F.lit("дня"),
                    month_name(first_month, 2), year_text,
                ),
                "range",
            ),
        )
        .when(
            first_date.isNotNull(),
            period(
                first_date,
                F.date_add(last_date, 1),
                F.when(first_date == last_date, F.date_format(first_date, dmy)).otherwise(
                    F.concat_ws("-", F.date_format(first_date, dmy), F.date_format(last_date, dmy))
                ),
                "range",
            ),
        )
        .when(year.isNull(), F.lit(None))
        .when(
            value("quarter").isNotNull(),
            period(
                _month_start(year, quarter_month),
                span(quarter_month, 3),
                F.concat(F.lit("Q"), value("quarter").cast("string"), F.lit(" "), year_text),
                "quarter",
            ),
        )
        .when(
            value("half").isNotNull(),
            period(
                _month_start(year, half_month),
                span(half_month, 6),
                F.concat_ws(
                    " ",
                    F.when(value("half") == 1, F.lit("первое")).otherwise(F.lit("второе")),
                    F.lit("полугодие"),
                    year_text,
                ),
                "half",
            ),
        )
        .when(
            first_month != last_month,
            period(
                _month_start(year, low),
                span(high, 1),
                F.concat(
                    month_name(first_month, 1), F.lit("-"), month_name(last_month, 1),
                    F.lit(" "), year_text,
                ),
                "range",
            ),
        )
        .when(
            first_month.isNotNull(),
            period(
                _month_start(year, first_month),
                span(first_month, 1),
                F.concat_ws(" ", month_name(first_month, 1), year_text),
                "month",
            ),
        )
        .otherwise(
            period(
                _month_start(year, F.lit(1)),
                _month_start(year + 1, F.lit(1)),
                F.concat(year_text, F.lit(" год")),
                "year",
            )
        )
    )
