"""Projections, renames and column order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.dates import date_part
from ..functions.money import loose_types

# --- Fixed values: columns every detail report carries, in report order.
AUDIT_COLUMNS = (
    "incdnt_sid", "incdnt_status_name", "incdnt_autoreg_flag",
    "incdnt_detection_person_name", "incdnt_source_name",
    "src_type_lvl_1_name", "src_type_lvl_2_name",
    "incdnt_type_lvl_1_name", "incdnt_type_lvl_2_name",
    "incdnt_detection_dt", "incdnt_start_dt", "incdnt_entry_dt",
    "org_struct_lvl_3_name", "org_struct_lvl_4_name", "process_lvl_4_name",
    "fin_impact_rub_amt", "direct_loss", "recovery_rub_amt", "recovery", "net_loss",
    "incdnt_summary_descr_txt", "incdnt_full_descr_txt", "incdnt_id",
)

# --- Fixed values: display names of the columns.
DISPLAY_NAMES = {
    "incdnt_id": "Идентификационный ключ инцидента операционного риска",
    "incdnt_sid": "Идентификатор события",
    "incdnt_status_name": "Статус события",
    "incdnt_autoreg_flag": "Признак авторегистрации",
    "incdnt_type_lvl_1_name": "Тип события - уровень 1",
    "incdnt_type_lvl_2_name": "Тип события - уровень 2",
    "incdnt_entry_dt": "Дата ввода",
    "org_struct_lvl_2_name": "Орг. структура - уровень 2",
    "org_struct_lvl_3_name": "Орг. структура - уровень 3",
    "org_struct_lvl_4_name": "Орг. структура - уровень 4",
    "risk_profile_id": "Идентификатор профиля риска",
    "risk_profile_name": "Наименование профиля риска",
    "incdnt_sum": "Общая сумма всех последствий (руб.)",
    "fin_impact_type_name": "Тип последствия",
    "fin_impact_kind_name": "Вид последствия",
    "fin_impact_rub_amt": "Сумма последствия (руб.)",
    "recovery_type_name": "Тип возмещения",
    "recovery_rub_amt": "Сумма возмещения (руб.)",
    "nonfin_impact_kind_name": "Вид качественной потери",
}


def select_present(df: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns in the listed order; absent names are skipped."""
    return df.select(*[c for c in columns if c in df.columns])


def keys_at_edges(df: DataFrame, business_id: str = "incdnt_sid", surrogate_id: str = "incdnt_id") -> DataFrame:
    """Business id first, surrogate id last, everything else in place."""
    first = [c for c in df.columns if c == business_id]
    last = [c for c in df.columns if c == surrogate_id]
    rest = [c for c in df.columns if c not in (business_id, surrogate_id)]
    return df.select(*first, *rest, *last)


def with_display_names(df: DataFrame, names: dict[str, str] = DISPLAY_NAMES) -> DataFrame:
    return df.withColumnsRenamed(names)


def lower_case_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def detail_columns(df: DataFrame, select: list[str] | None) -> DataFrame:
    """Every column without a selection, else the selection plus the audit columns."""
    if not select:
        return df
    extra = [c for c in AUDIT_COLUMNS if c in df.columns and c not in select]
    return select_present(df, list(select) + extra)


def derive(df: DataFrame, source: str, new_column: str, op: str = "month") -> DataFrame:
    return df.withColumn(new_column, date_part(df[source], op))


def for_export(df: DataFrame) -> DataFrame:
    """Decimals as double and zoned times as naive times."""
    return df.select(*loose_types(df.schema))


def preview(df: DataFrame, rows: int = 8, columns: int = 12) -> DataFrame:
    return df.select(*df.columns[:columns]).limit(rows)
