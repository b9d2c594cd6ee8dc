"""Registration of queries and the SQL form of the views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VIEW_SQL = {
    "incident_base": """
        SELECT o_orderkey AS incdnt_id, 'EVE-' || o_orderkey AS incdnt_sid,
               o_orderdate AS incdnt_entry_dt, o_orderstatus AS incdnt_status_name,
               o_orderpriority AS incdnt_type_lvl_1_name, o_custkey AS risk_profile_id,
               CAST(o_totalprice AS DECIMAL(18,2)) AS incdnt_sum
        FROM orders""",
    "unit": """
        SELECT c_custkey, c_name AS risk_profile_name, r_name AS org_struct_lvl_2_name,
               c_mktsegment AS org_struct_lvl_3_name, n_name AS org_struct_lvl_4_name,
               CASE WHEN c_acctbal > 5000 THEN 'Y' WHEN c_acctbal > 0 THEN 'N' END AS incdnt_autoreg_flag
        FROM customer JOIN nation ON c_nationkey = n_nationkey
                      JOIN region ON n_regionkey = r_regionkey""",
    "incident": """
        SELECT incident_base.*, unit.* EXCLUDE (c_custkey)
        FROM incident_base JOIN unit ON risk_profile_id = c_custkey""",
    "fin_impact": """
        SELECT l_orderkey AS incdnt_id, l_orderkey || '-' || l_linenumber AS fin_impact_sid,
               l_returnflag AS fin_impact_type_name, l_linestatus AS fin_impact_kind_name,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS fin_impact_rub_amt,
               l_shipdate AS fin_impact_reg_dt, l_partkey AS fin_impact_account_num,
               l_suppkey AS fin_impact_docum_num
        FROM lineitem""",
    "recovery": """
        SELECT l_orderkey AS incdnt_id, l_orderkey || '-' || l_linenumber AS recovery_sid,
               l_linestatus AS recovery_type_name,
               CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS recovery_rub_amt,
               l_shipdate AS recovery_reg_dt, l_partkey AS recovery_src_account_num,
               l_suppkey AS recovery_doc_num
        FROM lineitem WHERE l_returnflag = 'A'""",
    "nonfin_impact": """
        SELECT l_orderkey AS incdnt_id, l_orderkey || '-' || l_linenumber AS nonfin_impact_sid,
               l_returnflag || l_linestatus AS nonfin_impact_kind_name,
               CASE WHEN l_quantity >= 40 THEN 'very high' WHEN l_quantity >= 30 THEN 'high'
                    WHEN l_quantity >= 20 THEN 'medium' WHEN l_quantity >= 10 THEN 'low'
                    ELSE 'none' END AS nonfin_impact_influence_class_name,
               l_partkey AS nonfin_part_num, l_suppkey AS nonfin_supp_num
        FROM lineitem""",
    "status_change": r"""
        SELECT user_id AS incdnt_id, event_id AS stts_chng_id, event_type AS stts_chng_action_name,
               ts AS stts_chng_action_dttm, props AS stts_chng_comment_txt,
               CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS stts_chng_user_num
        FROM events""",
}
_NEEDS = {"incident": ("incident_base", "unit")}


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """Put the SQL of the named views in front of a statement."""
    names: list[str] = []
    for view in views:
        names += [n for n in (*_NEEDS.get(view, ()), view) if n not in names]
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def presentable(df: DataFrame) -> DataFrame:
    """Plain result types: decimals as double, dates and times as text."""
    columns = []
    for field in df.schema.fields:
        kind, c = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind == "decimal":
            c = c.cast("double")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(views) -> DataFrame`` under a name, with its SQL where there is one."""

    def register(fn):
        def run(spark: SparkSession, path: str) -> DataFrame:
            return presentable(fn(Views(spark, path)))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(sql, views)
        return fn

    return register
