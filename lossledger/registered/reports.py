"""Reports (R)."""

import uuid

from pyspark.sql import functions as F

from ..functions.text import strip_rare_unicode
from ..operators.lineage import shared_folder
from ..plans import presets
from ..plans.report import Funnel, build_report, with_fill_rates
from ..plans.spec import ChildJoin, Metric, SourceModel
from ..sources import sinks
from .base import query

QUARTER = ("1998-01-01", "1998-03-31")

MODEL = SourceModel(
    columns=(
        "incdnt_id", "incdnt_sid", "incdnt_entry_dt", "incdnt_status_name", "incdnt_type_lvl_1_name",
        "risk_profile_id", "incdnt_sum", "risk_profile_name", "org_struct_lvl_2_name",
        "org_struct_lvl_3_name", "org_struct_lvl_4_name", "incdnt_autoreg_flag",
        "incdnt_drct_dmg_sum",
    ),
    children={
        "fin_impact": ("incdnt_id", "fin_impact_rub_amt", "fin_impact_type_name", "fin_impact_kind_name"),
        "recovery": ("incdnt_id", "recovery_rub_amt", "recovery_type_name"),
    },
    money={
        "incdnt_drct_dmg_sum": ChildJoin(
            "fin_impact", (Metric("fin_impact_rub_amt", "sum", "direct_loss", {"fin_impact_type_name": "R"}),)
        ),
        "recovery_rub_amt": ChildJoin("recovery", (Metric("recovery_rub_amt", "sum", "recovery"),)),
    },
)


def _tables(v):
    return {"incident": v.incident, "fin_impact": v.fin_impact, "recovery": v.recovery}


# Urgent cases and those of one segment, per quarter and region: what is left of them after returns,
# among mid-sized cases with impacts of several kinds; the two largest remainders of each quarter.
SPEC = {
    "source": {
        "table": "incident",
        "joins": [
            {"table": "fin_impact", "on": "incdnt_id", "how": "left", "pre_aggregate": {
                "agg": {"fin_impact_type_name": {"fn": "nunique", "as": "types"}}}},
            {"table": "recovery", "on": "incdnt_id", "how": "left", "pre_aggregate": {
                "agg": {"recovery_rub_amt": {"fn": "sum", "as": "returned"}}}},
        ],
    },
    "filters": [
        {"kind": "any_of", "options": [{"incdnt_type_lvl_1_name": "1-URGENT"}, {"org_struct_lvl_3_name__like": "%MACH%"}]},
        {"kind": "range", "column": "incdnt_sum", "op": "lt", "value": 300_000},
        {"kind": "range", "column": "types", "op": "gte", "value": 2},
        {"kind": "range", "column": "cases", "op": "gt", "value": 1},
    ],
    "derive": [{"source": "incdnt_entry_dt", "new_column": "quarter", "op": "quarter"}],
    "aggregate": {
        "group_by": ["quarter", "org_struct_lvl_2_name"],
        "metrics": [
            {"as": "cases", "source": "incdnt_id", "fn": "nunique"},
            {"as": "volume", "source": "incdnt_sum", "fn": "sum"},
            {"as": "given_back", "source": "returned", "fn": "sum"},
        ],
    },
    "derived_metrics": [{"as": "remainder", "expr": {"op": "sub", "left": "volume", "right": "given_back"}}],
    "window": [{"partition_by": ["quarter"], "order_by": "remainder", "top_n": 2}],
    "sort": [{"by": "quarter", "desc": False}, {"by": "rank", "desc": False}],
    "select": ["quarter", "rank", "org_struct_lvl_2_name", "cases", "volume", "given_back", "remainder"],
}

_STAGES = """
    WITH k AS (SELECT incdnt_id, COUNT(DISTINCT fin_impact_type_name) AS types FROM fin_impact GROUP BY 1),
         b AS (SELECT incdnt_id, SUM(recovery_rub_amt) AS returned FROM recovery GROUP BY 1),
         chosen AS (SELECT * FROM incident LEFT JOIN k USING (incdnt_id) LEFT JOIN b USING (incdnt_id)
                    WHERE (incdnt_type_lvl_1_name = '1-URGENT' OR org_struct_lvl_3_name LIKE '%MACH%') AND incdnt_sum < 300000),
         g AS (SELECT year(incdnt_entry_dt) || '-Q' || quarter(incdnt_entry_dt) AS quarter, org_struct_lvl_2_name,
                      COUNT(DISTINCT incdnt_id) AS cases, SUM(incdnt_sum) AS volume, COALESCE(SUM(returned), 0) AS given_back
               FROM chosen WHERE types >= 2 GROUP BY 1, 2 HAVING cases > 1),
         top AS (SELECT quarter, ROW_NUMBER() OVER (PARTITION BY quarter ORDER BY volume - given_back DESC, org_struct_lvl_2_name) AS rank,
                        org_struct_lvl_2_name, cases, CAST(volume AS DOUBLE) AS volume, CAST(given_back AS DOUBLE) AS given_back,
                        CAST(volume - given_back AS DOUBLE) AS remainder FROM g QUALIFY rank <= 2)"""


@query("r1_declarative_report", _STAGES + "SELECT * FROM top", ("incident", "fin_impact", "recovery"))
def declarative_report(v):
    return build_report(_tables(v), SPEC, MODEL)


@query("g34_report_funnel", _STAGES + """
    SELECT 1 AS place, 'source' AS stage, (SELECT COUNT(*) FROM chosen) AS rows
    UNION ALL SELECT 2, 'join', (SELECT COUNT(*) FROM chosen)
    UNION ALL SELECT 3, 'ranges', (SELECT COUNT(*) FROM chosen WHERE types >= 2)
    UNION ALL SELECT 4, 'aggregate', (SELECT COUNT(*) FROM g)
    UNION ALL SELECT 5, 'export', (SELECT COUNT(*) FROM top)""", ("incident", "fin_impact", "recovery"))
def report_funnel(v):
    """Rows left after each stage of the report, counted while it is exported."""
    spark, funnel = v.incident.sparkSession, Funnel()
    report = build_report(_tables(v), SPEC, MODEL, funnel)
    sinks.publish_csv(report, f"{shared_folder(spark)}/report-{uuid.uuid4().hex}")
    rows = [(place, *row) for place, row in enumerate(funnel.rows(), 1)]
    return spark.createDataFrame(rows, "place int, stage string, rows bigint")


@query("r1_ranked_report", """
    WITH g AS (SELECT strftime(incdnt_entry_dt, '%Y-%m') AS month, org_struct_lvl_4_name,
                      COUNT(incdnt_id) AS cnt, SUM(incdnt_sum) AS loss FROM incident
               WHERE incdnt_status_name <> 'P' AND incdnt_sum >= 10000 GROUP BY 1, 2)
    SELECT month, org_struct_lvl_4_name, cnt, CAST(loss AS DOUBLE) AS loss,
           ROW_NUMBER() OVER (PARTITION BY month ORDER BY cnt DESC, org_struct_lvl_4_name) AS rank
    FROM g WHERE cnt > 2 QUALIFY rank <= 3""", ("incident",))
def ranked_report(v):
    return build_report({"incident": v.incident}, {
        "source": {"table": "incident"},
        "filters": [
            {"kind": "categorical", "column": "incdnt_status_name", "op": "ne", "value": "P"},
            {"kind": "range", "column": "incdnt_sum", "op": "gte", "value": 10000},
            {"kind": "range", "column": "cnt", "op": "gt", "value": 2},
        ],
        "derive": [{"source": "incdnt_entry_dt", "new_column": "month", "op": "month"}],
        "aggregate": {
            "group_by": ["month", "org_struct_lvl_4_name"],
            "metrics": [
                {"as": "cnt", "source": "incdnt_id", "fn": "count"},
                {"as": "loss", "source": "incdnt_sum", "fn": "sum"},
            ],
        },
        "window": [{"partition_by": ["month"], "order_by": "cnt", "top_n": 3}],
        "sort": [{"by": "month", "desc": False}, {"by": "rank", "desc": False}],
    })


@query("r2_sparse_money_replaced", """
    SELECT incdnt_status_name, CAST(COALESCE(SUM(direct_loss), 0) AS DOUBLE) AS loss, COUNT(incdnt_id) AS cnt
    FROM incident_base JOIN (SELECT incdnt_id, SUM(fin_impact_rub_amt) AS direct_loss FROM fin_impact
                             WHERE fin_impact_type_name = 'R' GROUP BY 1) USING (incdnt_id)
    WHERE direct_loss >= 70000 GROUP BY 1""", ("incident_base", "fin_impact"))
def sparse_money_replaced(v):
    # The supplied tables have no such column: it stays unfilled, and the count finds that.
    incident = v.incident.withColumn("incdnt_drct_dmg_sum", F.lit(None).cast("decimal(18,2)"))
    spec = {
        "source": {"table": "incident"},
        "filters": [{"kind": "range", "column": "incdnt_drct_dmg_sum", "op": "gte", "value": 70000}],
        "aggregate": {
            "group_by": ["incdnt_status_name"],
            "metrics": [
                {"as": "loss", "source": "incdnt_drct_dmg_sum", "fn": "sum"},
                {"as": "cnt", "source": "incdnt_id", "fn": "count"},
            ],
        },
    }
    return build_report({**_tables(v), "incident": incident}, spec, with_fill_rates(MODEL, incident))


_IN_QUARTER = "incdnt_entry_dt >= TIMESTAMP '1998-01-01' AND incdnt_entry_dt < TIMESTAMP '1998-04-01'"
_ENTRY = "strftime(incdnt_entry_dt, '%Y-%m-%d %H:%M:%S') AS incdnt_entry_dt"


@query("r3_period_report", f"""
    SELECT incdnt_id, incdnt_sid, {_ENTRY}, incdnt_status_name, org_struct_lvl_3_name, risk_profile_name,
           CAST(incdnt_sum AS DOUBLE) AS incdnt_sum
    FROM incident WHERE {_IN_QUARTER} AND substr(upper(org_struct_lvl_3_name), 1, 4) IN ('BUIL', 'AUTO')
      AND incdnt_sum > 1000
    QUALIFY ROW_NUMBER() OVER (PARTITION BY incdnt_id ORDER BY incident.incdnt_entry_dt, incdnt_sid) = 1""", ("incident",))
def period_report(v):
    return presets.period_report(
        v.incident, *QUARTER, "org_struct_lvl_3_name", ["BUIL", "AUTO"],
        texts=["risk_profile_name"], condition="incdnt_sum > 1000",
    ).select(
        "incdnt_id", "incdnt_sid", "incdnt_entry_dt", "incdnt_status_name", "org_struct_lvl_3_name",
        "risk_profile_name", "incdnt_sum",
    )


@query("r4_impact_report", f"""
    SELECT incdnt_sid, {_ENTRY}, fin_impact_sid, fin_impact_type_name, fin_impact_account_num,
           CAST(fin_impact_rub_amt AS DOUBLE) AS fin_impact_rub_amt
    FROM incident JOIN fin_impact USING (incdnt_id) WHERE {_IN_QUARTER}
    QUALIFY ROW_NUMBER() OVER (PARTITION BY incdnt_sid, fin_impact_sid ORDER BY
        fin_impact_reg_dt, fin_impact_account_num, fin_impact_docum_num, fin_impact.fin_impact_rub_amt) = 1""",
       ("incident", "fin_impact"))
def impact_report(v):
    order = [F.asc(c) for c in
             ("fin_impact_reg_dt", "fin_impact_account_num", "fin_impact_docum_num", "fin_impact_rub_amt")]
    return presets.impact_report(v.incident, v.fin_impact, *QUARTER, order).select(
        "incdnt_sid", "incdnt_entry_dt", "fin_impact_sid", "fin_impact_type_name",
        "fin_impact_account_num", "fin_impact_rub_amt",
    )


@query("r5_recovery_report", f"""
    SELECT incdnt_sid, {_ENTRY}, recovery_sid, recovery_type_name, recovery_doc_num,
           CAST(recovery_rub_amt AS DOUBLE) AS recovery_rub_amt
    FROM incident JOIN recovery USING (incdnt_id) WHERE {_IN_QUARTER}
    QUALIFY ROW_NUMBER() OVER (PARTITION BY incdnt_sid, recovery_sid ORDER BY
        recovery_reg_dt, recovery_src_account_num, recovery_doc_num, recovery.recovery_rub_amt) = 1""",
       ("incident", "recovery"))
def recovery_report(v):
    order = [F.asc(c) for c in
             ("recovery_reg_dt", "recovery_src_account_num", "recovery_doc_num", "recovery_rub_amt")]
    return presets.recovery_report(v.incident, v.recovery, *QUARTER, order).select(
        "incdnt_sid", "incdnt_entry_dt", "recovery_sid", "recovery_type_name", "recovery_doc_num", "recovery_rub_amt"
    )


@query("r6_qualitative_report", f"""
    SELECT incdnt_sid, {_ENTRY}, nonfin_impact_sid, nonfin_impact_kind_name, nonfin_impact_influence_class_name
    FROM incident JOIN nonfin_impact USING (incdnt_id) WHERE {_IN_QUARTER}
    QUALIFY ROW_NUMBER() OVER (PARTITION BY incdnt_sid, nonfin_impact_sid ORDER BY
        nonfin_part_num, nonfin_supp_num, nonfin_impact_kind_name, nonfin_impact_influence_class_name) = 1""",
       ("incident", "nonfin_impact"))
def qualitative_report(v):
    order = [F.asc(c) for c in ("nonfin_part_num", "nonfin_supp_num", "nonfin_impact_kind_name",
                                "nonfin_impact_influence_class_name")]
    return presets.qualitative_report(v.incident, v.nonfin_impact, *QUARTER, order).select(
        "incdnt_sid", "incdnt_entry_dt", "nonfin_impact_sid", "nonfin_impact_kind_name",
        "nonfin_impact_influence_class_name",
    )


@query("r7_deleted_report", """
    SELECT incdnt_sid, strftime(incdnt_entry_dt, '%Y-%m-%d %H:%M:%S') AS incdnt_entry_dt, org_struct_lvl_3_name,
           stts_chng_id, stts_chng_comment_txt, stts_chng_user_num
    FROM incident LEFT JOIN (SELECT * FROM status_change WHERE upper(stts_chng_action_name) = 'ERROR') USING (incdnt_id)
    WHERE incdnt_entry_dt >= TIMESTAMP '1996-01-01' AND incdnt_entry_dt < TIMESTAMP '2000-01-01'
      AND incdnt_status_name = 'P' AND substr(upper(org_struct_lvl_3_name), 1, 4) IN ('HOUS', 'FURN')""",
       ("incident", "status_change"))
def deleted_report(v):
    return presets.deleted_report(
        v.incident, v.status_change, "1996-01-01", "1999-12-31", "org_struct_lvl_3_name", ["HOUS", "FURN"],
        "p", "Error",
    ).select(
        "incdnt_sid", "incdnt_entry_dt", "org_struct_lvl_3_name", "stts_chng_id",
        "stts_chng_comment_txt", "stts_chng_user_num",
    )


@query("r8_one_incident_report", """
    SELECT incdnt_sid, fin_impact_sid, CAST(fin_impact_rub_amt AS DOUBLE) AS fin_impact_rub_amt, recovery_sid,
           CAST(recovery_rub_amt AS DOUBLE) AS recovery_rub_amt
    FROM incident LEFT JOIN fin_impact USING (incdnt_id) LEFT JOIN recovery USING (incdnt_id)
    WHERE incdnt_sid = 'EVE-77'""", ("incident", "fin_impact", "recovery"))
def one_incident_report(v):
    return presets.one_incident_report(v.incident, v.fin_impact, v.recovery, "EVE-77").select(
        "incdnt_sid", "fin_impact_sid", "fin_impact_rub_amt", "recovery_sid", "recovery_rub_amt"
    )


@query("r9_profiling_extract", f"""
    SELECT incdnt_id, incdnt_sid, {_ENTRY}, incdnt_status_name, org_struct_lvl_3_name, org_struct_lvl_4_name, risk_profile_name
    FROM incident WHERE {_IN_QUARTER} AND upper(incdnt_status_name) = 'F' AND lower(org_struct_lvl_3_name) LIKE '%mobile%'
      AND (lower(org_struct_lvl_2_name) LIKE '%a%' OR lower(org_struct_lvl_4_name) LIKE '%a%') AND incdnt_sum < 400000""",
       ("incident",))
def profiling_extract(v):
    return presets.profiling_extract(
        v.incident, *QUARTER, status="f", unit=("org_struct_lvl_3_name", "Mobile"),
        block=(["org_struct_lvl_2_name", "org_struct_lvl_4_name"], "A"),
        condition="incdnt_sum < 400000", texts=["risk_profile_name"],
    ).select(
        "incdnt_id", "incdnt_sid", "incdnt_entry_dt", "incdnt_status_name", "org_struct_lvl_3_name",
        "org_struct_lvl_4_name", "risk_profile_name",
    )


@query("r9_readable_text", """
    SELECT doc_id, regexp_replace(text, '[\\x{1128}-\\x{FFFF}\\x02\\x08\\x0b]', '', 'g') AS text FROM documents""")
def readable_text(v):
    return v.documents.select("doc_id", strip_rare_unicode(F.col("text")).alias("text"))


@query("r1_report_without_rows", """
    SELECT incdnt_type_lvl_1_name, CAST(SUM(incdnt_sum) AS DOUBLE) AS loss FROM incident_base
    WHERE incdnt_sum > 1000000000 GROUP BY 1""", ("incident_base",))
def report_without_rows(v):
    return build_report({"incident": v.incident_base}, {
        "source": {"table": "incident"},
        "filters": [{"kind": "range", "column": "incdnt_sum", "op": "gt", "value": 1_000_000_000}],
        "aggregate": {
            "group_by": ["incdnt_type_lvl_1_name"],
            "metrics": [{"as": "loss", "source": "incdnt_sum", "fn": "sum"}],
        },
    })


@query("r1_detail_report", """
    SELECT incdnt_sid, risk_profile_name, CAST(incdnt_sum AS DOUBLE) AS incdnt_sum, incdnt_status_name,
           incdnt_autoreg_flag, incdnt_type_lvl_1_name,
           strftime(incdnt_entry_dt, '%Y-%m-%d %H:%M:%S') AS incdnt_entry_dt, org_struct_lvl_3_name,
           org_struct_lvl_4_name, CAST(direct_loss AS DOUBLE) AS direct_loss, incdnt_id
    FROM incident LEFT JOIN (SELECT incdnt_id, SUM(fin_impact_rub_amt) AS direct_loss FROM fin_impact
                             WHERE fin_impact_type_name = 'R' GROUP BY 1) USING (incdnt_id)
    WHERE incdnt_entry_dt >= TIMESTAMP '2000-01-01' AND incdnt_entry_dt < TIMESTAMP '2000-04-01'
      AND incdnt_status_name <> 'P' AND incdnt_sum >= 200000""", ("incident", "fin_impact"))
def detail_report(v):
    return build_report(_tables(v), {
        "source": {
            "table": "incident",
            "joins": [{
                "table": "fin_impact", "on": "incdnt_id",
                "pre_aggregate": {"agg": {"fin_impact_rub_amt": {
                    "fn": "sum", "as": "direct_loss", "filter": {"fin_impact_type_name": {"eq": "R"}}}}},
            }],
        },
        "filters": [
            {"kind": "period", "intent": "Q1 2000", "column": "incdnt_entry_dt", "required": True},
            {"kind": "categorical", "column": "incdnt_status_name", "op": "ne", "value": "P"},
            {"kind": "range", "column": "incdnt_sum", "op": "gte", "value": 200000},
        ],
        "select": ["risk_profile_name", "incdnt_sum"],
        "detail": True,
    }, MODEL)
