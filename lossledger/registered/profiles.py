"""Profiles of an extract (G18–G31, G35–G44)."""

from pyspark.sql import functions as F

from ..functions import predicates as p
from ..operators import profile
from ..operators.joins import join_aggregated
from .base import query


def _with_recovered(v):
    """Incidents with their recovery sum."""
    return join_aggregated(v.incident, v.recovery, [F.sum("recovery_rub_amt").alias("recovered")])


_RECOVERED = """
    LEFT JOIN (SELECT incdnt_id, SUM(recovery_rub_amt) AS recovered FROM recovery GROUP BY 1) USING (incdnt_id)"""


def pct(part: str, whole: str) -> str:
    return f"ROUND(CAST({part} AS DOUBLE) * 100 / CAST(({whole}) AS DOUBLE), 4)"


_SHARES = (
    "COUNT(*) AS cnt, CAST(SUM(incdnt_sum) AS DOUBLE) AS loss, "
    + pct("COUNT(*)", "SELECT COUNT(*) FROM incident") + " AS cnt_pct, "
    + pct("SUM(incdnt_sum)", "SELECT SUM(incdnt_sum) FROM incident") + " AS loss_pct"
)


@query("g18_monthly_profile", f"""
    SELECT strftime(incdnt_entry_dt, '%Y-%m') AS month, {_SHARES} FROM incident GROUP BY 1""", ("incident",))
def monthly(v):
    return profile.monthly(v.incident, "incdnt_entry_dt", "incdnt_sum")


_LONG = """
    (SELECT incdnt_sum, unnest(['incdnt_status_name', 'incdnt_type_lvl_1_name', 'org_struct_lvl_3_name', 'org_struct_lvl_4_name']) AS col,
            unnest([incdnt_status_name, incdnt_type_lvl_1_name, org_struct_lvl_3_name, org_struct_lvl_4_name]) AS value
     FROM incident)"""


@query("g19_category_profile", f"""
    SELECT col, value, {_SHARES}, ROW_NUMBER() OVER (PARTITION BY col ORDER BY COUNT(*) DESC, value) AS rn
    FROM {_LONG} GROUP BY col, value QUALIFY rn <= 5""", ("incident",))
def categories(v):
    columns = ["incdnt_status_name", "incdnt_type_lvl_1_name", "org_struct_lvl_3_name", "org_struct_lvl_4_name"]
    return profile.categories(v.incident, columns, "incdnt_sum")


@query("g20_block_profile", f"""
    SELECT 'org_struct_lvl_4_name' AS col, org_struct_lvl_4_name AS value, {_SHARES},
           ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, org_struct_lvl_4_name) AS rn
    FROM incident WHERE NOT starts_with(org_struct_lvl_4_name, 'NATION_1') GROUP BY 2 QUALIFY rn <= 5""", ("incident",))
def blocks(v):
    return profile.blocks(v.incident, "org_struct_lvl_4_name", "incdnt_sum", "NATION_1")


@query("g21_detection_channels", """
    SELECT COUNT(*) FILTER (WHERE lower(org_struct_lvl_2_name) LIKE '%asia%') AS client_cnt,
           CAST(SUM(incdnt_sum) FILTER (WHERE lower(org_struct_lvl_2_name) LIKE '%asia%') AS DOUBLE) AS client_loss,
           COUNT(*) FILTER (WHERE regexp_matches(lower(org_struct_lvl_2_name), 'europ|east')) AS control_cnt,
           CAST(SUM(incdnt_sum) FILTER (WHERE regexp_matches(lower(org_struct_lvl_2_name), 'europ|east')) AS DOUBLE) AS control_loss
    FROM incident""", ("incident",))
def detection_channels(v):
    return profile.detection_channels(
        v.incident, "org_struct_lvl_2_name", "incdnt_sum", client="asia", control="europ|east"
    )


@query("g22_largest_losses", f"""
    SELECT incdnt_sid, incdnt_status_name, CAST(incdnt_sum AS DOUBLE) AS incdnt_sum,
           {pct('incdnt_sum', 'SELECT SUM(incdnt_sum) FROM incident_base')} AS loss_pct
    FROM incident_base ORDER BY incident_base.incdnt_sum DESC, incdnt_sid LIMIT 3""", ("incident_base",))
def largest(v):
    return profile.largest(v.incident_base, "incdnt_sid", "incdnt_sum", "incdnt_status_name")


@query("g23_concentration", f"""
    SELECT CAST(SUM(incdnt_sum) AS DOUBLE) AS top_sum,
           (SELECT CAST(SUM(incdnt_sum) AS DOUBLE) FROM incident_base) AS total_loss,
           {pct('SUM(incdnt_sum)', 'SELECT SUM(incdnt_sum) FROM incident_base')} AS top_pct
    FROM (SELECT incdnt_sum FROM incident_base ORDER BY 1 DESC LIMIT 10)""", ("incident_base",))
def concentration(v):
    return profile.concentration(v.incident_base, "incdnt_sum")


@query("g24_most_frequent_pair", """
    SELECT risk_profile_id, risk_profile_name, COUNT(*) AS cnt FROM incident
    GROUP BY 1, 2 ORDER BY cnt DESC, 1, 2 LIMIT 1""", ("incident",))
def most_frequent_pair(v):
    return profile.most_frequent_pair(v.incident, "risk_profile_id", "risk_profile_name")


@query("g25_status_groups", """
    SELECT CASE incdnt_status_name WHEN 'F' THEN 'approved' WHEN 'O' THEN 'draft' ELSE 'deleted' END AS status_group,
           COUNT(*) AS cnt FROM incident_base GROUP BY 1""", ("incident_base",))
def status_groups(v):
    return profile.status_groups(v.incident_base, "incdnt_status_name", ["f"], ["o"], ["p"])


@query("g26_deleted_block", f"""
    SELECT COUNT(*) AS deleted_cnt, CAST(SUM(incdnt_sum) AS DOUBLE) AS deleted_loss,
           CAST(COALESCE(SUM(recovered), 0) AS DOUBLE) AS deleted_recovery
    FROM incident {_RECOVERED} WHERE incdnt_status_name = 'P'""", ("incident", "recovery"))
def deleted_block(v):
    return profile.deleted_block(_with_recovered(v), "incdnt_status_name", "incdnt_sum", "recovered", ["p"])


@query("g27_kind_distribution", """
    SELECT nonfin_impact_kind_name, COUNT(*) AS cnt FROM nonfin_impact GROUP BY 1""", ("nonfin_impact",))
def kind_distribution(v):
    return profile.distribution(v.nonfin_impact, "nonfin_impact_kind_name")


@query("g27_type_distribution", """
    SELECT fin_impact_type_name, COUNT(*) AS cnt FROM fin_impact GROUP BY 1""", ("fin_impact",))
def type_distribution(v):
    return profile.distribution(v.fin_impact, "fin_impact_type_name")


@query("g27_recovery_distribution", """
    SELECT recovery_type_name, COUNT(*) AS cnt FROM recovery GROUP BY 1""", ("recovery",))
def recovery_distribution(v):
    return profile.distribution(v.recovery, "recovery_type_name")


_SERIES = """
    SELECT strftime(date_trunc('{unit}', incdnt_entry_dt), '%Y-%m-%d') AS bucket, COUNT(*) AS cnt,
           CAST(SUM(incdnt_sum) AS DOUBLE) AS loss, CAST(COALESCE(SUM(recovered), 0) AS DOUBLE) AS recovery
    FROM incident {rec} WHERE {cond} GROUP BY 1"""


def _series(v, condition: str | None):
    df = _with_recovered(v)
    df = df.filter(condition) if condition else df
    return profile.adaptive_series(df, "incdnt_entry_dt", "incdnt_sum", "recovered")


@query("g28_series_by_month", _SERIES.format(unit="month", rec=_RECOVERED, cond="TRUE"), ("incident", "recovery"))
def series_by_month(v):
    return _series(v, None)


_ONE_QUARTER = "incdnt_entry_dt >= TIMESTAMP '1998-01-01' AND incdnt_entry_dt < TIMESTAMP '1998-04-01'"


@query("g28_series_by_week", _SERIES.format(unit="week", rec=_RECOVERED, cond=_ONE_QUARTER), ("incident", "recovery"))
def series_by_week(v):
    return _series(v, _ONE_QUARTER.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


@query("g28_series_by_day", """
    SELECT strftime(ts, '%Y-%m-%d') AS bucket, COUNT(*) AS cnt,
           CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS loss,
           CAST(COALESCE(SUM(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type = 'purchase'), 0) AS DOUBLE) AS recovery
    FROM events GROUP BY 1""")
def series_by_day(v):
    amount = F.col("value").cast("decimal(18,2)")
    df = v.events.select(
        "ts", amount.alias("loss"), F.when(F.col("event_type") == "purchase", amount).alias("recovery")
    )
    return profile.adaptive_series(df, "ts", "loss", "recovery")


@query("g29_best_distribution", """
    SELECT 'incdnt_type_lvl_1_name' AS col, incdnt_type_lvl_1_name AS value, COUNT(*) AS cnt
    FROM incident GROUP BY 2""", ("incident",))
def best_distribution(v):
    return profile.best_distribution(v.incident, [
        "incdnt_sid", "risk_profile_name", "incdnt_status_name", "org_struct_lvl_2_name",
        "org_struct_lvl_4_name", "incdnt_type_lvl_1_name",
    ])


@query("g30_text_frequency", """
    WITH t AS (SELECT doc_id, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text FROM documents
               WHERE regexp_replace(text, '\\s+', '', 'g') <> '')
    SELECT lower(text) AS key, MIN_BY(text, doc_id) AS display, COUNT(*) AS cnt,
           ROUND(COUNT(*) * 100.0::DOUBLE / (SELECT COUNT(*) FROM t), 4) AS pct
    FROM t GROUP BY 1 ORDER BY cnt DESC, 1 LIMIT 200""")
def text_frequency(v):
    return profile.text_frequency(v.documents, "text", "doc_id")


@query("g31_complaints_per_month", """
    SELECT strftime(o_orderdate, '%Y-%m') AS month, COUNT(*) AS cnt,
           ROUND(COUNT(*) * 100.0::DOUBLE / (SELECT COUNT(*) FROM documents), 4) AS pct
    FROM documents JOIN orders ON o_orderkey = doc_id GROUP BY 1""")
def complaints_per_month(v):
    dated = v.documents.join(v.orders, F.col("doc_id") == F.col("o_orderkey"), "left")
    return profile.count_shares(dated, F.date_format("o_orderdate", "yyyy-MM"), "month")


@query("g31_complaints_per_label", """
    SELECT quality * 2 + toxic AS label, COUNT(*) AS cnt,
           ROUND(COUNT(*) * 100.0::DOUBLE / (SELECT COUNT(*) FROM documents), 4) AS pct
    FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def complaints_per_label(v):
    labelled = v.documents.join(v.labels, "doc_id", "left")
    return profile.count_shares(labelled, F.col("quality") * 2 + F.col("toxic"), "label")


@query("g35_period_totals", f"""
    SELECT COUNT(*) AS incidents, COUNT(*) FILTER (WHERE incdnt_sum > 0) AS with_loss,
           COUNT(*) FILTER (WHERE recovered > 0) AS with_recovery,
           COUNT(*) FILTER (WHERE incdnt_autoreg_flag = 'Y') AS automatic,
           CAST(SUM(incdnt_sum) AS DOUBLE) AS loss,
           CAST(SUM(incdnt_sum) FILTER (WHERE org_struct_lvl_3_name = 'BUILDING') AS DOUBLE) AS credit_loss,
           CAST(SUM(incdnt_sum) FILTER (WHERE org_struct_lvl_3_name <> 'BUILDING') AS DOUBLE) AS other_loss,
           CAST(SUM(recovered) AS DOUBLE) AS recovery,
           CAST(SUM(incdnt_sum) - SUM(recovered) AS DOUBLE) AS net
    FROM incident {_RECOVERED}""", ("incident", "recovery"))
def period_totals(v):
    return profile.period_totals(
        _with_recovered(v), "incdnt_sum", "recovered", p.is_flag_set("incdnt_autoreg_flag"),
        F.col("org_struct_lvl_3_name") == "BUILDING",
    )


@query("g35_status_counts", """
    SELECT incdnt_status_name, COUNT(*) AS cnt FROM incident_base GROUP BY 1""", ("incident_base",))
def status_counts(v):
    return profile.distribution(v.incident_base, "incdnt_status_name")


@query("g36_amounts_by_type", f"""
    SELECT fin_impact_type_name, CAST(SUM(fin_impact_rub_amt) AS DOUBLE) AS amount, COUNT(*) AS cnt,
           fin_impact_type_name = 'N' AS is_profit,
           CASE WHEN fin_impact_type_name <> 'N' THEN
               {pct('SUM(fin_impact_rub_amt)', "SELECT SUM(fin_impact_rub_amt) FROM fin_impact WHERE fin_impact_type_name <> 'N'")}
           END AS pct
    FROM fin_impact GROUP BY 1""", ("fin_impact",))
def amounts_by_type(v):
    return profile.amounts_by_type(v.fin_impact, "fin_impact_type_name", "fin_impact_rub_amt", "N")


@query("g36_largest_kinds", """
    SELECT fin_impact_kind_name, CAST(SUM(fin_impact_rub_amt) AS DOUBLE) AS amount
    FROM fin_impact GROUP BY 1 ORDER BY SUM(fin_impact_rub_amt) DESC, 1 LIMIT 3""", ("fin_impact",))
def largest_kinds(v):
    return profile.largest_kinds(v.fin_impact, "fin_impact_kind_name", "fin_impact_rub_amt")


@query("g37_recovery_totals", """
    SELECT COUNT(*) AS row_count, COUNT(DISTINCT incdnt_id) AS incidents, CAST(SUM(recovery_rub_amt) AS DOUBLE) AS recovery
    FROM recovery""", ("recovery",))
def recovery_totals(v):
    return profile.recovery_totals(v.recovery, "incdnt_id", "recovery_rub_amt")


@query("g37_largest_recovery_types", """
    SELECT recovery_type_name, CAST(SUM(recovery_rub_amt) AS DOUBLE) AS amount
    FROM recovery GROUP BY 1 ORDER BY SUM(recovery_rub_amt) DESC, 1 LIMIT 3""", ("recovery",))
def largest_recovery_types(v):
    return profile.largest_kinds(v.recovery, "recovery_type_name", "recovery_rub_amt")


@query("g38_top_kinds", """
    SELECT nonfin_impact_kind_name AS kind, COUNT(*) AS cnt,
           ROUND(COUNT(*) * 100.0::DOUBLE / (SELECT COUNT(*) FROM nonfin_impact), 4) AS pct
    FROM nonfin_impact GROUP BY 1 ORDER BY cnt DESC, 1 LIMIT 5""", ("nonfin_impact",))
def top_kinds(v):
    shares = profile.count_shares(v.nonfin_impact, F.col("nonfin_impact_kind_name"), "kind")
    return shares.orderBy(F.desc("cnt"), "kind").limit(5)


@query("g38_influence_levels", """
    SELECT nonfin_impact_influence_class_name, COUNT(*) AS cnt, COUNT(DISTINCT incdnt_id) AS incidents,
           nonfin_impact_influence_class_name IN ('very high', 'high') AS is_critical
    FROM nonfin_impact GROUP BY 1""", ("nonfin_impact",))
def influence_levels(v):
    return profile.influence_levels(
        v.nonfin_impact, "incdnt_id", "nonfin_impact_influence_class_name", ["very high", "high"]
    )


@query("g39_all_kinds_at_once", """
    SELECT incdnt_id, COUNT(DISTINCT nonfin_impact_kind_name) AS kinds FROM nonfin_impact
    WHERE nonfin_impact_kind_name IN ('RF', 'AO') GROUP BY 1 HAVING COUNT(DISTINCT nonfin_impact_kind_name) = 2""",
       ("nonfin_impact",))
def all_kinds_at_once(v):
    return profile.with_all_kinds(v.nonfin_impact, "incdnt_id", "nonfin_impact_kind_name", ["RF", "AO"])


@query("g40_deletions_by_user", """
    SELECT stts_chng_user_num, COUNT(*) AS deletions FROM status_change
    WHERE stts_chng_action_name = 'error' GROUP BY 1 HAVING COUNT(*) > 15""", ("status_change",))
def deletions_by_user(v):
    log = v.status_change.filter("stts_chng_action_name = 'error'")
    return profile.deletions_by_user(log, "stts_chng_user_num", more_than=15)


@query("g40_most_active_users", """
    SELECT stts_chng_user_num, COUNT(*) AS deletions FROM status_change
    WHERE stts_chng_action_name = 'error' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""", ("status_change",))
def most_active_users(v):
    log = v.status_change.filter("stts_chng_action_name = 'error'")
    return profile.deletions_by_user(log, "stts_chng_user_num", top=5)


@query("g40_deletion_control", """
    SELECT COUNT(DISTINCT incdnt_id) AS incidents, COUNT(*) AS deletions,
           COUNT(*) FILTER (WHERE length(stts_chng_comment_txt) < 9) AS without_reason,
           COUNT(*) FILTER (WHERE incdnt_status_name = 'F') AS after_approval,
           COUNT(*) FILTER (WHERE incdnt_sum > 250000) AS large,
           strftime(MIN(stts_chng_action_dttm), '%Y-%m-%d %H:%M:%S') AS first_deletion,
           strftime(MAX(stts_chng_action_dttm), '%Y-%m-%d %H:%M:%S') AS last_deletion
    FROM incident_base JOIN status_change USING (incdnt_id) WHERE stts_chng_action_name = 'error'""",
       ("incident_base", "status_change"))
def deletion_control(v):
    log = v.status_change.filter("stts_chng_action_name = 'error'")
    return profile.deletion_control(
        v.incident_base.join(log, "incdnt_id"), "incdnt_id", "stts_chng_action_dttm", "stts_chng_comment_txt",
        F.col("incdnt_status_name") == "F", "incdnt_sum", 250000, min_comment=9,
    )


@query("g41_dossier_net", """
    SELECT incdnt_id, impacts, CAST(loss AS DOUBLE) AS loss, CAST(gain AS DOUBLE) AS gain,
           CAST(COALESCE(recovered, 0) AS DOUBLE) AS recovered,
           CAST(loss - gain - COALESCE(recovered, 0) AS DOUBLE) AS net
    FROM (SELECT incdnt_id, COUNT(DISTINCT fin_impact_sid) AS impacts,
                 COALESCE(SUM(fin_impact_rub_amt) FILTER (WHERE fin_impact_type_name <> 'N'), 0) AS loss,
                 COALESCE(SUM(fin_impact_rub_amt) FILTER (WHERE fin_impact_type_name = 'N'), 0) AS gain
          FROM fin_impact GROUP BY 1)
    LEFT JOIN (SELECT incdnt_id, SUM(recovery_rub_amt) AS recovered FROM recovery GROUP BY 1) USING (incdnt_id)""",
       ("fin_impact", "recovery"))
def dossier_net(v):
    return profile.dossier_net(
        v.fin_impact, v.recovery, "incdnt_id", "fin_impact_rub_amt", "fin_impact_type_name", "N",
        "fin_impact_sid", "recovery_rub_amt",
    )


@query("g42_problem_debt", """
    SELECT COUNT(*) AS loans, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS debt,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS reserve,
           CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS pledge FROM lineitem""")
def problem_debt(v):
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    loans = v.lineitem.select(
        F.col("l_extendedprice").cast("decimal(18,2)").alias("debt"),
        (price * F.col("l_discount").cast("decimal(4,2)")).alias("reserve"),
        F.col("l_quantity").cast("decimal(12,2)").alias("pledge"),
    )
    return profile.problem_debt(loans, "debt", "reserve", "pledge")


@query("g43_largest_described", r"""
    SELECT incdnt_sid, CAST(incdnt_sum AS DOUBLE) AS incdnt_sum, description, rn, CAST(ceil(rn / 10.0) AS BIGINT) AS batch
    FROM (SELECT incdnt_sid, incdnt_sum, ROW_NUMBER() OVER (ORDER BY incdnt_sum DESC, incdnt_sid) AS rn,
                 COALESCE(NULLIF(regexp_replace(CASE WHEN lang <> 'en' THEN text END, '^\s+|\s+$', '', 'g'), ''), source) AS description
          FROM incident_base LEFT JOIN documents ON doc_id = incdnt_id) WHERE rn <= 30 AND description IS NOT NULL""",
       ("incident_base",))
def largest_described(v):
    full = F.when(F.col("lang") != "en", F.col("text")).alias("full")
    docs = v.documents.select(F.col("doc_id").alias("incdnt_id"), full, "source")
    return profile.largest_described(
        v.incident_base.join(docs, "incdnt_id", "left"), "incdnt_sid", "incdnt_sum", ["full", "source"]
    )


@query("g44_distinct_comments", """
    SELECT DISTINCT stts_chng_comment_txt AS comment FROM status_change ORDER BY 1 LIMIT 300""", ("status_change",))
def distinct_comments(v):
    return profile.distinct_comments(v.status_change, "stts_chng_comment_txt")
