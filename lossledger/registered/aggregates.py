"""Aggregations (G1–G17, G32–G33)."""

import uuid

from pyspark.sql import functions as F

from ..operators import aggregates as g
from ..operators import catalog
from ..operators.lineage import shared_folder
from .base import query
from .scans import CATALOG_COLUMNS


@query("g1_group_functions", """
    SELECT incdnt_autoreg_flag, incdnt_type_lvl_1_name, CAST(SUM(incdnt_sum) AS DOUBLE) AS total,
           ROUND(CAST(SUM(incdnt_sum) AS DOUBLE) / COUNT(incdnt_sum), 2) AS mean, COUNT(incdnt_id) AS cnt,
           CAST(MAX(incdnt_sum) AS DOUBLE) AS largest, CAST(MIN(incdnt_sum) AS DOUBLE) AS smallest,
           COUNT(DISTINCT risk_profile_id) AS profiles
    FROM incident GROUP BY 1, 2""", ("incident",))
def group_functions(v):
    mean = F.round(g.aggregate("sum", "incdnt_sum").cast("double") / g.aggregate("count", "incdnt_sum"), 2)
    return g.group_by(v.incident, ["incdnt_autoreg_flag", "incdnt_type_lvl_1_name"], [
        g.aggregate("sum", "incdnt_sum").alias("total"),
        mean.alias("mean"),
        g.aggregate("count", "incdnt_id").alias("cnt"),
        g.aggregate("max", "incdnt_sum").alias("largest"),
        g.aggregate("min", "incdnt_sum").alias("smallest"),
        g.aggregate("nunique", "risk_profile_id").alias("profiles"),
    ])


@query("g2_aliased_metrics", """
    SELECT l_returnflag, SUM(CAST(l_quantity AS BIGINT))::BIGINT AS quantity_sum,
           MAX(CAST(l_quantity AS BIGINT)) AS quantity_max FROM lineitem GROUP BY 1""")
def aliased_metrics(v):
    whole = v.lineitem.withColumn("quantity", F.col("l_quantity").cast("bigint"))
    return g.group_by(whole, ["l_returnflag"], [
        g.aggregate("sum", "quantity").alias("quantity_sum"),
        g.aggregate("max", "quantity").alias("quantity_max"),
    ])


@query("g3_filtered_aggregate", """
    SELECT incdnt_id, CAST(SUM(fin_impact_rub_amt) FILTER (WHERE fin_impact_type_name = 'R') AS DOUBLE) AS direct,
           COUNT(*) FILTER (WHERE fin_impact_type_name = 'A') AS other
    FROM fin_impact GROUP BY 1""", ("fin_impact",))
def filtered_aggregate(v):
    kind = F.col("fin_impact_type_name")
    return g.group_by(v.fin_impact, ["incdnt_id"], [
        g.aggregate("sum", "fin_impact_rub_amt", kind == "R").alias("direct"),
        g.aggregate("count", "incdnt_id", kind == "A").alias("other"),
    ])


@query("g4_derived_metrics", """
    SELECT fin_impact_kind_name, fin_impact_type_name, CAST(amount AS DOUBLE) AS amount,
           CAST(amount - r AS DOUBLE) AS difference, CAST(amount + r AS DOUBLE) AS added, cnt * 2 AS doubled,
           ROUND(CAST(amount AS DOUBLE) / NULLIF(CAST(r AS DOUBLE), 0), 4) AS ratio
    FROM (SELECT fin_impact_kind_name, fin_impact_type_name, SUM(fin_impact_rub_amt) AS amount, COUNT(*) AS cnt,
                 COALESCE(SUM(fin_impact_rub_amt) FILTER (WHERE fin_impact_type_name = 'R'), 0) AS r
          FROM fin_impact GROUP BY 1, 2)""", ("fin_impact",))
def derived_metrics(v):
    grouped = g.group_by(v.fin_impact, ["fin_impact_kind_name", "fin_impact_type_name"], [
        g.money_sum("fin_impact_rub_amt").alias("amount"),
        F.count(F.lit(1)).alias("cnt"),
        g.money_sum("fin_impact_rub_amt", F.col("fin_impact_type_name") == "R").alias("r"),
    ])
    amount, r = F.col("amount"), F.col("r")
    return grouped.select(
        "fin_impact_kind_name", "fin_impact_type_name", "amount",
        g.derived_metric("sub", amount, r).alias("difference"),
        g.derived_metric("add", amount, r).alias("added"),
        g.derived_metric("mul", F.col("cnt"), F.lit(2)).alias("doubled"),
        F.round(g.derived_metric("safe_div", amount, r), 4).alias("ratio"),
    )


@query("g5_having_range", """
    SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM orders GROUP BY 1 HAVING SUM(CAST(o_totalprice AS DECIMAL(18,2))) BETWEEN 1000000 AND 3000000""")
def having_range(v):
    grouped = v.orders.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    return grouped.filter(F.col("total").between(1000000, 3000000))


@query("g6_first_per_key", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
    QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""")
def first_per_key(v):
    order = [F.asc(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    return g.first_per_key(v.lineitem, ["l_orderkey", "l_linenumber"], order).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )


@query("g7_fill_rates", """
    SELECT 'incident' AS tbl, col, ROUND(COUNT(value) * 100.0::DOUBLE / COUNT(*), 2) AS filled_pct FROM (
        SELECT unnest(['incdnt_status_name', 'incdnt_type_lvl_1_name', 'org_struct_lvl_4_name',
                       'incdnt_autoreg_flag', 'risk_profile_name']) AS col,
               unnest([incdnt_status_name, incdnt_type_lvl_1_name, org_struct_lvl_4_name,
                       incdnt_autoreg_flag, risk_profile_name]) AS value FROM incident) GROUP BY col""", ("incident",))
def fill_rates(v):
    return catalog.fill_rates(v.incident, CATALOG_COLUMNS, "incident")


@query("g8_approx_cardinality")
def approx_cardinality(v):
    return catalog.approx_cardinality(v.incident, CATALOG_COLUMNS, "incident")


@query("g8_sketched_cardinality", """
    SELECT 'incident' AS tbl, col, COUNT(DISTINCT value) AS n_values, COUNT(DISTINCT value) > 800 AS high_card, TRUE AS within_5_pct FROM (
        SELECT unnest(['incdnt_status_name', 'incdnt_type_lvl_1_name', 'org_struct_lvl_4_name',
                       'incdnt_autoreg_flag', 'risk_profile_name', 'incdnt_sid']) AS col,
               unnest([incdnt_status_name, incdnt_type_lvl_1_name, org_struct_lvl_4_name,
                       incdnt_autoreg_flag, risk_profile_name, incdnt_sid]) AS value FROM incident) GROUP BY col""", ("incident",))
def sketched_cardinality(v):
    """Sketches per year, stored and united, against exact counts."""
    spark, columns = v.incident.sparkSession, [*CATALOG_COLUMNS, "incdnt_sid"]
    path = f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    catalog.cardinality_sketches(v.incident, columns, F.year("incdnt_entry_dt")).write.partitionBy("part").parquet(path)
    estimates = catalog.united(spark.read.parquet(path), "incident")
    exact = v.incident.agg(*[F.count_distinct(c).alias(c) for c in columns]).unpivot([], columns, "col", "n_values")
    near = F.abs(F.col("distinct_approx") - F.col("n_values")) <= F.col("n_values") * 0.05
    return estimates.join(exact, "col").select("tbl", "col", "n_values", "high_card", near.alias("within_5_pct"))


@query("g9_frequent_values", """
    SELECT tbl, col, value, cnt FROM (
        SELECT 'incident' AS tbl, col, value, COUNT(*) AS cnt FROM (
            SELECT unnest(['org_struct_lvl_4_name', 'risk_profile_name']) AS col,
                   unnest([org_struct_lvl_4_name, risk_profile_name]) AS value FROM incident)
        WHERE value IS NOT NULL GROUP BY col, value)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY col ORDER BY cnt DESC, value) <= 500""", ("incident",))
def frequent_values(v):
    return catalog.frequent_values(v.incident, ["org_struct_lvl_4_name", "risk_profile_name"], "incident")


@query("g10_distinct_values", """
    SELECT DISTINCT p_name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY 1 LIMIT 50""")
def distinct_values(v):
    return g.distinct_values(v.part, "p_name", "RING", 50)


@query("g12_headline", """
    SELECT COUNT(*) AS row_count, COUNT(DISTINCT incdnt_id) AS incidents,
           CAST(SUM(incdnt_sum) AS DOUBLE) AS loss, CAST(COALESCE(SUM(recovered), 0) AS DOUBLE) AS recovery,
           COUNT(*) FILTER (WHERE incdnt_autoreg_flag = 'Y') AS automatic
    FROM incident LEFT JOIN (SELECT incdnt_id, SUM(recovery_rub_amt) AS recovered FROM recovery GROUP BY 1)
         USING (incdnt_id)""", ("incident", "recovery"))
def headline(v):
    from ..functions.predicates import is_flag_set
    from ..operators.joins import join_aggregated

    df = join_aggregated(v.incident, v.recovery, [F.sum("recovery_rub_amt").alias("recovered")])
    return g.headline(df, "incdnt_id", "incdnt_sum", "recovered", is_flag_set("incdnt_autoreg_flag"))


@query("g13_top_category", """
    SELECT org_struct_lvl_4_name AS label, COUNT(*) AS cnt,
           ROUND(COUNT(*) * 100.0::DOUBLE / (SELECT COUNT(*) FROM incident), 0) AS pct
    FROM incident GROUP BY 1 ORDER BY cnt DESC, 1 LIMIT 1""", ("incident",))
def top_category(v):
    return g.top_category(v.incident, "org_struct_lvl_4_name")


@query("g13_top_category_of_unique", """
    SELECT CAST(NULL AS VARCHAR) AS label, CAST(NULL AS BIGINT) AS cnt, CAST(NULL AS DOUBLE) AS pct
    FROM (SELECT COUNT(DISTINCT incdnt_sid) AS n FROM incident_base) WHERE n > 50""", ("incident_base",))
def top_category_of_unique(v):
    return g.top_category(v.incident_base, "incdnt_sid")


@query("g14_breakdown", """
    SELECT incdnt_type_lvl_1_name, COUNT(*) AS cnt FROM incident_base
    GROUP BY 1 ORDER BY cnt DESC, 1 LIMIT 5""", ("incident_base",))
def breakdown(v):
    return g.top_values(v.incident_base, "incdnt_type_lvl_1_name")


@query("g15_months_of_year", """
    SELECT lpad(CAST(m AS VARCHAR), 2, '0') AS month, COUNT(ts) AS cnt
    FROM range(1, 13) r(m) LEFT JOIN events ON month(ts) = m GROUP BY 1""")
def months_of_year(v):
    return g.months_of_year(v.events, "ts")


@query("g16_loss_totals", """
    SELECT CAST(SUM(fin_impact_rub_amt) AS DOUBLE) AS total_loss,
           CAST(SUM(fin_impact_rub_amt) FILTER (WHERE fin_impact_type_name = 'R') AS DOUBLE) AS direct_loss
    FROM fin_impact""", ("fin_impact",))
def loss_totals(v):
    return g.loss_totals(v.fin_impact, "fin_impact_rub_amt", F.col("fin_impact_type_name") == "R")


_NET = """
    SELECT incdnt_id, CAST({net} AS DOUBLE) AS net_loss FROM
        (SELECT incdnt_id, SUM(fin_impact_rub_amt) FILTER (WHERE fin_impact_type_name = 'N') AS loss
         FROM fin_impact GROUP BY 1)
    LEFT JOIN (SELECT incdnt_id, SUM(recovery_rub_amt) AS rec FROM recovery GROUP BY 1) USING (incdnt_id)"""


def _net(v, clamp: bool):
    from ..operators.joins import child_sums, join_aggregated

    losses = child_sums(v.fin_impact, "incdnt_id", [
        g.aggregate("sum", "fin_impact_rub_amt", F.col("fin_impact_type_name") == "N").alias("loss")
    ])
    both = join_aggregated(losses, v.recovery, [F.sum("recovery_rub_amt").alias("rec")])
    return g.with_net_loss(both, "loss", "rec", clamp).select("incdnt_id", "net_loss")


@query("g17_net_loss_clamped", _NET.format(net="greatest(0, COALESCE(loss, 0) - COALESCE(rec, 0))"),
       ("fin_impact", "recovery"))
def net_loss_clamped(v):
    return _net(v, True)


@query("g17_net_loss", _NET.format(net="COALESCE(loss, 0) - COALESCE(rec, 0)"), ("fin_impact", "recovery"))
def net_loss_unclamped(v):
    return _net(v, False)


@query("g32_summary", """
    WITH t AS (SELECT risk_profile_name, SUM(incdnt_sum) AS total FROM incident GROUP BY 1)
    SELECT COUNT(*) AS groups, (SELECT risk_profile_name FROM t ORDER BY total DESC, 1 DESC LIMIT 1) AS top_group,
           CAST(MAX(total) AS DOUBLE) AS top_value, CAST(SUM(total) AS DOUBLE) AS total FROM t""", ("incident",))
def summary(v):
    grouped = v.incident.groupBy("risk_profile_name").agg(F.sum("incdnt_sum").alias("total"))
    return g.summary(grouped, "risk_profile_name", "total")


@query("g33_bars", """
    WITH t AS (SELECT org_struct_lvl_4_name, SUM(incdnt_sum) AS total FROM incident GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)
    SELECT org_struct_lvl_4_name, CAST(total AS DOUBLE) AS total,
           ROUND(CAST(total AS DOUBLE) / (SELECT CAST(MAX(total) AS DOUBLE) FROM t), 4) AS bar FROM t""", ("incident",))
def bars(v):
    grouped = v.incident.groupBy("org_struct_lvl_4_name").agg(F.sum("incdnt_sum").alias("total"))
    return g.bars(grouped, "org_struct_lvl_4_name", "total")
