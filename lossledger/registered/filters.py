"""Filters and predicates (F)."""

from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions.dates import half_open_period
from ..operators import catalog, filters
from .base import query

_KEYS = ("o_orderkey", "o_totalprice")


@query("f1_equality_and_null", """
    SELECT o_orderkey, l_partkey FROM orders
    LEFT JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderstatus = 'P' AND l_partkey IS NULL""")
def equality_and_null(v):
    joined = v.orders.join(v.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.filter(p.where({"o_orderstatus": "P", "l_partkey": None})).select("o_orderkey", "l_partkey")


@query("f2_in_list", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def in_list(v):
    return v.orders.filter(p.where({"o_orderpriority": ["1-URGENT", "2-HIGH"]})).select(*_KEYS)


@query("f3_comparisons", """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_quantity > 10 AND l_quantity <= 40 AND l_linenumber >= 2 AND l_linenumber < 6
      AND l_linenumber <> 4 AND l_returnflag = 'N'""")
def comparisons(v):
    cond = p.where({
        "l_quantity": {"gt": 10, "lte": 40}, "l_linenumber__gte": 2, "l_linenumber__lt": 6,
        "l_linenumber__ne": 4, "l_returnflag__eq": "N",
    })
    return v.lineitem.filter(cond).select("l_orderkey", "l_linenumber", "l_quantity")


@query("f4_like_and_free_text", """
    SELECT p_partkey, p_name FROM part WHERE p_name LIKE 's%' AND p_name LIKE '%ring%'""")
def like_and_free_text(v):
    cond = p.where({"p_name__like": "s%"}) & p.free_text("p_name", "ring")
    return v.part.filter(cond).select("p_partkey", "p_name")


@query("f5_half_open_period", """
    SELECT event_id, event_type FROM events
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'""")
def period(v):
    return v.events.filter(half_open_period(F.col("ts"), "2024-01-05", "2024-01-12")).select(
        "event_id", "event_type"
    )


@query("f6_code_prefix", """
    SELECT c_custkey, c_mktsegment FROM customer WHERE substr(upper(c_mktsegment), 1, 4) IN ('BUIL', 'MACH')""")
def code_prefix(v):
    return v.customer.filter(p.code_prefix_in("c_mktsegment", ["BUIL", "MACH"])).select(
        "c_custkey", "c_mktsegment"
    )


@query("f7_equals_ignore_case", "SELECT event_id FROM events WHERE upper(event_type) = 'ERROR'")
def equals_ignore_case(v):
    return v.events.filter(p.equals_ignore_case("event_type", "Error")).select("event_id")


@query("f8_contains_any_level", """
    SELECT incdnt_id, org_struct_lvl_2_name, org_struct_lvl_3_name FROM incident
    WHERE contains(lower(org_struct_lvl_2_name), 'mer') OR contains(lower(org_struct_lvl_3_name), 'mer')
       OR contains(lower(org_struct_lvl_4_name), 'mer') OR contains(lower(org_struct_lvl_3_name), 'auto')""",
       ("incident",))
def contains_any_level(v):
    levels = ["org_struct_lvl_2_name", "org_struct_lvl_3_name", "org_struct_lvl_4_name"]
    cond = p.contains_ignore_case(levels, "Mer") | p.contains_ignore_case(levels[1:2], "AUTO")
    return v.incident.filter(cond).select("incdnt_id", *levels[:2])


@query("f9_named_compound", """
    SELECT incdnt_id FROM incident
    WHERE org_struct_lvl_2_name = 'ASIA' OR org_struct_lvl_3_name LIKE '%HOUSE%' OR org_struct_lvl_4_name LIKE '%ION_1%'""",
       ("incident",))
def named_compound(v):
    cond = p.raised_by_customer(
        "org_struct_lvl_2_name", "org_struct_lvl_3_name", "org_struct_lvl_4_name", "ASIA", "HOUSE", "ION_1"
    )
    return v.incident.filter(cond).select("incdnt_id")


@query("f10_raw_predicate", """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 AND o_orderstatus <> 'P'""")
def raw_predicate(v):
    return filters.by_expression(v.orders, "o_totalprice > 400000 AND o_orderstatus <> 'P'").select(*_KEYS)


@query("f11_filter_on_result", """
    SELECT o_custkey, COUNT(*) AS cnt FROM orders GROUP BY 1 HAVING COUNT(*) BETWEEN 10 AND 12""")
def filter_on_result(v):
    grouped = v.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("cnt"))
    return filters.by_expression(grouped, "cnt >= 10 AND cnt <= 12")


@query("f12_staged_ranges", """
    SELECT o_orderpriority, COUNT(*) AS cnt, CAST(SUM(loss) AS DOUBLE) AS loss_sum
    FROM orders JOIN (SELECT l_orderkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS loss FROM lineitem GROUP BY 1)
         ON l_orderkey = o_orderkey
    WHERE o_totalprice > 100000 AND loss > 120000 GROUP BY 1 HAVING SUM(loss) > 1000000""")
def staged_ranges(v):
    from ..plans.report import build_report
    from ..plans.spec import ChildJoin, Metric, Range, ReportSpec

    spec = ReportSpec(
        source="orders",
        joins=(ChildJoin("impacts", (Metric("amount", "sum", "loss"),), key="o_orderkey"),),
        ranges=(Range("o_totalprice", "gt", 100000), Range("loss", "gt", 120000), Range("loss_sum", "gt", 1000000)),
        group_by=("o_orderpriority",),
        metrics=(Metric("o_orderkey", "count", "cnt"), Metric("loss", "sum", "loss_sum")),
    )
    impacts = v.fin_impact.select(
        F.col("incdnt_id").alias("o_orderkey"), F.col("fin_impact_rub_amt").alias("amount")
    )
    return build_report({"orders": v.orders, "impacts": impacts}, spec)


@query("f13_enum_check", """
    WITH wanted AS (SELECT DISTINCT 'c_mktsegment' AS col, upper(p_type) AS value FROM part
                    UNION SELECT DISTINCT 'c_mktsegment', c_mktsegment FROM customer)
    SELECT col, value FROM wanted WHERE value NOT IN (SELECT c_mktsegment FROM customer)""")
def enum_check(v):
    known = catalog.value_counts(v.customer, ["c_mktsegment"], "customer")
    column = F.lit("c_mktsegment").alias("col")
    wanted = v.part.select(column, F.upper("p_type").alias("value")).union(
        v.customer.select(column, "c_mktsegment")
    ).distinct()
    return filters.unknown_values(wanted, known)


@query("f14_tiered_match", """
    SELECT incdnt_id, org_struct_lvl_2_name FROM incident
    WHERE lower(org_struct_lvl_2_name) = 'middle east'""", ("incident",))
def tiered_exact(v):
    levels = ["org_struct_lvl_3_name", "org_struct_lvl_4_name", "org_struct_lvl_2_name"]
    return filters.tiered_match(v.incident, levels, " Middle East ").select("incdnt_id", levels[2])


@query("f14_tiered_match_words", """
    SELECT incdnt_id, org_struct_lvl_3_name FROM incident
    WHERE lower(org_struct_lvl_3_name) LIKE 'machi%'""", ("incident",))
def tiered_words(v):
    levels = ["org_struct_lvl_3_name", "org_struct_lvl_4_name", "org_struct_lvl_2_name"]
    return filters.tiered_match(v.incident, levels, "Machines блок").select("incdnt_id", levels[0])


@query("f15_text_date_range", """
    SELECT o_orderkey FROM orders
    WHERE CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END
          BETWEEN '1997-03-01' AND '1997-04-15'""")
def text_date_range(v):
    dated = v.orders.withColumn(
        "day", F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    return dated.filter(p.between_text_dates("day", "1997-03-01", "1997-04-15")).select("o_orderkey")


@query("f16_status_group", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def status_group(v):
    return filters.status_group(v.orders, "o_orderstatus", ["f", "approved"]).select("o_orderkey")


@query("f16_status_group_fallback", "SELECT o_orderkey FROM orders")
def status_group_fallback(v):
    return filters.status_group(v.orders, "o_orderstatus").select("o_orderkey")


@query("f17_any_of", """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderstatus = 'P' AND (o_orderpriority = '1-URGENT' OR o_totalprice < 5000)""")
def any_of(v):
    cond = p.where({"o_orderstatus": "P", "_or": [{"o_orderpriority": "1-URGENT"}, {"o_totalprice__lt": 5000}]})
    return v.orders.filter(cond).select(*_KEYS)


@query("f18_leak_check", """
    SELECT COUNT(DISTINCT org_struct_lvl_3_name) AS distinct_values,
           COUNT(DISTINCT org_struct_lvl_3_name) > 1 AS leak
    FROM incident WHERE org_struct_lvl_2_name = 'EUROPE'""", ("incident",))
def leak_check(v):
    return filters.leak_check(v.incident.filter("org_struct_lvl_2_name = 'EUROPE'"), "org_struct_lvl_3_name")


@query("g11_probe", """
    SELECT least(COUNT(*), 1000) AS row_count, COUNT(*) > 0 AS matched, COUNT(*) >= 1000 AS capped
    FROM lineitem WHERE l_quantity > 30""")
def probe(v):
    return filters.probe(v.lineitem, p.where({"l_quantity__gt": 30}), 1000)


@query("g34_row_funnel", """
    WITH f AS (SELECT COUNT(*) AS n0, COUNT(*) FILTER (WHERE a) AS n1, COUNT(*) FILTER (WHERE a AND b) AS n2,
                      COUNT(*) FILTER (WHERE a AND b AND c) AS n3
               FROM (SELECT o_orderdate >= TIMESTAMP '1998-01-01' AS a, o_orderstatus <> 'P' AS b,
                            o_totalprice > 200000 AS c FROM orders))
    SELECT 0::BIGINT AS position, 'source' AS stage, n0 AS row_count FROM f
    UNION ALL SELECT 1, 'period', n1 FROM f UNION ALL SELECT 2, 'status', n2 FROM f
    UNION ALL SELECT 3, 'amount', n3 FROM f""")
def row_funnel(v):
    return filters.row_funnel(v.orders, [
        ("period", F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")),
        ("status", F.col("o_orderstatus") != "P"),
        ("amount", F.col("o_totalprice") > 200000),
    ])
