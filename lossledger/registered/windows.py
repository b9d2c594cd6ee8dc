"""Window functions (W) and ranked batches (S6)."""

from pyspark.sql import functions as F

from ..operators import profile, windows
from .base import query

_ALL = """
    SELECT incdnt_id, org_struct_lvl_4_name, {fn}() OVER (
        PARTITION BY org_struct_lvl_4_name ORDER BY incdnt_sum DESC{tie}) AS rank FROM incident"""


@query("w1_row_number", _ALL.format(fn="ROW_NUMBER", tie=", incdnt_id"), ("incident",))
def row_number(v):
    return windows.rank_all(
        v.incident, ["org_struct_lvl_4_name"], "incdnt_sum", ["incdnt_id"]
    ).select("incdnt_id", "org_struct_lvl_4_name", "rank")


@query("w1_row_number_ascending", """
    SELECT l_orderkey, l_linenumber, l_partkey, ROW_NUMBER() OVER (
        PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rank
    FROM lineitem""")
def row_number_ascending(v):
    return windows.rank_all(
        v.lineitem, ["l_returnflag"], "l_quantity",
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], descending=False,
    ).select("l_orderkey", "l_linenumber", "l_partkey", "rank")


@query("w2_rank", """
    SELECT l_orderkey, l_linenumber, l_partkey, RANK() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS rank
    FROM lineitem""")
def rank(v):
    return windows.rank_all(v.lineitem, ["l_returnflag"], "l_quantity", [], "rank").select(
        "l_orderkey", "l_linenumber", "l_partkey", "rank"
    )


@query("w3_dense_rank", """
    SELECT l_orderkey, l_linenumber, l_partkey, DENSE_RANK() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS rank
    FROM lineitem""")
def dense_rank(v):
    return windows.rank_all(v.lineitem, ["l_returnflag"], "l_quantity", [], "dense_rank").select(
        "l_orderkey", "l_linenumber", "l_partkey", "rank"
    )


@query("w4_top_n_per_group", """
    SELECT month, risk_profile_id, cnt, ROW_NUMBER() OVER (PARTITION BY month ORDER BY cnt DESC, risk_profile_id) AS rank
    FROM (SELECT strftime(incdnt_entry_dt, '%Y-%m') AS month, risk_profile_id, COUNT(*) AS cnt
          FROM incident_base GROUP BY 1, 2) QUALIFY rank <= 20""", ("incident_base",))
def top_n_per_group(v):
    grouped = v.incident_base.groupBy(
        F.date_format("incdnt_entry_dt", "yyyy-MM").alias("month"), "risk_profile_id"
    ).agg(F.count(F.lit(1)).alias("cnt"))
    return windows.rank_top_n(grouped, ["month"], "cnt", 20, tie_break=("risk_profile_id",))


@query("w4_top_ranks_per_group", """
    SELECT l_returnflag, l_orderkey, l_quantity, DENSE_RANK() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS rank
    FROM lineitem QUALIFY rank <= 2""")
def top_ranks_per_group(v):
    return windows.rank_top_n(
        v.lineitem, ["l_returnflag"], "l_quantity", 2, "dense_rank", descending=False
    ).select("l_returnflag", "l_orderkey", "l_quantity", "rank")


@query("w5_global_rank", """
    SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders""")
def global_rank(v):
    return windows.rank_all(v.orders, [], "o_totalprice", ["o_orderkey"]).select("o_orderkey", "rank")


@query("w5_global_top", """
    SELECT s_suppkey, RANK() OVER (ORDER BY s_acctbal DESC) AS rank FROM supplier QUALIFY rank <= 15""")
def global_top(v):
    return windows.rank_top_n(v.supplier, [], "s_acctbal", 15, "rank").select("s_suppkey", "rank")


@query("w6_new_and_resumed", """
    WITH days AS (SELECT DISTINCT risk_profile_name, CAST(incdnt_entry_dt AS DATE) AS day FROM incident
                  WHERE incdnt_entry_dt < TIMESTAMP '1999-01-01'),
    gaps AS (SELECT *, day - LAG(day) OVER (PARTITION BY risk_profile_name ORDER BY day) AS gap FROM days)
    SELECT risk_profile_name, CASE WHEN BOOL_OR(gap IS NULL) THEN 'new' ELSE 'resumed' END AS kind,
           strftime(MIN(day), '%Y-%m-%d') AS first_day, MAX(gap) AS gap_days
    FROM gaps WHERE day >= DATE '1998-01-01'
    GROUP BY 1 HAVING BOOL_OR(gap IS NULL) OR MAX(gap) >= 180""", ("incident",))
def new_and_resumed(v):
    return windows.new_and_resumed(
        v.incident, "risk_profile_name", "incdnt_entry_dt", "1998-01-01", "1999-01-01"
    )


@query("s6_ranked_batches", """
    SELECT incdnt_id, rn, CAST(ceil(rn / 5.0) AS BIGINT) AS batch FROM (
        SELECT incdnt_id, ROW_NUMBER() OVER (ORDER BY incdnt_sum DESC, incdnt_id) AS rn FROM incident_base)
    WHERE rn <= 10""", ("incident_base",))
def ranked_batches(v):
    return profile.ranked_batches(
        v.incident_base, [F.desc("incdnt_sum"), F.asc("incdnt_id")], 10, 5
    ).select("incdnt_id", "rn", "batch")
