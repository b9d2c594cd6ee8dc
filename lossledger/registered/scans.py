"""Scans, lookups and projections (A, B) and limits (S)."""

import uuid

from pyspark.sql import functions as F

from ..functions.text import canonical_id
from ..operators import catalog, projection, search, snapshots, sorting
from ..operators.lineage import shared_folder
from ..sources import lookup, sinks
from .base import query

DAY = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query("a1_full_scan", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
    FROM orders""")
def full_scan(v):
    return v.orders


@query("a2_single_table_query", """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000 AND o_orderpriority <> '5-LOW'
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 500""")
def single_table_query(v):
    return lookup.query(
        v.orders,
        where={"o_orderstatus": ["F", "O"], "o_totalprice__gte": 1000, "o_orderpriority": {"ne": "5-LOW"}},
        columns=["o_orderkey", "o_totalprice"],
        order_by="o_totalprice",
        order_desc=True,
        limit=500,
        tie_break=("o_orderkey",),
    )


_CATALOG_SQL = """
    {name} AS (
        SELECT k.tbl, k.col, k.value, k.cnt, f.filled_pct FROM (
            SELECT 'incident' AS tbl, col, value, COUNT(*) AS cnt FROM (
                SELECT unnest(['incdnt_status_name', 'incdnt_type_lvl_1_name', 'org_struct_lvl_4_name',
                               'incdnt_autoreg_flag', 'risk_profile_name']) AS col,
                       unnest([incdnt_status_name, incdnt_type_lvl_1_name, org_struct_lvl_4_name,
                               incdnt_autoreg_flag, risk_profile_name]) AS value
                FROM incident WHERE {where}) WHERE value IS NOT NULL GROUP BY col, value) k
        JOIN (
            SELECT col, ROUND(COUNT(value) * 100.0::DOUBLE / COUNT(*), 2) AS filled_pct FROM (
                SELECT unnest(['incdnt_status_name', 'incdnt_type_lvl_1_name', 'org_struct_lvl_4_name',
                               'incdnt_autoreg_flag', 'risk_profile_name']) AS col,
                       unnest([incdnt_status_name, incdnt_type_lvl_1_name, org_struct_lvl_4_name,
                               incdnt_autoreg_flag, risk_profile_name]) AS value
                FROM incident WHERE {where}) GROUP BY col) f USING (col))"""

CATALOG_COLUMNS = [
    "incdnt_status_name", "incdnt_type_lvl_1_name", "org_struct_lvl_4_name",
    "incdnt_autoreg_flag", "risk_profile_name",
]


@query("a5_snapshot_drift", "WITH " + _CATALOG_SQL.format(
    name="a", where="incdnt_entry_dt < TIMESTAMP '1998-06-01'") + "," + _CATALOG_SQL.format(
    name="b", where="incdnt_entry_dt >= TIMESTAMP '1998-06-01'") + """
    SELECT tbl, col, value, a.cnt AS cnt_before, a.filled_pct AS filled_before,
           b.cnt AS cnt_after, b.filled_pct AS filled_after,
           CASE WHEN a.cnt IS NULL THEN 'new' WHEN b.cnt IS NULL THEN 'lost'
                WHEN a.cnt <> b.cnt THEN 'count' ELSE 'fill' END AS change
    FROM a FULL JOIN b USING (tbl, col, value)
    WHERE a.cnt IS DISTINCT FROM b.cnt OR a.filled_pct IS DISTINCT FROM b.filled_pct""", ("incident",))
def snapshot_drift(v):
    border = F.lit("1998-06-01").cast("timestamp_ntz")
    sides = [
        catalog.build_catalog({"incident": (v.incident.filter(side), CATALOG_COLUMNS)})
        for side in (F.col("incdnt_entry_dt") < border, F.col("incdnt_entry_dt") >= border)
    ]
    return catalog.drift(*sides)


def _two_snapshots(v):
    """Orders and customers before a release, and after it: a new column, a lost one, another type,
    a status that is no longer given, and a unit that was renamed."""
    root = f"{shared_folder(v.orders.sparkSession)}/profiles-{uuid.uuid4().hex}"
    orders = v.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    customer = v.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    snapshots.save({"orders": (orders, ["o_orderstatus", "o_orderpriority"]), "customer": (customer, ["c_mktsegment"])}, root, "1")
    later = orders.drop("o_custkey").withColumns({
        "o_totalprice": F.col("o_totalprice").cast("decimal(18,2)"),
        "o_orderstatus": F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")),
        "o_is_large": F.col("o_totalprice") > 100000,
    })
    renamed = customer.withColumn("c_mktsegment", F.replace("c_mktsegment", F.lit("MACHINERY"), F.lit("MACHINES")))
    snapshots.save({"orders": (later, ["o_orderstatus", "o_orderpriority"]), "customer": (renamed, ["c_mktsegment"])}, root, "2")
    return root


@query("a5_stored_schema_drift", """
    WITH o AS (SELECT COUNT(*) AS n, COUNT(o_custkey) AS custkey, COUNT(o_totalprice) AS price, COUNT(o_orderstatus) AS status,
                      COUNT(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS kept FROM orders),
    p AS (SELECT ROUND(custkey * 100.0::DOUBLE / n, 2) AS custkey, ROUND(price * 100.0::DOUBLE / n, 2) AS price,
                 ROUND(status * 100.0::DOUBLE / n, 2) AS status, ROUND(kept * 100.0::DOUBLE / n, 2) AS kept FROM o)
    SELECT 'orders' AS tbl, 'o_custkey' AS col, 'bigint' AS type_before, NULL AS type_after, custkey AS filled_before,
           NULL::DOUBLE AS filled_after, 'lost' AS change, FALSE AS same_schema FROM p
    UNION ALL SELECT 'orders', 'o_is_large', NULL, 'boolean', NULL, price, 'new', FALSE FROM p
    UNION ALL SELECT 'orders', 'o_totalprice', 'double', 'decimal(18,2)', price, price, 'type', FALSE FROM p
    UNION ALL SELECT 'orders', 'o_orderstatus', 'string', 'string', status, kept, 'fill', FALSE FROM p WHERE status <> kept""")
def stored_schema_drift(v):
    """Columns that changed between two stored snapshots."""
    return snapshots.schema_drift(v.orders.sparkSession, _two_snapshots(v), "1", "2")


@query("a5_stored_value_drift", """
    WITH a AS (
        SELECT 'orders' AS tbl, 'o_orderstatus' AS col, o_orderstatus AS value, COUNT(*) AS cnt FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 3
        UNION ALL SELECT 'orders', 'o_orderpriority', o_orderpriority, COUNT(*) FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 3
        UNION ALL SELECT 'customer', 'c_mktsegment', c_mktsegment, COUNT(*) FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 3),
    b AS (SELECT tbl, col, replace(value, 'MACHINERY', 'MACHINES') AS value, cnt FROM a WHERE NOT (col = 'o_orderstatus' AND value = 'P')),
    rows AS (SELECT 'orders' AS tbl, COUNT(*) AS n FROM orders UNION ALL SELECT 'customer', COUNT(*) FROM customer),
    fa AS (SELECT tbl, col, ROUND(SUM(cnt) * 100.0::DOUBLE / n, 2) AS filled_before FROM a JOIN rows USING (tbl) GROUP BY 1, 2, n),
    fb AS (SELECT tbl, col, ROUND(SUM(cnt) * 100.0::DOUBLE / n, 2) AS filled_after FROM b JOIN rows USING (tbl) GROUP BY 1, 2, n)
    SELECT tbl, col, value, a.cnt AS cnt_before, CASE WHEN a.cnt IS NOT NULL THEN filled_before END AS filled_before,
           b.cnt AS cnt_after, CASE WHEN b.cnt IS NOT NULL THEN filled_after END AS filled_after,
           CASE WHEN a.cnt IS NULL THEN 'new' WHEN b.cnt IS NULL THEN 'lost' WHEN a.cnt <> b.cnt THEN 'count' ELSE 'fill' END AS change
    FROM a FULL JOIN b USING (tbl, col, value) LEFT JOIN fa USING (tbl, col) LEFT JOIN fb USING (tbl, col)
    WHERE a.cnt IS DISTINCT FROM b.cnt OR filled_before IS DISTINCT FROM filled_after""")
def stored_value_drift(v):
    """Values that changed between two stored snapshots."""
    return snapshots.value_drift(v.orders.sparkSession, _two_snapshots(v), "1", "2")


@query("a6_csv_round_trip", """
    SELECT doc_id, text, lang, source, n_chars FROM documents""")
def csv_round_trip(v):
    """All documents, line breaks, quotes and nulls included, published as CSV twice and read again."""
    spark, path = v.documents.sparkSession, f"{shared_folder(v.documents.sparkSession)}/csv-{uuid.uuid4().hex}"
    sinks.publish_csv(v.documents.select("doc_id", "text"), path)
    sinks.publish_csv(v.documents.select("doc_id", "text", "lang", "source", "n_chars"), path)
    return sinks.read_published_csv(spark, path)


@query("a7_point_lookup_list", """
    SELECT doc_id, lang, source FROM documents WHERE doc_id IN (3, 17, 42, 99, 100000)""")
def point_lookup_list(v):
    return lookup.by_ids(v.documents, "DOC_ID", [3, 17, 42, 99, 100000]).select("doc_id", "lang", "source")


@query("a7_point_lookup_frame", """
    SELECT doc_id, lang, source FROM documents
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def point_lookup_frame(v):
    wanted = v.labels.filter("toxic = 1").select("doc_id")
    return lookup.by_ids(v.documents, "doc_id", wanted).select("doc_id", "lang", "source")


@query("a8_embeddings_with_ids", """
    SELECT vec_id, label, len(embedding) AS dims,
           ROUND(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm
    FROM embeddings""")
def embeddings_with_ids(v):
    e = F.col("embedding")
    return v.embeddings.select(
        "vec_id", "label", F.size(e).alias("dims"),
        F.round(F.sqrt(search.inner_product(e, e)), 4).alias("norm"),
    )


@query("b1_select_present", "SELECT o_totalprice, o_orderkey FROM orders")
def select_present(v):
    return projection.select_present(v.orders, ["o_totalprice", "no_such_column", "o_orderkey"])


@query("b2_keys_at_edges", """
    SELECT incdnt_sid, incdnt_status_name, risk_profile_id, incdnt_id FROM incident_base""", ("incident_base",))
def keys_at_edges(v):
    return projection.keys_at_edges(
        v.incident_base.select("incdnt_id", "incdnt_status_name", "incdnt_sid", "risk_profile_id")
    )


@query("b3_display_names", """
    SELECT incdnt_sid AS "Идентификатор события", incdnt_status_name AS "Статус события",
           CAST(incdnt_sum AS DOUBLE) AS "Общая сумма всех последствий (руб.)"
    FROM incident_base""", ("incident_base",))
def display_names(v):
    return projection.with_display_names(
        v.incident_base.select("incdnt_sid", "incdnt_status_name", "incdnt_sum")
    )


@query("b4_lower_case_names", "SELECT s_suppkey, s_name FROM supplier")
def lower_case_names(v):
    return projection.lower_case_names(
        v.supplier.select(F.col("s_suppkey").alias("S_SUPPKEY"), F.col("s_name").alias("S_Name"))
    )


@query("b5_detail_columns", """
    SELECT risk_profile_name, incdnt_sid, incdnt_status_name, incdnt_autoreg_flag, incdnt_type_lvl_1_name,
           strftime(incdnt_entry_dt, '%Y-%m-%d %H:%M:%S') AS incdnt_entry_dt,
           org_struct_lvl_3_name, org_struct_lvl_4_name, incdnt_id
    FROM incident""", ("incident",))
def detail_columns(v):
    return projection.detail_columns(v.incident, ["risk_profile_name"])


@query("b6_computed_column", """
    SELECT strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS quarter, COUNT(*) AS cnt
    FROM orders GROUP BY 1""")
def computed_column(v):
    return projection.derive(v.orders, "o_orderdate", "quarter", "quarter").groupBy("quarter").agg(
        F.count(F.lit(1)).alias("cnt")
    )


@query("s1_report_order", """
    SELECT o_orderpriority, o_orderkey, o_orderstatus FROM orders ORDER BY o_orderpriority, o_orderkey""")
def report_order(v):
    return sorting.sort_ascending(
        v.orders.select("o_orderpriority", "o_orderkey", "o_orderstatus"), ["o_orderpriority", "o_orderkey"]
    )


@query("s2_top_n_nulls_last", """
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(half AS DOUBLE) AS half FROM (
        SELECT *, CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS half FROM lineitem)
    ORDER BY half DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey LIMIT 100""")
def top_n_nulls_last(v):
    amount = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice").cast("decimal(18,2)"))
    return sorting.top_n(
        v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", amount.alias("half")),
        "half", 100, tie_break=("l_orderkey", "l_linenumber", "l_partkey"),
    )


@query("s2_bottom_n", """
    SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal NULLS LAST, s_suppkey LIMIT 25""")
def bottom_n(v):
    return sorting.top_n(v.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", 25, True, ("s_suppkey",))


@query("s3_limit_rules", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100000""")
def limit_rules(v):
    ordered = v.orders.select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey")
    return sorting.preview_limited(ordered, "junk")


@query("s5_preview", """
    SELECT incdnt_id, incdnt_sid, strftime(incdnt_entry_dt, '%Y-%m-%d %H:%M:%S') AS incdnt_entry_dt,
           incdnt_status_name, incdnt_type_lvl_1_name
    FROM incident_base ORDER BY incdnt_id LIMIT 8""", ("incident_base",))
def preview(v):
    return projection.preview(v.incident_base.orderBy("incdnt_id"), rows=8, columns=5)


@query("h7_canonical_id", r"""
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN 'EVE-' || o_orderkey
           WHEN 3 THEN CAST((o_orderkey + 1) * 1000 AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS id
    FROM orders""")
def canonical_ids(v):
    k = F.col("o_orderkey")
    form = (
        F.when(k % 4 == 0, F.concat(F.lit("  "), k.cast("string")))
        .when(k % 4 == 1, F.concat(k.cast("string"), F.lit(".0")))
        .when(k % 4 == 2, F.concat(F.lit("EVE-"), k.cast("string"), F.lit(" ")))
        .otherwise(F.concat((k + 1).cast("string"), F.lit("e+3")))
    )
    return v.orders.select("o_orderkey", canonical_id(form).alias("id"))
