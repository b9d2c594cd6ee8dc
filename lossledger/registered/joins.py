"""Joins (J) and set operations (U)."""

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.predicates import equals_ignore_case
from ..operators import credit, joins, sets
from ..operators.lineage import shared_folder
from ..sources import sinks
from .base import query


def first_days(v):
    """Loans with the day before their first balance as issue day, the last balance day as
    incident day; balances per loan and day."""
    amount = F.col("l_extendedprice").cast("decimal(12,2)")
    snapshots = v.lineitem.groupBy(
        F.col("l_orderkey").alias("loan_id"), F.to_date("l_shipdate").alias("day")
    ).agg(
        F.sum(amount).alias("debt"),
        F.sum(amount * F.col("l_tax").cast("decimal(4,2)")).alias("overdue"),
        F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("interest"),
        F.sum(F.col("l_linenumber").cast("decimal(12,2)")).alias("interest_overdue"),
        F.max(F.col("l_discount").cast("decimal(4,2)")).alias("reserve"),
    )
    cases = snapshots.groupBy("loan_id").agg(
        F.date_sub(F.min("day"), 1).alias("issue_day"), F.max("day").alias("incident_day")
    )
    return cases, snapshots


SNAPSHOT_SQL = """
    snapshots AS (
        SELECT l_orderkey AS loan_id, CAST(l_shipdate AS DATE) AS day,
               SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS debt,
               SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS overdue,
               SUM(CAST(l_quantity AS DECIMAL(12,2))) AS interest,
               SUM(CAST(l_linenumber AS DECIMAL(12,2))) AS interest_overdue,
               MAX(CAST(l_discount AS DECIMAL(4,2))) AS reserve
        FROM lineitem GROUP BY 1, 2),
    cases AS (
        SELECT loan_id, MIN(day) - 1 AS issue_day, MAX(day) AS incident_day FROM snapshots GROUP BY 1)"""


def dec(c: str, kind: str = "decimal(18,2)") -> Column:
    return F.col(c).cast(kind)


@query("j1_incident_impacts", """
    SELECT incdnt_id, incdnt_sid, fin_impact_sid, fin_impact_type_name, fin_impact_account_num,
           fin_impact_docum_num, CAST(fin_impact_rub_amt AS DOUBLE) AS fin_impact_rub_amt
    FROM incident_base JOIN fin_impact USING (incdnt_id)""", ("incident_base", "fin_impact"))
def incident_impacts(v):
    return joins.with_children(v.incident_base, v.fin_impact).select(
        "incdnt_id", "incdnt_sid", "fin_impact_sid", "fin_impact_type_name",
        "fin_impact_account_num", "fin_impact_docum_num", "fin_impact_rub_amt",
    )


@query("j2_incident_recoveries", """
    SELECT incdnt_id, incdnt_status_name, recovery_sid, recovery_src_account_num,
           CAST(recovery_rub_amt AS DOUBLE) AS recovery_rub_amt
    FROM incident_base JOIN recovery USING (incdnt_id)""", ("incident_base", "recovery"))
def incident_recoveries(v):
    return joins.with_children(v.incident_base, v.recovery).select(
        "incdnt_id", "incdnt_status_name", "recovery_sid", "recovery_src_account_num", "recovery_rub_amt"
    )


@query("j3_incident_qualitative", """
    SELECT incdnt_id, nonfin_impact_sid, nonfin_impact_kind_name, nonfin_impact_influence_class_name
    FROM incident_base JOIN nonfin_impact USING (incdnt_id)""", ("incident_base", "nonfin_impact"))
def incident_qualitative(v):
    return joins.with_children(v.incident_base, v.nonfin_impact).select(
        "incdnt_id", "nonfin_impact_sid", "nonfin_impact_kind_name", "nonfin_impact_influence_class_name"
    )


@query("j4_deleted_with_actions", """
    SELECT incdnt_id, incdnt_sid, stts_chng_id,
           strftime(stts_chng_action_dttm, '%Y-%m-%d %H:%M:%S') AS stts_chng_action_dttm
    FROM incident_base LEFT JOIN (SELECT * FROM status_change WHERE stts_chng_action_name = 'error') USING (incdnt_id)
    WHERE incdnt_status_name = 'P'""", ("incident_base", "status_change"))
def deleted_with_actions(v):
    actions = v.status_change.filter(equals_ignore_case("stts_chng_action_name", "Error"))
    deleted = v.incident_base.filter(equals_ignore_case("incdnt_status_name", "p"))
    return joins.with_children(deleted, actions, how="left").select(
        "incdnt_id", "incdnt_sid", "stts_chng_id", "stts_chng_action_dttm"
    )


@query("j5_impacts_times_recoveries", """
    SELECT incdnt_id, fin_impact_sid, fin_impact_account_num, recovery_sid, recovery_src_account_num
    FROM incident_base LEFT JOIN fin_impact USING (incdnt_id) LEFT JOIN recovery USING (incdnt_id)""",
       ("incident_base", "fin_impact", "recovery"))
def impacts_times_recoveries(v):
    both = joins.with_children(
        joins.with_children(v.incident_base, v.fin_impact, how="left"), v.recovery, how="left"
    )
    return both.select(
        "incdnt_id", "fin_impact_sid", "fin_impact_account_num", "recovery_sid", "recovery_src_account_num"
    )


@query("j6_preaggregated_join", """
    SELECT incdnt_id, CAST(direct_loss AS DOUBLE) AS direct_loss, impacts
    FROM incident_base LEFT JOIN (
        SELECT incdnt_id, SUM(fin_impact_rub_amt) AS direct_loss, COUNT(*) AS impacts
        FROM fin_impact WHERE fin_impact_type_name = 'R' GROUP BY 1) USING (incdnt_id)""",
       ("incident_base", "fin_impact"))
def preaggregated_join(v):
    return joins.join_aggregated(
        v.incident_base,
        v.fin_impact,
        [F.sum("fin_impact_rub_amt").alias("direct_loss"), F.count(F.lit(1)).alias("impacts")],
        condition=F.col("fin_impact_type_name") == "R",
    ).select("incdnt_id", "direct_loss", "impacts")


@query("j7_inner_join", """
    SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey""")
def inner_join(v):
    return joins.equi_join(v.orders, v.customer, left_on="o_custkey", right_on="c_custkey").select(
        "o_orderkey", "c_name"
    )


@query("j7_outer_join", """
    SELECT a.c_custkey AS left_key, b.c_custkey AS right_key
    FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 3000) a
    FULL JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') b ON a.c_custkey = b.c_custkey""")
def outer_join(v):
    left = v.customer.filter("c_acctbal > 3000").select(F.col("c_custkey").alias("left_key"))
    right = v.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("right_key"))
    return joins.equi_join(left, right, left_on="left_key", right_on="right_key", how="outer")


@query("j7_right_join", """
    SELECT c_custkey, COUNT(o_orderkey) AS orders FROM orders RIGHT JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def right_join(v):
    right = joins.equi_join(v.orders, v.customer, left_on="o_custkey", right_on="c_custkey", how="right")
    return right.groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("j8_fanout_keys", """
    SELECT l_orderkey, l_linenumber, COUNT(*) AS row_count FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def fanout_keys(v):
    return joins.duplicate_keys(v.lineitem, ["l_orderkey", "l_linenumber"])


@query("j8_guarded_join", """
    SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""")
def guarded_join(v):
    customer = v.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return joins.guarded_join(v.orders, customer, ["o_custkey"], "inner").select("o_orderkey", "c_mktsegment")


@query("j8_join_growth", """
    SELECT 'impacts' AS side, (SELECT COUNT(*) FROM orders) AS left_rows,
           (SELECT COUNT(*) FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey) AS joined_rows,
           (SELECT COUNT(*) FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey) > (SELECT COUNT(*) FROM orders) AS grew
    UNION ALL SELECT 'unit', (SELECT COUNT(*) FROM orders), (SELECT COUNT(*) FROM orders JOIN customer ON o_custkey = c_custkey),
           (SELECT COUNT(*) FROM orders JOIN customer ON o_custkey = c_custkey) > (SELECT COUNT(*) FROM orders)""")
def join_growth(v):
    """Rows before and after two joins, counted while the joined rows are written."""
    customer = v.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    impacts = v.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    orders = v.orders.select("o_orderkey", "o_custkey")
    rows = []
    for side, joined, growth in (
        ("impacts", *joins.watched_join(orders, impacts, ["o_orderkey"], allow_fanout=True)),
        ("unit", *joins.watched_join(orders, customer, ["o_custkey"], "inner")),
    ):
        sinks.publish_csv(joined, f"{shared_folder(joined.sparkSession)}/growth-{uuid.uuid4().hex}")
        rows.append((side, *growth().values()))
    return v.orders.sparkSession.createDataFrame(rows, "side string, left_rows bigint, joined_rows bigint, grew boolean")


@query("j9_having_sum", """
    SELECT incdnt_id, incdnt_sid FROM incident_base WHERE incdnt_id IN (
        SELECT incdnt_id FROM fin_impact WHERE fin_impact_type_name = 'R'
        GROUP BY 1 HAVING SUM(fin_impact_rub_amt) > 90000)""", ("incident_base", "fin_impact"))
def having_sum(v):
    return joins.having_sum(
        v.incident_base, v.fin_impact, "fin_impact_rub_amt", ">", 90000,
        condition=F.col("fin_impact_type_name") == "R",
    ).select("incdnt_id", "incdnt_sid")


@query("j10_dossier_counts", """
    SELECT incdnt_id,
           COALESCE(a, 0) AS impacts, COALESCE(b, 0) AS recoveries, COALESCE(c, 0) AS qualitative, COALESCE(d, 0) AS actions
    FROM incident_base
    LEFT JOIN (SELECT incdnt_id, COUNT(*) AS a FROM fin_impact GROUP BY 1) USING (incdnt_id)
    LEFT JOIN (SELECT incdnt_id, COUNT(*) AS b FROM recovery GROUP BY 1) USING (incdnt_id)
    LEFT JOIN (SELECT incdnt_id, COUNT(*) AS c FROM nonfin_impact GROUP BY 1) USING (incdnt_id)
    LEFT JOIN (SELECT incdnt_id, COUNT(*) AS d FROM status_change GROUP BY 1) USING (incdnt_id)""",
       ("incident_base", "fin_impact", "recovery", "nonfin_impact", "status_change"))
def dossier_counts(v):
    return joins.dossier_counts(v.incident_base, {
        "impacts": v.fin_impact, "recoveries": v.recovery,
        "qualitative": v.nonfin_impact, "actions": v.status_change,
    })


@query("j10_dossier", """
    SELECT incdnt_id, incdnt_sid, fin_impact_sid AS impact_fin_impact_sid,
           fin_impact_docum_num AS impact_fin_impact_docum_num,
           recovery_sid AS recovery_recovery_sid, recovery_doc_num AS recovery_recovery_doc_num
    FROM incident_base LEFT JOIN fin_impact USING (incdnt_id) LEFT JOIN recovery USING (incdnt_id)
    WHERE incdnt_id = (SELECT MIN(incdnt_id) FROM recovery)""", ("incident_base", "fin_impact", "recovery"))
def dossier(v):
    one = v.incident_base.filter(F.col("incdnt_id") == v.recovery.agg(F.min("incdnt_id")).scalar())
    return joins.dossier(one, v.fin_impact, v.recovery).select(
        "incdnt_id", "incdnt_sid", "impact_fin_impact_sid", "impact_fin_impact_docum_num",
        "recovery_recovery_sid", "recovery_recovery_doc_num",
    )


def _children(v):
    """The four child tables of an incident, each with the order of its records."""
    return {
        "impacts": (v.fin_impact.select("incdnt_id", "fin_impact_sid", "fin_impact_type_name"), ["fin_impact_sid"]),
        "recoveries": (v.recovery.select("incdnt_id", "recovery_sid", "recovery_type_name"), ["recovery_sid"]),
        "qualitative": (v.nonfin_impact.select("incdnt_id", "nonfin_impact_sid", "nonfin_impact_kind_name"), ["nonfin_impact_sid"]),
        "actions": (v.status_change.select("incdnt_id", "stts_chng_action_dttm", "stts_chng_id", "stts_chng_action_name"),
                    ["stts_chng_action_dttm", "stts_chng_id"]),
    }


_SHOWN = {  # record -> text, in SQL and in Spark
    "impacts": ("fin_impact_sid || ':' || fin_impact_type_name", lambda r: F.concat_ws(":", r["fin_impact_sid"], r["fin_impact_type_name"])),
    "recoveries": ("recovery_sid || ':' || recovery_type_name", lambda r: F.concat_ws(":", r["recovery_sid"], r["recovery_type_name"])),
    "qualitative": ("nonfin_impact_sid || ':' || nonfin_impact_kind_name",
                    lambda r: F.concat_ws(":", r["nonfin_impact_sid"], r["nonfin_impact_kind_name"])),
    "actions": ("stts_chng_id || ':' || stts_chng_action_name",
                lambda r: F.concat_ws(":", r["stts_chng_id"].cast("string"), r["stts_chng_action_name"])),
}
_CHILD_TABLES = ("fin_impact", "recovery", "nonfin_impact", "status_change")


def _dossier_sql(page: int) -> str:
    orders = ("fin_impact_sid, fin_impact_type_name", "recovery_sid, recovery_type_name",
              "nonfin_impact_sid, nonfin_impact_kind_name", "stts_chng_action_dttm, stts_chng_id, stts_chng_action_name")
    pages = ", ".join(f"""{name} AS (
        SELECT incdnt_id, page, COUNT(*) AS n, string_agg(shown, '|' ORDER BY place) AS records FROM (
            SELECT incdnt_id, {shown} AS shown, ROW_NUMBER() OVER w AS place, (ROW_NUMBER() OVER w - 1) // {page} AS page FROM {table}
            WINDOW w AS (PARTITION BY incdnt_id ORDER BY {order})) GROUP BY 1, 2)"""
        for (name, (shown, _)), table, order in zip(_SHOWN.items(), _CHILD_TABLES, orders, strict=True))
    every = " UNION ".join(f"SELECT incdnt_id, page FROM {name}" for name in _SHOWN)
    columns = ", ".join(f"COALESCE({n}.n, 0) AS n_{n}, COALESCE({n}.records, '') AS {n}" for n in _SHOWN)
    sides = " ".join(f"LEFT JOIN {n} ON {n}.incdnt_id = i.incdnt_id AND {n}.page = p.page" for n in _SHOWN)
    return f"""WITH {pages}, pages AS ({every})
        SELECT i.incdnt_id, i.incdnt_sid, i.incdnt_status_name, COALESCE(p.page, 0) AS page, {columns}
        FROM incident_base i LEFT JOIN pages p ON p.incdnt_id = i.incdnt_id {sides}"""


def _shown(dossiers):
    return dossiers.select(
        "incdnt_id", "incdnt_sid", "incdnt_status_name", "page",
        *[F.size(n).alias(f"n_{n}") for n in _SHOWN],
        *[F.array_join(F.transform(n, show), "|").alias(n) for n, (_, show) in _SHOWN.items()],
    )


@query("j10_nested_dossier", _dossier_sql(joins.PAGE), ("incident_base", *_CHILD_TABLES))
def nested_dossier(v):
    """Every incident with its impacts, recoveries, qualitative impacts and status log as records."""
    return _shown(joins.nested_dossier(v.incident_base, _children(v)))


@query("j10_nested_dossier_pages", _dossier_sql(3), ("incident_base", *_CHILD_TABLES))
def nested_dossier_pages(v):
    """The same on pages of three records."""
    return _shown(joins.nested_dossier(v.incident_base, _children(v), page=3))


@query("j11_balance_with_penalty", "WITH" + SNAPSHOT_SQL + """
    SELECT loan_id, CAST(debt AS DOUBLE) AS debt, CAST(COALESCE(penalty, 0) AS DOUBLE) AS penalty
    FROM cases JOIN snapshots USING (loan_id)
    LEFT JOIN (SELECT o_orderkey AS loan_id, CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS penalty
               FROM orders) USING (loan_id)
    WHERE day = incident_day""")
def balance_with_penalty(v):
    cases, snapshots = first_days(v)
    at_day = snapshots.join(
        cases.select("loan_id", F.col("incident_day").alias("day")), ["loan_id", "day"], "left_semi"
    )
    loans = v.orders.select(
        F.col("o_orderkey").alias("loan_id"),
        F.when(F.col("o_orderstatus") == "P", dec("o_totalprice")).alias("penalty"),
    )
    return credit.debt_with_penalty(at_day, loans, "loan_id", "penalty").select("loan_id", "debt", "penalty")


@query("j12_two_dates", "WITH" + SNAPSHOT_SQL + """
    SELECT loan_id, strftime(issue_day, '%Y-%m-%d') AS issue_day, strftime(incident_day, '%Y-%m-%d') AS incident_day,
           CAST(a.debt AS DOUBLE) AS debt_now, CAST(b.debt AS DOUBLE) AS debt_then,
           CAST(a.reserve - b.reserve AS DOUBLE) AS growth
    FROM cases JOIN snapshots a USING (loan_id) JOIN snapshots b USING (loan_id)
    WHERE a.day = incident_day AND b.day = issue_day + 1""")
def two_dates(v):
    cases, snapshots = first_days(v)
    both = joins.snapshots_at_two_dates(
        cases, snapshots, "loan_id", "day", "incident_day", "issue_day", ["debt", "reserve"]
    )
    return both.select(
        "loan_id", "issue_day", "incident_day", "debt_now", "debt_then",
        (F.col("reserve_now") - F.col("reserve_then")).alias("growth"),
    )


@query("j13_recovery_coefficient", """
    WITH coef(bankrupt, product, percent) AS (VALUES
        ('0','1',49),('0','2',45),('0','3',20),('0','4',15),('0','5',20),('0','6',24),
        ('1','1',49),('1','2',15),('1','3',4),('1','4',5),('1','5',7),('1','6',6))
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.03 ELSE COALESCE(percent, 0) / 100.0 END::DOUBLE AS coefficient
    FROM orders LEFT JOIN coef
      ON bankrupt = CAST(o_custkey % 3 AS VARCHAR) AND product = CAST(o_orderkey % 7 AS VARCHAR)""")
def recovery_coefficient(v):
    loans = v.orders.select(
        "o_orderkey",
        "o_orderstatus",
        (F.col("o_custkey") % 3).cast("string").alias("bankrupt"),
        (F.col("o_orderkey") % 7).cast("string").alias("product"),
    )
    return credit.with_recovery_coefficient(
        loans, "bankrupt", "product", F.col("o_orderstatus") == "F"
    ).select("o_orderkey", "coefficient")


@query("j14_pledges_on_date", """
    SELECT o_orderkey AS loan_id, strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS day,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS pledge
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def pledges_on_date(v):
    pledges = v.lineitem.select(
        F.col("l_orderkey").alias("loan_id"), F.to_date("l_shipdate").alias("day"), dec("l_extendedprice").alias("value")
    )
    per_loan = credit.pledge_per_loan(pledges, "loan_id", "day", "value")
    return v.orders.select(F.col("o_orderkey").alias("loan_id")).join(per_loan, "loan_id")


@query("j15_attach_text", """
    SELECT vec_id, label, source, n_chars FROM embeddings LEFT JOIN documents ON doc_id = vec_id""")
def attach_text(v):
    docs = v.documents.select(F.col("doc_id").alias("vec_id"), "source", "n_chars")
    return v.embeddings.select("vec_id", "label").join(docs, "vec_id", "left")


@query("j16_log_with_employee", """
    SELECT stts_chng_id, stts_chng_user_num, s_name AS employee
    FROM status_change LEFT JOIN supplier ON s_suppkey = stts_chng_user_num""", ("status_change",))
def log_with_employee(v):
    employees = v.supplier.select(F.col("s_suppkey").alias("stts_chng_user_num"), F.col("s_name").alias("employee"))
    return v.status_change.join(employees, "stts_chng_user_num", "left").select(
        "stts_chng_id", "stts_chng_user_num", "employee"
    )


@query("u1_union_products", """
    SELECT l_orderkey AS income_value, l_returnflag AS product, '' AS contract_number,
           CAST(l_orderkey AS VARCHAR) AS search_id FROM lineitem
    UNION
    SELECT o_orderkey, 'KK', o_orderpriority, CAST(o_custkey AS VARCHAR) FROM orders""")
def union_products(v):
    key = F.col("l_orderkey")
    loans = v.lineitem.select(key.alias("id"), F.col("l_returnflag").alias("product"), key.alias("search_id"))
    cards = v.orders.select(
        F.col("o_orderkey").cast("string").cast("bigint").alias("id"),
        F.col("o_orderpriority").alias("contract"),
        F.col("o_custkey").alias("search_id"),
    )
    return sets.union_products(loans, cards, "KK")


@query("u2_union_candidates", """
    SELECT user_id, first_rank, second_rank FROM
        (SELECT user_id, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, user_id) AS first_rank
         FROM events WHERE event_type = 'purchase' GROUP BY 1 QUALIFY first_rank <= 40) a
    FULL JOIN
        (SELECT user_id, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, user_id) AS second_rank
         FROM events WHERE event_type = 'error' GROUP BY 1 QUALIFY second_rank <= 40) b USING (user_id)""")
def union_candidates(v):
    from ..operators.profile import ranked_batches

    def ranking(kind: str, name: str):
        counted = v.events.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        top = ranked_batches(counted, [F.desc("n"), F.asc("user_id")], 40, 40)
        return top.select("user_id", F.col("rn").alias(name))

    return sets.union_candidates(
        ranking("purchase", "first_rank"), ranking("error", "second_rank"), ["user_id"]
    )
