"""Credit losses (C) and the credit report (R10)."""

from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..operators import credit, joins
from .base import query
from .joins import SNAPSHOT_SQL, first_days

RISKS = ("DRP-10024", "DRP-10023", "DRP-10047", "DRP-10027", "DRP-10102")
DEVIATIONS = ("1", "37", "38", "36", "40", "35", "5", "14", "2", "42", "44", "45", "46", "6", "41")


def _pick(values, number):
    return F.element_at(F.split(F.lit(",".join(values)), ","), (number % len(values) + 1).cast("int"))


def _cases(v):
    """Loans as cases: codes from their keys, balances at two dates, pledge on the incident day."""
    days, snapshots = first_days(v)
    balances = joins.snapshots_at_two_dates(
        days, snapshots, "loan_id", "day", "incident_day", "issue_day",
        ["debt", "overdue", "interest", "interest_overdue", "reserve"],
    )
    pledges = v.lineitem.select(
        F.col("l_orderkey").alias("loan_id"), F.to_date("l_shipdate").alias("incident_day"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("value"),
    )
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    amount = F.col("o_totalprice").cast("decimal(12,2)")
    loans = v.orders.select(
        key.alias("loan_id"),
        (key % 3 + 1).cast("string").alias("client"),
        _pick(RISKS, customer).alias("risk"),
        _pick(DEVIATIONS, key).alias("deviation"),
        amount.alias("credit_amount"),
        F.split(_pick(("1;2", "3", "4;9", "1;2;3;4"), key), ";").alias("factor_codes"),
        (amount * F.lit("0.02").cast("decimal(4,2)")).alias("overstatement"),
        (customer % 100).cast("int").alias("withdrawn_share"),
        (amount * F.lit("0.30").cast("decimal(4,2)")).alias("withdrawn_amount"),
        (key % 2 + 1).cast("string").alias("pledge_state"),
    )
    pledged = credit.pledge_per_loan(pledges, "loan_id", "incident_day", "value")
    return loans.join(balances, "loan_id").join(pledged, ["loan_id", "incident_day"], "left")


def _list(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


CASES_SQL = "WITH" + SNAPSHOT_SQL + f""",
    pledges AS (SELECT l_orderkey AS loan_id, CAST(l_shipdate AS DATE) AS day, SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS pledge
                FROM lineitem GROUP BY 1, 2),
    loans AS (
        SELECT o_orderkey AS loan_id, CAST(o_orderkey % 3 + 1 AS VARCHAR) AS client, {_list(RISKS)}[o_custkey % 5 + 1] AS risk,
               {_list(DEVIATIONS)}[o_orderkey % 15 + 1] AS deviation, CAST(o_totalprice AS DECIMAL(12,2)) AS credit,
               CAST([48, 18, 3, 69][o_orderkey % 4 + 1] AS DECIMAL(10,4)) AS weight,
               CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.02 AS DECIMAL(4,2)) AS overstatement, o_custkey % 100 AS share,
               CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.30 AS DECIMAL(4,2)) AS withdrawn_amount, o_orderkey % 2 = 0 AS pledge_lost
        FROM orders),
    measured AS (
        SELECT l.*, CAST(a.debt + a.overdue AS DECIMAL(18,4)) AS base, CAST(a.interest + a.interest_overdue AS DECIMAL(18,4)) AS interest,
               a.reserve AS p1, a.reserve - b.reserve AS d, CAST(p.pledge AS DECIMAL(18,4)) AS pledge, incident_day
        FROM loans l JOIN cases USING (loan_id) JOIN snapshots a ON a.loan_id = l.loan_id AND a.day = incident_day
        JOIN snapshots b ON b.loan_id = l.loan_id AND b.day = issue_day + 1
        LEFT JOIN pledges p ON p.loan_id = l.loan_id AND p.day = incident_day),
    branch AS (
        SELECT *, base * p1 AS rvps, interest * p1 AS rvp, base * d AS ds, interest * d AS di,
               CASE WHEN client = '1' THEN
                        CASE WHEN d > 0 AND ((risk = 'DRP-10024' AND deviation = '1') OR risk = 'DRP-10102') THEN 'x1.00' ELSE 'credit' END
                    WHEN client = '3' THEN
                        CASE WHEN risk = 'DRP-10024' AND deviation = '37' THEN CASE WHEN d > 0 THEN 'x0.75' END
                             WHEN risk = 'DRP-10024' AND deviation = '38' THEN CASE WHEN d > 0 THEN 'x0.87' END
                             WHEN risk = 'DRP-10024' AND deviation = '36' THEN CASE WHEN d <= 0 THEN 'credit' END
                             WHEN risk = 'DRP-10024' AND deviation IN ('35', '40') THEN CASE WHEN d <= 0 THEN 'over' END
                             WHEN risk = 'DRP-10023' THEN CASE WHEN d <= 0 THEN 'withdrawn' WHEN share <= 50 THEN 'share' ELSE 'x0.87' END
                             WHEN risk = 'DRP-10047' THEN CASE WHEN d > 0 THEN 'growth' ELSE 'credit' END
                             WHEN risk = 'DRP-10027' AND pledge_lost THEN CASE WHEN d > 0 AND base * d < pledge THEN 'pledge part' ELSE 'pledge' END END
                    ELSE
                        CASE WHEN risk = 'DRP-10024' AND deviation IN ('5', '6', '14', '36', '41') THEN CASE WHEN d > 0 THEN 'x0.89' ELSE 'credit x0.89' END
                             WHEN (risk = 'DRP-10024' AND deviation IN ('2', '42')) OR risk = 'DRP-10023' OR (risk = 'DRP-10047' AND deviation = '44')
                                  THEN CASE WHEN d > 0 THEN 'weight' ELSE 'credit weight' END
                             WHEN risk = 'DRP-10024' AND deviation IN ('35', '40') THEN CASE WHEN d > 0 AND base * d < overstatement THEN 'over part' ELSE 'over' END
                             WHEN risk = 'DRP-10047' AND deviation IN ('45', '46') THEN CASE WHEN d > 0 THEN 'growth' ELSE 'credit' END
                             WHEN risk = 'DRP-10027' AND pledge_lost THEN CASE WHEN d > 0 AND base * d < pledge THEN 'pledge whole' END END
               END AS b
        FROM measured),
    losses AS (
        SELECT *, CAST(CASE WHEN b LIKE 'x0%' OR b = 'x1.00' THEN CAST(rvps * CAST(substr(b, 2) AS DECIMAL(4,2)) AS DECIMAL(38,6))
                       WHEN b = 'share' THEN rvps * share WHEN b = 'weight' THEN CAST(rvps * weight AS DECIMAL(38,6))
                       WHEN b IN ('growth', 'pledge part', 'pledge whole', 'over part') THEN ds END AS DOUBLE) AS direct,
               CAST(CASE WHEN b LIKE 'x0%' OR b = 'x1.00' THEN CAST(rvp * CAST(substr(b, 2) AS DECIMAL(4,2)) AS DECIMAL(38,6))
                       WHEN b = 'share' THEN rvp * share WHEN b = 'weight' THEN CAST(rvp * weight AS DECIMAL(38,6))
                       WHEN b = 'growth' THEN di WHEN b = 'pledge part' THEN pledge - ds WHEN b = 'pledge whole' THEN pledge
                       WHEN b = 'over part' THEN overstatement - ds END AS DOUBLE) AS indirect,
               CAST(CASE WHEN b = 'credit' THEN credit WHEN b = 'credit x0.89' THEN credit * CAST(0.89 AS DECIMAL(4,2))
                       WHEN b = 'credit weight' THEN credit * weight WHEN b = 'over' THEN overstatement
                       WHEN b = 'withdrawn' THEN least(withdrawn_amount, base) WHEN b = 'pledge' THEN pledge END AS DOUBLE) AS potential
        FROM branch)"""

_OUT = ["loan_id", "risk", "deviation", "direct", "indirect", "potential"]


def _losses(v, client: str):
    return credit.losses(_cases(v)).filter(F.col("client") == client).select(*_OUT)


@query("c1_person_losses", CASES_SQL + f" SELECT {', '.join(_OUT)} FROM losses WHERE client = '1'")
def person_losses(v):
    return _losses(v, fixed.CLIENT_PERSON)


@query("c2_small_business_losses", CASES_SQL + f" SELECT {', '.join(_OUT)} FROM losses WHERE client = '3'")
def small_business_losses(v):
    return _losses(v, fixed.CLIENT_SMALL)


@query("c3_corporate_losses", CASES_SQL + f" SELECT {', '.join(_OUT)} FROM losses WHERE client = '2'")
def corporate_losses(v):
    return _losses(v, fixed.CLIENT_CORPORATE)


@query("c4_factor_weights", """
    SELECT o_orderkey, [48, 18, 3, 69][o_orderkey % 4 + 1]::BIGINT AS weight FROM orders""")
def factor_weights(v):
    codes = F.split(_pick(("1;2", "3", "4;9", "1;2;3;4"), F.col("o_orderkey")), ";")
    return v.orders.select("o_orderkey", credit.factor_weight(codes).alias("weight"))


@query("c5_loss_kinds", CASES_SQL + """
    SELECT client, CASE WHEN direct IS NOT NULL THEN 'pair' WHEN potential IS NOT NULL THEN 'potential' ELSE 'none' END AS kind,
           COUNT(*) AS cnt FROM losses GROUP BY 1, 2""")
def loss_kinds(v):
    kind = (
        F.when(F.col("direct").isNotNull(), "pair")
        .when(F.col("potential").isNotNull(), "potential")
        .otherwise("none")
    )
    return credit.losses(_cases(v)).groupBy("client", kind.alias("kind")).agg(F.count(F.lit(1)).alias("cnt"))


_RISK_ROWS = ", ".join(f"('{code}', '{meaning}')" for code, meaning in fixed.RISK_PROFILES)
_CLIENT_ROWS = ", ".join(f"('{code}', '{meaning}')" for code, meaning in fixed.CLIENT_TYPES)


@query("c6_code_dictionaries", f"""
    WITH names(code, meaning) AS (VALUES {_RISK_ROWS}), clients(code, meaning) AS (VALUES {_CLIENT_ROWS})
    SELECT o_orderkey, COALESCE(names.meaning, risk) AS risk_name, COALESCE(clients.meaning, client) AS client_name
    FROM (SELECT o_orderkey, 'DRP-' || (10023 + o_custkey % 3) AS risk, CAST(o_orderkey % 4 AS VARCHAR) AS client FROM orders)
    LEFT JOIN names ON names.code = risk LEFT JOIN clients ON clients.code = client""")
def code_dictionaries(v):
    coded = v.orders.select(
        "o_orderkey",
        F.concat(F.lit("DRP-"), F.col("o_custkey") % 3 + 10023).alias("risk"),
        (F.col("o_orderkey") % 4).cast("string").alias("client"),
    )
    named = credit.with_meaning(coded, "risk", fixed.RISK_PROFILES, "risk_name")
    return credit.with_meaning(named, "client", fixed.CLIENT_TYPES, "client_name").select(
        "o_orderkey", "risk_name", "client_name"
    )


@query("r10_credit_report", CASES_SQL + f""",
    names(code, meaning) AS (VALUES {_RISK_ROWS}), clients(code, meaning) AS (VALUES {_CLIENT_ROWS})
    SELECT clients.meaning AS client_name, loan_id, strftime(incident_day, '%Y-%m-%d') AS incident_day, names.meaning AS risk_name,
           deviation, direct, indirect, potential
    FROM losses JOIN names ON names.code = risk JOIN clients ON clients.code = client""")
def credit_report(v):
    report = credit.losses(_cases(v))
    report = credit.with_meaning(report, "risk", fixed.RISK_PROFILES, "risk_name")
    return credit.with_meaning(report, "client", fixed.CLIENT_TYPES, "client_name").select(
        "client_name", "loan_id", "incident_day", "risk_name", "deviation", "direct", "indirect", "potential"
    )
