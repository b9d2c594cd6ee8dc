"""Credit losses: one pass over a table of cases with balances at two dates.

A case has a client type, a risk code, a deviation code and the balances of its loan on the
incident day (``_now``) and on the day after issue (``_then``). The result is either a pair
(direct, indirect) or one potential loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed

LOSS = "decimal(38,6)"


def code_dictionary(spark: SparkSession, pairs) -> DataFrame:
    """A code list as a small dimension table."""
    return spark.createDataFrame(list(pairs), "code string, meaning string")


def with_meaning(df: DataFrame, code: str, pairs, out: str) -> DataFrame:
    """Attach the meaning of a code; an unknown code stands for itself."""
    meaning = code_dictionary(df.sparkSession, pairs).select(
        F.col("code").alias(code), F.col("meaning").alias(out)
    )
    return df.join(meaning, code, "left").withColumn(out, F.coalesce(out, F.col(code)))


def recovery_coefficients(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(fixed.RECOVERY_COEFFICIENTS), "bankrupt string, product string, percent int"
    )


def with_recovery_coefficient(df: DataFrame, bankrupt: str, product: str, on_balance: Column) -> DataFrame:
    """Coefficient by (bankrupt flag, product); on the balance sheet a constant; none is 0."""
    table = recovery_coefficients(df.sparkSession).select(
        F.col("bankrupt").alias(bankrupt), F.col("product").alias(product), "percent"
    )
    percent = F.when(on_balance, F.lit(fixed.ON_BALANCE_COEFFICIENT)).otherwise(
        F.coalesce("percent", F.lit(0))
    )
    return (
        df.join(table, [bankrupt, product], "left")
        .withColumn("coefficient", (percent / F.lit(100)).cast("decimal(6,4)"))
        .drop("percent")
    )


def factor_weight(codes: Column) -> Column:
    """Sum of the weights of the given factor codes; unknown codes weigh nothing."""
    weights = F.create_map(*[F.lit(x) for pair in fixed.FACTOR_WEIGHTS for x in pair])
    return F.aggregate(
        codes,
        F.lit(0),
        lambda total, code: total + F.coalesce(F.try_element_at(weights, code), F.lit(0)),
    )


def off_balance_flag(status: Column, written_off: str) -> Column:
    return F.when(status == written_off, F.lit("1")).otherwise(F.lit("0"))


def debt_with_penalty(balances: DataFrame, loans: DataFrame, loan: str, penalty: str) -> DataFrame:
    """Balances on a date with the loan's penalty, zero where it is missing."""
    fines = loans.select(loan, F.coalesce(penalty, F.lit(0).cast("decimal(18,2)")).alias(penalty))
    return balances.join(fines, loan, "left")


def pledge_per_loan(pledges: DataFrame, loan: str, day: str, amount: str) -> DataFrame:
    """Sum of pledge values per loan and day."""
    return pledges.groupBy(loan, day).agg(F.sum(amount).alias("pledge"))


def _case(*rules: tuple[Column, Column]) -> Column:
    """The value of the first rule whose condition holds."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def _outcome(direct=None, indirect=None, potential=None) -> Column:
    def amount(c) -> Column:
        return (F.lit(None) if c is None else c).cast(LOSS)

    return F.struct(
        amount(direct).alias("direct"),
        amount(indirect).alias("indirect"),
        amount(potential).alias("potential"),
    )


def losses(cases: DataFrame, percent: bool = False) -> DataFrame:
    """Add ``direct``, ``indirect`` and ``potential`` loss.

    Expected columns: client, risk, deviation, credit_amount, debt_now, overdue_now,
    interest_now, interest_overdue_now, reserve_now, reserve_then, factor_codes,
    overstatement, withdrawn_share, withdrawn_amount, pledge_state, pledge.
    ``percent`` divides the factor weights and the withdrawn share by one hundred; they are
    whole percents multiplied as they are otherwise.
    """
    col = F.col
    scale = F.lit(100 if percent else 1)
    base = col("debt_now") + col("overdue_now")
    interest = col("interest_now") + col("interest_overdue_now")
    growth = col("reserve_now") - col("reserve_then")
    grew = growth > 0
    rvps, rvp = (base * col("reserve_now")).cast(LOSS), (interest * col("reserve_now")).cast(LOSS)
    debt_growth, interest_growth = (base * growth).cast(LOSS), (interest * growth).cast(LOSS)
    credit = col("credit_amount")

    def factor(text: str) -> Column:
        return F.lit(text).cast("decimal(4,2)")

    def scaled(multiplier: Column) -> Column:
        return _outcome(direct=rvps * multiplier, indirect=rvp * multiplier)

    def potential(c: Column) -> Column:
        return _outcome(potential=c)

    def risk_is(code: str) -> Column:
        return col("risk") == code

    def deviation_in(codes) -> Column:
        return col("deviation").isin(list(codes))

    nothing = _outcome()
    unsuitable = risk_is(fixed.RISK_UNSUITABLE_BORROWER)
    withdrawn = risk_is(fixed.RISK_FUNDS_WITHDRAWN)
    uncollectable = risk_is(fixed.RISK_CANNOT_COLLECT)
    pledge_lost = risk_is(fixed.RISK_PLEDGE) & (col("pledge_state") == fixed.PLEDGE_LOST)

    theft = (unsuitable & deviation_in(fixed.DEVIATION_FRAUD)) | col("risk").isin(
        fixed.RISK_THEFT_BY_OUTSIDERS, fixed.RISK_THEFT_BY_STAFF
    )
    person = F.when(grew & theft, scaled(F.lit(1))).otherwise(potential(credit))

    share_asked = F.coalesce(col("withdrawn_share"), F.lit(0))
    share = (share_asked / scale).cast("decimal(10,4)")
    amount_asked = F.coalesce(col("withdrawn_amount"), F.lit(0))
    within_pledge = debt_growth < col("pledge")
    small = _case(
        (grew & unsuitable & deviation_in(fixed.DEVIATION_SYSTEM_FAILURE),
         scaled(factor(fixed.SYSTEM_FAILURE_FACTOR))),
        (grew & unsuitable & deviation_in(fixed.DEVIATION_OUTSIDE_FRAUD),
         scaled(factor(fixed.OUTSIDE_FRAUD_FACTOR))),
        (~grew & unsuitable & deviation_in(fixed.DEVIATION_OTHER), potential(credit)),
        (~grew & unsuitable & deviation_in(fixed.DEVIATION_FALSE_PLEDGE_REPORT),
         potential(col("overstatement"))),
        (grew & withdrawn & (share_asked <= fixed.WITHDRAWN_SHARE_CAP), scaled(share)),
        (grew & withdrawn, scaled(factor(fixed.OUTSIDE_FRAUD_FACTOR))),
        (~grew & withdrawn, potential(F.least(amount_asked, base))),
        (grew & uncollectable, _outcome(direct=debt_growth, indirect=interest_growth)),
        (~grew & uncollectable, potential(credit)),
        (grew & pledge_lost & within_pledge,
         _outcome(direct=debt_growth, indirect=col("pledge") - debt_growth)),
        (pledge_lost, potential(col("pledge"))),
    ).otherwise(nothing)

    weight = (factor_weight(col("factor_codes")) / scale).cast("decimal(10,4)")
    weighted = F.when(grew, scaled(weight)).otherwise(potential(credit * weight))
    decision = factor(fixed.CORPORATE_DECISION_FACTOR)
    below_overstatement = debt_growth < col("overstatement")
    corporate = _case(
        (unsuitable & deviation_in(fixed.CORPORATE_DECISION_DEVIATIONS),
         F.when(grew, scaled(decision)).otherwise(potential(credit * decision))),
        (unsuitable & deviation_in(fixed.CORPORATE_FACTOR_DEVIATIONS), weighted),
        (unsuitable & deviation_in(fixed.DEVIATION_FALSE_PLEDGE_REPORT) & grew & below_overstatement,
         _outcome(direct=debt_growth, indirect=col("overstatement") - debt_growth)),
        (unsuitable & deviation_in(fixed.DEVIATION_FALSE_PLEDGE_REPORT), potential(col("overstatement"))),
        (withdrawn, weighted),
        (uncollectable & deviation_in(fixed.DEVIATION_DELIBERATE_BANKRUPTCY), weighted),
        (uncollectable & deviation_in(fixed.CORPORATE_COURT_DEVIATIONS),
         F.when(grew, _outcome(direct=debt_growth, indirect=interest_growth)).otherwise(potential(credit))),
        (pledge_lost & grew & within_pledge, _outcome(direct=debt_growth, indirect=col("pledge"))),
    ).otherwise(nothing)

    outcome = _case(
        (col("client") == fixed.CLIENT_PERSON, person),
        (col("client") == fixed.CLIENT_SMALL, small),
        (col("client") == fixed.CLIENT_CORPORATE, corporate),
    ).otherwise(nothing)
    return (
        cases.withColumn("outcome", outcome)
        .withColumns({name: F.col(f"outcome.{name}") for name in ("direct", "indirect", "potential")})
        .drop("outcome")
    )
