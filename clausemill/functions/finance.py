"""Loan arithmetic as column expressions: instalments, present value, internal rate of return, cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import round2
from .plan import settle

RATE_FLOOR, RATE_CEILING, TOLERANCE = -0.99, 10.0, 1e-10
NEWTON_STEPS, BISECT_STEPS = 24, 70

# fixed values: messages a caller sees
ERR_POSITIVE = "principal and tenure must be positive"
ERR_PRINCIPAL = "principal must be positive"
ERR_TENURE = "tenure must be a positive whole number of months"
ERR_RATE = "interest rate cannot be negative"
ERR_FEES = "upfront fees must be non-negative and smaller than the principal"
ERR_FEW_FLOWS = "at least two cash flows are required"
ERR_ONE_SIDED = "cash flows must contain both inflows and outflows"
ERR_NO_ROOT = "no IRR in the search interval"


def emi_reducing(principal: Column, annual_percent: Column, months: Column) -> Column:
    """Instalment on the outstanding balance; null for non-positive principal or tenure."""
    r = annual_percent / 12 / 100
    growth = F.pow(1 + r, months)
    value = F.when(r == 0, principal / months).otherwise(principal * r * growth / (growth - 1))
    return F.when((principal > 0) & (months > 0), value)


def emi_flat(principal: Column, annual_percent: Column, months: Column) -> Column:
    interest = principal * annual_percent * months / (12 * 100)
    return F.when((principal > 0) & (months > 0), (principal + interest) / months)


def _let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``; a plain reuse would be evaluated at every mention."""
    return F.get(F.transform(F.array(value), use), 0)


def _over(flow: Column, discount: Column) -> Column:
    # far below zero the discount underflows; the quotient is then infinite, not an error
    return F.when(discount == 0, flow * F.lit(float("inf"))).otherwise(flow / discount)


def npv(rate: Column, flows: Column) -> Column:
    """Net present value of an array of flows, the first at t = 0."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(1.0).alias("discount"))
    return F.aggregate(
        flows,
        start,
        lambda s, cf: F.struct(
            (s.total + _over(cf, s.discount)).alias("total"), (s.discount * (1 + rate)).alias("discount")
        ),
        lambda s: s.total,
    )


def _npv_and_slope(rate: Column, flows: Column) -> Column:
    start = F.struct(
        F.lit(0.0).alias("f"), F.lit(0.0).alias("d"), F.lit(1.0).alias("discount"), F.lit(0.0).alias("t")
    )
    return F.aggregate(
        flows,
        start,
        lambda s, cf: F.struct(
            (s.f + _over(cf, s.discount)).alias("f"),
            (s.d - _over(s.t * cf, s.discount * (1 + rate))).alias("d"),
            (s.discount * (1 + rate)).alias("discount"),
            (s.t + 1).alias("t"),
        ),
    )


def _newton(value_and_slope, start_rate: float = 0.01) -> Column:
    """Root search by tangents; ``done`` is 1 on success, 2 when the search left the bracket."""

    def state(rate: Column, done: Column) -> Column:
        return F.struct(rate.alias("rate"), done.alias("done"))

    def advance(rate: Column, following: Column) -> Column:
        lost = following.isNull() | F.isnan(following) | (following <= RATE_FLOOR) | (following > RATE_CEILING)
        close = F.abs(following - rate) < TOLERANCE
        return F.when(lost, state(rate, F.lit(2))).otherwise(state(following, F.when(close, 1).otherwise(0)))

    def step(s: Column, _i: Column) -> Column:
        moved = _let(
            value_and_slope(s.rate),
            lambda fd: F.when(F.abs(fd.f) < TOLERANCE, state(s.rate, F.lit(1))).otherwise(
                _let(s.rate - F.try_divide(fd.f, fd.d), lambda following: advance(s.rate, following))
            ),
        )
        return F.when(s.done > 0, s).otherwise(moved)

    start = state(F.lit(start_rate), F.lit(0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, step)


def _bisect(value) -> Column:
    """Halve the bracket on the sign change; null when both ends have the same sign."""

    def step(s: Column, _i: Column) -> Column:
        mid = (s.lo + s.hi) / 2
        same = F.signum(value(mid)) == s.sign
        return F.struct(
            F.when(same, mid).otherwise(s.lo).alias("lo"),
            F.when(same, s.hi).otherwise(mid).alias("hi"),
            s.sign.alias("sign"),
        )

    low_sign = F.signum(value(F.lit(RATE_FLOOR)))
    start = F.struct(F.lit(RATE_FLOOR).alias("lo"), F.lit(RATE_CEILING).alias("hi"), low_sign.alias("sign"))
    root = F.aggregate(
        F.sequence(F.lit(1), F.lit(BISECT_STEPS)), start, step, lambda s: (s.lo + s.hi) / 2
    )
    return F.when(low_sign != F.signum(value(F.lit(RATE_CEILING))), root)


def _solve(newton: Column, bisect: Column) -> Column:
    # the bisection is an untaken branch for every row the tangents solved
    return _let(newton, lambda s: F.when(s.done == 1, s.rate).otherwise(bisect))


def irr(flows: Column) -> Column:
    """``struct(rate, error)`` of irregular flows; the error names what is wrong with them."""
    rate = _solve(_newton(lambda r: _npv_and_slope(r, flows)), _bisect(lambda r: npv(r, flows)))
    two_sided = F.exists(flows, lambda c: c > 0) & F.exists(flows, lambda c: c < 0)
    valid = (F.size(flows) >= 2) & two_sided
    rate = F.when(valid, rate)
    error = (
        F.when(F.size(flows) < 2, ERR_FEW_FLOWS)
        .when(~two_sided, ERR_ONE_SIDED)
        .when(rate.isNull(), ERR_NO_ROOT)
    )
    return F.struct(rate.alias("rate"), error.alias("error"))


def _annuity(r: Column, n: Column) -> Column:
    """Present value of n payments of 1; the series limit n stands in at a zero rate."""
    return F.when(F.abs(r) < 1e-12, n.cast("double")).otherwise(-F.expm1(-n * F.log1p(r)) / r)


def irr_level(net: Column, emi: Column, n: Column) -> Column:
    """Monthly rate at which n payments of ``emi`` repay ``net``; null without a root."""

    def value(r: Column) -> Column:
        return net - emi * _annuity(r, n)

    def value_and_slope(r: Column) -> Column:
        # d/dr of (1 - v) / r with v = (1+r)^-n, and its limit at r = 0
        def pair(v: Column) -> Column:
            flat = -n * (n + 1) / 2.0
            slope = F.when(F.abs(r) < 1e-7, flat).otherwise((n * v * r / (1 + r) - (1 - v)) / (r * r))
            return F.struct(value(r).alias("f"), (-emi * slope).alias("d"))

        return _let(F.exp(-n * F.log1p(r)), pair)

    return F.when((net > 0) & (emi > 0), _solve(_newton(value_and_slope), _bisect(value)))


def fee_amount(principal: Column, amount: Column, pct: Column) -> Column:
    """The stated amount (even zero), else the percentage of the principal, else zero."""
    return F.coalesce(amount, round2(principal * pct / 100), F.lit(0.0))


COST_FIELDS = (
    "emi", "tenureMonths", "totalRepayment", "totalInterest", "upfrontFees", "netDisbursal",
    "totalCostOfCredit", "effectiveAnnualRatePercent", "aprPercent",
)


def cost_error(principal, rate, months, fees) -> Column:
    return (
        F.when(principal <= 0, ERR_PRINCIPAL)
        .when((months <= 0) | (months != F.floor(months)), ERR_TENURE)
        .when(rate < 0, ERR_RATE)
        .when((fees < 0) | (fees >= principal), ERR_FEES)
    )


def with_loan_cost(
    df,
    principal: str = "principal",
    rate: str = "annual_rate_percent",
    months: str = "tenure_months",
    method: str = "method",
    fees: str = "upfront_fees",
    stated_emi: str = "stated_emi",
    when: Column | None = None,
):
    """Add the nine cost columns and ``cost_error`` to a loan table, one projection after another."""
    p, r, n, fee = F.col(principal), F.col(rate), F.col(months), F.col(fees)
    wanted = F.lit(True) if when is None else when
    df = df.withColumn("_invalid", F.when(wanted, cost_error(p, r, n, fee)))
    usable = wanted & F.col("_invalid").isNull()
    formula = F.when(F.col(method) == "flat", emi_flat(p, r, n)).otherwise(emi_reducing(p, r, n))
    stated = F.when(F.col(stated_emi) > 0, F.col(stated_emi))
    df = df.withColumn("_emi", F.when(usable, round2(F.coalesce(stated, formula))))
    df = df.withColumn("_repay", round2(F.col("_emi") * n)).withColumn("_net", F.when(usable, round2(p - fee)))
    df = df.withColumn("_interest", round2(F.col("_repay") - p))
    df = df.withColumn("_monthly", irr_level(F.col("_net"), F.col("_emi"), n))
    solved = usable & F.col("_monthly").isNotNull()
    monthly = F.col("_monthly")
    values = {
        "emi": F.col("_emi"),
        "tenureMonths": n.cast("int"),
        "totalRepayment": F.col("_repay"),
        "totalInterest": F.col("_interest"),
        "upfrontFees": round2(fee),
        "netDisbursal": F.col("_net"),
        "totalCostOfCredit": round2(F.col("_interest") + fee),
        "effectiveAnnualRatePercent": round2((F.pow(1 + monthly, F.lit(12)) - 1) * 100),
        "aprPercent": round2(monthly * 12 * 100),
    }
    # a zero instalment has no outflow; a positive one without a root is out of the search interval
    no_rate = F.when(F.col("_emi") > 0, ERR_NO_ROOT).otherwise(ERR_ONE_SIDED)
    error = F.coalesce(F.col("_invalid"), F.when(usable & monthly.isNull(), no_rate))
    df = df.select(
        "*", *[F.when(solved, v).alias(k) for k, v in values.items()], error.alias("cost_error")
    )
    return settle(df.drop("_invalid", "_emi", "_repay", "_net", "_interest", "_monthly"), [*values, "cost_error"])
