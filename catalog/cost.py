"""Loan arithmetic over orders taken as loans and line items taken as cash flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.functions import finance
from clausemill.functions import money as M
from clausemill.operators import cost

from .registry import query, table

LOAN_FIELDS = [
    "o_orderkey AS loan_id",
    "o_custkey",
    "o_totalprice AS principal",
    "CAST(CASE WHEN o_orderkey % 31 = 0 THEN 0 ELSE 6 + o_orderkey % 15 END AS DOUBLE) AS annual_rate_percent",
    "CAST(CASE WHEN o_orderkey % 53 = 0 THEN 0 ELSE 12 * (1 + o_orderkey % 20) END AS INT) AS tenure_months",
    "CASE WHEN o_orderkey % 4 = 0 THEN 'flat' ELSE 'reducing' END AS method",
    "CAST(CASE WHEN o_orderkey % 6 = 0 THEN 0.0 WHEN o_orderkey % 6 = 1 THEN 750.0 END AS DOUBLE) AS fee_amount",
    "CAST(CASE WHEN o_orderkey % 6 < 5 THEN o_orderkey % 3 END AS DOUBLE) AS fee_percent",
    "CAST(CASE WHEN o_orderkey % 10 = 0 THEN floor(o_totalprice / (12 * (1 + o_orderkey % 20)) * 120) / 100 END AS DOUBLE) AS stated_emi",
]


def loans(spark, d):
    rows = table(spark, d, "orders").selectExpr(*LOAN_FIELDS)
    fees = finance.fee_amount(F.col("principal"), F.col("fee_amount"), F.col("fee_percent"))
    return rows.withColumn("upfront_fees", fees)


def round2_sql(x: str) -> str:
    return f"(floor((({x}) + 2.220446049250313e-16) * 100.0 + 0.5) / 100.0)"


FEE_SQL = f"coalesce(fee_amount, {round2_sql('principal * fee_percent / 100')}, 0.0)"
LOANS = (
    "loans0 AS (SELECT " + ", ".join(LOAN_FIELDS) + f" FROM orders), loans AS (SELECT *, CAST({FEE_SQL} AS DOUBLE) AS upfront_fees FROM loans0)"
)
REDUCING = "(CASE WHEN annual_rate_percent = 0 THEN principal / tenure_months ELSE principal * (annual_rate_percent / 12 / 100) * pow(1 + annual_rate_percent / 12 / 100, tenure_months) / (pow(1 + annual_rate_percent / 12 / 100, tenure_months) - 1) END)"
FLAT = "((principal + principal * annual_rate_percent * tenure_months / 1200) / tenure_months)"
COSTED = f""", checked AS (SELECT *, CASE WHEN principal <= 0 THEN '{finance.ERR_PRINCIPAL}' WHEN tenure_months <= 0 THEN '{finance.ERR_TENURE}'
      WHEN annual_rate_percent < 0 THEN '{finance.ERR_RATE}' WHEN upfront_fees < 0 OR upfront_fees >= principal THEN '{finance.ERR_FEES}' END AS error FROM loans),
  emis AS (SELECT *, {round2_sql(f"CASE WHEN stated_emi > 0 THEN stated_emi WHEN method = 'flat' THEN {FLAT} ELSE {REDUCING} END")} AS emi, {round2_sql('principal - upfront_fees')} AS net FROM checked WHERE error IS NULL),
  bis AS (SELECT loan_id, net, emi, tenure_months AS n, CAST(-0.99 AS DOUBLE) AS lo, CAST(10 AS DOUBLE) AS hi, 0 AS it FROM emis
    UNION ALL SELECT loan_id, net, emi, n, CASE WHEN f < 0 THEN mid ELSE lo END, CASE WHEN f < 0 THEN hi ELSE mid END, it + 1 FROM (
      SELECT *, net - emi * CASE WHEN abs(mid) < 1e-9 THEN n ELSE (1 - pow(1 + mid, -n)) / mid END AS f FROM (SELECT *, (lo + hi) / 2 AS mid FROM bis WHERE it < 62))),
  costed AS (SELECT e.*, (lo + hi) / 2 AS monthly FROM emis e JOIN bis USING (loan_id) WHERE it = 62)"""


@query(
    "emi_reducing_f1",
    "WITH " + LOANS + f" SELECT loan_id, CASE WHEN tenure_months > 0 THEN round({REDUCING}, 4) END AS emi FROM loans",
)
def emi_reducing(spark, d):
    value = finance.emi_reducing(F.col("principal"), F.col("annual_rate_percent"), F.col("tenure_months"))
    return loans(spark, d).select("loan_id", F.round(value, 4).alias("emi"))


@query(
    "emi_flat_f2",
    "WITH " + LOANS + f" SELECT loan_id, CASE WHEN tenure_months > 0 THEN {round2_sql(FLAT)} END AS emi FROM loans",
)
def emi_flat(spark, d):
    value = finance.emi_flat(F.col("principal"), F.col("annual_rate_percent"), F.col("tenure_months"))
    return loans(spark, d).select("loan_id", M.round2(value).alias("emi"))


_EMI = "floor(principal / 24 * 100) / 100"


@query(
    "total_cost_f3",
    "WITH " + LOANS + f""" SELECT loan_id, {round2_sql(f'{_EMI} * 30')} AS "totalRepayment", {round2_sql(round2_sql(f'{_EMI} * 30') + ' - principal')} AS "totalInterest",
      {round2_sql('upfront_fees')} AS "upfrontFees", {round2_sql(round2_sql(round2_sql(f'{_EMI} * 30') + ' - principal') + ' + upfront_fees')} AS "totalCostOfCredit" FROM loans""",
)
def total_cost(spark, d):
    emi = F.floor(F.col("principal") / 24 * 100) / 100
    values = cost.total_cost(F.col("principal"), emi, F.lit(30), F.col("upfront_fees"))
    return loans(spark, d).select("loan_id", *[v.alias(k) for k, v in values.items()])


@query(
    "rounding_f4",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    + round2_sql("(l_extendedprice * l_discount - 1000) / 8") + " AS rounded FROM lineitem",
)
def rounding(spark, d):
    value = M.round2((F.col("l_extendedprice") * F.col("l_discount") - 1000) / 8)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", value.alias("rounded"))


def flows(spark, d):
    """A purchase at 80 % of its line items' value at t = 0, the items coming back one period each."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("loan_id"), "l_linenumber", "l_extendedprice")
    both = F.array(
        F.struct(F.lit(0).alias("t"), (F.col("l_extendedprice") * -0.8).alias("amount")),
        F.struct(F.col("l_linenumber").alias("t"), F.col("l_extendedprice").alias("amount")),
    )
    rows = items.select("loan_id", F.explode(both).alias("f")).select("loan_id", "f.t", "f.amount")
    return rows.filter((F.col("t") > 0) | (F.col("loan_id") % 13 != 0))


FLOWS = """flows AS (SELECT l_orderkey AS loan_id, 0 AS t, l_extendedprice * -0.8 AS amount FROM lineitem WHERE l_orderkey % 13 <> 0
  UNION ALL SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem)"""


@query(
    "net_present_value_f5",
    "WITH " + FLOWS + " SELECT loan_id, round(sum(amount / pow(1.015, t)), 4) AS npv FROM flows GROUP BY loan_id",
)
def net_present_value(spark, d):
    return cost.npv_of_flows(flows(spark, d), F.lit(0.015)).withColumn("npv", F.round("npv", 4))


@query(
    "rate_of_return_f6",
    "WITH RECURSIVE " + FLOWS + f""", per AS (SELECT loan_id, t, sum(amount) AS a FROM flows GROUP BY ALL),
    arr AS (SELECT loan_id, list(a ORDER BY t) AS a, list(t ORDER BY t) AS t, min(a) AS lowest, max(t) AS last FROM per GROUP BY loan_id),
    bis AS (SELECT loan_id, a, t, CAST(-0.99 AS DOUBLE) AS lo, CAST(10 AS DOUBLE) AS hi, 0 AS it FROM arr WHERE lowest < 0
      UNION ALL SELECT loan_id, a, t, CASE WHEN f > 0 THEN mid ELSE lo END, CASE WHEN f > 0 THEN hi ELSE mid END, it + 1 FROM (
        SELECT *, list_sum(list_transform(a, lambda x, i: x / pow(1 + mid, t[i]))) AS f FROM (SELECT *, (lo + hi) / 2 AS mid FROM bis WHERE it < 60)))
    SELECT loan_id, round((lo + hi) / 2, 6) AS rate, CAST(NULL AS VARCHAR) AS error FROM bis WHERE it = 60
    UNION ALL SELECT loan_id, NULL, '{finance.ERR_ONE_SIDED}' FROM arr WHERE lowest >= 0""",
)
def rate_of_return(spark, d):
    return cost.irr_of_flows(flows(spark, d)).withColumn("rate", F.round("rate", 6))


@query(
    "loan_cost_f7",
    "WITH RECURSIVE " + LOANS + COSTED + f""" SELECT l.loan_id, emi, CASE WHEN c.loan_id IS NOT NULL THEN c.tenure_months END AS "tenureMonths",
      {round2_sql('emi * c.tenure_months')} AS "totalRepayment", {round2_sql(round2_sql('emi * c.tenure_months') + ' - c.principal')} AS "totalInterest",
      {round2_sql('c.upfront_fees')} AS "upfrontFees", net AS "netDisbursal",
      {round2_sql(round2_sql(round2_sql('emi * c.tenure_months') + ' - c.principal') + ' + c.upfront_fees')} AS "totalCostOfCredit",
      {round2_sql('(pow(1 + monthly, 12) - 1) * 100')} AS "effectiveAnnualRatePercent", {round2_sql('monthly * 12 * 100')} AS "aprPercent", l.error AS cost_error
      FROM checked l LEFT JOIN costed c USING (loan_id)""",
)
def loan_cost(spark, d):
    return finance.with_loan_cost(loans(spark, d)).select("loan_id", *finance.COST_FIELDS, "cost_error")


@query(
    "sum_amounts_f8",
    "SELECT o_custkey, " + round2_sql("sum(o_totalprice)") + " AS total FROM orders GROUP BY o_custkey",
)
def sum_amounts(spark, d):
    return cost.sum_amounts(table(spark, d, "orders"), "o_custkey", "o_totalprice")


@query("percent_of_f9", "SELECT o_orderkey, " + round2_sql("(o_orderkey % 40 / 4.0) / 100 * o_totalprice") + " AS result FROM orders")
def percent_of(spark, d):
    value = cost.percent_of(F.col("o_orderkey") % 40 / 4, F.col("o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", value.alias("result"))


@query("fee_amounts_f10", "WITH " + LOANS + " SELECT loan_id, upfront_fees AS fee FROM loans")
def fee_amounts(spark, d):
    return loans(spark, d).select("loan_id", F.col("upfront_fees").alias("fee"))
