"""Offers of neighbouring orders compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.functions import finance
from clausemill.operators import compare, extraction
from clausemill.sources import store

from .cost import COSTED, LOANS, loans, round2_sql
from .extraction import LOAN_FACTS, TERMS_COST, parsed_loans
from .registry import query, table
from .text import _indian_sql

_KIND = "CASE WHEN o_orderkey % 5 = 4 THEN 'contract' ELSE 'loan' END"


def pairs(spark, d):
    """Every order with the next one; every ninth with itself, every eleventh with one that does not exist."""
    key = F.col("o_orderkey")
    right = F.when(key % 9 == 0, key).when(key % 11 == 0, -key - 1).otherwise(key + 1)
    return table(spark, d, "orders").select(key.alias("pair_id"), key.alias("left_id"), right.alias("right_id"))


PAIRS = "pairs AS (SELECT o_orderkey AS pair_id, o_orderkey AS left_id, CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey WHEN o_orderkey % 11 = 0 THEN -o_orderkey - 1 ELSE o_orderkey + 1 END AS right_id FROM orders)"


@query(
    "pair_validation_o1",
    "WITH " + PAIRS + f""", docs AS (SELECT o_orderkey AS doc_id, {_KIND} AS kind FROM orders)
    SELECT pair_id, left_id, right_id, CASE WHEN left_id = right_id THEN 'SAME_DOCUMENT' WHEN r.doc_id IS NULL THEN 'NOT_FOUND' WHEN l.kind <> 'loan' OR r.kind <> 'loan' THEN 'KIND_NOT_SUPPORTED' END AS reject
    FROM pairs JOIN docs l ON l.doc_id = left_id LEFT JOIN docs r ON r.doc_id = right_id""",
)
def pair_validation(spark, d):
    docs = table(spark, d, "orders").selectExpr("o_orderkey AS doc_id", f"{_KIND} AS kind")
    return compare.validate_pairs(pairs(spark, d), docs)


@query(
    "cheaper_offer_o2",
    "WITH RECURSIVE " + LOANS + COSTED + ", " + PAIRS + f""", rates AS (SELECT loan_id, {round2_sql('(pow(1 + monthly, 12) - 1) * 100')} AS ear FROM costed)
    SELECT pair_id, l.ear AS left_rate, r.ear AS right_rate, CASE WHEN l.ear < r.ear THEN 'left' WHEN l.ear > r.ear THEN 'right' ELSE 'unknown' END AS cheaper
    FROM pairs LEFT JOIN rates l ON l.loan_id = left_id LEFT JOIN rates r ON r.loan_id = right_id""",
)
def cheaper_offer(spark, d):
    costs = finance.with_loan_cost(loans(spark, d)).select(F.col("loan_id").alias("doc_id"), "effectiveAnnualRatePercent")
    verdicts = compare.compare_pairs(pairs(spark, d), costs)
    return verdicts.select("pair_id", "left_rate", "right_rate", "cheaper")


def _num(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) || '.0' ELSE CAST({x} AS VARCHAR) END"


def _fee(amount: str, pct: str, description: str) -> str:
    """A fee as JSON without its null members."""
    parts = f"concat_ws(',', CASE WHEN {amount} IS NOT NULL THEN '\"amount\":' || {_num(amount)} END, CASE WHEN {pct} IS NOT NULL THEN '\"percent\":' || {_num(pct)} END, {description})"
    return f"CASE WHEN {amount} IS NULL AND {pct} IS NULL THEN 'not stated' ELSE '{{' || {parts} || '}}' END"


_NULL = "CAST(NULL AS DOUBLE)"


@query(
    "offer_payload_o3",
    "WITH " + LOAN_FACTS + f""" SELECT doc_id, field, value FROM (SELECT doc_id, unnest(['lender', 'principal', 'tenureMonths', 'interestRate', 'statedEmi', 'processingFee', 'insurancePremium', 'otherUpfrontCharges', 'prepaymentCharges', 'latePaymentCharges', 'bounceCharges']) AS field,
      unnest([coalesce(lender, 'not stated'), coalesce(CAST(principal AS VARCHAR), 'not stated'), coalesce(CAST(tenure_months AS VARCHAR), 'not stated'),
        CASE WHEN annual_rate_percent IS NULL THEN 'not stated' ELSE '{{"annualPercent":' || {_num('annual_rate_percent')} || ',"type":"' || rate_type || '","method":"' || method || '"}}' END, 'not stated',
        {_fee(_NULL, 'fee_percent', "'\"description\":\"fee\"'")}, {_fee('insurance', _NULL, 'NULL')},
        CASE WHEN has_others THEN '[{{"amount":100.0,"description":"Stamp duty"}}, {{"percent":0.5}}]' ELSE '[]' END, {_fee(_NULL, 'prepay', 'NULL')}, {_fee(_NULL, 'late', "'\"description\":\"per month\"'")}, 'not stated']) AS value FROM facts)""",
)
def offer_payload(spark, d):
    return compare.describe_terms(parsed_loans(spark, d))


def _whole(x: str) -> str:
    return f"'₹' || regexp_replace({_indian_sql('round(' + x + ')')}, '\\.00$', '')"


def _money(x: str) -> str:
    return f"'₹' || {_indian_sql(x)}"


def _months(n: str) -> str:
    return f"""CAST({n} AS VARCHAR) || ' months (' || concat_ws(' ', CASE WHEN {n} // 12 > 1 THEN CAST({n} // 12 AS VARCHAR) || ' yrs' WHEN {n} // 12 = 1 THEN '1 yr' END, CASE WHEN {n} % 12 > 0 THEN CAST({n} % 12 AS VARCHAR) || ' mo' END) || ')'"""


SIDES = TERMS_COST + f""", side AS (SELECT f.doc_id, f.lender, f.tenure_months AS n, f.annual_rate_percent AS r, f.rate_type, f.method, f.principal, c.emi, c.monthly, c.upfront_fees AS fees, f.prepay, f.late, {round2_sql(round2_sql('c.emi * c.tenure_months') + ' - c.principal')} AS interest
    FROM facts f LEFT JOIN costed c USING (doc_id)),
  shown AS (SELECT doc_id, unnest(range(13)) AS i, unnest(['Lender', 'Loan amount', 'Interest rate', 'Tenure', 'EMI', 'Upfront fees', 'Total interest', 'Effective annual rate', 'APR', 'Prepayment charges', 'Late payment / penal', 'Bounce charges', 'Risk flags']) AS aspect, unnest([coalesce(lender, '—'),
      CASE WHEN principal IS NULL THEN '—' ELSE {_whole('principal')} END,
      CASE WHEN r IS NULL THEN 'Not stated' ELSE printf('%.2f', r) || '% ' || rate_type || ', ' || method END, CASE WHEN n IS NULL THEN '—' ELSE {_months('n')} END,
      CASE WHEN emi IS NULL THEN '—' ELSE {_money('emi')} END, CASE WHEN fees IS NULL THEN '—' ELSE {_whole('fees')} END, CASE WHEN interest IS NULL THEN '—' ELSE {_whole('interest')} END, CASE WHEN monthly IS NULL THEN '—' ELSE printf('%.2f', {round2_sql('(pow(1 + monthly, 12) - 1) * 100')}) || '%' END,
      CASE WHEN monthly IS NULL THEN '—' ELSE printf('%.2f', {round2_sql('monthly * 12 * 100')}) || '%' END, CASE WHEN prepay IS NULL THEN 'Not stated' ELSE '4%' END, CASE WHEN late IS NULL THEN 'Not stated' ELSE CAST(CAST(late AS INTEGER) AS VARCHAR) || '%' END, 'Not stated', 'Not assessed']) AS value FROM side)"""


@query(
    "comparison_table_o4",
    "WITH RECURSIVE " + LOAN_FACTS + SIDES + ", " + PAIRS + """ SELECT pair_id, l.aspect, l.value AS "left", r.value AS "right" FROM pairs JOIN shown l ON l.doc_id = left_id JOIN shown r ON r.doc_id = right_id AND r.i = l.i""",
)
def comparison_table(spark, d):
    costed = extraction.cost_from_terms(parsed_loans(spark, d)).withColumn("risks", F.lit(None).cast("string"))
    return compare.comparison_table(pairs(spark, d), costed).drop("row_no")


_NARRATIVE = """concat('{"summary":', CASE WHEN k % 6 = 0 THEN 'null' ELSE '"A is cheaper."' END, ',"differences":[{"aspect":"Rate","left":"1","right":"2","favours":"',
  CASE WHEN k % 4 = 0 THEN 'both' ELSE 'left' END, '","note":"n"}', CASE WHEN k % 2 = 0 THEN '' ELSE ',{"aspect":"Fee","left":"1","right":"2","favours":"neither","note":"n"}' END, ']}')"""


@query(
    "narratives_o5",
    """SELECT o_orderkey AS pair_id, CASE WHEN o_orderkey % 6 <> 0 AND o_orderkey % 4 <> 0 THEN 'A is cheaper.' END AS summary,
      CAST(CASE WHEN o_orderkey % 6 <> 0 AND o_orderkey % 4 <> 0 THEN 1 + o_orderkey % 2 END AS INTEGER) AS differences,
      CASE WHEN o_orderkey % 6 = 0 OR o_orderkey % 4 = 0 THEN 'LLM_BAD_RESPONSE' END AS error FROM orders""",
)
def narratives(spark, d):
    rows = store.spread(table(spark, d, "orders").selectExpr("o_orderkey AS k"), "k", store.UNFOLDED)
    parsed = compare.parse_narratives(rows.selectExpr("k AS pair_id", f"{_NARRATIVE} AS raw"))
    count = F.when(F.col("differences").isNotNull(), F.size("differences"))
    return parsed.select("pair_id", "summary", count.alias("differences"), "error")
