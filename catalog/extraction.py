"""Model responses written from orders and customers, some of them malformed by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.operators import extraction
from clausemill.sources import store

from .cost import FLAT, REDUCING, round2_sql
from .registry import query, table

# one loan response per order; the rules name the malformed ones
LOAN_JSON = """CASE WHEN k % 19 = 0 THEN 'garbage' WHEN k % 23 = 0 THEN 'null' ELSE concat(
 '{"lenderName":{"value":"Lender ', CAST(k % 7 AS STRING), '","ref":', CAST(k % 6 AS STRING), ',"confidence":0.9}',
 ',"principalAmount":{"value":', CASE WHEN k % 5 = 0 THEN '"five lakh"' ELSE CAST(price AS STRING) END, ',"ref":2,"confidence":1}',
 ',"interestRate":', CASE WHEN k % 7 = 0 THEN '"fourteen"' ELSE concat('{"annualPercent":', CAST(6 + k % 15 AS STRING), ',"rateType":"',
   CASE WHEN k % 2 = 0 THEN 'fixed' ELSE 'floating' END, '","method":"', CASE WHEN k % 4 = 0 THEN 'flat' ELSE 'reducing' END, '","benchmark":null,"ref":3,"confidence":0.8}') END,
 ',"tenureMonths":{"value":', CASE WHEN k % 13 = 0 THEN '36.5' WHEN k % 11 = 0 THEN 'null' ELSE CAST(12 * (1 + k % 20) AS STRING) END, ',"ref":3,"confidence":1}',
 ',"statedEmi":{"value":null,"ref":null,"confidence":0}',
 ',"processingFee":{"amount":null,"percent":', CAST(k % 3 AS STRING), ',"description":"fee","ref":2,"confidence":1}',
 ',"insurancePremium":{"amount":', CASE WHEN k % 2 = 0 THEN '500' ELSE 'null' END, ',"percent":null,"description":null,"ref":4,"confidence":0.5}',
 ',"otherUpfrontCharges":', CASE WHEN k % 17 = 0 THEN '"none"' ELSE '[{"amount":100,"percent":null,"description":"Stamp duty","ref":1,"confidence":1},{"amount":null,"percent":0.5,"description":null,"ref":9,"confidence":1}]' END,
 ',"prepaymentCharges":{"amount":null,"percent":4,"description":null,"ref":3,"confidence":1}',
 ',"latePaymentCharges":{"amount":null,"percent":', CASE WHEN k % 29 = 0 THEN '140' ELSE '2' END, ',"description":"per month","ref":3,"confidence":1}',
 CASE WHEN k % 3 = 0 THEN '' ELSE ',"bounceCharges":{"amount":null,"percent":null,"description":null,"ref":null,"confidence":0}' END, '}') END"""


def loan_responses(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS k", "CAST(o_totalprice AS DECIMAL(18, 2)) AS price")
    return store.spread(rows, "k", store.UNFOLDED).selectExpr("k AS doc_id", f"{LOAN_JSON} AS raw")


def parsed_loans(spark, d):
    return extraction.parse_output(loan_responses(spark, d), extraction.LOAN)


# the same responses as typed columns: what validation and salvage must leave
LOAN_FACTS = """facts AS (SELECT o_orderkey AS doc_id, k19 OR k23 AS lost,
    CASE WHEN NOT (k19 OR k23) THEN 'Lender ' || CAST(k % 7 AS VARCHAR) END AS lender, k % 6 AS lender_ref,
    CASE WHEN NOT (k19 OR k23) AND k % 5 <> 0 THEN o_totalprice END AS principal,
    CASE WHEN NOT (k19 OR k23) AND k % 7 <> 0 THEN CAST(6 + k % 15 AS DOUBLE) END AS annual_rate_percent,
    CASE WHEN k19 OR k23 OR k % 7 = 0 THEN 'unknown' WHEN k % 4 = 0 THEN 'flat' ELSE 'reducing' END AS method,
    CASE WHEN k19 OR k23 OR k % 7 = 0 THEN 'unknown' WHEN k % 2 = 0 THEN 'fixed' ELSE 'floating' END AS rate_type,
    CASE WHEN NOT (k19 OR k23) AND k % 13 <> 0 AND k % 11 <> 0 THEN CAST(12 * (1 + k % 20) AS INTEGER) END AS tenure_months,
    CASE WHEN NOT (k19 OR k23) THEN CAST(k % 3 AS DOUBLE) END AS fee_percent,
    CASE WHEN NOT (k19 OR k23) AND k % 2 = 0 THEN CAST(500 AS DOUBLE) END AS insurance,
    NOT (k19 OR k23) AND k % 17 <> 0 AS has_others,
    CASE WHEN NOT (k19 OR k23) THEN CAST(4 AS DOUBLE) END AS prepay,
    CASE WHEN NOT (k19 OR k23) THEN CASE WHEN k % 29 = 0 THEN CAST(140 AS DOUBLE) ELSE 2 END END AS late,
    CASE WHEN k19 THEN ': Invalid input: expected object, received undefined' WHEN k23 THEN ': Invalid input: expected object, received null'
      ELSE concat_ws('; ', CASE WHEN k % 5 = 0 THEN 'principalAmount.value: Invalid input: expected number, received string' END,
        CASE WHEN k % 7 = 0 THEN 'interestRate: Invalid input: expected object, received string' END,
        CASE WHEN k % 13 = 0 THEN 'tenureMonths.value: Invalid input: expected int, received number' END,
        CASE WHEN k % 17 = 0 THEN 'otherUpfrontCharges: Invalid input: expected array, received string' END,
        CASE WHEN k % 3 = 0 THEN 'bounceCharges: Invalid input: expected object, received undefined' END) END AS issues
  FROM (SELECT *, o_orderkey AS k, o_orderkey % 19 = 0 AS k19, o_orderkey % 23 = 0 AND o_orderkey % 19 <> 0 AS k23 FROM orders))"""


@query("strict_parse_x1", "WITH " + LOAN_FACTS + " SELECT doc_id, issues = '' AS valid, issues FROM facts")
def strict_parse(spark, d):
    return parsed_loans(spark, d).select("doc_id", "valid", F.array_join("issues", "; ").alias("issues"))


@query(
    "retry_requests_x2",
    "WITH " + LOAN_FACTS + " SELECT doc_id, 'That JSON failed validation: ' || issues || '. Return the corrected JSON only.' AS message FROM facts WHERE issues <> ''",
)
def retry_requests(spark, d):
    return extraction.retry_requests(parsed_loans(spark, d)).select("doc_id", "message")


@query(
    "salvaged_fields_x3",
    "WITH " + LOAN_FACTS + """ SELECT doc_id, lender, principal, annual_rate_percent, rate_type, method, tenure_months, fee_percent, insurance,
      CAST(CASE WHEN has_others THEN 2 ELSE 0 END AS INTEGER) AS others, prepay, late FROM facts""",
)
def salvaged_fields(spark, d):
    return parsed_loans(spark, d).select(
        "doc_id", F.col("lenderName.value").alias("lender"), F.col("principalAmount.value").alias("principal"),
        F.col("interestRate.annualPercent").alias("annual_rate_percent"), F.col("interestRate.rateType").alias("rate_type"),
        F.col("interestRate.method").alias("method"), F.col("tenureMonths.value").alias("tenure_months"),
        F.col("processingFee.percent").alias("fee_percent"), F.col("insurancePremium.amount").alias("insurance"),
        F.size("otherUpfrontCharges").alias("others"), F.col("prepaymentCharges.percent").alias("prepay"),
        F.col("latePaymentCharges.percent").alias("late"),
    )


def passages(spark, d, name="orders", key="o_orderkey", n=4):
    """``n`` passages per key, each on its own page."""
    rows = table(spark, d, name).select(F.col(key).alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rank"))
    text = F.concat(
        F.lit("CLAUSE "), F.col("rank").cast("string"), F.lit("\nThe text of document "), F.col("doc_id").cast("string"),
        F.lit(" stands here; it is No. 4. More follows."),
    )
    return rows.select(
        "doc_id", "rank", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("rank").cast("string")).alias("chunk_id"),
        F.col("rank").alias("page_start"), F.col("rank").alias("page_end"),
        F.concat(F.lit("CLAUSE "), F.col("rank").cast("string")).alias("clause_title"), text.alias("content"),
    )


_CITE = """CASE WHEN present AND ref BETWEEN 1 AND 4 THEN CAST(doc_id AS VARCHAR) || ':' || CAST(ref AS VARCHAR) END AS chunk_id,
  CASE WHEN present AND ref BETWEEN 1 AND 4 THEN CAST(ref AS INTEGER) END AS page,
  CASE WHEN present AND ref BETWEEN 1 AND 4 THEN 'The text of document ' || CAST(doc_id AS VARCHAR) || ' stands here; it is No. 4.' END AS quote"""


@query(
    "loan_evidence_x4",
    "WITH " + LOAN_FACTS + f""", ev AS (
      SELECT doc_id, 'lenderName' AS field, 0 AS item, lender IS NOT NULL AS present, lender_ref AS ref, 0.9 AS confidence FROM facts
      UNION ALL SELECT doc_id, 'principalAmount', 0, principal IS NOT NULL, 2, 1 FROM facts
      UNION ALL SELECT doc_id, 'interestRate', 0, annual_rate_percent IS NOT NULL, 3, 0.8 FROM facts
      UNION ALL SELECT doc_id, 'tenureMonths', 0, tenure_months IS NOT NULL, 3, 1 FROM facts
      UNION ALL SELECT doc_id, 'statedEmi', 0, false, NULL, 0 FROM facts
      UNION ALL SELECT doc_id, 'processingFee', 0, fee_percent IS NOT NULL, 2, 1 FROM facts
      UNION ALL SELECT doc_id, 'insurancePremium', 0, insurance IS NOT NULL, 4, 0.5 FROM facts
      UNION ALL SELECT doc_id, 'prepaymentCharges', 0, prepay IS NOT NULL, 3, 1 FROM facts
      UNION ALL SELECT doc_id, 'latePaymentCharges', 0, late IS NOT NULL, 3, 1 FROM facts
      UNION ALL SELECT doc_id, 'bounceCharges', 0, false, NULL, 0 FROM facts
      UNION ALL SELECT doc_id, 'otherUpfrontCharges', 0, true, 1, 1 FROM facts WHERE has_others
      UNION ALL SELECT doc_id, 'otherUpfrontCharges', 1, true, 9, 1 FROM facts WHERE has_others)
    SELECT doc_id, field, CAST(item AS INTEGER) AS item, CAST(CASE WHEN present THEN confidence ELSE 0 END AS DOUBLE) AS confidence, NOT present AS not_found, {_CITE} FROM ev""",
)
def loan_evidence(spark, d):
    rows = extraction.evidence_rows(parsed_loans(spark, d), extraction.LOAN)
    return extraction.resolve_evidence(rows, passages(spark, d)).drop("page_end", "clause_title")


@query("terms_out_of_range_x4", "WITH " + LOAN_FACTS + " SELECT doc_id, 'TERMS_OUT_OF_RANGE' AS reject FROM facts WHERE late > 100")
def terms_out_of_range(spark, d):
    """Values that parse but lie outside the final ranges become coded rows."""
    return extraction.range_reject(parsed_loans(spark, d)).filter("reject IS NOT NULL").select("doc_id", "reject")


def _fact_json(name: str, value: str, ref: str) -> str:
    return f"""',"{name}":{{"value":', {value}, ',"ref":', {ref}, ',"confidence":0.7}}'"""


CONTRACT_JSON = (
    """concat('{"documentType":{"value":"', segment, ' agreement","ref":1,"confidence":1}',
 ',"parties":{"value":', CASE WHEN k % 4 = 0 THEN '[]' WHEN k % 9 = 0 THEN '["A", 5]' ELSE concat('["Party ', CAST(k AS STRING), '","Deshpande"]') END, ',"ref":1,"confidence":1}', """
    + ", ".join(
        [
            _fact_json("effectiveDate", "'\"1 August 2026\"'", "'2'"),
            _fact_json("term", "CASE WHEN k % 5 = 0 THEN 'null' ELSE '\"24 months\"' END", "'2'"),
            _fact_json("paymentObligations", "'\"Rs. 38,000 a month\"'", "'7'"),
            _fact_json("securityDeposit", "CASE WHEN k % 3 = 0 THEN '228000' ELSE '\"Rs. 2,28,000\"' END", "'3'"),
            _fact_json("noticePeriod", "concat('\"', CAST(30 * (1 + k % 2) AS STRING), ' days\"')", "'3'"),
            _fact_json("terminationConditions", "'null'", "'null'"),
            _fact_json("renewal", "'\"renews with 10% more\"'", "'4'"),
            _fact_json("governingLaw", "CASE WHEN k % 2 = 0 THEN '\"Arbitration in Pune\"' ELSE '\"courts of Pune\"' END", "'4'"),
        ]
    )
    + ", '}')"
)


def parsed_contracts(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey AS k", "c_mktsegment AS segment")
    responses = store.spread(rows, "k", store.UNFOLDED).selectExpr("k AS doc_id", f"{CONTRACT_JSON} AS raw")
    return extraction.parse_output(responses, extraction.CONTRACT)


CONTRACT_FACTS = """cf AS (SELECT c_custkey AS doc_id, field, value, ref FROM (SELECT c_custkey, c_custkey AS k, c_mktsegment AS segment FROM customer) c, LATERAL (VALUES
    ('documentType', segment || ' agreement', 1), ('parties', CASE WHEN k % 4 <> 0 AND k % 9 <> 0 THEN 'Party ' || CAST(k AS VARCHAR) || ' Deshpande' END, 1),
    ('effectiveDate', '1 August 2026', 2), ('term', CASE WHEN k % 5 <> 0 THEN '24 months' END, 2), ('paymentObligations', 'Rs. 38,000 a month', 7),
    ('securityDeposit', CASE WHEN k % 3 <> 0 THEN 'Rs. 2,28,000' END, 3), ('noticePeriod', CAST(30 * (1 + k % 2) AS VARCHAR) || ' days', 3), ('terminationConditions', NULL, NULL),
    ('renewal', 'renews with 10% more', 4), ('governingLaw', CASE WHEN k % 2 = 0 THEN 'Arbitration in Pune' ELSE 'courts of Pune' END, 4)) v(field, value, ref))"""


@query(
    "contract_facts_x5",
    "WITH " + CONTRACT_FACTS + f""", ev AS (SELECT *, value IS NOT NULL AS present FROM cf)
    SELECT doc_id, field, CAST(CASE WHEN NOT present THEN 0 WHEN field IN ('documentType', 'parties') THEN 1 ELSE 0.7 END AS DOUBLE) AS confidence, NOT present AS not_found, {_CITE} FROM ev""",
)
def contract_facts(spark, d):
    rows = extraction.evidence_rows(parsed_contracts(spark, d), extraction.CONTRACT)
    found = extraction.resolve_evidence(rows, passages(spark, d, "customer", "c_custkey"))
    return found.drop("page_end", "clause_title", "item")


OUTLINE_JSON = """concat('{"title":"', name, '","summary":', CASE WHEN k % 8 = 0 THEN '5' ELSE '"About parts."' END, ',"sections":[',
  array_join(transform(sequence(1, CAST(1 + k % 23 AS INT)), i -> concat('{"heading":"H', CAST(i AS STRING), '","gist":"g","ref":', CASE WHEN i % 6 = 0 THEN 'null' ELSE CAST(i AS STRING) END, '}')), ','), ']}')"""


@query(
    "outlines_x6",
    """WITH o AS (SELECT p_partkey AS doc_id, p_name, p_partkey % 8 = 0 OR 1 + p_partkey % 23 > 20 AS bad, 1 + p_partkey % 23 AS n FROM part),
    s AS (SELECT doc_id, unnest(range(1, n + 1)) AS i FROM o WHERE NOT bad)
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS section_no, 'H' || CAST(i AS VARCHAR) AS heading, CASE WHEN i <= 4 THEN CAST(i AS INTEGER) END AS page, CAST(NULL AS VARCHAR) AS error FROM s
    UNION ALL SELECT doc_id, NULL, NULL, NULL, 'LLM_BAD_RESPONSE' FROM o WHERE bad""",
)
def outlines(spark, d):
    """Outlines of one to twenty-three sections; too many sections or a wrong summary is an error row."""
    rows = table(spark, d, "part").selectExpr("p_partkey AS k", "p_name AS name")
    parsed = extraction.parse_outlines(store.spread(rows, "k", store.UNFOLDED).selectExpr("k AS doc_id", f"{OUTLINE_JSON} AS raw"))
    cited = extraction.resolve_outline(parsed, passages(spark, d, "part", "p_partkey"))
    good = cited.select("doc_id", "section_no", "heading", "page", F.lit(None).cast("string").alias("error"))
    bad = parsed.filter("error IS NOT NULL").select("doc_id", "error")
    return good.unionByName(bad, allowMissingColumns=True)


_KINDS = "CASE o_orderkey % 3 WHEN 0 THEN 'loan' WHEN 1 THEN 'contract' ELSE 'general' END"


@query(
    "kind_routing_x7",
    f"SELECT analysis, count(*) AS documents FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'terms' WHEN 1 THEN 'facts' ELSE 'outline' END AS analysis FROM orders) GROUP BY analysis",
)
def kind_routing(spark, d):
    routed = extraction.route_by_kind(table(spark, d, "orders").selectExpr("o_orderkey AS doc_id", f"{_KINDS} AS kind"))
    parts = [df.select(F.lit(name).alias("analysis")) for name, df in routed.items()]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.groupBy("analysis").agg(F.count("*").alias("documents"))


@query(
    "analysis_reuse_x8",
    "SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 10 = 1",
)
def analysis_reuse(spark, d):
    """Every third document has no stored analysis; every tenth is forced."""
    docs = table(spark, d, "orders").selectExpr(
        "o_orderkey AS doc_id", "CASE WHEN o_orderkey % 3 <> 0 THEN '{}' END AS extraction",
        "CASE WHEN o_orderkey % 10 = 1 THEN true WHEN o_orderkey % 10 < 5 THEN false END AS force",
    )
    return extraction.needs_analysis(docs, "extraction").select("doc_id")


@query(
    "reused_analyses_x8",
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 10 = 1 THEN 'fresh ' || CAST(o_orderkey AS VARCHAR) ELSE '{}' END AS extraction,
      NOT (o_orderkey % 3 = 0 OR o_orderkey % 10 = 1) AS reused FROM orders""",
)
def reused_analyses(spark, d):
    """Stored analyses together with the fresh ones of the documents that needed them."""
    docs = table(spark, d, "orders").selectExpr(
        "o_orderkey AS doc_id", "CASE WHEN o_orderkey % 3 <> 0 THEN '{}' END AS extraction",
        "CASE WHEN o_orderkey % 10 = 1 THEN true WHEN o_orderkey % 10 < 5 THEN false END AS force",
    )
    fresh = docs.select("doc_id", F.concat(F.lit("fresh "), F.col("doc_id").cast("string")).alias("extraction"))
    return extraction.with_stored(docs, fresh, "extraction")


@query(
    "merged_after_retry_x2",
    "WITH " + LOAN_FACTS + """ SELECT doc_id, issues <> '' AND doc_id % 2 = 0 OR issues = '' AS valid,
      CASE WHEN issues <> '' AND doc_id % 2 = 0 THEN 'Lender 1' ELSE lender END AS lender FROM facts""",
)
def merged_after_retry(spark, d):
    """Every second failed response comes back as a good one; what did not is salvaged from the first."""
    first = parsed_loans(spark, d)
    asked = extraction.retry_requests(first).filter("doc_id % 2 = 0")
    second = asked.selectExpr("doc_id", "1 AS k", "CAST(1000 AS DECIMAL(18, 2)) AS price").selectExpr("doc_id", f"{LOAN_JSON} AS raw")
    merged = extraction.after_retry(first.select("doc_id", "raw"), second)
    done = extraction.parse_output(merged, extraction.LOAN)
    return done.select("doc_id", "valid", F.col("lenderName.value").alias("lender"))


@query(
    "found_fields_x9",
    "WITH " + LOAN_FACTS + """ SELECT doc_id, CAST((lender IS NOT NULL)::INT + (principal IS NOT NULL)::INT + (annual_rate_percent IS NOT NULL)::INT + (tenure_months IS NOT NULL)::INT
      + (fee_percent IS NOT NULL)::INT + (insurance IS NOT NULL)::INT + (prepay IS NOT NULL)::INT + (late IS NOT NULL)::INT AS INTEGER) AS found FROM facts""",
)
def found_fields(spark, d):
    parsed = parsed_loans(spark, d)
    return parsed.select("doc_id", extraction.found_fields(parsed, extraction.LOAN).alias("found"))


_COMPLETE = "principal IS NOT NULL AND annual_rate_percent IS NOT NULL AND tenure_months IS NOT NULL"
TERMS_COST = f""", withfees AS (SELECT *, {round2_sql('principal * fee_percent / 100')} AS pf, coalesce(insurance, 0.0) AS ins,
      CASE WHEN has_others THEN 100.0 + {round2_sql('principal * 0.5 / 100')} ELSE 0.0 END AS oth FROM facts WHERE {_COMPLETE}),
  priced AS (SELECT doc_id, principal, annual_rate_percent, tenure_months, method, least(CAST({round2_sql('pf + ins + oth')} AS DOUBLE), principal - 1) AS upfront_fees,
      CAST((pf > 0)::INT + (ins > 0)::INT + CASE WHEN has_others THEN 2 ELSE 0 END AS INTEGER) AS lines FROM withfees),
  emis AS (SELECT *, {round2_sql(f"CASE WHEN method = 'flat' THEN {FLAT} ELSE {REDUCING} END")} AS emi, {round2_sql('principal - upfront_fees')} AS net FROM priced WHERE upfront_fees >= 0),
  bis AS (SELECT doc_id, net, emi, tenure_months AS n, CAST(-0.99 AS DOUBLE) AS lo, CAST(10 AS DOUBLE) AS hi, 0 AS it FROM emis
    UNION ALL SELECT doc_id, net, emi, n, CASE WHEN f < 0 THEN mid ELSE lo END, CASE WHEN f < 0 THEN hi ELSE mid END, it + 1 FROM (
      SELECT *, net - emi * CASE WHEN abs(mid) < 1e-9 THEN n ELSE (1 - pow(1 + mid, -n)) / mid END AS f FROM (SELECT *, (lo + hi) / 2 AS mid FROM bis WHERE it < 62))),
  costed AS (SELECT e.*, (lo + hi) / 2 AS monthly FROM emis e JOIN bis USING (doc_id) WHERE it = 62)"""


@query(
    "cost_from_terms_f11",
    "WITH RECURSIVE " + LOAN_FACTS + TERMS_COST + f""" SELECT f.doc_id, emi, c.upfront_fees AS "upfrontFees", {round2_sql('(pow(1 + monthly, 12) - 1) * 100')} AS "effectiveAnnualRatePercent",
      coalesce(lines, 0) AS lines, concat_ws(', ', CASE WHEN f.principal IS NULL THEN 'principal' END, CASE WHEN f.annual_rate_percent IS NULL THEN 'interest rate' END, CASE WHEN f.tenure_months IS NULL THEN 'tenure' END) AS missing
    FROM facts f LEFT JOIN costed c USING (doc_id)""",
)
def cost_from_terms(spark, d):
    costed = extraction.cost_from_terms(parsed_loans(spark, d))
    return costed.select(
        "doc_id", "cost.emi", "cost.upfrontFees", "cost.effectiveAnnualRatePercent", F.size("upfront_breakdown").alias("lines"),
        F.array_join("missing", ", ").alias("missing"),
    )


