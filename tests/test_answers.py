import json

from pyspark.sql import functions as F

from clausemill.operators import answers, extraction, risks
from clausemill.plans.ask import cited_answers

PASSAGES = [
    ("q", 1, "chunk-1", 1, 1, "1. CLAUSE", "5. FEES\nThe Borrower shall pay a processing fee of 2% of the loan amount. It is deducted at disbursement."),
    ("q", 2, "chunk-2", 2, 2, "2. CLAUSE", "6. PREPAYMENT\nPrepayment charge of 4% applies after the twelfth EMI; no prepayment is permitted before that."),
    ("q", 3, "chunk-3", 3, 4, None, "7. DEFAULT\nPenal interest of 2% per month accrues on overdue amounts."),
]
SCHEMA = "query_id string, rank int, chunk_id string, page_start int, page_end int, clause_title string, content string"


def parsed(spark, raws):
    rows = [(str(i), raw, 3) for i, raw in enumerate(raws)]
    df = answers.parse_answers(spark.createDataFrame(rows, "query_id string, raw string, passages int"))
    return [(r.answer, list(r.refs), r.not_found) for r in df.orderBy("query_id").collect()]


def test_parse_answers(spark):
    got = parsed(
        spark,
        [
            "The processing fee is 2% [1] and prepayment costs 4% [2].",
            "Fees and prepayment are covered [1, 2]. Again [1].",
            "Something [7] and real [3].",
            "Loans usually have fees.",
            "NOT_IN_DOCUMENT\nThe agreement does not mention a cooling-off period.",
            "NOT_IN_DOCUMENT",
            "The answer is NOT_IN_DOCUMENT here [03, 99999999999999999999].",
        ],
    )
    assert got == [
        ("The processing fee is 2% [1] and prepayment costs 4% [2].", [1, 2], False),
        ("Fees and prepayment are covered [1, 2]. Again [1].", [1, 2], False),
        ("Something and real [3].", [3], False),
        ("Loans usually have fees.", [], False),
        ("The agreement does not mention a cooling-off period.", [], True),
        ("The document does not appear to state this.", [], True),
        ("The answer is NOT_IN_DOCUMENT here [3].", [3], False),
    ]


def test_citations_and_groundedness(spark):
    passages = spark.createDataFrame(PASSAGES, SCHEMA)
    responses = spark.createDataFrame([("q", "The fee is 2% [1], prepayment [2].")], "query_id string, raw string")
    tools = spark.createDataFrame([], "query_id string, tool_calls int")
    done, citations = cited_answers(responses, passages, tools)
    assert done.first().grounded is True
    got = {r.ref: (r.chunk_id, r.page, r.page_end, r.clause_title, r.quote) for r in citations.collect()}
    assert got[1] == ("chunk-1", 1, 1, "1. CLAUSE", "The Borrower shall pay a processing fee of 2% of the loan amount.")
    assert got[2][4] == "Prepayment charge of 4% applies after the twelfth EMI; no prepayment is permitted before that."


def test_context_text(spark):
    text = answers.contexts(spark.createDataFrame(PASSAGES, SCHEMA)).first().context
    assert text.startswith("[1] (page 1 | clause: 1. CLAUSE)\n5. FEES")
    assert "\n\n[3] (pages 3-4)\n7. DEFAULT" in text


GOOD = {
    "lenderName": {"value": "Meridian Finance Limited", "ref": 1, "confidence": 1},
    "principalAmount": {"value": 500000, "ref": 2, "confidence": 1},
    "interestRate": {"annualPercent": 14, "rateType": "fixed", "method": "reducing", "benchmark": None, "ref": 3, "confidence": 1},
    "tenureMonths": {"value": 36, "ref": 3, "confidence": 0.9},
    "statedEmi": {"value": 17088.81, "ref": 3, "confidence": 1},
    "processingFee": {"amount": None, "percent": 2, "description": "2% plus GST", "ref": 2, "confidence": 1},
    "insurancePremium": {"amount": 6500, "percent": None, "description": "credit life", "ref": 2, "confidence": 0.8},
    "otherUpfrontCharges": [{"amount": 1800, "percent": None, "description": "GST on processing fee", "ref": 2, "confidence": 0.7}],
    "prepaymentCharges": {"amount": None, "percent": 4, "description": "after 12 EMIs", "ref": 3, "confidence": 1},
    "latePaymentCharges": {"amount": None, "percent": 2, "description": "per month", "ref": 3, "confidence": 1},
    "bounceCharges": {"amount": None, "percent": None, "description": None, "ref": None, "confidence": 0},
}


def outputs(spark, *objects):
    rows = [(str(i), o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objects)]
    df = spark.createDataFrame(rows, "doc_id string, raw string")
    return extraction.parse_output(df, extraction.LOAN)


def test_strict_parse_and_salvage(spark):
    broken = {**GOOD, "principalAmount": {"value": "five lakh", "ref": 2, "confidence": 1}, "interestRate": "fourteen", "otherUpfrontCharges": "none"}
    odd = {**GOOD, "tenureMonths": {"value": 36.5, "ref": 3, "confidence": 1.5}}
    got = outputs(spark, GOOD, broken, "null", "garbage", odd).orderBy("doc_id").collect()
    assert [r.valid for r in got] == [True, False, False, False, False]
    assert got[0].issues == []
    assert got[1].lenderName.value == "Meridian Finance Limited"
    assert tuple(got[1].principalAmount) == (None, None, 0.0)
    assert got[1].interestRate.rateType == "unknown" and got[1].otherUpfrontCharges == []
    assert got[1].issues == [
        "principalAmount.value: Invalid input: expected number, received string",
        "interestRate: Invalid input: expected object, received string",
        "otherUpfrontCharges: Invalid input: expected array, received string",
    ]
    assert got[2].tenureMonths.value is None and got[3].processingFee.amount is None
    assert got[4].issues == [
        "tenureMonths.value: Invalid input: expected int, received number",
        "tenureMonths.confidence: Too big: expected number to be <=1",
    ]


def test_terms_cite_passages(spark):
    passages = spark.createDataFrame(
        [
            ("0", 1, "c1", 1, 1, "1. T", "A. LENDER\nMeridian Finance Limited is the lender."),
            ("0", 2, "c2", 2, 2, "2. T", "B. LOAN\nThe loan amount is Rs. 5,00,000. Processing fee 2%."),
        ],
        SCHEMA.replace("query_id", "doc_id"),
    )
    terms = extraction.loan_terms(outputs(spark, {**GOOD, "tenureMonths": {"value": 36, "ref": 9, "confidence": 1}}), passages).first()
    evidence = {(e.field, e.item): e for e in terms.evidence}
    assert evidence["principalAmount", 0].citation.chunk_id == "c2"
    assert evidence["principalAmount", 0].citation.quote == "The loan amount is Rs. 5,00,000."
    assert evidence["bounceCharges", 0].not_found and evidence["bounceCharges", 0].confidence == 0
    assert evidence["tenureMonths", 0].citation is None and not evidence["tenureMonths", 0].not_found
    assert evidence["otherUpfrontCharges", 0].citation.page == 2
    assert (terms.currency, terms.reject) == ("INR", None)


def test_cost_from_terms(spark):
    missing = {**GOOD, "principalAmount": {"value": None, "ref": None, "confidence": 0}, "interestRate": "x", "tenureMonths": "x"}
    got = extraction.cost_from_terms(outputs(spark, GOOD, missing)).orderBy("doc_id").collect()
    assert [(b.label, b.amount) for b in got[0].upfront_breakdown] == [
        ("Processing fee", 10000.0), ("Insurance premium", 6500.0), ("GST on processing fee", 1800.0),
    ]
    assert (got[0].cost.upfrontFees, got[0].cost.effectiveAnnualRatePercent, got[0].missing) == (18300.0, 17.97, [])
    assert got[1].missing == ["principal", "interest rate", "tenure"] and got[1].cost is None
    n = outputs(spark, GOOD).select(extraction.found_fields(None, extraction.LOAN).alias("n")).first().n
    assert n == 9


def test_out_of_range_terms_are_rows_with_a_code(spark):
    bad = {**GOOD, "interestRate": {**GOOD["interestRate"], "annualPercent": 140}}
    assert extraction.range_reject(outputs(spark, bad)).first().reject == "TERMS_OUT_OF_RANGE"


def test_risk_candidates_and_flags(spark):
    rows = [
        ("d", "loan", "a", 0, 1, 1, None, "Disputes go to arbitration."),
        ("d", "loan", "b", 1, 2, 2, None, "The Lender may terminate without notice and take possession of the vehicle; the Borrower has no corresponding right."),
        ("g", "general", "g", 0, 1, 1, None, "Disputes go to arbitration."),
    ]
    chunks = spark.createDataFrame(rows, "doc_id string, kind string, chunk_id string, chunk_index int, page_start int, page_end int, clause_title string, content string")
    found = risks.find_candidates(chunks)
    got = {(r.category, r.chunk_id): (r.matches, r.candidate) for r in found.collect()}
    assert got == {("one_sided_termination", "b"): (3, 1), ("arbitration", "a"): (1, 2)}
    prompt = risks.review_prompts(found).first().prompt
    assert prompt.startswith("Candidate 1 | risk: One-sided termination or recall | check: ")
    assert "\n(page 2)\nThe Lender may" in prompt and prompt.endswith("Review all 2 candidates.")
    reviews = {
        "reviews": [
            {"candidate": 0, "present": True, "severity": "low", "title": "x", "explanation": "y"},
            {"candidate": 2, "present": True, "severity": "high", "title": "arb", "explanation": "y"},
            {"candidate": 1, "present": False, "severity": "low", "title": "no", "explanation": "y"},
            {"candidate": 1, "present": True, "severity": "medium", "title": "term", "explanation": "y"},
            {"candidate": 1, "present": True, "severity": "low", "title": "late", "explanation": "y"},
        ]
    }
    responses = spark.createDataFrame([("d", json.dumps(reviews)), ("g", "[]")], "doc_id string, raw string")
    parsed_reviews = risks.parse_reviews(responses)
    assert {r.doc_id: r.error for r in parsed_reviews.collect()} == {"d": None, "g": "LLM_BAD_RESPONSE"}
    flags = risks.flag_order(risks.resolve_reviews(parsed_reviews, found)).orderBy("position").collect()
    assert [(f.category, f.severity, f.title, f.position) for f in flags] == [
        ("arbitration", "high", "arb", 1), ("one_sided_termination", "medium", "term", 2),
    ]


def test_rule_counts(spark):
    assert risks.rule_table(spark).count() == 63
    table = risks.category_table(spark).agg(F.count_if("for_loan"), F.count_if("for_contract")).first()
    assert tuple(table) == (8, 11)


def test_history_and_limits(spark):
    turns = [("c", i, "user" if i % 2 == 0 else "assistant", f"t{i}", i == 14, i == 3) for i in range(15)]
    df = spark.createDataFrame(turns, "conv_id string, turn int, role string, text string, pending boolean, error boolean")
    history = answers.recent_history(df).first().history
    assert [t.content for t in history] == [f"t{i}" for i in range(4, 14)]


def test_requests_reuse_upload_placeholders(spark):
    asks = spark.createDataFrame(
        [("q1", "d", "Is AKLPM4821R mine?", [("user", "my phone is 9820144710 and PAN ZZZPQ9999Z")]), ("q2", "e", "Hello?", [])],
        "query_id string, doc_id string, question string, history array<struct<role:string,content:string>>",
    )
    pii = spark.createDataFrame([("d", "[PAN_1]", "AKLPM4821R", 0)], "doc_id string, placeholder string, original string, seed_pos int")
    got = {r.query_id: r for r in answers.mask_requests(asks, pii).collect()}
    assert got["q1"].question == "Is [PAN_1] mine?"
    assert got["q1"].history[0].content == "my phone is [PHONE_1] and PAN [PAN_2]"
    assert got["q2"].question == "Hello?" and got["q2"].history == []


def test_contexts_keep_every_passage_and_long_questions_are_rejected(spark):
    rows = [("q", i, i, i, None, f"text {i}") for i in range(1, 61)]
    passages = spark.createDataFrame(rows, "query_id string, rank int, page_start int, page_end int, clause_title string, content string")
    context = answers.contexts(passages).first()
    assert context.passages == 60 and context.context.endswith("text 60")
    asks = spark.createDataFrame(
        [("a", "d", "x" * 2000, []), ("b", "d", "x" * 2001, []), ("c", "d", "ok", [("user", "y" * 8001)]), ("e", "d", "", [])],
        "query_id string, doc_id string, question string, history array<struct<role:string,content:string>>",
    )
    within, rejects = answers.split_requests(asks)
    assert [r.query_id for r in within.collect()] == ["a"]
    assert {r.query_id: r.issue for r in rejects.collect()} == {"b": "question", "c": "history.content", "e": "question"}
