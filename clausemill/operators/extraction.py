"""Loan terms, contract facts and outlines out of model responses: validate, salvage, cite, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finance
from ..functions import jsonspec as J
from ..functions import text as X
from ..functions.money import round2
from ..functions.plan import settle

# fixed values: what a response must hold
TEXT = {"value": "string?", "ref": "int?", "confidence": "confidence"}
NUMBER = {"value": "number?", "ref": "int?", "confidence": "confidence"}
WHOLE = {"value": "int?", "ref": "int?", "confidence": "confidence"}
FEE = {"amount": "number?", "percent": "number?", "description": "string?", "ref": "int?", "confidence": "confidence"}
RATE = {
    "annualPercent": "number?", "rateType": ("fixed", "floating", "unknown"), "method": ("reducing", "flat", "unknown"),
    "benchmark": "string?", "ref": "int?", "confidence": "confidence",
}
NAMES = {"value": "strings", "ref": "int?", "confidence": "confidence"}
LOAN = {
    "lenderName": TEXT, "principalAmount": NUMBER, "interestRate": RATE, "tenureMonths": WHOLE, "statedEmi": NUMBER,
    "processingFee": FEE, "insurancePremium": FEE, "otherUpfrontCharges": [FEE], "prepaymentCharges": FEE,
    "latePaymentCharges": FEE, "bounceCharges": FEE,
}
CONTRACT = {
    "documentType": TEXT, "parties": NAMES, "effectiveDate": TEXT, "term": TEXT, "paymentObligations": TEXT,
    "securityDeposit": TEXT, "noticePeriod": TEXT, "terminationConditions": TEXT, "renewal": TEXT, "governingLaw": TEXT,
}
OUTLINE_SECTION = {"heading": "string", "gist": "string", "ref": "int?"}
MAX_OUTLINE_SECTIONS = 20
MAX_ISSUES = 8


def _field_issues(name: str, spec) -> str:
    if isinstance(spec, list):
        return J.array_issues("_root", name, spec[0])
    return J.object_issues(J.member("_root", name), f"'{name}'", spec)


def _field_value(name: str, spec) -> str:
    if isinstance(spec, list):
        return J.array_structs("_root", name, spec[0])
    return J.object_struct(J.member("_root", name), spec)


def _quick(name: str, spec) -> str:
    """The field's value where one look at its schema shows that it fits."""
    if isinstance(spec, list):
        return J.quick_array("_root", name, spec[0])
    return J.quick_object("_root", name, spec)


def _absent(spec) -> str:
    """The not-found default of a field."""
    if isinstance(spec, list):
        return f"CAST(array() AS array<{J.struct_type(spec[0])}>)"
    defaults = {"confidence": "0.0D", "rateType": "'unknown'", "method": "'unknown'"}
    if spec.get("value") == "strings":
        defaults["value"] = "array()"
    members = ", ".join(f"'{n}', {defaults.get(n, 'NULL')}" for n in spec)
    return f"CAST(named_struct({members}) AS {J.struct_type(spec)})"


def parse_output(responses: DataFrame, spec: dict, raw: str = "raw") -> DataFrame:
    """Strict parse: one typed column per field plus ``issues`` (``path: message``) and ``valid``.

    A field that fails on its own is replaced by its not-found default, so one malformed fee does not
    discard the other fields; ``valid`` tells a clean response from a salvaged one. A field whose schema shows that it fits is
    read in one step; the rules that name what is wrong run only for the others.
    """
    keep = responses.columns
    df = responses.selectExpr("*", f"{J.parse(raw)} AS _root")
    df = settle(df.selectExpr("*", *[f"{_quick(n, f)} AS _q_{n}" for n, f in spec.items()]), [f"_q_{n}" for n in spec])
    fits = " OR ".join(f"_q_{n} IS NOT NULL" for n in spec)
    df = settle(df.selectExpr("*", f"CASE WHEN {fits} THEN 'object' ELSE {J.kind('_root')} END AS _kind"), ["_kind"])
    nothing = "CAST(array() AS array<string>)"
    df = df.selectExpr("*", *[f"CASE WHEN _q_{n} IS NOT NULL THEN {nothing} ELSE {_field_issues(n, f)} END AS _i_{n}" for n, f in spec.items()])
    every = ", ".join(f"_i_{n}" for n in spec)
    wrong = f"array({J.expected(repr(''), 'object', '_kind')})"
    fields = [
        f"CASE WHEN _q_{n} IS NOT NULL THEN _q_{n} WHEN _kind = 'object' AND size(_i_{n}) = 0 THEN {_field_value(n, f)} ELSE {_absent(f)} END AS {n}"
        for n, f in spec.items()
    ]
    issues = f"CASE WHEN _kind = 'object' THEN concat({every}) ELSE {wrong} END AS issues"
    done = df.selectExpr(*keep, *fields, issues).withColumn("valid", F.size("issues") == 0)
    return settle(done, [*spec, "issues", "valid"])


def retry_requests(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Second request for responses that failed: the first eight issues, sent back once."""
    listed = F.array_join(F.slice("issues", 1, MAX_ISSUES), "; ")
    message = F.concat(F.lit("That JSON failed validation: "), listed, F.lit(". Return the corrected JSON only."))
    return parsed.filter(~F.col("valid")).select(key, "raw", message.alias("message"))


def after_retry(first: DataFrame, second: DataFrame, key: str = "doc_id") -> DataFrame:
    """The second answer where there is one, else the first."""
    again = second.select(key, F.col("raw").alias("_raw2"))
    return first.join(again, key, "left").withColumn("raw", F.coalesce("_raw2", "raw")).drop("_raw2")


def _evidence(field: str, item: Column, present: Column, node: Column) -> Column:
    return F.struct(
        F.lit(field).alias("field"), item.cast("int").alias("item"), present.alias("present"),
        node.ref.alias("ref"), node.confidence.alias("confidence"),
    )


def _present(name: str, spec, node: Column) -> Column:
    if spec is FEE:
        return node.amount.isNotNull() | node.percent.isNotNull()
    if spec is RATE:
        return node.annualPercent.isNotNull()
    if spec is NAMES:
        return F.size(node.value) > 0
    return node.value.isNotNull()


def evidence_rows(parsed: DataFrame, spec: dict, key: str = "doc_id") -> DataFrame:
    """``(key, field, item, present, ref, confidence)``, one row per field or list item."""
    single = F.array(
        *[
            _evidence(n, F.lit(0), _present(n, s, F.col(n)), F.col(n))
            for n, s in spec.items()
            if not isinstance(s, list)
        ]
    )
    def items(name: str, spec) -> Column:
        return F.transform(name, lambda e, i: _evidence(name, i, _present(name, spec, e), e))

    listed = [items(n, s[0]) for n, s in spec.items() if isinstance(s, list)]
    return parsed.select(key, F.explode(F.concat(single, *listed) if listed else single).alias("e")).select(key, "e.*")


def resolve_evidence(evidence: DataFrame, passages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cite the passage a present field refers to; absent fields get confidence 0 and no citation."""
    at = passages.select(
        key, F.col("rank").cast("int").alias("ref"), "chunk_id", F.col("page_start").alias("page"), "page_end",
        "clause_title", X.quote("content").alias("quote"),
    )
    wanted = evidence.withColumn("ref", F.when(F.col("present"), F.col("ref")))
    joined = wanted.join(at, [key, "ref"], "left")
    return joined.select(
        key, "field", "item", F.when(F.col("present"), F.col("confidence")).otherwise(0.0).alias("confidence"),
        (~F.col("present")).alias("not_found"), "chunk_id", "page", "page_end", "clause_title", "quote",
    )


def range_reject(parsed: DataFrame) -> DataFrame:
    """Add ``reject`` for loan values outside the final ranges: money >= 0, percent 0..100, tenure > 0."""

    def bad_money(x: Column) -> Column:
        return F.coalesce(x < 0, F.lit(False))

    def bad_percent(x: Column) -> Column:
        return F.coalesce((x < 0) | (x > 100), F.lit(False))

    def bad_fee(f: Column) -> Column:
        return bad_money(f.amount) | bad_percent(f.percent)

    bad = bad_money(F.col("principalAmount.value")) | bad_money(F.col("statedEmi.value"))
    bad = bad | bad_percent(F.col("interestRate.annualPercent"))
    bad = bad | F.coalesce(F.col("tenureMonths.value") <= 0, F.lit(False))
    for name, spec in LOAN.items():
        if spec is FEE:
            bad = bad | bad_fee(F.col(name))
    bad = bad | F.exists("otherUpfrontCharges", bad_fee)
    return parsed.withColumn("reject", F.when(bad, "TERMS_OUT_OF_RANGE"))


def loan_terms(parsed: DataFrame, passages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Resolved terms: the typed fields, currency and a map of evidence per field."""
    return _with_evidence(range_reject(parsed), LOAN, passages, key).withColumn("currency", F.lit("INR"))


def contract_facts(parsed: DataFrame, passages: DataFrame, key: str = "doc_id") -> DataFrame:
    return _with_evidence(parsed, CONTRACT, passages, key)


def _with_evidence(parsed: DataFrame, spec: dict, passages: DataFrame, key: str) -> DataFrame:
    resolved = resolve_evidence(evidence_rows(parsed, spec, key), passages, key)
    citation = F.when(
        F.col("chunk_id").isNotNull(), F.struct("chunk_id", "page", "page_end", "clause_title", "quote")
    )
    entry = F.struct("field", "item", "confidence", "not_found", citation.alias("citation"))
    per_doc = resolved.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("field", "item", entry.alias("e")))).alias("_e"))
    return parsed.join(per_doc, key, "left").withColumn("evidence", F.transform("_e", lambda x: x.e)).drop("_e")


def found_fields(parsed: DataFrame, spec: dict) -> Column:
    """How many single fields were found; list fields do not count."""
    flags = [_present(n, s, F.col(n)).cast("int") for n, s in spec.items() if not isinstance(s, list)]
    return sum(flags[1:], flags[0])


def parse_outlines(responses: DataFrame) -> DataFrame:
    """``title``, ``summary``, ``sections`` and an ``error`` for responses of another shape."""
    df = responses.selectExpr("*", f"{J.parse('raw')} AS _root")
    head = J.object_issues("_root", "''", {"title": "string", "summary": "string"})
    issues = f"concat({head}, {J.array_issues('_root', 'sections', OUTLINE_SECTION, MAX_OUTLINE_SECTIONS)})"
    checked = settle(df.selectExpr("*", f"coalesce(size({issues}) > 0, true) AS _bad"), ["_root", "_bad"])
    return checked.selectExpr(
        *responses.columns,
        f"CASE WHEN NOT _bad THEN {J.value('_root', 'title', 'string')} END AS title",
        f"CASE WHEN NOT _bad THEN {J.value('_root', 'summary', 'string')} END AS summary",
        f"CASE WHEN NOT _bad THEN {J.array_structs('_root', 'sections', OUTLINE_SECTION)} END AS sections",
        "CASE WHEN _bad THEN 'LLM_BAD_RESPONSE' END AS error",
    )


def resolve_outline(outlines: DataFrame, passages: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, section_no, heading, gist, chunk_id, page, page_end, clause_title, quote)`` in order."""
    rows = outlines.select(key, F.posexplode("sections").alias("section_no", "s")).select(
        key, "section_no", "s.heading", "s.gist", "s.ref"
    )
    at = passages.select(
        key, F.col("rank").cast("int").alias("ref"), "chunk_id", F.col("page_start").alias("page"), "page_end",
        "clause_title", X.quote("content").alias("quote"),
    )
    return rows.join(at, [key, "ref"], "left").drop("ref")


def route_by_kind(documents: DataFrame) -> dict[str, DataFrame]:
    """Documents per analysis: loans get terms and cost, contracts facts, the rest an outline."""
    return {
        "terms": documents.filter(F.col("kind") == "loan"),
        "facts": documents.filter(F.col("kind") == "contract"),
        "outline": documents.filter(F.col("kind") == "general"),
    }


def needs_analysis(documents: DataFrame, stored: str, force: str = "force") -> DataFrame:
    """Documents whose stored analysis is missing or must be renewed."""
    return documents.filter(F.col(stored).isNull() | F.coalesce(F.col(force), F.lit(False)))


def with_stored(documents: DataFrame, fresh: DataFrame, stored: str, force: str = "force", key: str = "doc_id") -> DataFrame:
    """``(key, stored, reused)``: fresh analyses of the documents that needed one, stored ones of all others."""
    todo = needs_analysis(documents, stored, force).select(key)
    kept = documents.join(todo, key, "left_anti").select(key, stored, F.lit(True).alias("reused"))
    return kept.unionByName(fresh.join(todo, key, "left_semi").select(key, stored, F.lit(False).alias("reused")))


def cost_from_terms(terms: DataFrame) -> DataFrame:
    """Add ``cost`` (null when it cannot be computed), ``upfront_breakdown`` and ``missing`` to loan terms."""
    p, rate, n = F.col("principalAmount.value"), F.col("interestRate.annualPercent"), F.col("tenureMonths.value")
    missing = F.array_compact(
        F.array(
            F.when(p.isNull(), "principal"), F.when(rate.isNull(), "interest rate"), F.when(n.isNull(), "tenure")
        )
    )

    def line(label: Column, f: Column) -> Column:
        stated = f.amount.isNotNull() | f.percent.isNotNull()
        amount = F.when(stated, finance.fee_amount(p, f.amount, f.percent)).otherwise(0.0)
        return F.struct(label.alias("label"), amount.alias("amount"))

    others = F.transform(
        "otherUpfrontCharges",
        lambda f, i: line(F.coalesce(f.description, F.concat(F.lit("Other charge "), (i + 1).cast("string"))), f),
    )
    named = F.array(
        line(F.lit("Processing fee"), F.col("processingFee")), line(F.lit("Insurance premium"), F.col("insurancePremium"))
    )
    breakdown = F.filter(F.concat(named, others), lambda b: b.amount > 0)
    df = terms.withColumn("_missing", missing)
    complete = F.size("_missing") == 0
    nothing = F.array().cast("array<struct<label:string,amount:double>>")
    df = df.withColumn("upfront_breakdown", F.when(complete, breakdown).otherwise(nothing))
    total = round2(F.aggregate("upfront_breakdown", F.lit(0.0), lambda a, b: a + b.amount))
    df = df.select(
        F.struct(*terms.columns).alias("_terms"), "upfront_breakdown", "_missing",
        p.alias("_p"), rate.alias("_r"), n.alias("_n"),
        F.when(F.col("interestRate.method") == "flat", "flat").otherwise("reducing").alias("_m"),
        F.least(total, p - 1).alias("_f"), F.col("statedEmi.value").alias("_s"),
    )
    df = finance.with_loan_cost(df, "_p", "_r", "_n", "_m", "_f", "_s", when=F.size("_missing") == 0)
    why = F.when(F.col("cost_error").isNotNull(), F.array("cost_error")).otherwise(F.col("_missing"))
    cost = F.when(F.col("emi").isNotNull(), F.struct(*finance.COST_FIELDS))
    return df.select("_terms.*", cost.alias("cost"), "upfront_breakdown", why.alias("missing"))
