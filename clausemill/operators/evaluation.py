"""Scoring answers, retrieval, extraction and risk flags against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finance
from ..functions import patterns as P
from ..functions import text as X
from ..functions.money import fraction_percent, round2

# fixed values: metrics and the share each must reach
THRESHOLDS = {
    "Retrieval recall@8 (hybrid)": 0.9,
    "Numeric answer accuracy": 0.8,
    "Citation accuracy": 0.8,
    "Not-in-document accuracy": 0.75,
    "Extraction field accuracy": 0.85,
}
# fixed values: contract fact checks as (field, needle)
FACT_CHECKS = (
    ("term", "24"), ("paymentObligations", "38,000"), ("securityDeposit", "2,28,000"), ("noticePeriod", "60"),
    ("renewal", "10%"), ("governingLaw", "arbitrat"), ("effectiveDate", "August 2026"), ("parties", "Deshpande"),
)


def pages_overlap(page_start: Column, page_end: Column, expected: Column) -> Column:
    return F.exists(expected, lambda p: p.between(page_start, page_end))


def expected_pages(truth: Column, path: Column) -> Column:
    """Pages listed at a dotted path of a ground-truth JSON text, the path itself a column."""
    return F.try_variant_get(F.try_parse_json(truth), F.concat(F.lit("$."), path, F.lit(".pages")), "array<int>")


def resolve_expected(questions: DataFrame, truth: DataFrame) -> DataFrame:
    """Fill in numeric expectations by question key: ``questions(id, slug, key, type, value)`` with
    ``truth(slug, key, expected)``; a numeric row without a truth row gets an error."""
    joined = questions.join(truth, ["slug", "key"], "left")
    value = F.when(F.col("type") == "numeric", F.coalesce(F.col("value"), F.col("expected")))
    unresolved = (F.col("type") == "numeric") & value.isNull()
    error = F.when(unresolved, F.concat(F.lit("no expected value for "), F.col("id")))
    return joined.withColumn("value", value).withColumn("error", error).drop("expected")


def truth_values(truth: DataFrame) -> DataFrame:
    """``(slug, key, expected)`` rows of a wide loan ground truth."""
    bounce = F.coalesce(F.col("bounce.amount"), F.col("principal") * F.col("bounce.percent") / 100)
    values = {
        "rate": F.col("annual_percent"), "tenure": F.col("tenure").cast("double"), "emi": F.col("stated_emi"),
        "principal": F.col("principal"), "prepay": F.coalesce(F.col("prepay.percent"), F.col("prepay.amount")),
        "bounce": bounce, "ear": F.col("effectiveAnnualRatePercent"), "interest-total": F.col("totalInterest"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("expected")) for k, v in values.items()])
    return truth.select("slug", F.explode(rows).alias("r")).select("slug", "r.key", "r.expected")


def check_numeric(answer: Column, value: Column, tolerance: Column) -> Column:
    numbers = X.numbers_in(answer)
    slack = F.greatest(F.abs(value) * F.coalesce(tolerance, F.lit(0.01)), F.lit(0.01))
    nil = answer.rlike(P.NIL_WORDING) | F.exists(numbers, lambda n: n == 0)
    return F.when(value == 0, nil).otherwise(F.exists(numbers, lambda n: F.abs(n - value) <= slack))


def check_text(answer: Column, keywords: Column) -> Column:
    lowered = F.lower(answer)
    return F.forall(keywords, lambda k: F.contains(lowered, F.lower(k)))


def check_refusal(answer: Column, citations: Column) -> Column:
    return (citations == 0) & answer.rlike(P.REFUSAL_WORDING)


def check_expectation(kind, answer, value, tolerance, keywords, citations) -> Column:
    return (
        F.when(kind == "numeric", check_numeric(answer, value, tolerance))
        .when(kind == "text", check_text(answer, keywords))
        .when(kind == "not_in_document", check_refusal(answer, citations))
    )


def mean(x: Column) -> Column:
    """Average, 0 over nothing."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def answer_accuracy(scored: DataFrame) -> DataFrame:
    """One row of accuracies from ``scored(type, ok, hit, needs_tool, tool_calls)``; ``hit`` is null when a
    question names no pages."""
    ok, hit = F.col("ok").cast("double"), F.col("hit").cast("double")
    return scored.agg(
        mean(ok).alias("answer_accuracy"),
        mean(F.when(F.col("type") == "numeric", ok)).alias("numeric_accuracy"),
        mean(F.when(F.col("type") != "not_in_document", hit)).alias("citation_accuracy"),
        mean(F.when(F.col("type") == "not_in_document", ok)).alias("refusal_accuracy"),
        mean(F.when(F.col("needs_tool"), (F.col("tool_calls") > 0).cast("double"))).alias("tool_accuracy"),
    )


def first_hits(expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``(query_id, first)``: rank of the first retrieved chunk on an expected page, null without one.

    ``expected(query_id, pages)``; ``retrieved(query_id, rank, page_start, page_end)``.
    """
    hit = pages_overlap(F.col("page_start"), F.col("page_end"), F.col("pages"))
    joined = expected.join(retrieved, "query_id", "left")
    return joined.groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("first"))


def retrieval_scores(first: DataFrame, by: list[str] | None = None) -> DataFrame:
    """recall@1, @4, @8 and mean reciprocal rank."""

    def within(k: int) -> Column:
        return F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0)))

    grouped = first.groupBy(*(by or []))
    return grouped.agg(
        within(1).alias("recall_1"), within(4).alias("recall_4"), within(8).alias("recall_8"),
        F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )


def _close(got: Column, want: Column, rel: float) -> Column:
    return F.coalesce(F.abs(got - want) <= F.greatest(F.abs(want) * rel, F.lit(0.01)), F.lit(False))


def scored_fee(principal: Column, f: Column) -> Column:
    """The evaluation's own fee rule: a positive amount, else the unrounded percentage, else 0."""
    return F.coalesce(F.when(f.amount > 0, f.amount), principal * f.percent / 100, F.lit(0.0))


def score_extraction(terms: DataFrame, truth: DataFrame) -> DataFrame:
    """``(slug, field, ok)``: thirteen checks per loan.

    ``terms`` holds parsed loan fields and ``slug``; ``truth(slug, lender, principal, annual_percent,
    rate_type, method, tenure, stated_emi, processing_resolved, insurance_amount, others, prepay, late,
    bounce)`` with the fees as ``struct(amount, percent)``.
    """
    t = truth.select(F.struct(*[F.col(c) for c in truth.columns if c != "slug"]).alias("t"), "slug")
    df = terms.join(t, "slug")
    principal = F.col("t.principal")

    def total(fees: Column) -> Column:
        return F.aggregate(fees, F.lit(0.0), lambda a, f: a + scored_fee(principal, f))

    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    insurance = F.coalesce(F.col("t.insurance_amount"), F.lit(0.0))
    other_truth, other_got = total(F.col("t.others")), total(F.col("otherUpfrontCharges"))
    prepay_truth = F.coalesce(F.col("t.prepay.percent"), F.col("t.prepay.amount"), F.lit(0.0))
    prepay_got = F.coalesce(F.col("prepaymentCharges.percent"), F.col("prepaymentCharges.amount"))
    lender = F.lower(X.strip_ws(F.coalesce(F.col("lenderName.value"), F.lit(""))))
    checks = {
        "lenderName": same(lender, F.lower(F.col("t.lender"))),
        "principal": _close(F.col("principalAmount.value"), principal, 0.005),
        "interestRate.annualPercent": _close(F.col("interestRate.annualPercent"), F.col("t.annual_percent"), 0.001),
        "interestRate.rateType": same(F.col("interestRate.rateType"), F.col("t.rate_type")),
        "interestRate.method": same(F.col("interestRate.method"), F.col("t.method")),
        "tenureMonths": same(F.col("tenureMonths.value"), F.col("t.tenure")),
        "statedEmi": _close(F.col("statedEmi.value"), F.col("t.stated_emi"), 0.001),
        "processingFee": _close(scored_fee(principal, F.col("processingFee")), F.col("t.processing_resolved"), 0.01),
        "insurancePremium": _close(scored_fee(principal, F.col("insurancePremium")), insurance, 0.01),
        "otherUpfrontCharges.total": _close(other_got, other_truth, 0.01),
        "prepaymentCharges": F.when(prepay_truth == 0, same(prepay_got, F.lit(0.0))).otherwise(
            _close(prepay_got, prepay_truth, 0.001)
        ),
        "latePaymentCharges": _close(F.col("latePaymentCharges.percent"), F.col("t.late.percent"), 0.001),
        "bounceCharges": _close(F.col("bounceCharges.amount"), F.col("t.bounce.amount"), 0.001),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("ok")) for k, v in checks.items()])
    return df.select("slug", F.explode(rows).alias("r")).select("slug", "r.field", "r.ok")


def field_accuracy(scores: DataFrame) -> DataFrame:
    return scores.groupBy("field").agg(F.avg(F.col("ok").cast("double")).alias("accuracy"))


def check_facts(facts: DataFrame, checks=FACT_CHECKS) -> DataFrame:
    """``(doc_id, field, ok)`` of ``facts(doc_id, field, value)``: the value contains its needle."""
    needle = F.create_map(*[F.lit(x) for pair in checks for x in pair])[F.col("field")]
    found = F.contains(F.lower(F.coalesce(F.col("value"), F.lit(""))), F.lower(needle))
    return facts.filter(needle.isNotNull()).select("doc_id", "field", found.alias("ok"))


def fact_rows(parsed: DataFrame) -> DataFrame:
    """``(doc_id, field, value)`` of parsed contract facts; the parties are joined by spaces."""
    names = [f for f, _ in FACT_CHECKS]
    value = {n: F.array_join("parties.value", " ") if n == "parties" else F.col(f"{n}.value") for n in names}
    rows = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in value.items()])
    return parsed.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.field", "r.value")


def set_scores(expected: DataFrame, found: DataFrame, documents: DataFrame) -> DataFrame:
    """Per document the precision and recall of found labels: ``(doc_id, expected, found, hits, …)``.

    Sets meet row by row in a full outer join; only counts are grouped, so no set is gathered.
    """
    both = (
        expected.select("doc_id", "category").distinct().withColumn("_e", F.lit(1))
        .join(found.select("doc_id", "category").distinct().withColumn("_f", F.lit(1)), ["doc_id", "category"], "full")
    )
    counts = both.groupBy("doc_id").agg(
        F.count("_e").alias("expected"), F.count("_f").alias("found"),
        F.count_if(F.col("_e").isNotNull() & F.col("_f").isNotNull()).alias("hits"),
    )
    joined = documents.select("doc_id").join(counts, "doc_id", "left").fillna(0, ["expected", "found", "hits"])
    hits = F.col("hits")
    return joined.select(
        "*",
        F.when(F.col("found") > 0, hits / F.col("found")).otherwise(1.0).alias("precision"),
        F.when(F.col("expected") > 0, hits / F.col("expected")).otherwise(1.0).alias("recall"),
    )


def set_differences(expected: DataFrame, found: DataFrame, documents: DataFrame) -> DataFrame:
    """``(doc_id, category, difference)``: what was ``missed`` and what is ``extra`` in ``documents(doc_id)``."""
    keys = ["doc_id", "category"]
    want, got = (x.select(*keys).distinct().join(documents.select("doc_id"), "doc_id", "left_semi") for x in (expected, found))
    missed = want.join(got, keys, "left_anti").withColumn("difference", F.lit("missed"))
    return missed.unionByName(got.join(want, keys, "left_anti").withColumn("difference", F.lit("extra")))


def macro_scores(per_document: DataFrame) -> DataFrame:
    return per_document.agg(mean(F.col("precision")).alias("precision"), mean(F.col("recall")).alias("recall"))


def failed_thresholds(metrics: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Metrics ``(metric, value)`` below their threshold."""
    threshold = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v))])[F.col("metric")]
    return metrics.withColumn("threshold", threshold).filter(F.col("value") < F.col("threshold"))


def report_rows(metrics: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """``(metric, line)``: one Markdown row per metric."""
    threshold = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v))])[F.col("metric")]
    shown = F.coalesce(fraction_percent(threshold), F.lit("–"))
    line = F.concat(F.lit("| "), F.col("metric"), F.lit(" | "), fraction_percent(F.col("value")), F.lit(" | "), shown, F.lit(" |"))
    return metrics.select("metric", line.alias("line"))


def write_report(metrics: DataFrame, folder: str, run: dict[str, str] | None = None, thresholds=THRESHOLDS) -> None:
    """Metrics as JSON and as a Markdown table (a handful of rows, so one file each), with what the run was: its subset,
    models, dimensions, top-k, time and seconds, as ``run`` names them."""
    run = run or {}
    threshold = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v))])[F.col("metric")]
    told = F.struct(*[F.lit(v).alias(k) for k, v in run.items()]) if run else F.lit(None).cast("string")
    metrics.withColumns({"threshold": threshold, "run": told}).coalesce(1).write.mode("overwrite").json(f"{folder}/json")
    shown = " · ".join(f"{k} {v}" for k, v in run.items())
    head = "# Evaluation report\n\n" + (f"Run: {shown}\n\n" if run else "") + "| metric | value | threshold |\n|---|---|---|\n"
    body = F.array_join(F.array_sort(F.collect_list("line")), "\n")
    report_rows(metrics, thresholds).agg(F.concat(F.lit(head), body).alias("value")).write.mode("overwrite").text(
        f"{folder}/markdown"
    )


def build_truth(specs: DataFrame) -> DataFrame:
    """Ground truth of generated loans: resolved fees, totals, rates and the risks that are absent.

    ``specs(slug, principal, annual_rate, tenure, method, stated_emi, processing, insurance, others, risks)``
    with fees as ``struct(amount, percent)``.
    """
    from ..functions.risk_rules import LOAN_CATEGORIES

    p = F.col("principal")

    def resolved(f: Column) -> Column:
        share = F.when(f.percent > 0, round2(p * f.percent / 100))
        return F.coalesce(f.amount, share, F.lit(0.0))

    others = F.aggregate("others", F.lit(0.0), lambda a, f: a + resolved(f))
    upfront = resolved(F.col("processing")) + F.coalesce(F.col("insurance.amount"), F.lit(0.0)) + others
    df = specs.select(
        "*", resolved(F.col("processing")).alias("processing_resolved"), upfront.alias("upfront"),
        F.array_except(F.lit(list(LOAN_CATEGORIES)), F.col("risks")).alias("absent_risks"),
    )
    return finance.with_loan_cost(df, "principal", "annual_rate", "tenure", "method", "upfront", "stated_emi")
