"""Comparing two loan offers: validation, verdict, payload and the side-by-side table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonspec as J
from ..functions import money as M
from ..functions.plan import settle

DIFFERENCE = {
    "aspect": "string", "left": "string", "right": "string", "favours": ("left", "right", "neither"), "note": "string",
}


def validate_pairs(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """``pairs(pair_id, left_id, right_id)`` plus ``reject``."""
    left = documents.select(F.col("doc_id").alias("left_id"), F.col("kind").alias("_lk"))
    right = documents.select(F.col("doc_id").alias("right_id"), F.col("kind").alias("_rk"))
    joined = pairs.join(left, "left_id", "left").join(right, "right_id", "left")
    reject = (
        F.when(F.col("left_id") == F.col("right_id"), "SAME_DOCUMENT")
        .when(F.col("_lk").isNull() | F.col("_rk").isNull(), "NOT_FOUND")
        .when((F.col("_lk") != "loan") | (F.col("_rk") != "loan"), "KIND_NOT_SUPPORTED")
    )
    return joined.withColumn("reject", reject).select(*pairs.columns, "reject")


def cheaper(left_rate: Column, right_rate: Column) -> Column:
    """The side with the strictly lower rounded effective annual rate."""
    return F.coalesce(
        F.when(left_rate < right_rate, "left").when(left_rate > right_rate, "right"), F.lit("unknown")
    )


def compare_pairs(pairs: DataFrame, costs: DataFrame) -> DataFrame:
    """Join both sides' cost rows ``costs(doc_id, effectiveAnnualRatePercent)`` and give the verdict."""
    left = costs.select(F.col("doc_id").alias("left_id"), F.col("effectiveAnnualRatePercent").alias("left_rate"))
    right = costs.select(F.col("doc_id").alias("right_id"), F.col("effectiveAnnualRatePercent").alias("right_rate"))
    joined = pairs.join(left, "left_id", "left").join(right, "right_id", "left")
    return joined.withColumn("cheaper", cheaper(F.col("left_rate"), F.col("right_rate")))


def _or_not_stated(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("not stated"))


def _fee_text(f: Column) -> Column:
    stated = f.amount.isNotNull() | f.percent.isNotNull()
    body = F.to_json(F.struct(f.amount.alias("amount"), f.percent.alias("percent"), f.description.alias("description")))
    return F.when(stated, body).otherwise("not stated")


def describe_terms(terms: DataFrame) -> DataFrame:
    """``(doc_id, field, value)`` rows of the comparison payload, ``not stated`` where absent."""
    rate = F.col("interestRate")
    rate_text = F.when(
        rate.annualPercent.isNotNull(),
        F.to_json(
            F.struct(
                rate.annualPercent.alias("annualPercent"), rate.rateType.alias("type"), rate.method.alias("method"),
                rate.benchmark.alias("benchmark"),
            )
        ),
    )
    others = F.concat(
        F.lit("["), F.array_join(F.transform("otherUpfrontCharges", _fee_text), ", "), F.lit("]")
    )
    values = {
        "lender": _or_not_stated(F.col("lenderName.value")),
        "principal": _or_not_stated(F.col("principalAmount.value")),
        "interestRate": _or_not_stated(rate_text),
        "tenureMonths": _or_not_stated(F.col("tenureMonths.value")),
        "statedEmi": _or_not_stated(F.col("statedEmi.value")),
        "processingFee": _fee_text(F.col("processingFee")),
        "insurancePremium": _fee_text(F.col("insurancePremium")),
        "otherUpfrontCharges": others,
        "prepaymentCharges": _fee_text(F.col("prepaymentCharges")),
        "latePaymentCharges": _fee_text(F.col("latePaymentCharges")),
        "bounceCharges": _fee_text(F.col("bounceCharges")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in values.items()])
    return terms.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.field", "r.value")


def _fee_display(name: str) -> Column:
    f = F.col(name)
    absent = f.amount.isNull() & f.percent.isNull()
    return M.fee(f.amount, f.percent, absent, f.description)


ASPECTS = (
    "Lender", "Loan amount", "Interest rate", "Tenure", "EMI", "Upfront fees", "Total interest",
    "Effective annual rate", "APR", "Prepayment charges", "Late payment / penal", "Bounce charges", "Risk flags",
)


def display_values(costed: DataFrame) -> DataFrame:
    """``(doc_id, shown)``: the thirteen display values of one offer, in the order of ``ASPECTS``.

    ``costed`` holds parsed terms, their ``cost`` and ``risks`` (display text, null when not assessed).
    """
    rate = F.col("interestRate")
    rate_text = F.when(rate.annualPercent.isNull(), "Not stated").otherwise(
        F.concat(M.percent(rate.annualPercent), F.lit(" "), rate.rateType, F.lit(", "), rate.method)
    )
    values = [
        F.coalesce(F.col("lenderName.value"), F.lit(M.DASH)),
        M.money(F.col("principalAmount.value"), whole=True),
        rate_text,
        M.months(F.col("tenureMonths.value")),
        M.money(F.coalesce(F.col("cost.emi"), F.col("statedEmi.value"))),
        M.money(F.col("cost.upfrontFees"), whole=True),
        M.money(F.col("cost.totalInterest"), whole=True),
        M.percent(F.col("cost.effectiveAnnualRatePercent")),
        M.percent(F.col("cost.aprPercent")),
        _fee_display("prepaymentCharges"),
        _fee_display("latePaymentCharges"),
        _fee_display("bounceCharges"),
        F.coalesce(F.col("risks"), F.lit("Not assessed")),
    ]
    return settle(costed.select("doc_id", F.array(*values).alias("shown")), ["shown"])


def comparison_table(pairs: DataFrame, costed: DataFrame) -> DataFrame:
    """``(pair_id, row_no, aspect, left, right)``: the sides meet as one row each and unfold afterwards.

    The sides are shuffled: their thirteen texts are many times the bytes of the files they come from, by which Spark
    would take a side for small enough to send it whole through the driver.
    """
    values = display_values(costed).hint("merge")
    left = values.select(F.col("doc_id").alias("left_id"), F.col("shown").alias("left"))
    right = values.select(F.col("doc_id").alias("right_id"), F.col("shown").alias("right"))
    joined = pairs.join(left, "left_id").join(right, "right_id")
    aspects = F.lit(list(ASPECTS))
    rows = joined.select("pair_id", F.posexplode(F.arrays_zip(aspects.alias("aspect"), "left", "right")).alias("row_no", "r"))
    return rows.select("pair_id", "row_no", "r.aspect", "r.left", "r.right")


def parse_narratives(responses: DataFrame) -> DataFrame:
    """``summary``, ``differences`` and ``error`` of ``responses(pair_id, raw)``."""
    df = responses.selectExpr("*", f"{J.parse('raw')} AS _root")
    head = J.object_issues("_root", "''", {"summary": "string"})
    issues = f"concat({head}, {J.array_issues('_root', 'differences', DIFFERENCE)})"
    checked = settle(df.selectExpr("*", f"coalesce(size({issues}) > 0, true) AS _bad"), ["_root", "_bad"])
    return checked.selectExpr(
        *responses.columns,
        f"CASE WHEN NOT _bad THEN {J.value('_root', 'summary', 'string')} END AS summary",
        f"CASE WHEN NOT _bad THEN {J.array_structs('_root', 'differences', DIFFERENCE)} END AS differences",
        "CASE WHEN _bad THEN 'LLM_BAD_RESPONSE' END AS error",
    )
