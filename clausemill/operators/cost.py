"""Cash-flow tables: present value and rate of return without gathering raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finance
from ..functions.money import round2


def npv_of_flows(flows: DataFrame, rate: Column, key: str = "loan_id") -> DataFrame:
    """``(key, npv)`` of ``flows(key, t, amount)``: a plain sum, combined map-side."""
    return flows.groupBy(key).agg(F.sum(F.col("amount") / F.pow(1 + rate, F.col("t"))).alias("npv"))


def flow_arrays(flows: DataFrame, key: str = "loan_id") -> DataFrame:
    """``(key, flows)``: dense arrays from t = 0.

    Rows are first added up per period, so a key gathers one value per period however many rows it has.
    """
    periods = flows.groupBy(key, "t").agg(F.sum("amount").alias("amount"))
    per_key = periods.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("t", "amount"))).alias("m"), F.max("t").alias("last")
    )
    dense = F.transform(F.sequence(F.lit(0), F.col("last")), lambda t: F.coalesce(F.col("m")[t], F.lit(0.0)))
    return per_key.select(key, dense.alias("flows"))


def irr_of_flows(flows: DataFrame, key: str = "loan_id") -> DataFrame:
    """``(key, rate, error)`` of irregular flows."""
    solved = flow_arrays(flows, key).select(key, finance.irr(F.col("flows")).alias("r"))
    return solved.select(key, "r.rate", "r.error")


def total_cost(principal: Column, emi: Column, months: Column, fees: Column) -> dict[str, Column]:
    """Repayment, interest, fees and cost of credit of a stated instalment."""
    repayment = round2(emi * months)
    interest = round2(repayment - principal)
    return {
        "totalRepayment": repayment,
        "totalInterest": interest,
        "upfrontFees": round2(fees),
        "totalCostOfCredit": round2(interest + fees),
    }


def sum_amounts(rows: DataFrame, key: str, amount: str) -> DataFrame:
    return rows.groupBy(key).agg(round2(F.sum(amount)).alias("total"))


def percent_of(percent: Column, amount: Column) -> Column:
    return round2(percent / 100 * amount)
