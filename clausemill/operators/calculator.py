"""Calculator calls requested by a model: JSON arguments in, result and display columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finance
from ..functions import jsonspec as J
from ..functions.money import display, round2
from ..functions.plan import settle
from .cost import percent_of, total_cost

# fixed values: arguments per tool as (rule, default)
METHODS = ("reducing", "flat")
TOOLS = {
    "calculate_emi": {
        "principal": ("positive", None), "annualRatePercent": ("min0", None), "tenureMonths": ("count", None),
        "method": ("method", "reducing"),
    },
    "calculate_total_cost": {
        "principal": ("positive", None), "emi": ("positive", None), "tenureMonths": ("count", None),
        "upfrontFees": ("min0", 0.0),
    },
    "calculate_effective_annual_rate": {
        "principal": ("positive", None), "annualRatePercent": ("min0", None), "tenureMonths": ("count", None),
        "method": ("method", "reducing"), "upfrontFees": ("min0", 0.0), "statedEmi": ("positive", "optional"),
    },
    "sum_amounts": {"amounts": ("amounts", None)},
    "percent_of": {"percent": ("min0", None), "amount": ("min0", None)},
}


def _issue(name: str, rule: str, default) -> str:
    """SQL text: null when the argument fits, else ``name: message``."""
    path, x = J.quoted(name), J.value("_args", name, "double")
    unless_absent = "got <> 'undefined' AND " if default is not None else ""
    if rule == "method":
        words = ", ".join(J.quoted(m) for m in METHODS)
        fits = f"got = 'string' AND {J.value('_args', name, 'string')} IN ({words})"
        wrong = J.says(path, 'Invalid option: expected one of "reducing"|"flat"')
        check = f"CASE WHEN {unless_absent}NOT ({fits}) THEN {wrong} END"
    elif rule == "amounts":
        items = J.value("_args", name, "array<variant>")
        check = (
            f"CASE WHEN got <> 'array' THEN {J.expected(path, 'array')} "
            f"WHEN size({items}) < 1 THEN {J.says(path, 'Too small: expected array to have >=1 items')} "
            f"WHEN exists({items}, e -> {J.kind('e')} <> 'number') THEN {J.says(path, 'Invalid input: expected number')} END"
        )
    else:
        check = f"CASE WHEN {unless_absent}got <> 'number' THEN {J.expected(path, 'number')}"
        if rule == "count":
            check += f" WHEN {x} <> floor({x}) THEN {J.expected(path, 'int')}"
        low, sign = ("< 0", ">=0") if rule == "min0" else ("<= 0", ">0")
        check += f" WHEN {x} {low} THEN {J.says(path, f'Too small: expected number to be {sign}')} END"
    return J.let(J.kind(J.member("_args", name)), "got", check)


def _problem() -> str:
    """SQL text: what is wrong with a call, null when nothing is."""
    branches = ""
    for tool, rules in TOOLS.items():
        issues = ", ".join(_issue(n, r, d) for n, (r, d) in rules.items())
        branches += f" WHEN name = '{tool}' THEN nullif(array_join(array_compact(array({issues})), '; '), '')"
    known = ", ".join(f"'{t}'" for t in TOOLS)
    return (
        f"CASE WHEN name NOT IN ({known}) THEN concat('unknown tool ', name) "
        f"WHEN {J.kind('_args')} <> 'object' THEN 'arguments are not an object'{branches} END"
    )


def _result_map(values: dict[str, Column]) -> Column:
    keys = F.array(*[F.lit(k) for k in values])
    return F.map_from_arrays(keys, F.array(*[v.cast("double") for v in values.values()]))


def _display_map(values: dict[str, Column]) -> Column:
    keys = F.array(*[F.lit(k) for k in values])
    return F.map_from_arrays(keys, F.array(*[display(k, v) for k, v in values.items()]))


def run_tools(requests: DataFrame) -> DataFrame:
    """``requests(call_id, name, args, …)`` plus ``result``, ``display`` and ``error``; a bad call is a row
    with an error, never a failed job."""
    df = requests.selectExpr("*", f"{J.parse('args')} AS _args").selectExpr(
        "*",
        f"{J.number('_args', 'principal')} AS _principal",
        f"{J.number('_args', 'annualRatePercent')} AS _rate",
        f"{J.number('_args', 'tenureMonths')} AS _months",
        f"coalesce({J.value('_args', 'method', 'string')}, 'reducing') AS _method",
        f"coalesce({J.number('_args', 'upfrontFees')}, 0.0D) AS _fees",
        f"{J.number('_args', 'statedEmi')} AS _stated",
        f"{J.number('_args', 'emi')} AS _arg_emi",
        f"{J.number('_args', 'percent')} AS _percent",
        f"{J.number('_args', 'amount')} AS _amount",
        f"{J.value('_args', 'amounts', 'array<double>')} AS _amounts",
        f"{_problem()} AS _problem",
    )
    df = settle(df, ["_problem"])
    ok = F.col("_problem").isNull()
    df = finance.with_loan_cost(
        df, "_principal", "_rate", "_months", "_method", "_fees", "_stated",
        when=ok & (F.col("name") == "calculate_effective_annual_rate"),
    )
    p, r, n = F.col("_principal"), F.col("_rate"), F.col("_months")
    emi = F.when(F.col("_method") == "flat", finance.emi_flat(p, r, n)).otherwise(finance.emi_reducing(p, r, n))
    results = {
        "calculate_emi": {"emi": round2(emi)},
        "calculate_total_cost": total_cost(p, F.col("_arg_emi"), n, F.col("_fees")),
        "calculate_effective_annual_rate": {k: F.col(k) for k in finance.COST_FIELDS},
        "sum_amounts": {"total": round2(F.aggregate("_amounts", F.lit(0.0), lambda a, x: a + x))},
        "percent_of": {"result": percent_of(F.col("_percent"), F.col("_amount"))},
    }
    result = F.lit(None).cast("map<string,double>")
    shown = F.lit(None).cast("map<string,string>")
    good = ok & F.col("cost_error").isNull()
    for tool, values in results.items():
        mine = good & (F.col("name") == tool)
        result = F.when(mine, _result_map(values)).otherwise(result)
        shown = F.when(mine, _display_map(values)).otherwise(shown)
    return df.select(
        *requests.columns, result.alias("result"), shown.alias("display"),
        F.coalesce(F.col("_problem"), F.col("cost_error")).alias("error"),
    )
