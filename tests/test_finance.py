import pytest
from pyspark.sql import functions as F

from clausemill.functions import checkdigit as C
from clausemill.functions import finance as fin
from clausemill.operators import calculator

# slug, principal, rate, months, method, fees, then emi, repayment, interest, net, effective, apr
LOANS = [
    ("personal", 500000.0, 14.0, 36, "reducing", 18300.0, None, 17088.81, 615197.16, 115197.16, 481700.0, 17.97, 16.64),
    ("home", 4000000.0, 8.75, 240, "reducing", 59700.0, None, 35348.43, 8483623.2, 4483623.2, 3940300.0, 9.34, 8.96),
    ("vehicle", 800000.0, 9.5, 60, "flat", 10500.0, None, 19666.67, 1180000.2, 380000.2, 789500.0, 18.51, 17.11),
    ("business", 2500000.0, 16.0, 48, "reducing", 85500.0, None, 70850.7, 3400833.6, 900833.6, 2414500.0, 19.49, 17.94),
    ("education", 1200000.0, 11.25, 84, "reducing", 4200.0, 20705.0, 20705.0, 1739220.0, 539220.0, 1195800.0, 11.98, 11.36),
]
SCHEMA = "loan_id string, principal double, annual_rate_percent double, tenure_months int, method string, upfront_fees double, stated_emi double"


def test_ground_truth_loans(spark):
    df = fin.with_loan_cost(spark.createDataFrame([r[:7] for r in LOANS], SCHEMA))
    cols = ["loan_id", "emi", "totalRepayment", "totalInterest", "netDisbursal", "effectiveAnnualRatePercent", "aprPercent"]
    got = {r[0]: tuple(r)[1:] for r in df.select(*cols).collect()}
    assert got == {r[0]: r[7:] for r in LOANS}


def test_cost_errors(spark):
    rows = [
        ("a", 0.0, 1.0, 1, "flat", 0.0, None), ("b", 10.0, 1.0, 0, "flat", 0.0, None),
        ("c", 10.0, -1.0, 1, "flat", 0.0, None), ("d", 10.0, 1.0, 1, "flat", 10.0, None),
        ("e", 1200.0, 0.0, 12, "reducing", 0.0, None), ("f", 0.01, 0.0, 100, "flat", 0.0, None),
    ]
    got = {r.loan_id: r for r in fin.with_loan_cost(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[k].cost_error for k in "abcdf"] == [
        fin.ERR_PRINCIPAL, fin.ERR_TENURE, fin.ERR_RATE, fin.ERR_FEES, fin.ERR_ONE_SIDED,
    ]
    assert (got["e"].emi, got["e"].aprPercent, got["e"].cost_error) == (100.0, 0.0, None)


def test_textbook_instalments(spark):
    rows = [(1e6, 10.0, 60), (5e6, 8.5, 240), (120000.0, 0.0, 12)]
    df = spark.createDataFrame(rows, "p double, r double, n int")
    got = df.select(F.round(fin.emi_reducing(F.col("p"), F.col("r"), F.col("n")), 2)).collect()
    assert [g[0] for g in got] == [21247.04, 43391.16, 10000.0]
    flat = spark.createDataFrame([(100000.0, 12.0, 12)], "p double, r double, n int")
    assert flat.select(F.round(fin.emi_flat(F.col("p"), F.col("r"), F.col("n")), 2)).first()[0] == 9333.33


def bisect(flows):
    def npv(r):
        return sum(c / (1 + r) ** t for t, c in enumerate(flows))

    lo, hi = -0.9, 10.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (npv(mid) > 0) == (npv(lo) > 0) else (lo, mid)
    return (lo + hi) / 2


def test_irr(spark):
    series = [[-100.0, 60.0, 60.0], [481700.0] + [-17088.81] * 36, [-1000.0, 200.0, 300.0, 700.0], [100.0] + [-1.0] * 200]
    df = spark.createDataFrame([(s,) for s in series], "f array<double>")
    got = [r.x.rate for r in df.select(fin.irr(F.col("f")).alias("x")).collect()]
    assert got[0] == pytest.approx(0.130662, abs=1e-6)
    assert got == pytest.approx([bisect(s) for s in series], abs=1e-8)
    bad = spark.createDataFrame([([100.0],), ([100.0, 50.0],), ([-1.0, -2.0],)], "f array<double>")
    assert [r.x.error for r in bad.select(fin.irr(F.col("f")).alias("x")).collect()] == [
        fin.ERR_FEW_FLOWS, fin.ERR_ONE_SIDED, fin.ERR_ONE_SIDED,
    ]


def test_verhoeff(spark):
    rows = [("2363",), ("2364",), ("531872046912",), ("x",), ("",)]
    df = spark.createDataFrame(rows, "s string")
    assert [r[0] for r in df.select(C.verhoeff_valid("s")).collect()] == [True, False, True, False, False]
    made = spark.range(500).select((F.col("id") * 7919 + 236).cast("string").alias("s"))
    made = made.withColumn("whole", F.concat("s", C.verhoeff_digit("s").cast("string")))
    round_trip = made.select(C.verhoeff_valid("whole").alias("ok"))
    assert round_trip.filter("ok").count() == 500
    assert spark.createDataFrame([("236",)], "s string").select(C.verhoeff_digit("s")).first()[0] == 3


def test_single_digit_errors_are_caught(spark):
    base = "531872046912"
    wrong = [(base[:i] + d + base[i + 1 :],) for i in range(12) for d in "0123456789" if d != base[i]]
    df = spark.createDataFrame(wrong, "s string")
    assert df.filter(C.verhoeff_valid("s")).count() == 0


def test_calculator(spark):
    rows = [
        ("1", "calculate_emi", '{"principal":500000,"annualRatePercent":14,"tenureMonths":36}'),
        ("2", "calculate_emi", '{"principal":800000,"annualRatePercent":9.5,"tenureMonths":60,"method":"flat"}'),
        ("3", "calculate_total_cost", '{"principal":500000,"emi":17088.81,"tenureMonths":36,"upfrontFees":18300}'),
        ("4", "calculate_effective_annual_rate", '{"principal":800000,"annualRatePercent":9.5,"tenureMonths":60,"method":"flat","upfrontFees":10500}'),
        ("5", "percent_of", '{"percent":2,"amount":500000}'),
        ("6", "sum_amounts", '{"amounts":[8000,1500,600,400]}'),
        ("7", "calculate_emi", '{"principal":-1,"annualRatePercent":14,"tenureMonths":36}'),
        ("8", "nope", "{}"),
        ("9", "calculate_effective_annual_rate", '{"principal":1000,"annualRatePercent":10,"tenureMonths":12,"upfrontFees":1000}'),
        ("a", "calculate_emi", '{"principal":"5","annualRatePercent":14,"tenureMonths":3.5}'),
        ("b", "sum_amounts", "not json"),
    ]
    df = calculator.run_tools(spark.createDataFrame(rows, "call_id string, name string, args string"))
    got = {r.call_id: r for r in df.collect()}
    assert got["1"].result == {"emi": 17088.81}
    assert got["2"].result == {"emi": 19666.67}
    assert got["3"].display == {
        "totalRepayment": "Rs. 6,15,197.16", "totalInterest": "Rs. 1,15,197.16", "upfrontFees": "Rs. 18,300.00",
        "totalCostOfCredit": "Rs. 1,33,497.16",
    }
    assert got["4"].display["effectiveAnnualRatePercent"] == "18.51%"
    assert got["4"].display["tenureMonths"] in ("60 months", "60.0 months")
    assert got["5"].result == {"result": 10000.0} and got["5"].display == {"result": "Rs. 10,000.00"}
    assert got["6"].result == {"total": 10500.0}
    assert got["7"].error.startswith("principal: Too small")
    assert got["8"].error == "unknown tool nope"
    assert "upfront fees" in got["9"].error
    assert got["a"].error == (
        "principal: Invalid input: expected number, received string; tenureMonths: Invalid input: expected int, received number"
    )
    assert got["b"].error == "arguments are not an object"
    assert all(got[k].error is None for k in "123456")
