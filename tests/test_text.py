import pytest
from pyspark.sql import functions as F

from clausemill.functions import money as M
from clausemill.functions import text as X


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


ACCEPTED = [
    "1. DEFINITIONS", "5.2 Prepayment Charges", "12.3.1 Notices", "ARTICLE III - INTEREST",
    "Clause 7. Default and Penal Charges", "SECTION B: FEES AND CHARGES", "SCHEDULE I - PARTICULARS OF THE LOAN",
    "REPRESENTATIONS AND WARRANTIES", "Annexure A",
]
REJECTED = [
    "5. The Borrower shall repay the Loan together with interest in 36 equated monthly instalments.",
    "Interest shall accrue at 14% per annum.", "Rs. 5,00,000", "INR 1,00,000", "EMI", "2026",
    "the borrower agrees to the terms", "A" * 90,
]


def test_headings(spark):
    got = values(spark, [(t,) for t in ACCEPTED + REJECTED], "t string", X.is_heading("t"))
    assert [g[0] for g in got] == [True] * len(ACCEPTED) + [False] * len(REJECTED)


@pytest.mark.parametrize(
    "text,expected",
    [
        ("B. LOAN\nThe loan amount is Rs. 5,00,000. Processing fee 2%.", "The loan amount is Rs. 5,00,000."),
        ("5. FEES\nThe Borrower shall pay a processing fee of 2% of the loan amount. It is deducted.",
         "The Borrower shall pay a processing fee of 2% of the loan amount."),
        ("short text without punctuation", "short text without punctuation"),
        ("x" * 300, "x" * 219 + "…"),
    ],
)
def test_quote(spark, text, expected):
    assert values(spark, [(text,)], "t string", X.quote("t")) == [(expected,)]


def test_sentences_keep_abbreviations(spark):
    text = "Pay Rs. 500 now. Then No. 4 applies; Late fees: 2%. done"
    got = values(spark, [(text,)], "t string", X.sentences("t"))[0][0]
    assert got == ["Pay Rs. 500 now.", "Then No. 4 applies;", "Late fees:", "2%. done"]


def test_numbers(spark):
    text = "Rs. 17,088.81 and 1,15,197 at 17.97% in v2 or 3.4.5 and 600"
    assert values(spark, [(text,)], "t string", X.numbers_in("t"))[0][0] == [17088.81, 115197.0, 17.97, 3.4, 600.0]


def test_question_normalisation_and_tokens(spark):
    got = values(spark, [("  What's [PAN_1]'s  EMI? né ",)], "t string", X.normalise_question("t"))
    assert got == [("what s [pan_1] s emi né",)]
    got = values(spark, [("Prepaying the charges [PAN_2] is 4% a",)], "t string", X.search_tokens("t"))
    assert got == [(["prepay", "charg", "4%"],)]


def test_titles_and_types(spark):
    rows = [("my_loan-deal.v2.pdf", ""), (".pdf", "application/pdf"), ("a.txt", "text/plain")]
    got = values(spark, rows, "f string, m string", X.title_from_file_name("f"), X.source_type(F.col("m"), F.col("f")))
    assert got == [("my loan deal.v2", "pdf"), ("Untitled document", "pdf"), ("a", None)]


def test_display(spark):
    rows = [(500000.0, 17.97, 36), (17088.81, None, 84), (None, 2.0, 18)]
    got = values(
        spark, rows, "a double, p double, n int", M.money(F.col("a")), M.percent(F.col("p")), M.months(F.col("n"))
    )
    assert got == [
        ("₹5,00,000.00", "17.97%", "36 months (3 yrs)"),
        ("₹17,088.81", "—", "84 months (7 yrs)"),
        ("—", "2.00%", "18 months (1 yr 6 mo)"),
    ]
    fees = [(None, 2.0, False), (500.0, None, False), (0.0, 0.0, False), (None, None, True), (750.0, 1.5, False)]
    got = values(
        spark, fees, "a double, p double, nf boolean",
        M.fee(F.col("a"), F.col("p"), F.col("nf"), F.lit(None).cast("string")),
    )
    assert [g[0] for g in got] == ["2%", "₹500.00", "Nil", "Not stated", "1.5% / ₹750.00"]


def test_rounding_towards_plus_infinity(spark):
    got = values(spark, [(-2.345,), (2.345,), (1.005,), (615197.16,)], "x double", M.round2(F.col("x")))
    assert [g[0] for g in got] == [-2.34, 2.35, 1.0, 615197.16] or [g[0] for g in got] == [-2.34, 2.35, 1.01, 615197.16]
    assert values(spark, [(615197.16,)], "x double", M.rupees(F.col("x"))) == [("Rs. 6,15,197.16",)]


def test_highlight(spark):
    chunk = "9. PREPAYMENT AND FORECLOSURE\nThe Borrower may prepay the principal outstanding plus applicable taxes."
    rows = [("  the principal outstanding plus applicable   taxes.",), ("9. PREPAYMENT AND FORECLOSURE",), ("Page 3 of 5",), ("Interest shall accrue on the Loan",)]
    got = values(spark, rows, "r string", X.highlight_hit(X.highlight_form(F.col("r")), X.highlight_form(F.lit(chunk))))
    assert [g[0] for g in got] == [True, True, False, False]
