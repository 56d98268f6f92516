"""The golden question table: eight questions per loan plus questions on single documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: (key, question, tolerance, pages_from, needs_tool, in_fast_subset) asked of every loan
LOAN_TEMPLATES = (
    ("rate", "What is the rate of interest on this loan, and is it fixed or floating?", None, "terms.interestRate", False, True),
    ("tenure", "How many monthly instalments does the loan have?", None, "terms.tenureMonths", False, False),
    ("emi", "What is the EMI amount stated in the agreement?", None, "terms.statedEmi", False, True),
    ("principal", "How much is being lent under this agreement?", None, "terms.principal", False, False),
    ("prepay", "Can I foreclose this loan early, and what will it cost me?", None, "terms.prepaymentCharges", False, True),
    ("bounce", "What is charged if my EMI payment bounces?", None, "terms.bounceCharges", False, False),
    ("ear", "Including every upfront charge, what is the effective annual interest rate I am really paying on this loan?", 0.02, "terms.interestRate", True, True),
    ("interest-total", "How much total interest will I pay over the full tenure if I pay every EMI on time?", 0.01, "terms.statedEmi", True, False),
)
FAST_LOANS = (0, 2)

# fixed values: (slug, key, type, question, value, keywords, pages_from, pages, tags)
SINGLE_QUESTIONS = (
    ("personal-loan-fixed", "nid-guarantor", "not_in_document", "Who is the guarantor for this loan?", None, None, None, None, "ci,nid"),
    ("home-loan-floating", "nid-moratorium", "not_in_document", "How long is the moratorium period before EMIs start?", None, None, None, None, "nid"),
    ("vehicle-loan-flat", "nid-cooling", "not_in_document", "Is there a cooling-off period during which I can return the loan without penalty?", None, None, None, None, "nid"),
    ("education-loan-floating", "nid-collateral", "not_in_document", "What collateral or property is mortgaged for this loan?", None, None, None, None, "nid"),
    ("business-loan-kfs", "cooling", "text", "Is there a cooling-off period?", None, ["3 working days"], None, [1], "ci"),
    ("home-loan-floating", "benchmark", "text", "What benchmark is the floating rate linked to?", None, ["SPLR"], "terms.interestRate", None, ""),
    ("personal-loan-fixed", "arbitration", "text", "How are disputes resolved, and who appoints the arbitrator?", None, ["arbitrat", "lender"], None, [4], ""),
    ("vehicle-loan-flat", "flat", "text", "Is interest calculated on the reducing balance or on the original principal?", None, ["flat"], "terms.interestRate", None, "ci"),
    ("residential-lease", "rent", "numeric", "What is the monthly rent and when is it due?", 38000.0, None, None, [1], "ci"),
    ("residential-lease", "deposit", "numeric", "How much is the security deposit?", 228000.0, None, None, [1], ""),
    ("residential-lease", "lockin", "text", "How long is the lock-in period and what happens if I leave during it?", None, ["12 months", "forfeit"], None, [1], "ci"),
    ("residential-lease", "notice", "numeric", "How much notice do I need to give to end the agreement after the lock-in?", 60.0, None, None, [2], ""),
    ("residential-lease", "renewal", "text", "Does the agreement renew automatically, and does the rent go up?", None, ["automatic", "10%"], None, [1], ""),
    ("residential-lease", "nid-parking", "not_in_document", "Which parking slot is allotted to the tenant?", None, None, None, None, "nid"),
    ("lecture-notes-tvm", "pv", "numeric", "What was the present value of the scholarship in the worked example?", 39927.0, None, None, [1], "ci"),
    ("lecture-notes-tvm", "emi-example", "numeric", "In the EMI worked example, what is the monthly instalment?", 21247.0, None, None, [1], ""),
    ("lecture-notes-tvm", "ear", "numeric", "What effective annual rate does 12% compounded monthly work out to?", 12.68, None, None, [1, 2], ""),
    ("lecture-notes-tvm", "flat-error", "text", "What common student error do the notes warn about when building an amortisation schedule?", None, ["original principal"], None, [1, 2], ""),
    ("lecture-notes-tvm", "nid-lecturer", "not_in_document", "Who is the lecturer teaching this course?", None, None, None, None, "nid"),
)


def loan_questions(loans: DataFrame) -> DataFrame:
    """Eight questions per row of ``loans(slug, position)``; the templates are a literal array."""
    entries = [
        F.struct(
            F.lit(key).alias("key"), F.lit(question).alias("question"), F.lit(tolerance).cast("double").alias("tolerance"),
            F.lit(pages).alias("pages_from"), F.lit(tool).alias("needs_tool"), F.lit(fast).alias("fast"),
        )
        for key, question, tolerance, pages, tool, fast in LOAN_TEMPLATES
    ]
    rows = loans.select("slug", "position", F.explode(F.array(*entries)).alias("q")).select("slug", "position", "q.*")
    in_fast = F.col("position").isin(*FAST_LOANS) & F.col("fast")
    tags = F.array_compact(F.array(F.when(in_fast, "ci"), F.when(F.col("needs_tool"), "tool")))
    nothing = F.lit(None)
    return rows.select(
        F.concat("slug", F.lit("/"), "key").alias("id"), "slug", "key", F.lit("numeric").alias("type"), "question",
        nothing.cast("double").alias("value"), "tolerance", nothing.cast("array<string>").alias("keywords"), "pages_from",
        nothing.cast("array<int>").alias("pages"), "needs_tool", tags.alias("tags"),
    )


def golden_questions(spark: SparkSession, loans: DataFrame) -> DataFrame:
    """The whole golden table."""
    rows = [
        (f"{slug}/{key}", slug, key, kind, question, value, None, keywords, pages_from, pages, False, [t for t in tags.split(",") if t])
        for slug, key, kind, question, value, keywords, pages_from, pages, tags in SINGLE_QUESTIONS
    ]
    schema = (
        "id string, slug string, key string, type string, question string, value double, tolerance double, "
        "keywords array<string>, pages_from string, pages array<int>, needs_tool boolean, tags array<string>"
    )
    return loan_questions(loans).unionByName(spark.createDataFrame(rows, schema))


def fast_subset(golden: DataFrame) -> DataFrame:
    return golden.filter(F.array_contains("tags", "ci"))
