from pyspark.sql import functions as F

from clausemill.operators import compare, evaluation, golden


def test_answer_checks(spark):
    rows = [
        ("The rate is 14% fixed", 14.0, True), ("about 13.95 percent", 14.0, True), ("It is 13.5", 14.0, False),
        ("There is no prepayment charge", 0.0, True), ("Rs. 0 is charged", 0.0, True), ("Rs. 10 is charged", 0.0, False),
    ]
    df = spark.createDataFrame(rows, "a string, v double, ok boolean")
    got = df.select("ok", evaluation.check_numeric(F.col("a"), F.col("v"), F.lit(None).cast("double")).alias("g")).collect()
    assert all(r.ok == r.g for r in got)
    sentinel = "The interest is stated. NOT_IN_DOCUMENT The document does not state more."
    refusal = spark.createDataFrame([(sentinel, 0), (sentinel, 1), ("Fees are 2%", 0)], "a string, n int")
    assert [r[0] for r in refusal.select(evaluation.check_refusal(F.col("a"), F.col("n"))).collect()] == [True, False, False]


def test_golden_table(spark):
    slugs = ["personal-loan-fixed", "home-loan-floating", "vehicle-loan-flat", "business-loan-kfs", "education-loan-floating"]
    loans = spark.createDataFrame([(s, i) for i, s in enumerate(slugs)], "slug string, position int")
    table = golden.golden_questions(spark, loans)
    kinds = {r.type: r["count"] for r in table.groupBy("type").count().collect()}
    assert kinds == {"numeric": 45 + 1, "text": 7, "not_in_document": 6} and table.count() == 59
    assert table.filter("needs_tool").count() == 10


def test_set_scores_count_empty_sets_as_one(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    expected = spark.createDataFrame([("a", "x"), ("a", "y")], "doc_id string, category string")
    found = spark.createDataFrame([("a", "x"), ("a", "z"), ("a", "x")], "doc_id string, category string")
    scores = evaluation.set_scores(expected, found, docs)
    got = {r.doc_id: (r.precision, r.recall) for r in scores.collect()}
    assert got == {"a": (0.5, 0.5), "b": (1.0, 1.0)}
    assert tuple(evaluation.macro_scores(scores).first()) == (0.75, 0.75)


def test_first_hits_and_scores(spark):
    expected = spark.createDataFrame([("p", [2]), ("q", [9]), ("r", [1])], "query_id string, pages array<int>")
    got = [("p", 1, 1, 1), ("p", 2, 2, 3), ("q", 1, 1, 2), ("r", 1, 1, 1)]
    retrieved = spark.createDataFrame(got, "query_id string, rank int, page_start int, page_end int")
    first = evaluation.first_hits(expected, retrieved)
    assert {r.query_id: r.first for r in first.collect()} == {"p": 2, "q": None, "r": 1}
    scores = evaluation.retrieval_scores(first).first()
    assert abs(scores.recall_1 - 1 / 3) < 1e-9 and abs(scores.mrr - 0.5) < 1e-9


def test_report_files(spark, tmp_path):
    metrics = spark.createDataFrame([("Citation accuracy", 0.5), ("Other", 1.0)], "metric string, value double")
    assert [r.metric for r in evaluation.failed_thresholds(metrics).collect()] == ["Citation accuracy"]
    evaluation.write_report(metrics, str(tmp_path / "report"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "report" / "markdown")).collect())
    assert "| Citation accuracy | 50.0% | 80.0% |" in text and "| Other | 100.0% | – |" in text


def test_pair_verdicts(spark):
    rows = [(1.0, 2.0, "left"), (2.0, 1.0, "right"), (1.0, 1.0, "unknown"), (None, 1.0, "unknown")]
    df = spark.createDataFrame(rows, "l double, r double, want string")
    assert df.filter(compare.cheaper(F.col("l"), F.col("r")) != F.col("want")).count() == 0
