"""Scoring queries: answers, retrieval, extraction and labels against ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.functions import patterns as P
from clausemill.operators import evaluation, golden
from clausemill.plans import evaluate
from clausemill.session import work_folder

from . import inputs as I
from .chunks import chunks_sql
from .cost import COSTED, LOANS, loans, round2_sql
from .extraction import CONTRACT_FACTS, LOAN_FACTS, parsed_contracts, parsed_loans
from .registry import query, table
from .retrieval import _CHUNKS, _QUERIES, chunk_table, field_queries, fused_sql, text_sql, vector_sql


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


GOLDEN = """golden AS (SELECT c_name || '/' || key AS id, type, needs_tool, c_custkey IN (0, 2) AND key IN ('rate', 'emi', 'prepay', 'ear') AS fast
    FROM customer, (VALUES ('rate', 'numeric', false), ('tenure', 'numeric', false), ('emi', 'numeric', false), ('principal', 'numeric', false), ('prepay', 'numeric', false), ('bounce', 'numeric', false), ('ear', 'numeric', true), ('interest-total', 'numeric', true)) t(key, type, needs_tool)
    UNION ALL SELECT * FROM (VALUES """ + ", ".join(
    f"({_quoted(slug + '/' + key)}, {_quoted(kind)}, false, {'ci' in tags.split(',')})" for slug, key, kind, *_, tags in golden.SINGLE_QUESTIONS
) + "))"


def _golden(spark, d):
    loans_ = table(spark, d, "customer").select(F.col("c_name").alias("slug"), F.col("c_custkey").alias("position"))
    return golden.golden_questions(spark, loans_)


@query("golden_questions_e1", "WITH " + GOLDEN + " SELECT * FROM golden")
def golden_questions(spark, d):
    """Eight questions for every customer taken as a loan, and the fixed questions on single documents."""
    return _golden(spark, d).select("id", "type", "needs_tool", F.array_contains("tags", "ci").alias("fast"))


@query("fast_questions_e1", "WITH " + GOLDEN + " SELECT id, type FROM golden WHERE fast")
def fast_questions(spark, d):
    """The subset that a quick evaluation asks."""
    return golden.fast_subset(_golden(spark, d)).select("id", "type")


@query(
    "expected_values_e2",
    "WITH " + LOANS + """, q AS (SELECT loan_id, key, type FROM loans, (VALUES ('rate', 'numeric'), ('tenure', 'numeric'), ('principal', 'numeric'), ('cooling', 'text'), ('colour', 'numeric')) v(key, type))
    SELECT CAST(loan_id AS VARCHAR) || '/' || key AS id, CASE key WHEN 'rate' THEN annual_rate_percent WHEN 'tenure' THEN tenure_months WHEN 'principal' THEN principal END AS value,
      CASE WHEN key = 'colour' THEN 'no expected value for ' || CAST(loan_id AS VARCHAR) || '/colour' END AS error FROM q JOIN loans USING (loan_id)""",
)
def expected_values(spark, d):
    """Numeric expectations by key; a key without ground truth is an error row."""
    fee = F.struct(F.lit(None).cast("double").alias("amount"), F.lit(2.0).alias("percent"))
    truth = loans(spark, d).select(
        F.col("loan_id").alias("slug"), F.col("annual_rate_percent").alias("annual_percent"), F.col("tenure_months").alias("tenure"),
        F.lit(0.0).alias("stated_emi"), "principal", fee.alias("prepay"), fee.alias("bounce"),
        F.lit(0.0).alias("effectiveAnnualRatePercent"), F.lit(0.0).alias("totalInterest"),
    )
    keys = [("rate", "numeric"), ("tenure", "numeric"), ("principal", "numeric"), ("cooling", "text"), ("colour", "numeric")]
    asked = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).alias("type")) for k, t in keys])
    questions = truth.select("slug", F.explode(asked).alias("q")).select(
        F.concat(F.col("slug").cast("string"), F.lit("/"), F.col("q.key")).alias("id"), "slug", "q.key", "q.type",
        F.lit(None).cast("double").alias("value"),
    )
    return evaluation.resolve_expected(questions, evaluation.truth_values(truth)).select("id", "value", "error")


@query(
    "page_overlap_e3",
    """SELECT l_orderkey, l_partkey, l_linenumber, len(list_filter([l_partkey % 20 + 1, l_suppkey % 20 + 1],
      lambda p: p BETWEEN l_linenumber AND l_linenumber + CAST(floor(l_quantity / 10) AS BIGINT))) > 0 AS hit FROM lineitem""",
)
def page_overlap(spark, d):
    last = F.col("l_linenumber") + F.floor(F.col("l_quantity") / 10)
    expected = F.array(F.col("l_partkey") % 20 + 1, F.col("l_suppkey") % 20 + 1)
    hit = evaluation.pages_overlap(F.col("l_linenumber"), last, expected)
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", hit.alias("hit"))


def _scores_sql(name: str, source: str) -> str:
    return f"""SELECT '{name}' AS retriever, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN first <= 4 THEN 1.0 ELSE 0.0 END), 6) AS recall_4,
      round(avg(CASE WHEN first <= 8 THEN 1.0 ELSE 0.0 END), 6) AS recall_8, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr
      FROM (SELECT e.doc_id, e.q, min(CASE WHEN e.doc_id % 3 + 1 BETWEEN c.page_start AND c.page_end THEN r.rank END) AS first
        FROM (SELECT doc_id, q FROM documents, questions) e LEFT JOIN {source} r ON r.doc_id = e.doc_id AND r.q = e.q LEFT JOIN corpus c ON c.chunk_id = r.chunk_id GROUP BY e.doc_id, e.q)"""


def _swept_sql(size: int, overlap: int) -> str:
    """Chunks of one cap, searched by both retrievers, scored against the page that follows from the document."""
    corpus = chunks_sql(size, overlap) + ", corpus AS (SELECT *, CAST(doc_id AS VARCHAR) || ':' || lpad(CAST(chunk_index AS VARCHAR), 6, '0') AS chunk_id FROM chunks)"
    counts = "SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM corpus"
    return f"""SELECT CAST({size} AS INTEGER) AS max_tokens, chunks, documents, round(chunks / documents, 6) AS mean_chunks, recall_1, recall_8, mrr FROM (
      {corpus}{_QUERIES}{vector_sql(24)}{text_sql(24)}{fused_sql(8)} SELECT * FROM ({_scores_sql('x', 'franked')}), ({counts}))"""


SIZES = ((200, 30), (400, 60), (800, 120))


@query("chunk_size_sweep_c7", " UNION ALL ".join(_swept_sql(*s) for s in SIZES))
def chunk_size_sweep(spark, d):
    """Three caps from one scan and one search: recall and reciprocal rank of the field queries, and chunks per document."""
    asks = field_queries(spark, d).withColumn("pages", F.array((F.col("doc_id") % 3 + 1).cast("int")))
    scores = evaluate.chunk_size_scores(I.pages(spark, d), asks, 64)
    return scores.select("max_tokens", "chunks", "documents", *[F.round(c, 6).alias(c) for c in ("mean_chunks", "recall_1", "recall_8", "mrr")])


@query(
    "retrieval_scores_e4",
    _CHUNKS + _QUERIES + vector_sql(24) + text_sql(24) + fused_sql(8)
    + ", vtop AS (SELECT * FROM vranked WHERE rank <= 8), ttop AS (SELECT * FROM tranked WHERE rank <= 8) "
    + " UNION ALL ".join(
        [_scores_sql("hybrid (RRF)", "franked"), _scores_sql("vector only", "vtop"), _scores_sql("full-text only", "ttop")]
    ),
)
def retrieval_scores(spark, d):
    """Three retrievers over the field queries; the expected page follows from the document."""
    asks = field_queries(spark, d).drop("vector").withColumn("pages", F.array((F.col("doc_id") % 3 + 1).cast("int")))
    scores = evaluate.retriever_scores(chunk_table(spark, d), asks, 64)
    return scores.select("retriever", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_4", "recall_8", "mrr")])


_SAID = "'The total is Rs. ' || CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS {s}) || ' for ' || CAST(o_orderkey % 40 AS {s}) || ' months, ' || CASE WHEN o_orderkey % 5 = 0 THEN 'no penalty applies' ELSE 'a fee applies' END"


def answers_table(spark, d):
    return table(spark, d, "orders").select("*", F.expr(_SAID.format(s="STRING")).alias("answer"))


@query(
    "numeric_checks_e5",
    """WITH t AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 0 WHEN o_orderkey % 4 = 1 THEN o_totalprice * 1.009 WHEN o_orderkey % 4 = 2 THEN o_totalprice * 1.03 ELSE 39.99 END AS want FROM orders)
    SELECT o_orderkey, CASE WHEN want = 0 THEN o_orderkey % 5 = 0 OR o_orderkey % 40 = 0 ELSE abs(round(o_totalprice, 2) - want) <= greatest(abs(want) * 0.01, 0.01) OR abs(o_orderkey % 40 - want) <= greatest(abs(want) * 0.01, 0.01) END AS ok FROM t""",
)
def numeric_checks(spark, d):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    want = F.when(key % 4 == 0, 0.0).when(key % 4 == 1, price * 1.009).when(key % 4 == 2, price * 1.03).otherwise(39.99)
    ok = evaluation.check_numeric(F.col("answer"), want, F.lit(None).cast("double"))
    return answers_table(spark, d).select("o_orderkey", ok.alias("ok"))


@query(
    "keyword_checks_e6",
    "SELECT doc_id, contains(lower(text), 'the') AND contains(lower(text), 'tion') AND contains(lower(text), 'one') AS ok FROM documents",
)
def keyword_checks(spark, d):
    words = F.array(F.lit("The"), F.lit("TION"), F.lit("one"))
    return table(spark, d, "documents").select("doc_id", evaluation.check_text(F.col("text"), words).alias("ok"))


_TURN_ANSWER = "text || CASE turn % 4 WHEN 1 THEN ' It does not say.' WHEN 3 THEN ' Not mentioned; no information.' ELSE '' END"


@query(
    "refusal_checks_e7",
    f"SELECT conv_id, turn, turn % 3 = 0 AND regexp_matches({_TURN_ANSWER}, '{P.REFUSAL_WORDING.replace(chr(39), chr(39) * 2)}') AS ok FROM conversations",
)
def refusal_checks(spark, d):
    ok = evaluation.check_refusal(F.expr(_TURN_ANSWER), F.col("turn") % 3)
    return table(spark, d, "conversations").select("conv_id", "turn", ok.alias("ok"))


@query(
    "answer_accuracy_e8",
    """WITH t AS (SELECT *, o_orderkey % 3 AS kind, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice * 1.05 END AS want, o_orderkey % 4 AS cites FROM orders),
    s AS (SELECT kind, CASE kind WHEN 0 THEN abs(round(o_totalprice, 2) - want) <= greatest(abs(want) * 0.01, 0.01) OR abs(o_orderkey % 40 - want) <= greatest(abs(want) * 0.01, 0.01)
        WHEN 1 THEN o_orderkey % 5 = 0 ELSE false END AS ok, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 6 = 0 END AS hit, o_orderkey % 9 = 0 AS needs_tool, o_orderkey % 10 AS calls FROM t)
    SELECT round(avg(ok::INT), 6) AS answer_accuracy, round(avg(ok::INT) FILTER (kind = 0), 6) AS numeric_accuracy, round(avg(hit::INT) FILTER (kind <> 2), 6) AS citation_accuracy,
      round(avg(ok::INT) FILTER (kind = 2), 6) AS refusal_accuracy, round(avg((calls > 0)::INT) FILTER (needs_tool), 6) AS tool_accuracy FROM s""",
)
def answer_accuracy(spark, d):
    """Numeric, text and refusal expectations dispatched over one answer table."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    kind = F.when(key % 3 == 0, "numeric").when(key % 3 == 1, "text").otherwise("not_in_document")
    want = F.when(key % 2 == 0, price).otherwise(price * 1.05)
    ok = evaluation.check_expectation(
        kind, F.col("answer"), want, F.lit(None).cast("double"), F.array(F.lit("NO penalty"), F.lit("rs.")), key % 4
    )
    scored = answers_table(spark, d).select(
        kind.alias("type"), ok.alias("ok"), F.when(key % 7 != 0, key % 6 == 0).alias("hit"),
        (key % 9 == 0).alias("needs_tool"), (key % 10).alias("tool_calls"),
    )
    accuracy = evaluation.answer_accuracy(scored)
    return accuracy.select(*[F.round(c, 6).alias(c) for c in accuracy.columns])


def truth(spark, d):
    """Ground truth of the loan responses, itself off by rule in some fields."""
    pair = lambda amount, percent: F.struct(
        F.lit(amount).cast("double").alias("amount"), F.lit(percent).cast("double").alias("percent")
    )
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("slug"), F.concat(F.lit("LENDER "), (k % 8).cast("string")).alias("lender"),
        (F.col("o_totalprice") * F.when(k % 4 == 1, 1.01).otherwise(1.001)).alias("principal"),
        (F.lit(6.0) + k % 15).alias("annual_percent"), F.lit("fixed").alias("rate_type"), F.lit("reducing").alias("method"),
        (F.lit(12) * (1 + k % 20)).cast("int").alias("tenure"), F.lit(100.0).alias("stated_emi"),
        (F.col("o_totalprice") * (k % 3) / 100).alias("processing_resolved"),
        F.when(k % 2 == 0, 500.0).alias("insurance_amount"), F.array(pair(100, None), pair(None, 0.5)).alias("others"),
        pair(None, 4).alias("prepay"), pair(None, 2).alias("late"), pair(500, None).alias("bounce"),
    )


_CLOSE = "coalesce(abs({0} - {1}) <= greatest(abs({1}) * {2}, 0.01), false)"
_TP = "(o_totalprice * CASE WHEN doc_id % 4 = 1 THEN 1.01 ELSE 1.001 END)"


@query(
    "extraction_scores_e9",
    "WITH " + LOAN_FACTS + f""", j AS (SELECT f.*, o_totalprice FROM facts f JOIN orders ON o_orderkey = doc_id),
    s AS (SELECT unnest(['lenderName', 'principal', 'interestRate.annualPercent', 'interestRate.rateType', 'interestRate.method', 'tenureMonths', 'statedEmi', 'processingFee', 'insurancePremium', 'otherUpfrontCharges.total', 'prepaymentCharges', 'latePaymentCharges', 'bounceCharges']) AS field,
      unnest([coalesce(lower(lender) = 'lender ' || CAST(doc_id % 8 AS VARCHAR), false), {_CLOSE.format('principal', _TP, 0.005)}, {_CLOSE.format('annual_rate_percent', '(6 + doc_id % 15)', 0.001)},
        rate_type = 'fixed', method = 'reducing', coalesce(tenure_months = 12 * (1 + doc_id % 20), false), false, {_CLOSE.format(f'coalesce({_TP} * fee_percent / 100, 0)', '(o_totalprice * (doc_id % 3) / 100)', 0.01)},
        {_CLOSE.format('coalesce(insurance, 0)', '(CASE WHEN doc_id % 2 = 0 THEN 500 ELSE 0 END)', 0.01)}, {_CLOSE.format(f'(CASE WHEN has_others THEN 100 + {_TP} * 0.005 ELSE 0 END)', f'(100 + {_TP} * 0.005)', 0.01)},
        {_CLOSE.format('prepay', '4', 0.001)}, {_CLOSE.format('late', '2', 0.001)}, false]) AS ok FROM j)
    SELECT field, round(avg(ok::INT), 6) AS accuracy FROM s GROUP BY field""",
)
def extraction_scores(spark, d):
    terms = parsed_loans(spark, d).withColumnRenamed("doc_id", "slug")
    scores = evaluation.field_accuracy(evaluation.score_extraction(terms, truth(spark, d)))
    return scores.withColumn("accuracy", F.round("accuracy", 6))


@query(
    "fact_checks_e10",
    "WITH " + CONTRACT_FACTS + """, n(field, needle) AS (VALUES """
    + ", ".join(f"('{f}', '{v}')" for f, v in evaluation.FACT_CHECKS)
    + """) SELECT doc_id, field, contains(lower(coalesce(value, '')), lower(needle)) AS ok FROM cf JOIN n USING (field)""",
)
def fact_checks(spark, d):
    return evaluation.check_facts(evaluation.fact_rows(parsed_contracts(spark, d)))


@query(
    "label_scores_e11",
    """WITH e AS (SELECT doc_id, 'quality' AS c FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1),
    f AS (SELECT doc_id, 'quality' AS c FROM documents WHERE n_chars > 500 UNION ALL SELECT doc_id, 'toxic' FROM documents WHERE doc_id % 9 = 0),
    p AS (SELECT l.doc_id, (SELECT count(*) FROM e WHERE e.doc_id = l.doc_id) AS expected, (SELECT count(*) FROM f WHERE f.doc_id = l.doc_id) AS found,
      (SELECT count(*) FROM e JOIN f USING (doc_id, c) WHERE e.doc_id = l.doc_id) AS hits FROM labels l)
    SELECT round(avg(CASE WHEN found > 0 THEN hits / found::DOUBLE ELSE 1 END), 6) AS precision, round(avg(CASE WHEN expected > 0 THEN hits / expected::DOUBLE ELSE 1 END), 6) AS recall FROM p""",
)
def label_scores(spark, d):
    """Labels as expected flags against a rule's flags, macro mean over the labelled documents."""
    expected, found, labels = _flags(spark, d)
    scores = evaluation.macro_scores(evaluation.set_scores(expected, found, labels))
    return scores.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def _flags(spark, d):
    labels, docs = table(spark, d, "labels"), table(spark, d, "documents")

    def flags(df, conditions):
        names = F.array_compact(F.array(*[F.when(c, n) for n, c in conditions.items()]))
        return df.select("doc_id", F.explode(names).alias("category"))

    expected = flags(labels, {"quality": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    return expected, flags(docs, {"quality": F.col("n_chars") > 500, "toxic": F.col("doc_id") % 9 == 0}), labels


@query(
    "label_differences_e11",
    """WITH e AS (SELECT doc_id, 'quality' AS category FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1),
    f AS (SELECT doc_id, 'quality' AS category FROM documents SEMI JOIN labels USING (doc_id) WHERE n_chars > 500 UNION ALL SELECT doc_id, 'toxic' FROM documents SEMI JOIN labels USING (doc_id) WHERE doc_id % 9 = 0)
    SELECT doc_id, category, 'missed' AS difference FROM e ANTI JOIN f USING (doc_id, category) UNION ALL SELECT doc_id, category, 'extra' FROM f ANTI JOIN e USING (doc_id, category)""",
)
def label_differences(spark, d):
    """Every label that the rule missed and every one that it added, on the labelled documents."""
    return evaluation.set_differences(*_flags(spark, d))


@query(
    "means_e12",
    """SELECT event_type, round(coalesce(avg(value) FILTER (value > 5), 0), 6) AS mean, coalesce(round(avg(value) FILTER (value > 1e9), 6), 0.0::DOUBLE) AS empty_mean,
      printf('%.1f', round(avg(CASE WHEN value > 5 THEN 1 ELSE 0 END) * 100, 4)) || '%' AS share FROM events GROUP BY event_type""",
)
def means(spark, d):
    from clausemill.functions.money import fraction_percent

    value = F.col("value")
    share = evaluation.mean((value > 5).cast("double"))
    return table(spark, d, "events").groupBy("event_type").agg(
        F.round(evaluation.mean(F.when(value > 5, value)), 6).alias("mean"),
        evaluation.mean(F.when(value > 1e9, value)).alias("empty_mean"),
        fraction_percent(F.round(share, 6)).alias("share"),
    )


_METRICS = """m AS (SELECT 'Retrieval recall@8 (hybrid)' AS metric, avg((o_orderkey % 10 > 0)::INT) AS value FROM orders UNION ALL SELECT 'Numeric answer accuracy', avg((o_orderkey % 4 > 0)::INT) FROM orders
  UNION ALL SELECT 'Citation accuracy', avg((o_orderkey % 6 > 0)::INT) FROM orders UNION ALL SELECT 'Not-in-document accuracy', avg((o_orderkey % 3 > 0)::INT) FROM orders
  UNION ALL SELECT 'Extraction field accuracy', avg((o_orderkey % 20 > 0)::INT) FROM orders UNION ALL SELECT 'Retrieval MRR (hybrid)', avg((o_orderkey % 2 > 0)::INT) FROM orders)"""


def metrics(spark, d):
    """Six metrics as shares of the orders."""
    moduli = {
        "Retrieval recall@8 (hybrid)": 10, "Numeric answer accuracy": 4, "Citation accuracy": 6,
        "Not-in-document accuracy": 3, "Extraction field accuracy": 20, "Retrieval MRR (hybrid)": 2,
    }
    shares = table(spark, d, "orders").agg(
        *[F.avg((F.col("o_orderkey") % n > 0).cast("double")).alias(f"m{i}") for i, n in enumerate(moduli.values())]
    )
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"m{i}").alias("value")) for i, k in enumerate(moduli)])
    return shares.select(F.inline(rows))


_LIMITS = "t(metric, threshold) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in evaluation.THRESHOLDS.items()) + ")"


@query(
    "failed_thresholds_e13",
    "WITH " + _METRICS + ", " + _LIMITS + " SELECT metric, round(value, 6) AS value, threshold FROM m JOIN t USING (metric) WHERE value < threshold",
)
def failed_thresholds(spark, d):
    return evaluation.failed_thresholds(metrics(spark, d)).withColumn("value", F.round("value", 6))


RUN = {"subset": "full", "embeddings": "feature-hash", "dimensions": "64", "top-k": "8"}


@query(
    "report_rows_e14",
    "WITH " + _METRICS + ", " + _LIMITS + """ SELECT metric, round(value, 9) AS value, '| ' || metric || ' | ' || printf('%.1f', floor(value * 1000 + 0.5) / 10) || '% | ' || coalesce(printf('%.1f', threshold * 100) || '%', '–') || ' |' AS line,
      'subset full · embeddings feature-hash · dimensions 64 · top-k 8' AS run FROM m LEFT JOIN t USING (metric)""",
)
def report_rows(spark, d):
    """The report written as JSON and Markdown and read again: values and run from the one, lines from the other."""
    folder = work_folder(spark, "report")
    evaluation.write_report(metrics(spark, d), folder, RUN)
    told = F.concat_ws(" · ", *[F.concat(F.lit(k + " "), F.col("run").getField(k)) for k in RUN])
    kind = "struct<" + ", ".join(f"`{k}`: string" for k in RUN) + ">"
    values = spark.read.schema(f"metric string, value double, threshold double, run {kind}").json(f"{folder}/json")
    lines = spark.read.text(f"{folder}/markdown").filter("value LIKE '| %' AND value NOT LIKE '| metric |%'").withColumnRenamed("value", "line")
    lines = lines.withColumn("metric", F.trim(F.split_part("line", F.lit("|"), F.lit(2))))
    return values.join(lines, "metric").select("metric", F.round("value", 9).alias("value"), "line", told.alias("run"))


@query(
    "ground_truth_e15",
    "WITH RECURSIVE " + LOANS + COSTED + f""" SELECT l.loan_id AS slug, upfront_fees AS processing, emi, {round2_sql('(pow(1 + monthly, 12) - 1) * 100')} AS ear,
      CASE WHEN l.loan_id % 2 = 0 THEN 'penal_interest,unilateral_rate_change,broad_data_sharing,one_sided_termination,cross_default,security_interest' ELSE 'auto_debit_mandate,unilateral_rate_change,broad_data_sharing,one_sided_termination,arbitration,cross_default,security_interest' END AS absent
      FROM checked l LEFT JOIN (SELECT loan_id, emi, monthly FROM costed) c USING (loan_id)""",
)
def ground_truth(spark, d):
    """Resolved fees, rates and absent risks of every order taken as a loan specification."""
    fee = F.struct(F.col("fee_amount").alias("amount"), F.col("fee_percent").alias("percent"))
    none = F.struct(F.lit(None).cast("double").alias("amount"), F.lit(None).cast("double").alias("percent"))
    k = F.col("loan_id")
    present = F.when(k % 2 == 0, F.array(F.lit("auto_debit_mandate"), F.lit("arbitration"))).otherwise(F.array(F.lit("penal_interest")))
    specs = loans(spark, d).select(
        k.alias("slug"), "principal", F.col("annual_rate_percent").alias("annual_rate"), F.col("tenure_months").alias("tenure"),
        "method", "stated_emi", fee.alias("processing"), none.alias("insurance"),
        F.array().cast("array<struct<amount:double,percent:double>>").alias("others"), present.alias("risks"),
    )
    built = evaluation.build_truth(specs)
    return built.select(
        "slug", F.col("processing_resolved").alias("processing"), "emi", F.col("effectiveAnnualRatePercent").alias("ear"),
        F.array_join("absent_risks", ",").alias("absent"),
    )

