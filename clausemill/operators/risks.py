"""Risk clauses: pattern pre-filter, review requests, review resolution and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsonspec as J
from ..functions import text as X
from ..functions.patterns import ascii_edges
from ..functions.plan import settle
from ..functions.risk_rules import CONTRACT_CATEGORIES, LOAN_CATEGORIES, RULES, SEVERITIES
from .answers import join_in_order
from .retrieval import top_k

CANDIDATES_PER_CATEGORY = 2
REVIEW = {
    "candidate": "int", "present": "bool", "severity": ("low", "medium", "high"), "title": "string",
    "explanation": "string",
}


def category_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """``(category, category_ord, label, question, for_loan, for_contract)``, a handful of fixed rows."""
    rows = [
        (c, i, label, question, c in LOAN_CATEGORIES, c in CONTRACT_CATEGORIES)
        for i, (c, label, question, _) in enumerate(rules)
    ]
    schema = "category string, category_ord int, label string, question string, for_loan boolean, for_contract boolean"
    return spark.createDataFrame(rows, schema)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """``(category, category_ord, pattern_ord, regex)``."""
    rows = [(c, i, j, p) for i, (c, _, _, patterns) in enumerate(rules) for j, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "category string, category_ord int, pattern_ord int, regex string")


def _matches(text: Column, patterns) -> Column:
    flags = [text.rlike("(?i)" + ascii_edges(p)).cast("int") for p in patterns]
    return sum(flags[1:], flags[0])


def in_scope(category: Column, kind: Column) -> Column:
    """Whether a document kind is reviewed for a category; general documents get no review."""
    return ((kind == "loan") & category.isin(*LOAN_CATEGORIES)) | (
        (kind == "contract") & category.isin(*CONTRACT_CATEGORIES)
    )


def category_matches(chunks: DataFrame, rules=RULES, text: str = "content", scoped: bool = False) -> DataFrame:
    """Chunk rows times categories with at least one matching pattern; literal patterns compile once.

    With ``scoped`` only the categories that the chunk's ``kind`` is reviewed for are searched.
    """

    def matches(category: str, patterns) -> Column:
        found = _matches(F.col(text), patterns)
        return F.when(in_scope(F.lit(category), F.col("kind")), found) if scoped else found

    entries = [
        F.struct(F.lit(i).alias("category_ord"), F.lit(c).alias("category"), matches(c, p).alias("matches"))
        for i, (c, _, _, p) in enumerate(rules)
    ]
    exploded = chunks.select("*", F.explode(F.filter(F.array(*entries), lambda e: e.matches > 0)).alias("m"))
    return exploded.select(*chunks.columns, "m.category_ord", "m.category", "m.matches")


def find_candidates(chunks: DataFrame, rules=RULES, per_category: int = CANDIDATES_PER_CATEGORY) -> DataFrame:
    """Best chunks per document and category for ``chunks(doc_id, kind, chunk_index, …)``, numbered in rule
    order as ``candidate``."""
    wanted = category_matches(chunks, rules, scoped=True)
    best = top_k(wanted, ["doc_id", "category_ord"], [F.desc("matches"), F.asc("chunk_index")], per_category)
    order = Window.partitionBy("doc_id").orderBy("category_ord", "rank")
    return best.withColumn("candidate", F.row_number().over(order))


def review_prompts(candidates: DataFrame, rules=RULES) -> DataFrame:
    """``(doc_id, candidates, prompt)``: at most two passages per category, so a bounded text."""

    def looked_up(values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("category_ord") + 1)

    head = F.concat(
        F.lit("Candidate "), F.col("candidate").cast("string"), F.lit(" | risk: "), looked_up([r[1] for r in rules]),
        F.lit(" | check: "), looked_up([r[2] for r in rules]), F.lit("\n"),
    )
    where = X.passage_header(F.lit(0), F.col("page_start"), F.col("page_end"), F.col("clause_title"))
    text = F.concat(head, F.regexp_replace(where, r"^\[0\] ", ""), F.lit("\n"), F.col("content"))
    joined = candidates.groupBy("doc_id").agg(
        F.count("*").alias("candidates"), join_in_order("candidate", text).alias("body")
    )
    tail = F.concat(F.lit("\n\nReview all "), F.col("candidates").cast("string"), F.lit(" candidates."))
    return joined.select("doc_id", "candidates", F.concat("body", tail).alias("prompt"))


def parse_reviews(responses: DataFrame) -> DataFrame:
    """``responses(doc_id, raw)`` plus ``reviews`` (null when malformed) and ``error``."""
    df = responses.selectExpr("*", f"{J.parse('raw')} AS _root")
    # where every item's schema shows that it fits, the reviews are read in one step; the others are looked at closer
    quick = settle(df.selectExpr("*", f"{J.quick_array('_root', 'reviews', REVIEW)} AS _quick"), ["_root", "_quick"])
    issues = J.array_issues("_root", "reviews", REVIEW)
    bad = f"CASE WHEN _quick IS NOT NULL THEN false ELSE coalesce(size({issues}) > 0, true) END"
    checked = settle(quick.selectExpr("*", f"{bad} AS _bad"), ["_root", "_quick", "_bad"])
    read = checked.selectExpr(
        *responses.columns,
        f"CASE WHEN NOT _bad THEN coalesce(_quick, {J.array_structs('_root', 'reviews', REVIEW)}) END AS reviews",
        "CASE WHEN _bad THEN 'LLM_BAD_RESPONSE' END AS error",
    )
    return settle(read, ["reviews", "error"])


def resolve_reviews(parsed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Flags ``(doc_id, category, severity, title, explanation, citation columns)``: the first present
    review of each category in response order."""
    rows = parsed.select("doc_id", F.posexplode("reviews").alias("pos", "r")).select("doc_id", "pos", "r.*")
    at = candidates.select(
        "doc_id", "candidate", "category", "category_ord", "chunk_id", F.col("page_start").alias("page"), "page_end",
        "clause_title", X.quote("content").alias("quote"),
    )
    present = rows.filter("present").join(at, ["doc_id", "candidate"])
    return top_k(present, ["doc_id", "category"], [F.asc("pos")], 1).drop("rank", "present", "pos")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.lit(list(SEVERITIES)), severity) - 1


def flags_per_document(flags: DataFrame) -> DataFrame:
    """``(doc_id, risk_flags)``: flags by severity, then category; at most one per category."""
    entry = F.struct(
        severity_rank(F.col("severity")).alias("o"), "category_ord",
        F.struct("category", "severity", "title", "explanation", "chunk_id", "page", "page_end", "clause_title", "quote").alias("flag"),
    )
    return flags.groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.flag).alias("risk_flags")
    )


def flag_order(flags: DataFrame) -> DataFrame:
    """Add the 1-based ``position`` of each flag within its document."""
    order = Window.partitionBy("doc_id").orderBy(severity_rank(F.col("severity")), "category_ord")
    return flags.withColumn("position", F.row_number().over(order))


def describe(flags: Column, separator: str = "; ") -> Column:
    """``not assessed``, ``none found`` or the list of ``severity: title``."""
    listed = F.transform(flags, lambda f: F.concat(f.severity, F.lit(": "), f.title))
    return (
        F.when(flags.isNull(), "not assessed")
        .when(F.size(flags) == 0, "none found")
        .otherwise(F.array_join(listed, separator))
    )
