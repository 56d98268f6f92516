"""Risk pre-filter over documents with English stand-in patterns, and reviews written by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.functions.risk_rules import CONTRACT_CATEGORIES, LOAN_CATEGORIES, RULES
from clausemill.operators import layout, risks
from clausemill.sources import store

from . import inputs as I
from .registry import query, table

# the corpus is invented prose: each category looks for word shapes that occur in it
DEMO_RULES = tuple(
    (category, label, question, patterns)
    for (category, label, question, _), patterns in zip(
        RULES,
        [
            (r"\bthe\b", r"ation", r"\bof the\b"), (r"\bin\b[^.]{0,40}\bto\b", r"ing\b"), (r"tion[^.]{0,30}ent",),
            (r"\bhe\b", r"\bshe\b|\bit\b"), (r"ight", r"ould"), (r"\band\b[^.]{0,20}\bthe\b",), (r"\bwith\b", r"\bas\b"),
            (r"er\b", r"est\b", r"ly\b"), (r"\bfor\b[^.]{0,60}\bof\b",), (r"\bthis\b",), (r"\bis\b", r"\bare\b"), (r"able",),
            (r"ble\b", r"ive\b"), (r"\bbe\b",), (r"\bor\b", r"\bnot\b", r"\bno\b"),
        ],
    )
)
_KIND = "CASE doc_id % 3 WHEN 0 THEN 'loan' WHEN 1 THEN 'contract' ELSE 'general' END"


def chunks(spark, d):
    """Collapsed lines of the paged documents as chunks, with a kind by rule."""
    lines = layout.page_lines(I.pages(spark, d))
    index = F.col("page") * 1000 + F.col("line_no")
    return lines.select(
        "doc_id", F.expr(_KIND).alias("kind"), F.concat(F.col("doc_id").cast("string"), F.lit(":"), index.cast("string")).alias("chunk_id"),
        index.alias("chunk_index"), F.col("page").alias("page_start"), F.col("page").alias("page_end"),
        F.lit(None).cast("string").alias("clause_title"), F.col("text").alias("content"),
    )


def _scope() -> str:
    loan = ", ".join(f"'{c}'" for c in LOAN_CATEGORIES)
    contract = ", ".join(f"'{c}'" for c in CONTRACT_CATEGORIES)
    return f"((kind = 'loan' AND category IN ({loan})) OR (kind = 'contract' AND category IN ({contract})))"


def _hits(patterns) -> str:
    return " + ".join(f"CAST(regexp_matches(text, '(?i){p}') AS INTEGER)" for p in patterns)


CANDIDATES = I.LINES + f""", ch AS (SELECT doc_id, {_KIND} AS kind, page, page * 1000 + line_no AS chunk_index, text FROM doc_lines),
  scored AS ({" UNION ALL ".join(f"SELECT doc_id, kind, page, chunk_index, text, {i} AS category_ord, '{c}' AS category, {_hits(p)} AS matches FROM ch" for i, (c, _, _, p) in enumerate(DEMO_RULES))}),
  best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category_ord ORDER BY matches DESC, chunk_index) AS rank FROM scored WHERE matches > 0 AND {_scope()} QUALIFY rank <= 2),
  cand AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY category_ord, rank) AS candidate FROM best)"""


def candidates(spark, d):
    return risks.find_candidates(chunks(spark, d), DEMO_RULES)


@query("category_scope_k2",
    f"""WITH cats(category) AS (VALUES {", ".join(f"('{r[0]}')" for r in RULES)}), docs AS (SELECT doc_id, {_KIND} AS kind FROM documents)
    SELECT doc_id, kind, count(*) FILTER ({_scope()}) AS categories FROM docs, cats GROUP BY doc_id, kind""")
def category_scope(spark, d):
    """How many categories are reviewed per document: eight, eleven or none."""
    docs = table(spark, d, "documents").select("doc_id", F.expr(_KIND).alias("kind"))
    wanted = F.filter(F.array(*[F.lit(r[0]) for r in RULES]), lambda c: risks.in_scope(c, F.col("kind")))
    return docs.select("doc_id", "kind", F.size(wanted).cast("bigint").alias("categories"))


# agreement sentences; every order strings three of them together by its key
SENTENCES = (
    "The Borrower shall sign a NACH form on the day of drawing.", "Each instalment is taken by auto debit.",
    "The mandate stays in force and the Borrower may not revoke it.", "Penal interest runs on every late rupee.",
    "Amounts overdue carry interest at 3% per month.", "Unpaid sums are compounded monthly and capitalised.",
    "The Lender may at its sole discretion revise the spread.", "Charges may change without prior notice, as may the vary of any fee.",
    "Data may be shared with group companies.", "The Lender may cross-sell other products.",
    "The Lender may recall the loan at any time.", "The Lender may repossess the vehicle.",
    "Disputes go to arbitration in Pune.", "A default under any other facility is a default here.",
    "The car is hypothecated and a lien is marked.", "The term is automatically renewed unless a notice is given.",
    "A lock-in of one year applies.", "The deposit is forfeited in full.", "The Tenant shall indemnify and hold harmless the Owner.",
    "Non-compete terms bind the Employee.", "In no event is the Owner liable.", "The Owner may amend the rules from time to time.",
    "Rent falls due on the fifth.", "Keys are handed over on payment.", "The borrower reads, the lender writes.",
)
_PICKS = ("o_orderkey % 25", "(o_orderkey * 7 + 3) % 25", "(o_orderkey * 11 + o_custkey) % 25")


def clauses(spark, d):
    """Orders as clauses of their customer's agreement."""
    orders = store.spread(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", store.UNFOLDED)
    sentences = F.array(*[F.lit(x) for x in SENTENCES])
    text = F.concat_ws(" ", *[F.get(sentences, F.expr(p).cast("int")) for p in _PICKS])
    kind = F.expr(_KIND.replace("doc_id", "o_custkey"))
    return orders.select(
        F.col("o_custkey").alias("doc_id"), kind.alias("kind"), F.col("o_orderkey").alias("chunk_index"), text.alias("content")
    )


def _real_hits(patterns) -> str:
    return " + ".join("CAST(regexp_matches(text, '(?i)" + p.replace("'", "''") + "') AS INTEGER)" for p in patterns)


CLAUSES = (
    "texts AS (SELECT o_custkey AS doc_id, "
    + _KIND.replace("doc_id", "o_custkey")
    + " AS kind, o_orderkey AS chunk_index, "
    + " || ' ' || ".join(f"s[{p} + 1]" for p in _PICKS)
    + " AS text FROM orders, (SELECT ["
    + ", ".join("'" + x.replace("'", "''") + "'" for x in SENTENCES)
    + "] AS s)), real AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, kind, chunk_index, {i} AS category_ord, '{c}' AS category, {_real_hits(p)} AS matches FROM texts"
        for i, (c, _, _, p) in enumerate(RULES)
    )
    + ")"
)


@query("risk_rule_hits_k1", "WITH " + CLAUSES + " SELECT category, matches, count(*) AS clauses FROM real WHERE matches > 0 GROUP BY ALL")
def risk_rule_hits(spark, d):
    """All sixty-three real patterns over clauses of agreement wording."""
    hits = risks.category_matches(clauses(spark, d))
    return hits.groupBy("category", "matches").agg(F.count("*").alias("clauses"))


@query(
    "agreement_risk_candidates_k3",
    "WITH " + CLAUSES + f""", best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category_ord ORDER BY matches DESC, chunk_index) AS rank FROM real WHERE matches > 0 AND {_scope()} QUALIFY rank <= 2)
    SELECT doc_id, category, chunk_index, matches, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY category_ord, rank) AS INTEGER) AS candidate FROM best""",
)
def agreement_risk_candidates(spark, d):
    """Two best clauses per customer and category with the real patterns."""
    return risks.find_candidates(clauses(spark, d)).select("doc_id", "category", "chunk_index", "matches", "candidate")


@query("risk_candidates_k3", "WITH " + CANDIDATES + " SELECT doc_id, category, chunk_index, CAST(matches AS INTEGER) AS matches, CAST(candidate AS INTEGER) AS candidate FROM cand")
def risk_candidates(spark, d):
    return candidates(spark, d).select("doc_id", "category", "chunk_index", "matches", "candidate")


def _lookup(values) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}][category_ord + 1]"


@query(
    "review_prompts_k4",
    "WITH " + CANDIDATES + f""" SELECT doc_id, count(*) AS candidates, string_agg('Candidate ' || CAST(candidate AS VARCHAR) || ' | risk: ' || {_lookup([r[1] for r in RULES])} || ' | check: ' || {_lookup([r[2] for r in RULES])}
      || chr(10) || '(page ' || CAST(page AS VARCHAR) || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY candidate) || chr(10) || chr(10) || 'Review all ' || CAST(count(*) AS VARCHAR) || ' candidates.' AS prompt FROM cand GROUP BY doc_id""",
)
def review_prompts(spark, d):
    return risks.review_prompts(candidates(spark, d), DEMO_RULES)


# reviews by rule: candidate 0 and 99 are out of range, some are absent, every 7th document is malformed
_REVIEWS = """CASE WHEN doc_id % 7 = 3 THEN '{"reviews":[{"candidate":1,"present":"yes"}]}' ELSE concat('{"reviews":[', array_join(transform(sequence(0, 30), i ->
  concat('{"candidate":', CAST(CASE WHEN i = 30 THEN 99 ELSE (i * 7 + doc_id) % 30 END AS STRING), ',"present":', CASE WHEN (i + doc_id) % 3 = 0 THEN 'false' ELSE 'true' END,
   ',"severity":"', element_at(array('low', 'medium', 'high'), CAST((i + doc_id) % 3 AS INT) + 1), '","title":"T', CAST(i AS STRING), '","explanation":"E"}')), ','), ']}') END"""


def reviews(spark, d):
    docs = store.spread(table(spark, d, "documents").select("doc_id"), "doc_id")
    return risks.parse_reviews(docs.select("doc_id", F.expr(_REVIEWS).alias("raw")))


FLAGS = CANDIDATES + """, rev AS (SELECT doc_id, i, CASE WHEN i = 30 THEN 99 ELSE (i * 7 + doc_id) % 30 END AS candidate, (i + doc_id) % 3 <> 0 AS present,
      ['low', 'medium', 'high'][(i + doc_id) % 3 + 1] AS severity, 'T' || CAST(i AS VARCHAR) AS title FROM documents, range(31) r(i) WHERE doc_id % 7 <> 3),
  flags AS (SELECT r.doc_id, c.category, c.category_ord, r.severity, r.title, c.page FROM rev r JOIN cand c USING (doc_id, candidate) WHERE present
      QUALIFY row_number() OVER (PARTITION BY r.doc_id, c.category ORDER BY i) = 1),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, category_ord) AS position FROM flags)"""


@query("resolved_reviews_k5",
    "WITH " + FLAGS + """ SELECT doc_id, category, severity, title, CAST(page AS INTEGER) AS page, CAST(NULL AS VARCHAR) AS error FROM flags
    UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, 'LLM_BAD_RESPONSE' FROM documents WHERE doc_id % 7 = 3""")
def resolved_reviews(spark, d):
    parsed = reviews(spark, d)
    flags = risks.resolve_reviews(parsed, candidates(spark, d)).select("doc_id", "category", "severity", "title", "page")
    bad = parsed.filter("error IS NOT NULL").select("doc_id", "error")
    return flags.withColumn("error", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


@query("ordered_flags_k6", "WITH " + FLAGS + " SELECT doc_id, category, severity, CAST(position AS INTEGER) AS position FROM ordered")
def ordered_flags(spark, d):
    flags = risks.resolve_reviews(reviews(spark, d), candidates(spark, d))
    return risks.flag_order(flags).select("doc_id", "category", "severity", "position")


@query("risk_summaries_k7",
    "WITH " + FLAGS + """, s AS (SELECT doc_id, string_agg(severity || ': ' || title, '; ' ORDER BY position) AS txt FROM ordered GROUP BY doc_id)
    SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 'not assessed' ELSE coalesce(txt, 'none found') END AS risks FROM documents LEFT JOIN s USING (doc_id)""")
def risk_summaries(spark, d):
    """A document whose review failed counts as not assessed, never as free of risks."""
    parsed = reviews(spark, d)
    flags = risks.flags_per_document(risks.resolve_reviews(parsed, candidates(spark, d)))
    joined = parsed.join(flags, "doc_id", "left")
    none = F.array().cast(joined.schema["risk_flags"].dataType)
    found = F.when(F.col("error").isNull(), F.coalesce("risk_flags", none))
    return joined.select("doc_id", risks.describe(found).alias("risks"))
