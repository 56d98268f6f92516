"""Inputs that the queries derive from the given tables, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions import patterns as P
from clausemill.functions.checkdigit import inverse_table, permutation_table, product_table, verhoeff_digit
from clausemill.sources import store

from .registry import table

WS = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


# --- agreements: every document with article and section headings between its lines ---

HEADING = "TERMS OF SUPPLY"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with a task per core."""
    return store.spread(table(spark, folder, "documents"), "doc_id")


def agreements(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, text)``: a section heading before every 6th line, an article before every 12th."""
    return headed(documents(spark, folder))


def headed(docs: DataFrame) -> DataFrame:
    def with_headings(line, i):
        article = F.when(i % 12 == 0, F.concat(F.lit("ARTICLE "), F.floor(i / 12 + 1).cast("string"), F.lit("\n")))
        section = F.when(
            i % 6 == 0, F.concat(F.lit("SECTION "), F.floor(i / 6 + 1).cast("string"), F.lit(f": {HEADING}\n"))
        )
        return F.concat(F.coalesce(article, F.lit("")), F.coalesce(section, F.lit("")), line)

    text = F.array_join(F.transform(F.split("text", "\n", -1), with_headings), "\n")
    return docs.select("doc_id", text.alias("text"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return store.cut_into_pages(agreements(spark, folder))


AGREEMENTS = f"""agreements AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
    (CASE WHEN (i-1) % 12 = 0 THEN 'ARTICLE ' || CAST((i-1)//12+1 AS VARCHAR) || chr(10) ELSE '' END) ||
    (CASE WHEN (i-1) % 6 = 0 THEN 'SECTION ' || CAST((i-1)//6+1 AS VARCHAR) || ': {HEADING}' || chr(10) ELSE '' END) || l),
    chr(10)) AS text
  FROM documents)"""

PAGES = AGREEMENTS + """, doc_pages AS (
  SELECT doc_id, CAST(p + 1 AS INTEGER) AS page, array_to_string(lines[p*8+1:p*8+8], chr(10)) AS text
  FROM (SELECT doc_id, lines, unnest(range(CAST(ceil(len(lines)/8.0) AS BIGINT))) AS p
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM agreements)))"""

LINES = PAGES + f""", doc_lines AS (
  SELECT doc_id, page, CAST(i AS INTEGER) AS line_no, ls[i+1] AS text
  FROM (SELECT doc_id, page, ls, unnest(range(len(ls))) AS i FROM (
    SELECT doc_id, page, list_filter(list_transform(string_split(text, chr(10)), lambda x: {collapse('x')}),
      lambda x: x <> '') AS ls FROM doc_pages)))"""


# pages with e-mail addresses masked, the one kind of identifier the invented prose holds
MASKED_PAGES = PAGES.replace("doc_pages AS", "raw_pages AS") + f""", found AS (SELECT doc_id, page, regexp_extract_all(text, '{P.EMAIL}') AS hits, string_split_regex(text, '{P.EMAIL}') AS gaps FROM raw_pages),
  each AS (SELECT doc_id, page, unnest(range(len(hits))) AS k, hits FROM found),
  firsts AS (SELECT doc_id, lower(hits[k+1]) AS key, min(page * 100000 + k) AS pos FROM each GROUP BY ALL),
  numbered AS (SELECT doc_id, key, '[EMAIL_' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS VARCHAR) || ']' AS ph FROM firsts),
  pieces AS (SELECT e.doc_id, e.page, string_agg(f.gaps[k+1] || ph, '' ORDER BY k) AS head FROM each e JOIN found f USING (doc_id, page) JOIN numbered n ON n.doc_id = e.doc_id AND n.key = lower(e.hits[k+1]) GROUP BY ALL),
  quality AS (SELECT doc_id, count(*) AS page_count, count(*) FILTER (length(regexp_replace(text, '{WS}+', '', 'g')) >= 25) AS text_pages FROM raw_pages GROUP BY doc_id),
  doc_pages AS (SELECT f.doc_id, f.page, coalesce(head, '') || gaps[-1] AS text FROM found f LEFT JOIN pieces USING (doc_id, page)
    SEMI JOIN (SELECT doc_id FROM quality WHERE page_count <= 60 AND text_pages > 0) q ON q.doc_id = f.doc_id)"""


def heading_sql(t: str) -> str:
    return f"""(CASE WHEN length({t}) NOT BETWEEN 3 AND 80 THEN false
  WHEN regexp_matches({t}, '(?i)^(ARTICLE|CLAUSE|SECTION|SCHEDULE|ANNEXURE|ANNEX|PART|CHAPTER){WS}+(\\d+|[IVXLC]+|[A-Z])\\b[^\\n]{{0,70}}$') THEN true
  WHEN regexp_matches({t}, '^[A-Z0-9][A-Z0-9 ,&/()''-]{{3,79}}$')
    THEN len(list_filter(string_split({t}, ' '), lambda w: regexp_matches(w, '[A-Z]{{3,}}'))) >= 2
  WHEN regexp_matches({t}, '^(\\d{{1,2}}(?:\\.\\d{{1,2}}){{0,3}})[.)]?{WS}+([A-Z][^\\n]{{2,79}})$')
    THEN len(string_split(regexp_extract({t}, '^(\\d{{1,2}}(?:\\.\\d{{1,2}}){{0,3}})[.)]?{WS}+([A-Z][^\\n]{{2,79}})$', 2), ' ')) <= 10
      AND NOT regexp_matches({t}, '[.;]$')
  ELSE false END)"""


def sentences_sql(t: str) -> str:
    """Sentence pieces of a collapsed line; the spaces after abbreviations are shielded first."""
    shielded = rf"regexp_replace({t}, '(^|[^A-Za-z0-9_])(Rs|No|Mr|Ms|Mrs|Dr|Sr|Jr|vs|Ltd|Pvt|Inc|Co)([.;:]) ', '\1\2\3' || chr(2), 'g')"
    cut = rf"regexp_replace({shielded}, '([.;:]) ([A-Z0-9(\[])', '\1' || chr(1) || '\2', 'g')"
    return f"list_filter(list_transform(string_split(replace({cut}, chr(2), ' '), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


# --- know-your-customer notes: one per order, the customer is the document, the order the page ---

KYC_FIELDS = [
    "o_custkey AS doc_id",
    "o_orderkey AS page",
    "concat('ABCP', chr(CAST(65 + o_orderkey % 26 AS INT)), lpad(CAST(o_custkey % 10000 AS STRING), 4, '0'), chr(CAST(65 + o_custkey % 26 AS INT))) AS pan",
    "concat('HDFC0', lpad(CAST(o_custkey % 1000000 AS STRING), 6, '0')) AS ifsc",
    "concat('2', lpad(CAST(o_orderkey AS STRING), 10, '0')) AS base",
    "concat('1', lpad(CAST(o_custkey * 2 + o_orderkey % 2 AS STRING), 10, '0')) AS account",
    "concat('9', lpad(CAST(o_custkey * 3 + o_orderkey % 3 AS STRING), 9, '0')) AS mobile",
    "concat(CASE WHEN o_orderkey % 3 = 0 THEN 'USER' ELSE 'user' END, CAST(o_custkey AS STRING), '@mail', CAST(o_orderkey % 2 AS STRING), '.example.com') AS email",
]

KYC_TEXT = """concat('Borrower PAN ', pan, ', IFSC ', ifsc, ', Aadhaar ', aadhaar, ', account no ', account,
  ' held, phone ', phone, ', mail ', email, '; amount Rs. 9', lpad(CAST(page AS STRING), 9, '0'), ' paid.')"""

PHONE_SHOWN = """CASE WHEN page % 2 = 0 THEN concat('+91 ', substr(mobile, 1, 5), ' ', substr(mobile, 6, 5)) ELSE mobile END"""
AADHAAR_SHOWN = """CASE WHEN page % 2 = 0 THEN concat(substr(whole, 1, 4), ' ', substr(whole, 5, 4), ' ', substr(whole, 9, 4)) ELSE whole END"""


def kyc(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, page, text, pan, ifsc, aadhaar, valid, account, phone, email)``; every third Aadhaar
    carries a wrong check digit."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    df = store.spread(orders, "o_orderkey", store.UNFOLDED).selectExpr(*KYC_FIELDS)
    digit = (verhoeff_digit("base") + F.when(F.col("page") % 3 == 0, 1).otherwise(0)) % 10
    df = df.withColumn("whole", F.concat("base", digit.cast("string")))
    df = df.selectExpr("*", f"{PHONE_SHOWN} AS phone", f"{AADHAAR_SHOWN} AS aadhaar", "page % 3 <> 0 AS valid")
    return df.selectExpr("doc_id", "page", f"{KYC_TEXT} AS text", "pan", "ifsc", "aadhaar", "whole", "valid", "account", "phone", "mobile", "email")


def verhoeff_fold_sql(digits: str, shift: int) -> str:
    """Running product over the reversed digits, as one fold over a list of table indexes."""
    places = f"list_transform(string_split(reverse({digits}), ''), lambda d, i: CAST({permutation_table()}[((i - 1 + {shift}) % 8) * 10 + CAST(d AS INTEGER) + 1] AS INTEGER))"
    return f"list_reduce({places}, lambda c, v: CAST({product_table()}[c * 10 + v + 1] AS INTEGER), 0)"


KYC = (
    "kyc0 AS (SELECT "
    + ", ".join(KYC_FIELDS).replace("STRING", "VARCHAR")
    + " FROM orders), kyc1 AS (SELECT *, base || CAST(("
    + f"CAST({inverse_table()}[{verhoeff_fold_sql('base', 1)} + 1] AS INTEGER)"
    + " + CASE WHEN page % 3 = 0 THEN 1 ELSE 0 END) % 10 AS VARCHAR) AS whole FROM kyc0), "
    + f"kyc2 AS (SELECT *, {PHONE_SHOWN} AS phone, {AADHAAR_SHOWN} AS aadhaar, page % 3 <> 0 AS valid FROM kyc1), "
    + f"kyc AS (SELECT *, {KYC_TEXT.replace('STRING', 'VARCHAR')} AS text FROM kyc2)"
)

# every identifier that must be found: (type, value, identity); positions follow from the text
KYC_HITS = KYC + """, kyc_hits AS (
  SELECT doc_id, page, type, value, key, CAST(instr(text, lead || value) - 1 + length(lead) AS INTEGER) AS start
  FROM (
    SELECT doc_id, page, text, 'PAN' AS type, pan AS value, pan AS key, 'PAN ' AS lead FROM kyc
    UNION ALL SELECT doc_id, page, text, 'IFSC', ifsc, ifsc, 'IFSC ' FROM kyc
    UNION ALL SELECT doc_id, page, text, 'AADHAAR', aadhaar, whole, 'Aadhaar ' FROM kyc WHERE valid
    UNION ALL SELECT doc_id, page, text, 'ACCOUNT', account, account, 'no ' FROM kyc
    UNION ALL SELECT doc_id, page, text, 'PHONE', phone, mobile, 'phone ' FROM kyc
    UNION ALL SELECT doc_id, page, text, 'EMAIL', email, lower(email), 'mail ' FROM kyc))"""

KYC_MAP = KYC_HITS + """, kyc_map AS (
  SELECT doc_id, type, key, original,
    '[' || type || '_' || CAST(row_number() OVER (PARTITION BY doc_id, type ORDER BY page, start) AS VARCHAR) || ']' AS placeholder,
    page, start
  FROM (SELECT doc_id, type, key, arg_min(value, page) AS original, min(page) AS page, arg_min(start, page) AS start
        FROM kyc_hits GROUP BY doc_id, type, key))"""
