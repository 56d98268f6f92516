"""Identifier detection, masking and unmasking over customer notes and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.functions import patterns as P
from clausemill.functions.checkdigit import verhoeff_digit, verhoeff_valid
from clausemill.operators import privacy
from clausemill.session import cut_lineage

from . import inputs as I
from .registry import query, table

EMAIL_SQL = P.EMAIL


def notes(spark, d):
    return I.kyc(spark, d)


def exploded(df, column):
    return df.select("doc_id", "page", F.explode(column).alias("s")).select(
        "doc_id", "page", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.value").alias("value")
    )


@query(
    "spans_m1",
    """WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+ing') AS hits, string_split_regex(text, '[A-Za-z]+ing') AS gaps FROM documents),
    i AS (SELECT *, unnest(range(len(hits))) AS k FROM w),
    o AS (SELECT doc_id, hits[k+1] AS value, list_sum(list_transform(gaps[1:k+1], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k], lambda x: length(x))), 0) AS s FROM i)
    SELECT doc_id, CAST(s AS INTEGER) AS span_start, CAST(s + length(value) AS INTEGER) AS span_end, value FROM o""",
)
def spans(spark, d):
    """Offsets of every match of one expression in whole documents."""
    docs = I.documents(spark, d)
    found = docs.select("doc_id", F.explode(F.expr(privacy.spans("text", "[A-Za-z]+ing", "PAN"))).alias("s"))
    return found.select("doc_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.value").alias("value"))


@query(
    "emails_m2",
    f"SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL_SQL}')) AS value FROM documents",
)
def emails(spark, d):
    docs = I.documents(spark, d)
    return docs.select("doc_id", F.explode(F.expr(privacy.spans("text", P.EMAIL, "EMAIL"))).alias("s")).select(
        "doc_id", F.col("s.value").alias("value")
    )


def _detector(name: str, kind: str):
    sql = "WITH " + I.KYC_HITS + f"""
      SELECT doc_id, page, start AS span_start, CAST(start + length(value) AS INTEGER) AS span_end, value FROM kyc_hits WHERE type = '{kind}'"""

    @query(name, sql)
    def detector(spark, d):
        return exploded(notes(spark, d), F.expr(privacy.identifier_candidates("text")[kind]))

    return detector


_detector("pan_m3", "PAN")
_detector("ifsc_m4", "IFSC")
_detector("aadhaar_m5", "AADHAAR")
_detector("account_m6", "ACCOUNT")
_detector("phone_m7", "PHONE")


@query(
    "check_digits_m8",
    f"""WITH k AS (SELECT o_orderkey, CAST(o_orderkey * 7 + 11 AS VARCHAR) AS s FROM orders),
    g AS (SELECT o_orderkey, s, CAST({I.inverse_table()}[{I.verhoeff_fold_sql('s', 1)} + 1] AS INTEGER) AS digit FROM k)
    SELECT o_orderkey, digit, {I.verhoeff_fold_sql('s', 0)} = 0 AS plain_valid, true AS made_valid FROM g""",
)
def check_digits(spark, d):
    s = F.col("s")
    keys = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 7 + 11).cast("string").alias("s"))
    keys = keys.withColumn("digit", verhoeff_digit("s"))
    keys = keys.withColumn("made", F.concat(s, F.col("digit").cast("string")))
    return keys.select(
        "o_orderkey", "digit", verhoeff_valid("s").alias("plain_valid"), verhoeff_valid("made").alias("made_valid")
    )


@query(
    "identifier_spans_m9",
    "WITH " + I.KYC_HITS + " SELECT doc_id, page, type, start AS span_start, CAST(start + length(value) AS INTEGER) AS span_end, value FROM kyc_hits",
)
def identifier_spans(spark, d):
    found = privacy.explode_spans(notes(spark, d), ["doc_id"], "page")
    return found.select("doc_id", "page", "type", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "value")


@query("identities_m10", "WITH " + I.KYC_HITS + " SELECT doc_id, page, type, key FROM kyc_hits")
def identities(spark, d):
    return privacy.explode_spans(notes(spark, d), ["doc_id"], "page").select("doc_id", "page", "type", "key")


@query("placeholders_m11", "WITH " + I.KYC_MAP + " SELECT doc_id, type, key, placeholder, original FROM kyc_map")
def placeholders(spark, d):
    found = privacy.explode_spans(notes(spark, d), ["doc_id"], "page")
    return privacy.number_placeholders(found, ["doc_id"], "page")


def masked_sql(maps: str, aadhaar_doc: str = "k.doc_id") -> str:
    """The note written with placeholders in place of the identifiers."""

    def join(kind, key):
        alias = kind.lower()
        return f"LEFT JOIN {maps} {alias} ON {alias}.doc_id = k.doc_id AND {alias}.type = '{kind}' AND {alias}.key = {key}"

    text = I.KYC_TEXT.replace("STRING", "VARCHAR").replace("CAST(page", "CAST(k.page")
    for name, kind in [("pan", "PAN"), ("ifsc", "IFSC"), ("account", "ACCOUNT"), ("phone", "PHONE"), ("email", "EMAIL")]:
        text = text.replace(f", {name},", f", {kind.lower()}.placeholder,")
    text = text.replace(", aadhaar,", ", CASE WHEN k.valid THEN aadhaar.placeholder ELSE k.aadhaar END,")
    joins = " ".join(
        join(k, v)
        for k, v in [("PAN", "k.pan"), ("IFSC", "k.ifsc"), ("ACCOUNT", "k.account"), ("PHONE", "k.mobile"), ("EMAIL", "lower(k.email)"), ("AADHAAR", "k.whole")]
    )
    return f"SELECT k.doc_id, k.page, {text} AS text FROM kyc k {joins}"


@query("masked_pages_m12", "WITH " + I.KYC_MAP + " " + masked_sql("kyc_map"))
def masked_pages(spark, d):
    pages = notes(spark, d).select("doc_id", "page", "text")
    return privacy.mask_documents(pages)[0]


@query(
    "identifier_counts_m12",
    "WITH " + I.KYC_HITS + """ SELECT doc_id, count(*) FILTER (type = 'AADHAAR') AS aadhaar, count(*) FILTER (type = 'PAN') AS pan,
      count(*) FILTER (type = 'IFSC') AS ifsc, count(*) FILTER (type = 'ACCOUNT') AS account,
      count(*) FILTER (type = 'PHONE') AS phone, count(*) FILTER (type = 'EMAIL') AS email FROM kyc_hits GROUP BY doc_id""",
)
def identifier_counts(spark, d):
    return privacy.type_counts(privacy.explode_spans(notes(spark, d), ["doc_id"], "page"), ["doc_id"])


_SEED_SQL = """, seeds AS (
    SELECT o_custkey AS doc_id, 0 AS seed_pos, '[PHONE_7]' AS placeholder, concat('+91 9', lpad(CAST(o_custkey * 3 AS VARCHAR), 9, '0')) AS original, 'PHONE' AS type, concat('9', lpad(CAST(o_custkey * 3 AS VARCHAR), 9, '0')) AS key, 7 AS n FROM orders GROUP BY o_custkey
    UNION ALL SELECT o_custkey, 1, '[EMAIL_2]', concat('User', CAST(o_custkey AS VARCHAR), '@mail1.example.com'), 'EMAIL', concat('user', CAST(o_custkey AS VARCHAR), '@mail1.example.com'), 2 FROM orders GROUP BY o_custkey),
  firsts AS (SELECT doc_id, type, key, arg_min(value, page) AS original, min(page) AS page, arg_min(start, page) AS start FROM kyc_hits GROUP BY ALL),
  fresh AS (SELECT f.* FROM firsts f ANTI JOIN seeds s USING (doc_id, type, key)),
  seeded AS (SELECT doc_id, type, key, original, '[' || type || '_' || CAST(coalesce(n, 0) + row_number() OVER (PARTITION BY doc_id, type ORDER BY page, start) AS VARCHAR) || ']' AS placeholder
    FROM fresh LEFT JOIN (SELECT doc_id, type, max(n) AS n FROM seeds GROUP BY ALL) USING (doc_id, type)
    UNION ALL SELECT doc_id, type, key, original, placeholder FROM seeds)"""


@query("seeded_masking_m13", "WITH " + I.KYC_HITS + _SEED_SQL + " " + masked_sql("seeded"))
def seeded_masking(spark, d):
    """Every customer already holds a placeholder for one phone and one e-mail, plus malformed entries."""
    seeds = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id")).distinct()
    key = F.col("doc_id").cast("string")
    phone = F.concat(F.lit("+91 9"), F.lpad((F.col("doc_id") * 3).cast("string"), 9, "0"))
    entries = F.array(
        F.struct(F.lit("[PHONE_7]").alias("placeholder"), phone.alias("original")),
        F.struct(F.lit("[EMAIL_2]").alias("placeholder"), F.concat(F.lit("User"), key, F.lit("@mail1.example.com")).alias("original")),
        F.struct(F.lit("[PASSPORT_1]").alias("placeholder"), F.lit("X").alias("original")),
        F.struct(F.lit("[PAN_first]").alias("placeholder"), F.lit("X").alias("original")),
    )
    seeds = seeds.select("doc_id", F.posexplode(entries).alias("seed_pos", "e")).select("doc_id", "seed_pos", "e.*")
    pages = notes(spark, d).select("doc_id", "page", "text")
    return privacy.mask_documents(pages, seeds=seeds)[0]


@query("masked_documents_m14", "WITH " + I.MASKED_PAGES.replace("SEMI JOIN (SELECT doc_id FROM quality WHERE page_count <= 60 AND text_pages > 0) q ON q.doc_id = f.doc_id", "") + " SELECT doc_id, page, text FROM doc_pages")
def masked_documents(spark, d):
    """Whole documents masked page by page with one numbering per document."""
    return privacy.mask_documents(I.pages(spark, d))[0]


@query("unmasked_m15", "WITH " + I.KYC_MAP + ", masked AS (" + masked_sql("kyc_map") + """),
    shown AS (SELECT doc_id, page, replace(replace(text, 'PAN [PAN_1]', 'PAN PAN_1'), 'IFSC [IFSC_1]', 'XIFSC_1') AS text FROM masked)
    SELECT k.doc_id, k.page, replace(replace(replace(replace(replace(s.text, 'PAN PAN_1', 'PAN ' || coalesce((SELECT original FROM kyc_map m WHERE m.doc_id = k.doc_id AND m.placeholder = '[PAN_1]'), '')),
      a.placeholder, a.original), p.placeholder, p.original), e.placeholder, e.original), c.placeholder, c.original) AS text
    FROM kyc k JOIN shown s USING (doc_id, page)
    JOIN kyc_map p ON p.doc_id = k.doc_id AND p.type = 'PHONE' AND p.key = k.mobile
    JOIN kyc_map e ON e.doc_id = k.doc_id AND e.type = 'EMAIL' AND e.key = lower(k.email)
    JOIN kyc_map c ON c.doc_id = k.doc_id AND c.type = 'ACCOUNT' AND c.key = k.account
    LEFT JOIN (SELECT doc_id, type, key, placeholder, original FROM kyc_map UNION ALL SELECT doc_id, 'NONE', '', 'no such text', '' FROM (SELECT DISTINCT doc_id FROM kyc)) a
      ON a.doc_id = k.doc_id AND ((k.valid AND a.type = 'AADHAAR' AND a.key = k.whole) OR (NOT k.valid AND a.type = 'NONE'))
    """.replace("coalesce((SELECT original", "coalesce((SELECT first(original)") + """ WHERE s.text NOT LIKE '%[PAN_%'
    UNION ALL SELECT k.doc_id, k.page, replace(replace(replace(replace(replace(s.text, q.placeholder, q.original), a.placeholder, a.original), p.placeholder, p.original), e.placeholder, e.original), c.placeholder, c.original)
    FROM kyc k JOIN shown s USING (doc_id, page)
    JOIN kyc_map q ON q.doc_id = k.doc_id AND q.type = 'PAN' AND q.key = k.pan
    JOIN kyc_map p ON p.doc_id = k.doc_id AND p.type = 'PHONE' AND p.key = k.mobile
    JOIN kyc_map e ON e.doc_id = k.doc_id AND e.type = 'EMAIL' AND e.key = lower(k.email)
    JOIN kyc_map c ON c.doc_id = k.doc_id AND c.type = 'ACCOUNT' AND c.key = k.account
    LEFT JOIN (SELECT doc_id, type, key, placeholder, original FROM kyc_map UNION ALL SELECT doc_id, 'NONE', '', 'no such text', '' FROM (SELECT DISTINCT doc_id FROM kyc)) a
      ON a.doc_id = k.doc_id AND ((k.valid AND a.type = 'AADHAAR' AND a.key = k.whole) OR (NOT k.valid AND a.type = 'NONE'))
    WHERE s.text LIKE '%[PAN_%'""")
def unmasked(spark, d):
    """Masked notes, some with dropped brackets or a placeholder inside a longer token, put back."""
    pages = notes(spark, d).select("doc_id", "page", "text")
    masked, numbered, _ = privacy.mask_documents(pages, kept=True)
    shown = F.replace(
        F.replace("text", F.lit("PAN [PAN_1]"), F.lit("PAN PAN_1")), F.lit("IFSC [IFSC_1]"), F.lit("XIFSC_1")
    )
    in_map = numbered.select("doc_id", F.lit(0).alias("seed_pos"), "placeholder", "original")
    return privacy.unmask_rows(masked.withColumn("text", shown), in_map, ["doc_id"], ["doc_id", "page"])


@query(
    "map_summaries_m16",
    "WITH " + I.KYC_MAP + """, per AS (SELECT doc_id, lower(type) AS t, count(*) AS n, min({'page': page, 'start': start}) AS pos FROM kyc_map GROUP BY ALL)
    SELECT doc_id, string_agg(CAST(n AS VARCHAR) || ' ' || t || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY pos) AS summary FROM per GROUP BY doc_id""",
)
def map_summaries(spark, d):
    """Map entries stand in the order their placeholders were issued; notes are searched once."""
    found = cut_lineage(privacy.explode_spans(notes(spark, d), ["doc_id"], "page").drop("end"))
    numbered = privacy.number_placeholders(found, ["doc_id"], "page")
    first = found.groupBy("doc_id", "type", "key").agg(F.min(F.col("page") * 1000 + F.col("start")).alias("seed_pos"))
    return privacy.map_summary(numbered.join(first, ["doc_id", "type", "key"]), ["doc_id"])
