"""Sections, folding, packing and chunks of the derived agreements."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.functions import patterns as P
from clausemill.operators import chunking
from clausemill.plans import samples
from clausemill.plans.ingest import ingest
from clausemill.session import work_folder
from clausemill.sources import store
from clausemill.sources.tables import Store
from clausemill.streaming import uploads

from . import inputs as I
from .registry import query, table, table_path

# sections as the headings cut them, over whole documents
SECTIONS = I.LINES + f""", headed AS (SELECT *, {I.heading_sql('text')} AS h FROM doc_lines),
  cut AS (SELECT *, sum(CAST(h AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY page, line_no) AS s FROM headed),
  secs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS sec, title, page_start, page_end, content FROM (
    SELECT doc_id, s, max(CASE WHEN h THEN text END) AS title, min(page) AS page_start, max(page) AS page_end,
      string_agg(text, chr(10) ORDER BY page, line_no) AS content FROM cut GROUP BY doc_id, s))"""

# folding is a walk over the sections of a document, the pending text carried along
FOLDED = SECTIONS + """, last AS (SELECT doc_id, max(sec) AS last FROM secs GROUP BY doc_id),
  walk AS (
    SELECT doc_id, sec, title, page_start, page_end, content, (ceil(length(content) / 4.0) < 15 AND sec < last) AS pending
    FROM secs JOIN last USING (doc_id) WHERE sec = 0
    UNION ALL
    SELECT s.doc_id, s.sec,
      CASE WHEN w.pending THEN CASE WHEN w.title IS NOT NULL AND s.title IS NOT NULL THEN w.title || ' > ' || s.title ELSE coalesce(s.title, w.title) END ELSE s.title END,
      CASE WHEN w.pending THEN w.page_start ELSE s.page_start END, s.page_end,
      CASE WHEN w.pending THEN w.content || chr(10) || s.content ELSE s.content END,
      (ceil(length(CASE WHEN w.pending THEN w.content || chr(10) || s.content ELSE s.content END) / 4.0) < 15 AND s.sec < l.last)
    FROM walk w JOIN secs s ON s.doc_id = w.doc_id AND s.sec = w.sec + 1 JOIN last l ON l.doc_id = s.doc_id),
  units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS unit, title, page_start, page_end, content FROM walk WHERE NOT pending)"""


def packed_sql(cap: int, overlap: int) -> str:
    """Windows over sentence pieces: the end by summing forward, the step back by summing backward."""
    pieces = I.sentences_sql("line")
    return f""", marked AS (SELECT w.doc_id, w.sec, c.page, c.line_no, c.text AS line,
      max(w2.sec) AS filler FROM walk w JOIN cut0 c ON c.doc_id = w.doc_id AND c.sec = w.sec JOIN walk w2 ON w2.doc_id = w.doc_id AND w2.sec = w.sec GROUP BY ALL),
  unit_of AS (SELECT doc_id, sec, sum(CASE WHEN prev THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS unit FROM (
      SELECT doc_id, sec, coalesce(lag(pending) OVER (PARTITION BY doc_id ORDER BY sec), false) AS prev FROM walk)),
  long_units AS (SELECT * FROM units WHERE ceil(length(content) / 4.0) > {cap}),
  segs AS (SELECT doc_id, unit, list(piece ORDER BY page, line_no, k) AS ps, list(page ORDER BY page, line_no, k) AS pgs FROM (
      SELECT m.doc_id, u.unit, m.page, m.line_no, unnest({pieces.replace('line', 'm.line')}) AS piece, unnest(range(len({pieces.replace('line', 'm.line')}))) AS k
      FROM marked m JOIN unit_of u USING (doc_id, sec) SEMI JOIN long_units l ON l.doc_id = m.doc_id AND l.unit = u.unit) GROUP BY doc_id, unit),
  costed AS (SELECT s.doc_id, s.unit, ps, pgs, title, list_transform(ps, lambda p: CAST(ceil(length(p) / 4.0) AS BIGINT) + 1) AS cs,
      CASE WHEN title IS NULL THEN 0 ELSE CAST(ceil(length(title) / 4.0) AS BIGINT) + 1 END AS head FROM segs s JOIN long_units USING (doc_id, unit)),
  summed AS (SELECT *, list_transform(range(len(cs) + 1), lambda i: coalesce(list_sum(cs[1:i]), 0)) AS acc FROM costed),
  wins AS (
    SELECT doc_id, unit, CAST(0 AS BIGINT) AS w0, greatest(CAST(1 AS BIGINT), CAST(len(list_filter(acc[2:], lambda a: a + head <= {cap})) AS BIGINT)) AS w1 FROM summed
    UNION ALL
    SELECT s.doc_id, s.unit, nxt, greatest(nxt + 1, CAST(len(list_filter(acc[2:], lambda a: a - acc[nxt+1] + head <= {cap})) AS BIGINT)) FROM (
      SELECT w.doc_id, w.unit, greatest(w0 + 1, CAST(len(list_filter(acc, lambda a: a <= acc[w1+1] - {overlap})) AS BIGINT) - 1) AS nxt
      FROM wins w JOIN summed s0 USING (doc_id, unit) WHERE w1 < len(cs)) n JOIN summed s ON s.doc_id = n.doc_id AND s.unit = n.unit),
  split AS (SELECT w.doc_id, w.unit, w0, title, pgs[w0+1] AS page_start, pgs[w1] AS page_end,
      CASE WHEN title IS NOT NULL AND w0 > 0 THEN title || chr(10) ELSE '' END || array_to_string(ps[w0+1:w1], ' ') AS content FROM wins w JOIN summed s USING (doc_id, unit)),
  chunk_rows AS (SELECT doc_id, unit, 0 AS w0, title, page_start, page_end, content FROM units WHERE ceil(length(content) / 4.0) <= {cap}
      UNION ALL SELECT doc_id, unit, w0, title, page_start, page_end, content FROM split),
  chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY unit, w0) - 1 AS INTEGER) AS chunk_index, title AS clause_title,
      CAST(page_start AS INTEGER) AS page_start, CAST(page_end AS INTEGER) AS page_end, content, CAST(ceil(length(content) / 4.0) AS INTEGER) AS token_count FROM chunk_rows)"""


CUT0 = """, cut0 AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS sec, page, line_no, text FROM cut)"""


def chunks_sql(cap: int = 400, overlap: int = 60) -> str:
    return "WITH RECURSIVE " + FOLDED + CUT0 + packed_sql(cap, overlap)


SECTION_COLUMNS = "doc_id, CAST({n} AS INTEGER) AS section_no, title, CAST(page_start AS INTEGER) AS page_start, CAST(page_end AS INTEGER) AS page_end, content, CAST(ceil(length(content) / 4.0) AS INTEGER) AS token_count"


@query("sections_c1", "WITH " + SECTIONS + " SELECT " + SECTION_COLUMNS.format(n="sec") + " FROM secs")
def sections(spark, d):
    return chunking.page_sections(I.pages(spark, d), min_tokens=0)


@query("folded_sections_c2", "WITH RECURSIVE " + FOLDED + " SELECT " + SECTION_COLUMNS.format(n="unit") + " FROM units")
def folded_sections(spark, d):
    return chunking.page_sections(I.pages(spark, d))


CHUNK_COLUMNS = ["doc_id", "chunk_index", "clause_title", "page_start", "page_end", "content", "token_count"]


@query(
    "whole_section_chunks_c3",
    chunks_sql() + " SELECT doc_id, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS tokens FROM chunks WHERE token_count <= 400 GROUP BY doc_id",
)
def whole_section_chunks(spark, d):
    small = chunking.chunk_documents(I.pages(spark, d)).filter("token_count <= 400")
    return small.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))


@query(
    "packed_windows_c4",
    chunks_sql(120, 30) + " SELECT doc_id, chunk_index, clause_title, page_start, page_end, content, token_count FROM chunks",
)
def packed_windows(spark, d):
    """A cap of 120 tokens, so that most sections are split into overlapping windows."""
    return chunking.chunk_documents(I.pages(spark, d), 120, 30).select(*CHUNK_COLUMNS)


@query("chunks_c5", chunks_sql() + " SELECT doc_id, chunk_index, clause_title, page_start, page_end, content, token_count FROM chunks")
def chunks(spark, d):
    return chunking.chunk_documents(I.pages(spark, d)).select(*CHUNK_COLUMNS)


def ingested_sql() -> str:
    """Documents behind the gate: masked, chunked, fingerprinted, classified by the agreement vocabulary."""
    loan = [f"len(regexp_extract_all(lower(content), '{p}'))" for p in P.LOAN_SIGNALS]
    contract = [f"len(regexp_extract_all(lower(content), '{p}'))" for p in P.CONTRACT_SIGNALS]
    sums = ", ".join(f"sum({c}) AS s{i}" for i, c in enumerate(loan + contract))
    n = len(loan)
    ls, cs = [f"s{i}" for i in range(n)], [f"s{i}" for i in range(n, n + len(contract))]

    def distinct(xs):
        return " + ".join(f"({x} > 0)::INT" for x in xs)

    return chunks_sql().replace(I.PAGES, I.MASKED_PAGES) + f""", counted AS (SELECT doc_id, count(*) AS n, sum(len(list_filter(string_split_regex(content, '{I.WS}+'), lambda w: w <> ''))) AS words, {sums} FROM chunks GROUP BY doc_id),
      kinds AS (SELECT doc_id, n, CASE WHEN ({" + ".join(cs)}) / greatest(words, 1)::DOUBLE * 1000 >= 10 AND {distinct(cs)} >= 4 THEN
          CASE WHEN ({" + ".join(ls)}) / greatest(words, 1)::DOUBLE * 1000 >= 12 AND {distinct(ls)} >= 5 THEN 'loan' ELSE 'contract' END ELSE 'general' END AS kind FROM counted),
      hashes AS (SELECT doc_id, sha256(string_agg(text, chr(12) ORDER BY page)) AS content_hash FROM doc_pages GROUP BY doc_id)
    SELECT doc_id, content_hash, CAST(n AS INTEGER) AS chunk_count, kind, 'pdf' AS source_type, CAST(page_count AS INTEGER) AS page_count,
      CASE WHEN text_pages < page_count THEN CAST(page_count - text_pages AS VARCHAR) || ' of ' || CAST(page_count AS VARCHAR) || ' pages had no extractable text and were skipped.' END AS warning, 'parsed' AS status
    FROM kinds JOIN hashes USING (doc_id) JOIN quality USING (doc_id)"""


@query("ingested_documents_c6", ingested_sql())
def ingested_documents(spark, d):
    """Mask, chunk, fingerprint and classify every document behind the page gate."""
    return ingest(I.pages(spark, d)).documents


_FILE = "CASE doc_id % 5 WHEN 0 THEN 'scan_' || CAST(doc_id AS {s}) || '.pdf' WHEN 1 THEN 'Offer-Letter_' || CAST(doc_id AS {s}) || '.DOCX' WHEN 2 THEN 'notes.txt' ELSE CAST(doc_id AS {s}) || '.pdf' END"


@query(
    "uploads_c6",
    "WITH " + I.PAGES + f""", files AS (SELECT doc_id, {_FILE.format(s='VARCHAR')} AS f FROM documents),
    typed AS (SELECT doc_id, CASE WHEN f LIKE '%.pdf' THEN 'pdf' WHEN f LIKE '%.DOCX' THEN 'docx' END AS source_type,
      trim(regexp_replace(regexp_replace(f, '\\.[^.]+$', ''), '[_-]+', ' ', 'g')) AS title FROM files),
    counted AS (SELECT doc_id, count(*) AS n, count(*) FILTER (length(regexp_replace(text, '{I.WS}+', '', 'g')) >= 25) AS textual FROM doc_pages WHERE doc_id % 7 <> 3 GROUP BY doc_id)
    SELECT doc_id, CASE WHEN reject IS NULL THEN title END AS title, CASE WHEN reject IS NULL THEN source_type END AS source_type, reject FROM (SELECT *,
      CASE WHEN source_type IS NULL THEN 'UNSUPPORTED_TYPE' WHEN source_type = 'pdf' AND n > 4 THEN 'TOO_MANY_PAGES' WHEN coalesce(textual, 0) = 0 AND source_type = 'pdf' THEN 'SCANNED_PDF'
        WHEN coalesce(textual, 0) = 0 THEN 'EMPTY_DOCUMENT' END AS reject FROM typed LEFT JOIN counted USING (doc_id))""",
)
def ingested_uploads(spark, d):
    """Documents as uploaded files of several types, a limit of four pages, every seventh without pages: one row for each."""
    files = table(spark, d, "documents").selectExpr("doc_id", f"{_FILE.format(s='STRING')} AS file_name", "'' AS mime_type")
    done = ingest(I.pages(spark, d).filter("doc_id % 7 <> 3"), files, max_pages=4, checkpoint=True)
    nothing = F.lit(None).cast("string")
    accepted = done.documents.select("doc_id", "title", "source_type", nothing.alias("reject"))
    return accepted.unionByName(done.rejects.select("doc_id", nothing.alias("title"), nothing.alias("source_type"), "reject"))


def sample_load_sql() -> str:
    """The documents behind the gate that are in the index, with the number of their identifiers."""
    gated = ingested_sql().rsplit("SELECT doc_id, content_hash", 1)[0]
    return gated + """ SELECT doc_id, 'slug-' || CAST(doc_id AS VARCHAR) AS slug, CAST(n AS INTEGER) AS chunk_count, kind, CAST(coalesce(ids, 0) AS BIGINT) AS identifiers
      FROM kinds LEFT JOIN (SELECT doc_id, count(*) AS ids FROM numbered GROUP BY doc_id) USING (doc_id) WHERE doc_id % 3 = 0"""


@query("sample_load_s15", sample_load_sql())
def sample_load(spark, d):
    """Every third document as a sample: a load of half of them, then two of all; chunks as they are stored in the end."""
    texts = I.pages(spark, d)
    index = table(spark, d, "documents").filter("doc_id % 3 = 0").selectExpr("doc_id", "concat('slug-', CAST(doc_id AS STRING)) AS slug", "concat('Sample ', CAST(doc_id AS STRING)) AS title")
    created = F.lit("2024-01-02 00:00:00").cast("timestamp")
    held = Store(spark, work_folder(spark, "samples"), buckets=8)
    samples.empty_store(held, texts, created)
    samples.load_samples(held, index.filter("doc_id % 2 = 0"), texts, "half", created)
    samples.load_samples(held, index, texts, "all", created)
    done = samples.load_samples(held, index, texts, "again", created)
    chunks_ = done.chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
    ids = done.pii_map.groupBy("doc_id").agg(F.count("*").alias("identifiers"))
    rows = done.documents.drop("chunk_count").join(chunks_, "doc_id").join(ids, "doc_id", "left").fillna(0, ["identifiers"])
    return rows.select("doc_id", F.col("sample_slug").alias("slug"), "chunk_count", "kind", "identifiers")


@query("streamed_documents_t1", ingested_sql())
def streamed_documents(spark, d):
    """The document file read as a stream: each micro-batch runs the batch flow and the result is the same."""
    root = work_folder(spark, "uploads")
    stream = uploads.ingest_uploads(
        spark, table_path(d, "documents"), root, f"{root}/state", schema="doc_id bigint, text string",
        prepare=lambda rows: store.cut_into_pages(I.headed(store.spread(rows, "doc_id"))),
    )
    stream.awaitTermination()
    return spark.read.parquet(f"{root}/documents").drop("batch")


@query(
    "streamed_embeddings_t2",
    "SELECT doc_id, sha256('feature-hash:64:RETRIEVAL_DOCUMENT:' || text) AS content_hash, CAST(64 AS INTEGER) AS size FROM documents",
)
def streamed_embeddings(spark, d):
    """The document file read as a stream of texts to embed through the cache."""
    root = work_folder(spark, "embeddings")
    stream = uploads.embed_chunks(
        spark, table_path(d, "documents"), root, f"{root}/state", 64, schema="doc_id bigint, text string",
        prepare=lambda rows: store.spread(rows, "doc_id").withColumnRenamed("text", "content"),
    )
    stream.awaitTermination()
    done = spark.read.parquet(f"{root}/chunks")
    return done.select("doc_id", "content_hash", F.size("embedding").alias("size"))
