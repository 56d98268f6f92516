"""Stored tables: lookups, deletes, expiry, write-back, fixtures, samples and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.operators import evaluation
from clausemill.session import work_folder
from clausemill.sources import store
from clausemill.sources.tables import Store

from .extraction import LOAN_FACTS, TERMS_COST, parsed_loans
from .cost import round2_sql
from .registry import query, table

# orders as documents, line items as their chunks
_DOCS = [
    "o_orderkey AS doc_id", "concat('Order ', CAST(o_orderkey AS STRING)) AS title", "o_orderkey % 4 = 0 AS is_sample",
    "CASE WHEN o_orderkey % 4 = 0 THEN concat('slug-', CAST(o_custkey AS STRING)) END AS sample_slug",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'embedded' ELSE 'parsed' END AS status", "o_orderstatus AS kind",
]
DOCS = "docs AS (SELECT " + ", ".join(_DOCS).replace("STRING", "VARCHAR") + " FROM orders)"


def documents(spark, d):
    return table(spark, d, "orders").selectExpr(*_DOCS)


def chunks(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_partkey").alias("chunk_id"),
        F.array("l_quantity", "l_tax").alias("embedding"),
    )


@query("stored_documents_s7", "WITH " + DOCS + """ SELECT doc_id, CAST(count(l_orderkey) AS INTEGER) AS chunk_count, TIMESTAMP '2024-01-02 00:00:00' AS created_at, TIMESTAMP '2024-01-03 12:00:00' AS expires_at
    FROM docs LEFT JOIN lineitem ON l_orderkey = doc_id GROUP BY doc_id""")
def stored_documents(spark, d):
    """Documents and chunks written twice, as by a retried load, and read back; they live for 36 hours."""
    created = F.lit("2024-01-02 00:00:00").cast("timestamp")
    rows = store.document_rows(documents(spark, d), chunks(spark, d), created, 36)
    root = work_folder(spark, "store")
    for _ in range(2):
        store.write_documents(rows.drop("chunk_count"), chunks(spark, d), root, "orders")
    stored, held = store.read_documents(spark, root)
    counts = held.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
    found = stored.join(counts, "doc_id", "left").fillna(0, ["chunk_count"])
    return found.select("doc_id", "chunk_count", "created_at", "expires_at")


@query("documents_by_id_s8", "WITH " + DOCS + " SELECT doc_id, title, status FROM docs SEMI JOIN (SELECT event_id * 2 AS doc_id FROM events) e USING (doc_id)")
def documents_by_id(spark, d):
    """Batch lookup of the ids named by the events."""
    wanted = table(spark, d, "events").select((F.col("event_id") * 2).alias("doc_id"))
    return store.find_documents(documents(spark, d), wanted).select("doc_id", "title", "status")


@query("document_by_slug_s8", "WITH " + DOCS + " SELECT doc_id, title FROM docs WHERE is_sample AND sample_slug = 'slug-7'")
def document_by_slug(spark, d):
    return store.find_by_slug(documents(spark, d), "slug-7").select("doc_id", "title")


@query("chunk_listing_s8", "SELECT l_orderkey AS doc_id, l_linenumber AS chunk_index, l_partkey AS chunk_id FROM lineitem SEMI JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F'")
def chunk_listing(spark, d):
    """Chunks of all finished documents in index order, without their vectors."""
    wanted = documents(spark, d).filter("kind = 'F'").select("doc_id")
    return store.list_chunks(chunks(spark, d), wanted)


@query("chunks_by_key_s8", "SELECT l_orderkey AS doc_id, l_linenumber AS chunk_index, l_partkey AS chunk_id FROM lineitem SEMI JOIN (SELECT o_orderkey AS k, o_orderkey % 200 AS p FROM orders) o ON l_orderkey = k AND l_partkey % 200 = p")
def chunks_by_key(spark, d):
    keys = chunks(spark, d).select("doc_id", "chunk_id").filter("chunk_id % 200 = doc_id % 200")
    return store.find_chunks(chunks(spark, d), keys)


def stored(spark, d, **tables):
    """A store with the given tables; changes to it are made twice in the queries, as by a retry."""
    held = Store(spark, work_folder(spark, "tables"), buckets=16)
    held.create("load", **tables)
    return held


@query(
    "cascaded_delete_s9",
    "WITH " + DOCS + """, gone AS (SELECT doc_id FROM docs WHERE NOT is_sample AND doc_id IN (SELECT event_id * 3 FROM events WHERE event_type = 'error')),
    held AS (SELECT 'documents' AS name, doc_id FROM docs UNION ALL SELECT 'chunks', l_orderkey FROM lineitem UNION ALL SELECT 'answers', o_orderkey FROM orders)
    SELECT name, count(*) FILTER (g.doc_id IS NULL) AS rows_left, count(g.doc_id) AS removed FROM held LEFT JOIN gone g USING (doc_id) GROUP BY name""",
)
def cascaded_delete(spark, d):
    """Documents named by error events go from the store, with their chunks and cached answers; samples stay."""
    ids = table(spark, d, "events").filter("event_type = 'error'").select((F.col("event_id") * 3).alias("doc_id"))
    cached = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    held = stored(spark, d, documents=documents(spark, d), chunks=chunks(spark, d), answers=cached)
    removed = [held.delete("delete", ids) for _ in range(2)][-1]
    parts = [held.read(n).agg(F.count("*").alias("rows_left")).select(F.lit(n).alias("name"), "rows_left", F.lit(c).cast("bigint").alias("removed")) for n, c in removed.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_EVENT_DOCS = "SELECT event_id AS doc_id, ts + INTERVAL 24 HOUR AS expires_at, event_type = 'purchase' AS is_sample FROM events"


@query(
    "expired_purge_s10",
    f"""WITH ev AS ({_EVENT_DOCS}), judged AS (SELECT *, expires_at < TIMESTAMP '2024-01-15 00:00:00' AND NOT is_sample AS gone FROM ev)
    SELECT doc_id, is_sample, (SELECT count(*) FROM judged WHERE gone) AS purged FROM judged WHERE NOT gone""",
)
def expired_purge(spark, d):
    """Events as stored documents with a life of a day; what a purge on a fixed date leaves and how many it took."""
    docs = table(spark, d, "events").select(
        F.col("event_id").alias("doc_id"), store.expiry(F.col("ts")).alias("expires_at"),
        (F.col("event_type") == "purchase").alias("is_sample"),
    )
    held = stored(spark, d, documents=docs)
    purged = [held.purge("purge", F.lit("2024-01-15 00:00:00").cast("timestamp")) for _ in range(2)][-1]
    return held.read("documents").select("doc_id", "is_sample", F.lit(purged["documents"]).cast("bigint").alias("purged"))


@query(
    "analysis_write_back_s11",
    "WITH " + DOCS + """ SELECT doc_id, CASE WHEN e.k IS NOT NULL THEN 'embedded' ELSE status END AS status, CASE WHEN e.k IS NOT NULL AND e.k % 5 > 0 THEN '{"v":' || CAST(e.k % 5 AS VARCHAR) || '}' END AS extraction
    FROM docs LEFT JOIN (SELECT event_id AS k FROM events) e ON e.k = doc_id""",
)
def analysis_write_back(spark, d):
    """Events bring a new status and, four times in five, an extraction for their stored document."""
    key = F.col("event_id")
    updates = table(spark, d, "events").select(
        key.alias("doc_id"), F.lit("embedded").alias("status"),
        F.when(key % 5 > 0, F.concat(F.lit('{"v":'), (key % 5).cast("string"), F.lit("}"))).alias("extraction"),
    )
    held = stored(spark, d, documents=documents(spark, d).withColumn("extraction", F.lit(None).cast("string")))
    for _ in range(2):
        held.write_back("analysis", updates, ["status", "extraction"])
    return held.read("documents").select("doc_id", "status", "extraction")


def vector_cache(spark, d):
    return table(spark, d, "embeddings").select(
        F.sha2(F.col("vec_id").cast("string"), 256).alias("content_hash"), F.lit("m").alias("model"), "embedding", "vec_id"
    )


@query(
    "fixture_rows_s12",
    """SELECT sha256(CAST(vec_id AS VARCHAR)) AS content_hash, CAST(len(embedding) AS INTEGER) AS size,
      round(list_sum(list_transform(embedding, lambda x, i: floor(CAST(x AS DOUBLE) * 1000000 + 0.5) / 1000000 * i)), 5) AS mark FROM embeddings""",
)
def fixture_rows(spark, d):
    """Vectors written as JSON lines, six decimals a component, and read again; marked by a weighted sum."""
    path = work_folder(spark, "fixture")
    store.export_fixture(vector_cache(spark, d).drop("vec_id"), path)
    rows = spark.read.schema("content_hash string, model string, embedding array<double>").json(path)
    mark = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("content_hash", F.size("embedding").alias("size"), F.round(mark, 5).alias("mark"))


@query(
    "fixture_import_s13",
    "SELECT sha256(CAST(vec_id AS VARCHAR)) AS content_hash, CASE WHEN vec_id % 3 = 0 THEN 'm' ELSE 'fixture' END AS model FROM embeddings",
)
def fixture_import(spark, d):
    """A third of the keys is cached; the fixture's file adds the others and overwrites none, a missing file adds nothing."""
    rows = vector_cache(spark, d)
    path = work_folder(spark, "fixture")
    store.export_fixture(rows.drop("vec_id").withColumn("model", F.lit("fixture")), path)
    cache = store.import_fixture(rows.filter("vec_id % 3 = 0").drop("vec_id"), f"{path}-missing")
    return store.import_fixture(cache, path).select("content_hash", "model")


@query(
    "sample_catalogue_s14",
    """WITH d AS (SELECT o_custkey AS slug, o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'embedded' ELSE 'parsed' END AS status FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 10 = 7)
    SELECT c_name AS title, doc_id, coalesce(status = 'embedded', false) AS loaded FROM customer LEFT JOIN d ON slug = c_custkey""",
)
def sample_catalogue(spark, d):
    """Customers as the sample index, some of their orders as loaded documents."""
    index = table(spark, d, "customer").select(F.col("c_custkey").alias("slug"), F.col("c_name").alias("title"))
    docs = table(spark, d, "orders").selectExpr(
        "o_custkey AS sample_slug", "o_orderkey AS doc_id", "o_orderkey % 10 IN (0, 7) AS is_sample",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'embedded' ELSE 'parsed' END AS status",
    )
    return store.sample_catalogue(index, docs).select("title", "doc_id", "loaded")


@query(
    "missing_samples_s15",
    "SELECT c_name AS title FROM customer ANTI JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 10 = 0) o ON o_custkey = c_custkey",
)
def missing_samples(spark, d):
    """What a repeated corpus load still has to ingest."""
    index = table(spark, d, "customer").select(F.col("c_custkey").alias("slug"), F.col("c_name").alias("title"))
    docs = table(spark, d, "orders").selectExpr("o_custkey AS sample_slug", "o_orderkey % 10 = 0 AS is_sample")
    return store.missing_samples(index, docs).select("title")


_TRUTH = """concat('{"slug":"s', CAST(k AS STRING), '","terms":{"prepaymentCharges":{"percent":4,"pages":[', CAST(k % 9 AS STRING), ',', CAST(k % 7 + 3 AS STRING), ']},"statedEmi":{"amount":5}}}')"""


@query(
    "ground_truth_pages_s16",
    """SELECT o_orderkey AS k, path, CASE WHEN path = 'terms.prepaymentCharges' THEN CAST(o_orderkey % 9 AS VARCHAR) || ',' || CAST(o_orderkey % 7 + 3 AS VARCHAR) END AS pages
    FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'terms.prepaymentCharges' WHEN 1 THEN 'terms.statedEmi' ELSE 'facts.rent' END AS path FROM orders)""",
)
def ground_truth_pages(spark, d):
    """Pages at a path that is itself a column; a missing node has none."""
    rows = table(spark, d, "orders").selectExpr(
        "o_orderkey AS k", "CASE o_orderkey % 3 WHEN 0 THEN 'terms.prepaymentCharges' WHEN 1 THEN 'terms.statedEmi' ELSE 'facts.rent' END AS path"
    ).selectExpr("*", f"{_TRUTH} AS truth")
    pages = evaluation.expected_pages(F.col("truth"), F.col("path"))
    return rows.select("k", "path", F.array_join(F.transform(pages, lambda p: p.cast("string")), ",").alias("pages"))


@query(
    "document_summaries_s17",
    "WITH RECURSIVE " + LOAN_FACTS + TERMS_COST + ", " + DOCS + f""" SELECT d.doc_id, title, status, emi, {round2_sql('(pow(1 + monthly, 12) - 1) * 100')} AS ear FROM docs d LEFT JOIN costed c ON c.doc_id = d.doc_id AND d.doc_id % 2 = 0""",
)
def document_summaries(spark, d):
    """Documents with the cost computed on read where terms were extracted (every second one)."""
    terms = parsed_loans(spark, d).filter("doc_id % 2 = 0")
    rows = store.document_summaries(documents(spark, d), terms)
    return rows.select("doc_id", "title", "status", "cost.emi", F.col("cost.effectiveAnnualRatePercent").alias("ear"))
