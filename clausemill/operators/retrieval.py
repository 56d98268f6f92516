"""Vector search, full-text search, rank fusion and the contexts built from them.

Queries and chunks meet by an equality on the document, never as a cross product, and every ranking is a
``row_number() <= k`` filter, which Spark turns into a partial limit in front of the shuffle: a scope that
holds a third of all chunks still sends at most k rows per query and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V

RRF_K = 60
CONTEXT_CHUNKS = 40
#: Rows of 64 bits in the table of the questions' lexemes.
ASKED_WORDS = 1 << 18

# fixed values: retrieval queries per field group
LOAN_QUERIES = (
    "lender name company registered office borrower agreement between",
    "loan amount sanctioned principal rupees disbursed",
    "rate of interest per annum fixed floating reducing balance flat benchmark spread",
    "tenure months repayment equated monthly instalments EMI amount",
    "processing fee insurance premium upfront charges deducted from disbursement documentation stamp duty",
    "prepayment foreclosure charges part payment",
    "penal interest late payment overdue default charges cheque bounce mandate dishonour",
    "schedule of charges key facts",
)
CONTRACT_QUERIES = (
    "agreement made between parties name of the parties hereinafter",
    "term of the agreement commence period months years expiry",
    "payment fee rent consideration payable monthly amount due date",
    "security deposit advance refundable forfeited",
    "termination notice period terminate written notice",
    "renewal extension automatically renew",
    "governing law jurisdiction arbitration dispute",
    "schedule summary of terms",
)


def top_k(scored: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key with their 1-based ``rank``."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def candidate_count(k: int) -> int:
    return max(3 * k, 20)


def vector_search(chunks: DataFrame, queries: DataFrame, k: int, large: bool = False) -> DataFrame:
    """Exact search of ``queries(query_id, doc_id, vector)`` among ``chunks(doc_id, chunk_id, chunk_index,
    embedding)``: nearest by cosine distance, ties by chunk order.

    Where many queries meet many chunks of one document, ``large`` measures them as matrices; else pairs are rows.
    """
    if large:
        from .cells import search_all

        return search_all(chunks, queries, k)
    pairs = queries.join(chunks.filter(F.col("embedding").isNotNull()), "doc_id").select(
        "query_id", "chunk_id", "chunk_index", V.cosine_distance(F.col("vector"), F.col("embedding")).alias("distance")
    )
    return top_k(pairs, ["query_id"], [F.asc_nulls_last("distance"), F.asc("chunk_index")], k)


def approximate_vector_search(
    chunks: DataFrame, queries: DataFrame, k: int, tables: int = 8, bits: int = 4
) -> DataFrame:
    """Nearest chunks among those that share a random-projection bucket with the query.

    Only ids meet by table and bucket; each distinct pair then fetches its two vectors and is measured once. More
    ``bits`` make smaller buckets and so fewer pairs, more ``tables`` find more of the neighbours.
    """

    def bucketed(df: DataFrame, key: str, vector: str) -> DataFrame:
        return df.select("doc_id", key, F.posexplode(V.signatures(F.col(vector), tables, bits)).alias("table", "bucket"))

    held = chunks.filter(F.col("embedding").isNotNull())
    pairs = bucketed(queries, "query_id", "vector").join(bucketed(held, "chunk_id", "embedding"), ["doc_id", "table", "bucket"])
    pairs = pairs.select("doc_id", "query_id", "chunk_id").distinct()
    scored = (
        pairs.join(queries.select("query_id", "vector"), "query_id")
        .join(held.select("doc_id", "chunk_id", "chunk_index", "embedding"), ["doc_id", "chunk_id"])
        .select("query_id", "chunk_id", "chunk_index", V.cosine_distance(F.col("vector"), F.col("embedding")).alias("distance"))
    )
    return top_k(scored, ["query_id"], [F.asc_nulls_last("distance"), F.asc("chunk_index")], k)


def recall_against(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact neighbours an approximate search found, over all queries."""
    got = approximate.select("query_id", "chunk_id", F.lit(1).alias("got"))
    return exact.join(got, ["query_id", "chunk_id"], "left").agg(
        F.count("*").alias("expected"), F.coalesce(F.sum("got"), F.lit(0)).alias("found")
    ).select("expected", "found", (F.col("found") / F.col("expected")).alias("recall"))


def postings(chunks: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """``(doc_id, chunk_id, chunk_index, lexeme, tf)``: build once per corpus and store by ``doc_id``.

    Where they serve only the given ``queries``, other lexemes than theirs are left out before the shuffle.
    """
    words = chunks.select("doc_id", "chunk_id", "chunk_index", F.explode(X.lexemes("content")).alias("lexeme"))
    return (words if queries is None else asked(words, queries)).groupBy("doc_id", "chunk_id", "chunk_index", "lexeme").agg(F.count("*").alias("tf"))


def asked(words: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows of ``words`` whose ``lexeme`` may be in a question: all that are, and few others."""
    return may_meet(words, queries.select("question").distinct().select(F.explode(X.lexemes("question")).alias("lexeme")), ["lexeme"])


def may_meet(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The ``rows`` whose ``keys`` may be among those of ``wanted``: all that are, and few others as long as those are few.

    The wanted keys are bits in a table of at most ``ASKED_WORDS`` rows, which is broadcast.
    """
    value = F.xxhash64(*keys)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(value, F.lit(64)).cast("int"))
    word = F.pmod(F.shiftright(value, 6), F.lit(ASKED_WORDS)).cast("int")
    table = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.withColumn("_word", word).join(F.broadcast(table), "_word")
    return met.filter(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct lexemes per query; a query of stop words only has none and so no hits."""
    return queries.select(
        "query_id", "doc_id", F.explode(F.array_distinct(X.lexemes("question"))).alias("lexeme")
    )


def occurrence_score() -> Column:
    return F.sum("tf")


def text_search(posting_table: DataFrame, queries: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """Chunks that share any lexeme with the question, most occurrences first, ties by chunk order."""
    hits = query_terms(queries).join(posting_table, ["doc_id", "lexeme"])
    scored = hits.groupBy("query_id", "chunk_id", "chunk_index").agg(
        (occurrence_score() if score is None else score).alias("score")
    )
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("chunk_index")], k)


def ranked_list(hits: DataFrame, source: str, weight: float) -> DataFrame:
    return hits.select(
        "query_id", F.col("chunk_id").alias("id"), F.lit(source).alias("source"), "rank", F.lit(float(weight)).alias("weight")
    )


def fuse(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of ``(query_id, source, id, rank, weight)``: ``(query_id, id, score,
    ranks)``. Lists without a positive weight do not count."""
    used = ranked.filter(F.col("weight") > 0)
    entry = F.struct("source", F.col("rank").cast("int").alias("rank"))
    return used.groupBy("query_id", "id").agg(
        F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))).alias("score"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("ranks"),
    )


def fused_top_k(ranked: DataFrame, k: int) -> DataFrame:
    return top_k(fuse(ranked), ["query_id"], [F.desc(F.round("score", 12)), F.asc("id")], k)


def hybrid_search(
    chunks: DataFrame, queries: DataFrame, k: int = 8, vector_weight: float = 1.0, text_weight: float = 1.0,
    posting_table: DataFrame | None = None, candidates: int | None = None,
) -> DataFrame:
    """``(query_id, chunk_id, score, ranks, rank)`` for ``queries(query_id, doc_id, question, vector)``.

    A retriever without weight is left out of the plan.
    """
    depth = candidates or candidate_count(k)
    lists = candidate_lists(chunks, queries, depth, vector_weight, text_weight, posting_table)
    return fused_top_k(lists, k).withColumnRenamed("id", "chunk_id")


def candidate_lists(
    chunks: DataFrame, queries: DataFrame, depth: int, vector_weight: float = 1.0, text_weight: float = 1.0,
    posting_table: DataFrame | None = None,
) -> DataFrame:
    """``(query_id, id, source, rank, weight)``: the lists of both retrievers, each as far as it has a weight."""
    lists = []
    if vector_weight > 0:
        lists.append(ranked_list(vector_search(chunks, queries, depth), "vector", vector_weight))
    if text_weight > 0:
        table = postings(chunks, queries) if posting_table is None else posting_table
        lists.append(ranked_list(text_search(table, queries, depth), "text", text_weight))
    if not lists:
        raise ValueError("at least one retriever needs a positive weight")
    return lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])


def with_chunk_columns(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add the chunk columns, never the vector."""
    columns = ["chunk_id", "doc_id", "chunk_index", "page_start", "page_end", "clause_title", "content", "token_count"]
    return hits.join(chunks.select(*columns), "chunk_id")


def field_queries(documents: DataFrame, questions, dims: int) -> DataFrame:
    """One query row per document and fixed question; each question is embedded once and all are a literal array."""
    spark = documents.sparkSession
    asked = spark.createDataFrame(list(enumerate(questions)), "query_no int, question string")
    embedded = asked.select("query_no", "question", V.hash_embedding(F.col("question"), dims).alias("vector"))
    entries = [
        F.struct(F.lit(r.question).alias("question"), F.lit(list(r.vector)).cast("array<float>").alias("vector"))
        for r in sorted(embedded.collect(), key=lambda r: r.query_no)  # as many rows as fixed questions
    ]
    rows = documents.select("doc_id", F.posexplode(F.array(*entries)).alias("query_no", "entry"))
    query_id = F.concat(F.col("doc_id").cast("string"), F.lit("/q"), F.col("query_no").cast("string"))
    return rows.select("doc_id", query_id.alias("query_id"), "entry.question", "entry.vector")


def union_context(hits: DataFrame, chunks: DataFrame, limit: int = CONTEXT_CHUNKS) -> DataFrame:
    """Distinct retrieved chunks per document in document order, the first ``limit`` of them."""
    distinct = hits.select("chunk_id").distinct()
    found = with_chunk_columns(distinct, chunks)
    return top_k(found, ["doc_id"], [F.asc("chunk_index")], limit)


def head_context(chunks: DataFrame, limit: int = CONTEXT_CHUNKS) -> DataFrame:
    """The first chunks of every document in order."""
    return top_k(chunks, ["doc_id"], [F.asc("chunk_index")], limit)
