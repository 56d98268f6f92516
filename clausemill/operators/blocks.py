"""Text search over a whole corpus: postings in blocks of chunks, with the most a lexeme can add in each block.

A query looks into its most promising blocks first. What its k-th hit scores there is a bar: blocks whose lexemes together
cannot reach it are never read. The result is that of reading all postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.plan import settle
from .retrieval import asked as asked_lexemes
from .retrieval import may_meet, query_terms, top_k

#: Blocks of chunks of about one length; lengths of one class differ by less than a factor of 1.5.
PARTS, CLASS = 16, 1.5
#: Blocks that a query reads to find its bar.
FIRST = 4


def blocked_postings(chunks: DataFrame, parts: int = PARTS, queries: DataFrame | None = None) -> DataFrame:
    """``block``, ``lexeme``, ``chunk_id``, ``chunk_index``, ``tf`` of ``chunks(chunk_id, chunk_index, content)``.

    Store them by ``block``. A block holds chunks of about one number of lexemes, since that bounds how often one occurs;
    a class of lengths is dealt over ``parts`` blocks, so a block stays small when the corpus grows with ``parts``. Where they
    serve only the given ``queries``, other lexemes than theirs are left out before the shuffle.
    """
    counted = chunks.select("chunk_id", "chunk_index", X.lexemes("content").alias("lexemes"))
    length = F.floor(F.log(CLASS, F.greatest(F.size("lexemes"), F.lit(1)).cast("double"))).cast("int")
    block = length * parts + F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int")
    # the block is made in front of the unfolding: behind it every word would carry all words of its chunk
    placed = settle(counted.select("chunk_id", "chunk_index", "lexemes", block.alias("block")), ["lexemes", "block"])
    words = placed.select("block", "chunk_id", "chunk_index", F.explode("lexemes").alias("lexeme"))
    words = words if queries is None else asked_lexemes(words, queries)
    return words.groupBy("block", "lexeme", "chunk_id", "chunk_index").agg(F.count(F.lit(1)).alias("tf"))


def block_bounds(postings: DataFrame) -> DataFrame:
    """``block``, ``lexeme``, ``most``: the highest count of a lexeme in a chunk of the block."""
    return postings.groupBy("block", "lexeme").agg(F.max("tf").alias("most"))


def _scored(postings: DataFrame, wanted: DataFrame, terms: DataFrame, few: bool = False) -> DataFrame:
    """The scores of all chunks of the wanted (``query_id``, ``block``) that share a lexeme with their query; where those are
    ``few``, other postings are left out before the shuffle."""
    asked = wanted.join(terms, "query_id").select("query_id", "block", "lexeme")
    postings = may_meet(postings, asked, ["block", "lexeme"]) if few else postings
    hits = asked.join(postings, ["block", "lexeme"])
    return hits.groupBy("query_id", "chunk_id", "chunk_index").agg(F.sum("tf").alias("score"))


def promising(postings: DataFrame, bounds: DataFrame, terms: DataFrame, k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """``(scores of the first blocks, further (query_id, block) that may hold one of the k best)``."""
    reach = terms.join(bounds, "lexeme").groupBy("query_id", "block").agg(F.sum("most").alias("reach"))
    begun = top_k(reach, ["query_id"], [F.desc("reach"), F.asc("block")], first).select("query_id", "block")
    seen = _scored(postings, begun, terms, few=True)
    bar = top_k(seen, ["query_id"], _order(), k).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("score").alias("bar"))
    # a chunk that ties with the bar may still come before it
    rest = reach.join(begun, ["query_id", "block"], "left_anti").join(bar, "query_id", "left")
    return seen, rest.filter(F.coalesce((F.col("hits") < k) | (F.col("reach") >= F.col("bar")), F.lit(True))).select("query_id", "block")


def _order() -> list[Column]:
    return [F.desc("score"), F.asc("chunk_index")]


def search(postings: DataFrame, bounds: DataFrame, queries: DataFrame, k: int, first: int = FIRST) -> DataFrame:
    """The ``k`` chunks of the corpus with most occurrences of each query's lexemes, ties by chunk order.

    ``queries(query_id, doc_id, question)``; the scope is the whole corpus and ``doc_id`` is not read. A query without a
    lexeme has no hits.
    """
    terms = query_terms(queries.withColumn("doc_id", F.lit(None).cast("string"))).select("query_id", "lexeme")
    seen, rest = promising(postings, bounds, terms, k, first)
    return top_k(seen.unionByName(_scored(postings, rest, terms)), ["query_id"], _order(), k)
