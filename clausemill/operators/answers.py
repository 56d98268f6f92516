"""Question answering around an external model: request tables, response parsing, citations, cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..session import cut_lineage
from . import privacy

MAX_QUESTION, MAX_TURN, MAX_HISTORY, HISTORY_TURNS, MAX_TOOL_ROUNDS = 2000, 8000, 20, 10, 4


def join_in_order(order: str, text: Column, separator: str = "\n\n"):
    """Aggregate expression: texts of a bounded group joined in order."""
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda s: s.t),
        separator,
    )


def contexts(passages: DataFrame, key: str = "query_id", order: str = "rank", outline: bool = False) -> DataFrame:
    """``(key, context, passages)``: all given passages, numbered; how many there are is up to the retrieval step."""
    label, ranged = ("heading", False) if outline else ("clause", True)
    text = X.passage(
        F.col(order), F.col("page_start"), F.col("page_end"), F.col("clause_title"), F.col("content"), label, ranged
    )
    return passages.groupBy(key).agg(
        join_in_order(order, text).alias("context"), F.count("*").cast("int").alias("passages")
    )


def question_prompts(context: DataFrame, questions: DataFrame) -> DataFrame:
    """The request table: context and question in one user message."""
    prompt = F.concat(
        F.lit("Context passages from the document:\n\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("question")
    )
    return questions.join(context, "query_id").select("query_id", "passages", prompt.alias("prompt"))


def extraction_prompts(context: DataFrame, ask: str, key: str = "doc_id") -> DataFrame:
    return context.select(
        key, "passages", F.concat(F.lit("Passages:\n\n"), F.col("context"), F.lit(f"\n\n{ask}")).alias("prompt")
    )


def request_issue(question: Column, history: Column) -> Column:
    """Why an ask request is out of limits, or null; ``history`` is an array of ``struct(role, content)``."""
    long_turn = F.exists(history, lambda t: F.length(t.content) > MAX_TURN)
    return (
        F.when((question == "") | (F.length(question) > MAX_QUESTION), "question")
        .when(F.size(history) > MAX_HISTORY, "history")
        .when(long_turn, "history.content")
    )


def split_requests(asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(requests within the limits, rejects (query_id, issue))``; nothing of a request is cut."""
    judged = asks.withColumn("issue", request_issue(F.col("question"), F.col("history")))
    return judged.filter("issue IS NULL").drop("issue"), judged.filter("issue IS NOT NULL").select("query_id", "issue")


def recent_history(turns: DataFrame, n: int = HISTORY_TURNS) -> DataFrame:
    """``(conv_id, history)``: the last ``n`` turns that are neither pending nor failed, oldest first."""
    usable = turns.filter(~F.col("pending") & ~F.col("error"))
    latest = usable.withColumn("_back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    kept = latest.filter(F.col("_back") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return kept.groupBy("conv_id").agg(
        F.transform(ordered, lambda t: F.struct(t.role.alias("role"), t.content.alias("content"))).alias("history")
    )


def mask_requests(asks: DataFrame, pii_map: DataFrame) -> DataFrame:
    """Mask the question (position 0) and the history of ``asks(query_id, doc_id, question, history)`` with
    the map issued at upload, ``pii_map(doc_id, placeholder, original, seed_pos)``.

    One request numbers its own new identifiers: a group is a question and at most twenty turns.
    """
    history = F.transform("history", lambda t, i: F.struct((i + 1).alias("pos"), t.content.alias("text")))
    first = F.array(F.struct(F.lit(0).alias("pos"), F.col("question").alias("text")))
    texts = asks.select("query_id", "doc_id", F.explode(F.concat(first, history)).alias("x")).select(
        "query_id", "doc_id", "x.pos", "x.text"
    )
    # seeds matter only to requests that hold an identifier, so few map rows are repeated per request
    found = cut_lineage(privacy.explode_spans(texts, ["query_id", "doc_id"], "pos"))
    asking = found.select("query_id", "doc_id").distinct()
    seeds = asking.join(pii_map, "doc_id").select("query_id", "doc_id", "seed_pos", "placeholder", "original")
    numbered = privacy.number_placeholders(found, ["query_id", "doc_id"], "pos", seeds)
    placed = privacy.place(found, numbered, ["query_id", "doc_id"])
    masked = privacy.apply_placeholders(texts, placed, ["query_id", "doc_id"], "pos")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    per_request = masked.groupBy("query_id").agg(ordered.alias("masked"))
    joined = asks.join(per_request, "query_id")
    turns = F.zip_with(
        F.col("history"), F.slice("masked", F.lit(2), F.size("history")),
        lambda t, m: F.struct(t.role.alias("role"), m.text.alias("content")),
    )
    return joined.select(
        "query_id", "doc_id", F.element_at("masked", 1).text.alias("question"), turns.alias("history")
    )


def with_cache_key(asks: DataFrame, model: str) -> DataFrame:
    key = X.answer_key(F.col("doc_id"), F.lit(model), F.col("question"), F.size("history"))
    return asks.withColumn("cache_key", key)


def probe_cache(keyed: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(hits with the stored response, misses)``; follow-up questions always miss."""
    stored = cache.select("cache_key", "response")
    hits = keyed.join(stored, "cache_key").withColumn("cached", F.lit(True))
    misses = keyed.join(stored.filter("cache_key IS NOT NULL"), "cache_key", "left_anti")
    return hits, misses


def fill_cache(cache: DataFrame, answered: DataFrame) -> DataFrame:
    """Insert answers of standalone questions unless the key exists; refusals without context stay out."""
    fresh = (
        answered.filter(F.col("cache_key").isNotNull() & ~F.col("no_context"))
        .dropDuplicates(["cache_key"])
        .join(cache.select("cache_key"), "cache_key", "left_anti")
    )
    return cache.unionByName(fresh.select(*cache.columns))


def no_context_answers(asks: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Fixed refusal for questions that retrieved nothing."""
    return asks.join(retrieved.select("query_id"), "query_id", "left_anti").select(
        "query_id", F.lit(P.NO_CONTEXT_ANSWER).alias("answer"), F.lit(0).alias("citations"),
        F.lit(True).alias("grounded"), F.lit(False).alias("cached"),
    )


def _kept_numbers(marker: Column, passages: Column) -> Column:
    numbers = F.transform(F.split(marker, ","), lambda n: X.strip_ws(n).try_cast("bigint"))
    return F.filter(numbers, lambda n: n.isNotNull() & (n >= 1) & (n <= passages))


def _rewrite(text: Column, passages: Column) -> Column:
    gaps = F.split(text, P.ANSWER_MARKER, -1)
    markers = F.regexp_extract_all(text, F.lit(P.ANSWER_MARKER), F.lit(1))

    def shown(m: Column) -> Column:
        kept = F.transform(_kept_numbers(m, passages), lambda n: n.cast("string"))
        return F.when(F.size(kept) > 0, F.concat(F.lit("["), F.array_join(kept, ", "), F.lit("]"))).otherwise("")

    pieces = F.zip_with(gaps, F.transform(markers, shown), lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    joined = F.array_join(pieces, "")
    return X.strip_ws(F.regexp_replace(F.regexp_replace(joined, " {2,}", " "), P.WS + "+([.,;])", "$1"))


def parse_answers(responses: DataFrame) -> DataFrame:
    """``responses(query_id, raw, passages, …)`` plus ``answer, refs, not_found``.

    A refusal is recognised as a prefix only; markers outside 1..passages are dropped from the text.
    """
    text = X.strip_ws("raw")
    refused = text.startswith(P.NOT_IN_DOCUMENT)
    rest = F.substr(text, F.lit(len(P.NOT_IN_DOCUMENT) + 1))
    explanation = X.strip_ws(F.regexp_replace(rest, "^(?:" + P.WS + "|[:.-])+", ""))
    refusal = F.coalesce(F.nullif(explanation, F.lit("")), F.lit(P.NOT_STATED_ANSWER))
    markers = F.regexp_extract_all(text, F.lit(P.ANSWER_MARKER), F.lit(1))
    refs = F.array_sort(
        F.array_distinct(F.flatten(F.transform(markers, lambda m: _kept_numbers(m, F.col("passages")))))
    )
    none = F.array().cast("array<bigint>")
    return responses.select(
        "*",
        F.when(refused, refusal).otherwise(_rewrite(text, F.col("passages"))).alias("answer"),
        F.when(refused, none).otherwise(refs).alias("refs"),
        refused.alias("not_found"),
    )


def resolve_citations(parsed: DataFrame, passages: DataFrame) -> DataFrame:
    """``(query_id, ref, chunk_id, page, page_end, clause_title, quote)`` of every cited passage."""
    cited = parsed.select("query_id", F.explode("refs").alias("ref"))
    at = passages.select(
        "query_id", F.col("rank").cast("bigint").alias("ref"), "chunk_id", F.col("page_start").alias("page"),
        F.col("page_end"), "clause_title", X.quote("content").alias("quote"),
    )
    return cited.join(at, ["query_id", "ref"])


def grounded(refs: Column, not_found: Column, tool_calls: Column) -> Column:
    """Refusals count as grounded; other answers need a citation or a calculator result."""
    return not_found | (F.size(refs) > 0) | (tool_calls > 0)


def tool_rounds(trace: DataFrame, max_rounds: int = MAX_TOOL_ROUNDS) -> DataFrame:
    """Per question: rounds, summed tokens, and the error when every allowed call still asked for tools.

    ``trace(query_id, round, calls, input_tokens, output_tokens)`` has one row per model call.
    """
    return trace.groupBy("query_id").agg(
        F.count_if(F.col("calls") > 0).alias("tool_rounds"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("calls").alias("tool_calls"),
    ).withColumn("error", F.when(F.col("tool_rounds") > max_rounds, "LLM_TOOL_LOOP"))
