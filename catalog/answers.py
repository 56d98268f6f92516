"""Question answering over conversations: masking, prompts, cache, parsing, citations, calculator, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.functions import finance
from clausemill.functions import patterns as P
from clausemill.operators import answers, calculator
from clausemill.sources import store

from . import inputs as I
from .cost import LOAN_FIELDS, LOANS, REDUCING, FLAT, round2_sql
from .registry import query, table

_QID = "CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR)"


def qid():
    return F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))


def turns(spark, d):
    return store.spread(table(spark, d, "conversations"), "conv_id")


def passages(spark, d):
    """Every turn of a conversation is a passage of its first user question."""
    rows = turns(spark, d).withColumn("rank", (F.col("turn") + 1).cast("int"))
    return rows.select(
        F.col("conv_id").alias("query_id"), "rank", F.concat(F.lit("c"), F.col("rank").cast("string")).alias("chunk_id"),
        (F.floor(F.col("rank") / 2) + 1).cast("int").alias("page_start"),
        (F.floor((F.col("rank") + 1) / 2) + 1).cast("int").alias("page_end"),
        F.when(F.col("rank") % 3 != 0, F.col("role")).alias("clause_title"), F.col("text").alias("content"),
    )


PASSAGES = """psg AS (SELECT conv_id AS query_id, turn + 1 AS rank, 'c' || CAST(turn + 1 AS VARCHAR) AS chunk_id, (turn + 1) // 2 + 1 AS page_start,
  (turn + 2) // 2 + 1 AS page_end, CASE WHEN (turn + 1) % 3 <> 0 THEN role END AS clause_title, text AS content FROM conversations)"""
_SHOWN = """'[' || CAST(rank AS VARCHAR) || '] (' || CASE WHEN page_start = page_end THEN 'page ' || CAST(page_start AS VARCHAR) ELSE 'pages ' || CAST(page_start AS VARCHAR) || '-' || CAST(page_end AS VARCHAR) END
  || CASE WHEN clause_title IS NULL THEN '' ELSE ' | clause: ' || clause_title END || ')' || chr(10) || content"""


@query(
    "prompts_a1",
    "WITH " + PASSAGES + f""", ctx AS (SELECT query_id, string_agg({_SHOWN}, chr(10) || chr(10) ORDER BY rank) AS context, CAST(count(*) AS INTEGER) AS passages FROM psg GROUP BY query_id)
    SELECT query_id, passages, 'Context passages from the document:' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Question: ' || text AS prompt
    FROM ctx JOIN conversations ON conv_id = query_id AND turn = 0""",
)
def prompts(spark, d):
    questions = turns(spark, d).filter("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("question"))
    return answers.question_prompts(answers.contexts(passages(spark, d)), questions)


@query(
    "outline_contexts_a1",
    "WITH " + PASSAGES + """ SELECT query_id, string_agg('[' || CAST(rank AS VARCHAR) || '] (page ' || CAST(page_start AS VARCHAR) || CASE WHEN clause_title IS NULL THEN '' ELSE ' | heading: ' || clause_title END || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context,
      CAST(count(*) AS INTEGER) AS passages FROM psg GROUP BY query_id""",
)
def outline_contexts(spark, d):
    return answers.contexts(passages(spark, d), outline=True)




_LEAD = "'My PAN AKLPM4821R, phone 98' || lpad(CAST(conv_id AS VARCHAR), 8, '0') || ': '"


@query(
    "masked_requests_a2",
    f"""WITH asks AS (SELECT conv_id, turn, {_QID} AS query_id, regexp_replace(text, '@', ' at ', 'g') AS body FROM conversations WHERE role = 'user'),
    judged AS (SELECT *, CASE WHEN length({_LEAD} || body) > 2000 THEN 'question' END AS issue FROM asks)
    SELECT query_id, issue, CASE WHEN issue IS NULL THEN 'My PAN [PAN_1], phone ' || CASE WHEN turn % 4 = 0 THEN '[PHONE_2]' ELSE '[PHONE_1]' END || ': ' || body END AS question,
      CASE WHEN issue IS NULL THEN 'reach ' || CASE WHEN turn % 4 = 0 THEN '[PHONE_3]' ELSE '[PHONE_2]' END || ' or [EMAIL_1]' END AS first_turn FROM judged""",
)
def masked_requests(spark, d):
    """User turns that mention a PAN known from the upload, two phones and an e-mail address; over-long ones are rejected."""
    asks = turns(spark, d).filter("role = 'user'")
    own = F.concat(F.lit("98"), F.lpad(F.col("conv_id").cast("string"), 8, "0"))
    other = F.lit("+91 81234 56780")
    question = F.concat(F.lit("My PAN AKLPM4821R, phone "), own, F.lit(": "), F.regexp_replace("text", "@", " at "))
    turn = F.struct(F.lit("user").alias("role"), F.concat(F.lit("reach "), other, F.lit(" or Me@Mail.example.com")).alias("content"))
    asked = asks.select(qid().alias("query_id"), qid().alias("doc_id"), question.alias("question"), F.array(turn).alias("history"), "turn")
    requests, rejects = answers.split_requests(asked)
    known = F.array(
        F.struct(F.lit(0).alias("seed_pos"), F.lit("[PAN_1]").alias("placeholder"), F.lit("AKLPM4821R").alias("original")),
        F.struct(F.lit(1).alias("seed_pos"), F.lit("[PHONE_1]").alias("placeholder"), F.lit("7000000001").alias("original")),
    )
    issued = F.when(F.col("turn") % 4 == 0, known).otherwise(F.slice(known, 1, 1))
    pii = requests.select("doc_id", F.explode(issued).alias("e")).select("doc_id", "e.*")
    masked = answers.mask_requests(requests.drop("turn"), pii)
    nothing = F.lit(None).cast("string")
    shown = masked.select("query_id", nothing.alias("issue"), "question", F.element_at("history", 1).content.alias("first_turn"))
    return shown.unionByName(rejects.select("query_id", "issue", nothing.alias("question"), nothing.alias("first_turn")))


def _norm(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}{I.WS[1:-1]}\[\]_]', ' ', 'g'), '{I.WS}+', ' ', 'g'))"


_KEYED = f"""keyed AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN sha256(CAST(conv_id % 50 AS VARCHAR) || '|chat|' || {_norm('text')}) END AS cache_key FROM conversations WHERE role = 'user'),
  cache AS (SELECT DISTINCT cache_key FROM keyed WHERE conv_id % 3 = 0 AND cache_key IS NOT NULL)"""


def keyed_questions(spark, d):
    empty = F.array().cast("array<struct<role:string,content:string>>")
    one = F.array(F.struct(F.lit("user").alias("role"), F.lit("earlier").alias("content")))
    asks = turns(spark, d).filter("role = 'user'").select(
        "conv_id", "turn", (F.col("conv_id") % 50).alias("doc_id"), F.col("text").alias("question"),
        F.when(F.col("turn") == 0, empty).otherwise(one).alias("history"),
    )
    return answers.with_cache_key(asks, "chat")


def answer_cache(spark, d):
    known = keyed_questions(spark, d).filter("conv_id % 3 = 0 AND cache_key IS NOT NULL").dropDuplicates(["cache_key"])
    return known.select("cache_key", "doc_id", F.concat(F.lit("stored "), "cache_key").alias("response"))


@query(
    "answer_cache_probe_a3",
    "WITH " + _KEYED + """ SELECT conv_id, turn, c.cache_key IS NOT NULL AS cached, CASE WHEN c.cache_key IS NOT NULL THEN 'stored ' || c.cache_key END AS response FROM keyed LEFT JOIN cache c USING (cache_key)""",
)
def answer_cache_probe(spark, d):
    hits, misses = answers.probe_cache(keyed_questions(spark, d), answer_cache(spark, d))
    shown = hits.select("conv_id", "turn", "cached", "response")
    return shown.unionByName(
        misses.select("conv_id", "turn", F.lit(False).alias("cached"), F.lit(None).cast("string").alias("response"))
    )


@query(
    "answer_cache_fill_a3",
    "WITH " + _KEYED + """, after AS (SELECT cache_key FROM cache UNION SELECT cache_key FROM keyed WHERE cache_key IS NOT NULL AND conv_id % 7 <> 0)
    SELECT cache_key, cache_key IN (SELECT cache_key FROM cache) AS stored FROM after""",
)
def answer_cache_fill(spark, d):
    """Answers go in unless the key is known; refusals without context (every seventh) do not."""
    cache = answer_cache(spark, d)
    answered = keyed_questions(spark, d).withColumn("no_context", F.col("conv_id") % 7 == 0)
    answered = answered.withColumn("response", F.lit("fresh"))
    filled = answers.fill_cache(cache, answered)
    return filled.select("cache_key", F.col("response").startswith("stored").alias("stored"))


@query(
    "no_context_answers_a4",
    f"""SELECT {_QID} AS query_id, '{P.NO_CONTEXT_ANSWER}' AS answer, CAST(0 AS INTEGER) AS citations, true AS grounded, false AS cached FROM conversations c
    WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations n WHERE n.conv_id = c.conv_id AND n.turn = c.turn + 1)""",
)
def no_context_answers(spark, d):
    """Questions that nothing follows count as questions without retrieved passages."""
    asks = turns(spark, d).filter("role = 'user'").withColumn("query_id", qid())
    found = turns(spark, d).select("conv_id", (F.col("turn") - 1).alias("turn")).select(qid().alias("query_id"))
    return answers.no_context_answers(asks, found)


# assistant turns with markers appended by rule
_RAW = """CASE WHEN (conv_id + turn) % 11 = 0 THEN 'NOT_IN_DOCUMENT: - ' || CASE WHEN turn % 2 = 1 THEN '' ELSE '.' END || text
  WHEN (conv_id + turn) % 13 = 0 THEN ' NOT_IN_DOCUMENT .' ELSE 'As stated [' || CAST(conv_id % 5 AS {s}) || ',  ' || CAST(turn AS {s}) || '] .  Also [9], [' || CAST(turn + 1 AS {s}) || '] ; ' || {body} END"""


def responses(spark, d):
    body = F.regexp_replace("text", r"[\[\]]", "")
    rows = turns(spark, d).filter("role = 'assistant'").withColumn("body", body)
    raw = _RAW.format(s="STRING", body="body")
    counted = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("passages"))
    return rows.withColumn("raw", F.expr(raw)).join(counted, "conv_id").select(
        qid().alias("query_id"), "conv_id", "raw", "passages", (F.col("turn") % 3 % 2).alias("tool_calls")
    )


RESPONSES = (
    "resp AS (SELECT "
    + _QID
    + " AS query_id, conv_id, turn, n AS passages, turn % 3 % 2 AS tool_calls, text, regexp_replace(text, '[\\[\\]]', '', 'g') AS body, (conv_id + turn) % 11 = 0 OR (conv_id + turn) % 13 = 0 AS refused FROM conversations JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) USING (conv_id) WHERE role = 'assistant')"
)
_MARK1 = "list_filter([conv_id % 5, turn], lambda x: x BETWEEN 1 AND passages)"
_MARK = f"""CASE WHEN refused THEN CAST([] AS BIGINT[]) ELSE list_sort(list_distinct(list_concat({_MARK1}, list_filter([9, turn + 1], lambda x: x BETWEEN 1 AND passages)))) END"""
_SHOWN1 = f"CASE WHEN len({_MARK1}) > 0 THEN '[' || array_to_string(list_transform({_MARK1}, lambda x: CAST(x AS VARCHAR)), ', ') || ']' ELSE '' END"
_SHOWN2 = "CASE WHEN turn + 1 BETWEEN 1 AND passages THEN '[' || CAST(turn + 1 AS VARCHAR) || ']' ELSE '' END"
_SHOWN9 = "CASE WHEN 9 <= passages THEN '[9]' ELSE '' END"
_CLEAN = f"""{I.strip("regexp_replace(regexp_replace(x, ' {2,}', ' ', 'g'), '" + I.WS + "+([.,;])', '" + chr(92) + "1', 'g')")}"""
PARSED = RESPONSES + f""", built AS (SELECT *, 'As stated ' || {_SHOWN1} || ' .  Also ' || {_SHOWN9} || ', ' || {_SHOWN2} || ' ; ' || body AS x FROM resp),
  parsed AS (SELECT query_id, conv_id, tool_calls, refused AS not_found, {_MARK} AS refs,
    CASE WHEN (conv_id + turn) % 11 = 0 THEN coalesce(nullif({I.strip("regexp_replace('.' || text, '^[\\s:.-]+', '')")}, ''), '{P.NOT_STATED_ANSWER}')
      WHEN refused THEN '{P.NOT_STATED_ANSWER}' ELSE {_CLEAN} END AS answer FROM built)"""


@query("parsed_answers_a5", "WITH " + PARSED + " SELECT query_id, answer, not_found, array_to_string(list_transform(refs, lambda x: CAST(x AS VARCHAR)), ',') AS refs FROM parsed")
def parsed_answers(spark, d):
    parsed = answers.parse_answers(responses(spark, d))
    refs = F.array_join(F.transform("refs", lambda r: r.cast("string")), ",")
    return parsed.select("query_id", "answer", "not_found", refs.alias("refs"))


@query(
    "citations_a6",
    "WITH " + PARSED + ", " + PASSAGES + """, cited AS (SELECT query_id AS qid, conv_id, unnest(refs) AS ref FROM parsed)
    SELECT qid AS query_id, ref, chunk_id, CAST(page_start AS INTEGER) AS page, CAST(page_end AS INTEGER) AS page_end, clause_title FROM cited JOIN psg ON psg.query_id = conv_id AND rank = ref""",
)
def citations(spark, d):
    """Markers resolved against the passages of the conversation."""
    parsed = answers.parse_answers(responses(spark, d))
    keyed = parsed.select("query_id", "conv_id")
    mine = passages(spark, d).withColumnRenamed("query_id", "conv_id").join(keyed, "conv_id")
    return answers.resolve_citations(parsed, mine).drop("quote")


@query(
    "groundedness_a7",
    "WITH " + PARSED + " SELECT query_id, not_found OR len(refs) > 0 OR tool_calls > 0 AS grounded FROM parsed",
)
def groundedness(spark, d):
    parsed = answers.parse_answers(responses(spark, d))
    grounded = answers.grounded(F.col("refs"), F.col("not_found"), F.col("tool_calls"))
    return parsed.select("query_id", grounded.alias("grounded"))


_ARGS = """CASE loan_id % 7
  WHEN 0 THEN concat('{"principal":', p, ',"annualRatePercent":', CAST(annual_rate_percent AS STRING), ',"tenureMonths":', CAST(tenure_months AS STRING), ',"method":"', method, '"}')
  WHEN 1 THEN concat('{"principal":', p, ',"emi":', CAST(1000 + loan_id % 100 AS STRING), ',"tenureMonths":24}')
  WHEN 2 THEN concat('{"principal":', p, ',"annualRatePercent":', CAST(annual_rate_percent AS STRING), ',"tenureMonths":', CAST(tenure_months AS STRING), ',"upfrontFees":', CASE WHEN loan_id % 5 = 0 THEN p ELSE '100' END, '}')
  WHEN 3 THEN concat('{"amounts":[', p, ',', CAST(loan_id AS STRING), ',0.5]}')
  WHEN 4 THEN concat('{"percent":', CAST(loan_id % 9 - 1 AS STRING), ',"amount":', p, '}')
  WHEN 5 THEN concat('{"principal":"', p, '","annualRatePercent":12,"tenureMonths":1.5}') ELSE '{}' END"""
_TOOL = "CASE loan_id % 7 WHEN 0 THEN 'calculate_emi' WHEN 1 THEN 'calculate_total_cost' WHEN 2 THEN 'calculate_effective_annual_rate' WHEN 3 THEN 'sum_amounts' WHEN 4 THEN 'percent_of' WHEN 5 THEN 'calculate_emi' ELSE 'convert_currency' END"


@query(
    "calculator_a8",
    "WITH " + LOANS + f""", r AS (SELECT *, loan_id % 7 AS tool FROM loans)
    SELECT loan_id AS call_id, CASE
      WHEN tool = 0 AND tenure_months > 0 THEN {round2_sql(f"CASE WHEN method = 'flat' THEN {FLAT} ELSE {REDUCING} END")}
      WHEN tool = 1 THEN {round2_sql('(1000 + loan_id % 100) * 24 - principal')} WHEN tool = 2 AND tenure_months > 0 AND loan_id % 5 <> 0 THEN {round2_sql('principal - 100')}
      WHEN tool = 3 THEN {round2_sql('principal + loan_id + 0.5')} WHEN tool = 4 AND loan_id % 9 > 0 THEN {round2_sql('(loan_id % 9 - 1) / 100.0::DOUBLE * principal')} END AS value,
      CASE WHEN tool IN (0, 2) AND tenure_months <= 0 THEN 'tenureMonths: Too small: expected number to be >0' WHEN tool = 2 AND loan_id % 5 = 0 THEN '{finance.ERR_FEES}'
      WHEN tool = 4 AND loan_id % 9 = 0 THEN 'percent: Too small: expected number to be >=0'
      WHEN tool = 5 THEN 'principal: Invalid input: expected number, received string; tenureMonths: Invalid input: expected int, received number'
      WHEN tool = 6 THEN 'unknown tool convert_currency' END AS error FROM r""",
)
def calculator_calls(spark, d):
    """Calls of every tool written as JSON, some with bad arguments; one figure of each result."""
    rows = table(spark, d, "orders").selectExpr(*LOAN_FIELDS, "CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING) AS p")
    calls = store.spread(rows, "loan_id", store.UNFOLDED).selectExpr("loan_id AS call_id", f"{_TOOL} AS name", f"{_ARGS} AS args")
    done = calculator.run_tools(calls)
    result = F.col("result")
    value = F.coalesce(result["netDisbursal"], result["emi"], result["total"], result["result"], result["totalInterest"])
    return done.select("call_id", value.alias("value"), "error")


@query(
    "tool_rounds_a9",
    """SELECT user_id, count(*) FILTER (event_type <> 'purchase') AS tool_rounds, CAST(sum(event_id % 100) AS BIGINT) AS input_tokens,
      CASE WHEN count(*) FILTER (event_type <> 'purchase') > 4 THEN 'LLM_TOOL_LOOP' END AS error FROM events GROUP BY user_id""",
)
def tool_rounds(spark, d):
    """Events as model calls: all but purchases asked for tools."""
    trace = table(spark, d, "events").select(
        F.col("user_id").alias("query_id"), (F.col("event_type") != "purchase").cast("int").alias("calls"),
        (F.col("event_id") % 100).alias("input_tokens"), F.lit(1).alias("output_tokens"),
    )
    done = answers.tool_rounds(trace)
    return done.select(F.col("query_id").alias("user_id"), "tool_rounds", "input_tokens", "error")


@query(
    "history_windows_a10",
    """WITH u AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE (conv_id + turn) % 6 <> 0 AND turn % 5 <> 4)
    SELECT conv_id, count(*) AS turns, string_agg(role || ':' || CAST(length(text) AS VARCHAR), ',' ORDER BY turn) AS history FROM u WHERE back <= 4 GROUP BY conv_id""",
)
def history_windows(spark, d):
    """The last four usable turns; every sixth is pending and some have failed."""
    marked = table(spark, d, "conversations").select(
        "*", ((F.col("conv_id") + F.col("turn")) % 6 == 0).alias("pending"), (F.col("turn") % 5 == 4).alias("error")
    )
    recent = answers.recent_history(marked, 4)
    shown = F.transform("history", lambda t: F.concat(t.role, F.lit(":"), F.length(t.content).cast("string")))
    return recent.select("conv_id", F.size("history").cast("bigint").alias("turns"), F.array_join(shown, ",").alias("history"))


