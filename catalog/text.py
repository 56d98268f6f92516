"""Scalar text operators over documents, conversations, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.functions import money as M
from clausemill.functions import text as X
from clausemill.functions import vectors as V
from clausemill.operators import classify, embedding, layout
from clausemill.sources import store

from . import inputs as I
from .registry import query, table

# English stand-ins for the agreement vocabulary, so that the invented prose of the corpus scores
DEMO_LOAN = (r"\bthe\b", r"\band\b", r"\bof\b", r"\bis\b|\bare\b", r"\btion", r"ing\b", r"\bfor\b")
DEMO_CONTRACT = (r"\bin\b", r"\bto\b", r"\bwith\b", r"\bare\b|\bwas\b", r"\bas\b", r"th(?:e|at)\b")


@query("pages_from_documents_s1", "WITH " + I.PAGES + " SELECT doc_id, page, text FROM doc_pages")
def pages_from_documents(spark, d):
    return I.pages(spark, d)


@query("page_lines_p1", "WITH " + I.LINES + " SELECT doc_id, page, line_no, text FROM doc_lines")
def page_lines(spark, d):
    return layout.page_lines(I.pages(spark, d))


@query("token_estimate_p2", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS INTEGER) AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.text_tokens("text").alias("tokens"))


@query(
    "headings_p3",
    "WITH " + I.LINES + f" SELECT doc_id, page, line_no, {I.heading_sql('text')} AS heading FROM doc_lines",
)
def headings(spark, d):
    return layout.page_lines(I.pages(spark, d)).select("doc_id", "page", "line_no", X.is_heading("text").alias("heading"))


@query(
    "sentences_p4",
    "WITH " + I.LINES
    + f""" SELECT doc_id, page, line_no, CAST(i AS INTEGER) AS piece_no, ps[i+1] AS piece FROM (
      SELECT doc_id, page, line_no, ps, unnest(range(len(ps))) AS i FROM (
        SELECT doc_id, page, line_no, {I.sentences_sql('text')} AS ps FROM doc_lines))""",
)
def sentences(spark, d):
    return layout.page_lines(I.pages(spark, d)).select(
        "doc_id", "page", "line_no", F.posexplode(X.sentences("text")).alias("piece_no", "piece")
    )


def _density_sql(patterns) -> tuple[str, str, str]:
    counts = [f"len(regexp_extract_all(lower(text), '{p}'))" for p in patterns]
    total = " + ".join(counts)
    distinct = " + ".join(f"CAST({c} > 0 AS INTEGER)" for c in counts)
    words = f"len(list_filter(string_split_regex(text, '{I.WS}+'), lambda w: w <> ''))"
    return total, distinct, words


_total, _distinct, _words = _density_sql(DEMO_LOAN)


@query(
    "keyword_density_p5",
    f"SELECT doc_id, round(({_total}) / greatest({_words}, 1)::DOUBLE * 1000, 6) AS density, CAST({_distinct} AS INTEGER) AS signals FROM documents",
)
def keyword_density(spark, d):
    docs = I.documents(spark, d)
    hits = [X.pattern_hits(F.lower("text"), p) for p in DEMO_LOAN]
    density, distinct = classify.keyword_density(hits, X.word_count("text"))
    return docs.select("doc_id", F.round(density, 6).alias("density"), distinct.cast("int").alias("signals"))


_lt, _ld, _w = _density_sql(DEMO_LOAN)
_ct, _cd, _ = _density_sql(DEMO_CONTRACT)


@query(
    "document_kind_p6",
    f"""WITH scored AS (SELECT doc_id, ({_lt}) / greatest({_w}, 1)::DOUBLE * 1000 AS ld, {_ld} AS ls,
        ({_ct}) / greatest({_w}, 1)::DOUBLE * 1000 AS cd, {_cd} AS cs FROM documents)
    SELECT doc_id, CASE WHEN cd >= 10 AND cs >= 4 THEN CASE WHEN ld >= 12 AND ls >= 5 THEN 'loan' ELSE 'contract' END ELSE 'general' END AS kind,
      floor(ld * 10 + 0.5) / 10 AS loan_density, floor(cd * 10 + 0.5) / 10 AS contract_density, CAST(ls AS BIGINT) AS loan_signals
    FROM scored""",
)
def document_kind(spark, d):
    """Counts per line add up to the document's, since no signal crosses a line end."""
    docs = I.documents(spark, d)
    lines = docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("content"))
    return classify.classify_chunks(lines, DEMO_LOAN, DEMO_CONTRACT).withColumn("loan_signals", F.col("loan_signals").cast("bigint"))


_kind_words = "lender borrower loan emi tenure principal sanctioned repayment disbursed agreement party shall notice terminate deposit rent".split()


@query(
    "agreement_kind_p6",
    """WITH words AS (SELECT o_orderkey AS doc_id, unnest(range(40)) AS i FROM orders),
    spelled AS (SELECT doc_id, (doc_id * 7 + i * (1 + doc_id % 5)) % 24 AS w FROM words),
    hits AS (SELECT doc_id,
      count(*) FILTER (w IN (0,1,2,3,4,5,6,7,8)) AS loan, count(DISTINCT CASE WHEN w IN (0,1,2,3,4,5,6,7,8) THEN w END) AS ls,
      count(*) FILTER (w IN (9,10,11,12,13,14,15)) AS con,
      count(DISTINCT CASE WHEN w IN (9,10,11,12,13) THEN w WHEN w IN (14,15) THEN 14 END) AS cs FROM spelled GROUP BY doc_id)
    SELECT doc_id, CASE WHEN con / 40.0 * 1000 >= 10 AND cs >= 4 THEN CASE WHEN loan / 40.0 * 1000 >= 12 AND ls >= 5 THEN 'loan' ELSE 'contract' END ELSE 'general' END AS kind,
      CAST(ls AS BIGINT) AS loan_signals FROM hits""",
)
def agreement_kind(spark, d):
    """The real agreement vocabulary on texts spelled from the order keys."""
    words = F.array(*[F.lit(w) for w in _kind_words + ["plain"] * (24 - len(_kind_words))])
    key = F.col("o_orderkey")
    text = F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.lit(39)), lambda i: F.get(words, ((key * 7 + i * (1 + key % 5)) % 24).cast("int"))
        ),
        " ",
    )
    orders = store.spread(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", store.UNFOLDED)
    docs = orders.select(key.alias("doc_id"), text.alias("content"))
    return classify.classify_chunks(docs).select("doc_id", "kind", F.col("loan_signals").cast("bigint").alias("loan_signals"))


@query(
    "quotes_p7",
    rf"""WITH bodies AS (SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN text[instr(text, chr(10))+1:] ELSE text END AS body FROM documents),
    firsts AS (SELECT doc_id, body, string_split(body, chr(10))[1] AS line FROM bodies),
    shielded AS (SELECT doc_id, body, line, regexp_replace(line, '(^|[^A-Za-z0-9_])(Rs|No|Mr|Ms|Mrs|Dr|Sr|Jr|vs|Ltd|Pvt|Inc|Co)([.;:])', '\1\2' || CASE WHEN true THEN chr(2) ELSE '' END || '\3', 'g') AS safe FROM firsts),
    cut AS (SELECT doc_id, body, replace(regexp_replace(line || CASE WHEN contains(body, chr(10)) THEN chr(10) || body[length(line)+2:length(line)+200] ELSE '' END,
        '^([^\n]{{20,}}?)([.;:]){I.WS}+([A-Z0-9(\[])', '\1\2' || chr(1) || '\3'), chr(2), '') AS marked FROM shielded),
    sentence AS (SELECT doc_id, body, CASE WHEN contains(marked, chr(1)) THEN marked[:instr(marked, chr(1))-1] ELSE body END AS s0 FROM cut),
    trimmed AS (SELECT doc_id, {I.strip('s0')} AS s FROM sentence)
    SELECT doc_id, CASE WHEN length(s) > 220 THEN s[1:219] || '…' ELSE s END AS quote FROM trimmed""".replace("'^([^\\n]{20,}?)([.;:])", "'^([^\\n]{19,}?)([.;:])"),
)
def quotes(spark, d):
    return table(spark, d, "documents").select("doc_id", X.quote("text").alias("quote"))


@query(
    "question_normalised_p8",
    rf"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}{I.WS[1:-1]}\[\]_]', ' ', 'g'), '{I.WS}+', ' ', 'g')) AS question
    FROM conversations""",
)
def question_normalised(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.normalise_question("text").alias("question"))


@query(
    "embedding_keys_p9",
    "SELECT doc_id, sha256('feature-hash:64:RETRIEVAL_DOCUMENT:' || text) AS content_hash FROM documents",
)
def embedding_keys(spark, d):
    docs = table(spark, d, "documents")
    return embedding.with_keys(docs, embedding.HASH_MODEL, 64, "RETRIEVAL_DOCUMENT").select("doc_id", "content_hash")


@query(
    "answer_keys_p10",
    rf"""SELECT conv_id, turn, CASE WHEN turn = 0 THEN sha256(CAST(conv_id AS VARCHAR) || '|chat|' ||
      trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}{I.WS[1:-1]}\[\]_]', ' ', 'g'), '{I.WS}+', ' ', 'g'))) END AS cache_key
    FROM conversations WHERE role = 'user'""",
)
def answer_keys(spark, d):
    turns = table(spark, d, "conversations").filter("role = 'user'")
    key = X.answer_key(F.col("conv_id"), F.lit("chat"), F.col("text"), F.col("turn"))
    return turns.select("conv_id", "turn", key.alias("cache_key"))


@query(
    "content_fingerprint_p11",
    "WITH " + I.PAGES + " SELECT doc_id, sha256(string_agg(text, chr(12) ORDER BY page)) AS content_hash FROM doc_pages GROUP BY doc_id",
)
def content_fingerprint(spark, d):
    gathered = I.pages(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return gathered.select("doc_id", X.fingerprint(F.transform("p", lambda x: x.text)).alias("content_hash"))


@query(
    "numbers_in_text_p12",
    """WITH t AS (SELECT o_orderkey, unnest([o_totalprice, CAST(o_orderkey AS DOUBLE), 1234567.0, round(o_totalprice / 1000, 1)]) AS n,
      unnest([0, 1, 2, 3]) AS pos FROM orders) SELECT o_orderkey, CAST(pos AS INTEGER) AS pos, round(n, 6) AS n FROM t""",
)
def numbers_in_text(spark, d):
    """Western, plain, Indian-grouped and short numbers written into a sentence, with decoys."""
    price = F.col("o_totalprice")
    text = F.concat(
        F.lit("Paid "), F.format_number(price, 2), F.lit(" for order "), F.col("o_orderkey").cast("string"),
        F.lit(" of 12,34,567 (ref A77, x9.5y) or "), F.format_string("%.1f", F.round(price / 1000, 1)), F.lit("k"),
    )
    text = F.regexp_replace(text, "k$", " thousand")
    rows = table(spark, d, "orders").select("o_orderkey", F.posexplode(X.numbers_in(text)).alias("pos", "n"))
    return rows.select("o_orderkey", "pos", F.round("n", 6).alias("n"))


def _indian_sql(x: str) -> str:
    """Group digits by reversing: three, then pairs."""
    cents = f"CAST(round(abs({x}) * 100) AS BIGINT)"
    whole = f"CAST({cents} // 100 AS VARCHAR)"
    head = f"reverse(regexp_replace(reverse({whole}[:-4]), '(\\d\\d)', '\\1,', 'g'))"
    grouped = f"CASE WHEN length({whole}) > 3 THEN ltrim({head}, ',') || ',' || {whole}[-3:] ELSE {whole} END"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || {grouped} || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'))"


@query(
    "indian_currency_p13",
    f"SELECT o_orderkey, 'Rs. ' || {_indian_sql('o_totalprice * 37')} AS rupees, printf('%.2f', floor(o_orderkey % 100 / 8.0 * 100 + 0.5) / 100) || '%' AS percent FROM orders",
)
def indian_currency(spark, d):
    orders = table(spark, d, "orders")
    return orders.select(
        "o_orderkey", M.display("totalRepayment", F.round(F.col("o_totalprice") * 37, 2)).alias("rupees"),
        M.display("aprPercent", F.col("o_orderkey") % 100 / 8).alias("percent"),
    )


@query(
    "display_helpers_p14",
    f"""SELECT o_orderkey,
      CASE WHEN o_orderkey % 7 = 0 THEN '—' ELSE '₹' || {_indian_sql('o_totalprice')} END AS money,
      CASE WHEN m IS NULL THEN '—' ELSE CAST(m AS VARCHAR) || ' months' || CASE WHEN m // 12 > 0 OR m % 12 > 0 THEN ' (' ||
        concat_ws(' ', CASE WHEN m // 12 > 1 THEN CAST(m // 12 AS VARCHAR) || ' yrs' WHEN m // 12 = 1 THEN '1 yr' END,
          CASE WHEN m % 12 > 0 THEN CAST(m % 12 AS VARCHAR) || ' mo' END) || ')' ELSE '' END END AS months,
      CASE WHEN o_orderkey % 5 = 0 THEN 'Not stated' WHEN o_orderkey % 5 = 1 THEN 'Nil'
        WHEN o_orderkey % 5 = 2 THEN CAST(o_orderkey % 4 + 1 AS VARCHAR) || '%'
        WHEN o_orderkey % 5 = 3 THEN CAST(o_orderkey % 4 + 1 AS VARCHAR) || '% / ₹' || {_indian_sql('o_totalprice')}
        ELSE 'Stated' END AS fee
    FROM (SELECT *, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 300 END AS m FROM orders)""",
)
def display_helpers(spark, d):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    amount = F.when(key % 5 == 1, 0.0).when(key % 5 == 3, price)
    share = F.when(key % 5 == 1, 0.0).when(key % 5 == 4, F.lit(None)).when(key % 5 != 0, (key % 4 + 1).cast("double"))
    return table(spark, d, "orders").select(
        "o_orderkey", M.money(F.when(key % 7 != 0, price)).alias("money"),
        M.months(F.when(key % 11 != 0, key % 300)).alias("months"),
        M.fee(amount, share, key % 5 == 0, F.lit(None).cast("string")).alias("fee"),
    )


@query(
    "passage_headers_p15",
    """SELECT doc_id, '[' || CAST(n AS VARCHAR) || '] (' || CASE WHEN a = b THEN 'page ' || CAST(a AS VARCHAR) ELSE 'pages ' || CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) END
      || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' | clause: ' || source END || ')' || chr(10) || text AS passage
    FROM (SELECT *, doc_id % 8 + 1 AS n, doc_id % 5 + 1 AS a, doc_id % 5 + 1 + doc_id % 2 AS b FROM documents)""",
)
def passage_headers(spark, d):
    key = F.col("doc_id")
    first = key % 5 + 1
    title = F.when(key % 3 != 0, F.col("source"))
    text = X.passage(key % 8 + 1, first, first + key % 2, title, F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.alias("passage"))


@query(
    "highlight_runs_p16",
    "WITH " + I.PAGES
    + f""", pages_n AS (SELECT doc_id, page, lower({I.collapse('text')}) AS hay FROM doc_pages),
    runs AS (SELECT doc_id, lower({I.collapse('line')}) AS run FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
    SELECT r.doc_id, p.page, count(*) AS hits FROM runs r JOIN pages_n p USING (doc_id)
    WHERE length(run) >= 12 AND contains(hay, run) GROUP BY ALL""",
)
def highlight_runs(spark, d):
    """Every line of a document as a run, lit up on the pages that contain it."""
    lines = I.documents(spark, d).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    runs = lines.select("doc_id", X.highlight_form(F.col("line")).alias("run"))
    cited = I.pages(spark, d).select("doc_id", "page", X.highlight_form(F.col("text")).alias("hay"))
    hits = runs.join(cited, "doc_id").filter(X.highlight_hit(F.col("run"), F.col("hay")))
    return hits.groupBy("doc_id", "page").agg(F.count("*").alias("hits"))


@query(
    "unit_vectors_p17",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN vec_id % 9 = 0 THEN 0.0::DOUBLE ELSE CAST(x AS DOUBLE) * i END) AS e FROM embeddings),
    n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v)
    SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS length2, round(u[1], 6) AS first, round(u[64], 6) AS last
    FROM (SELECT vec_id, CASE WHEN norm = 0 THEN e ELSE list_transform(e, lambda x: x / norm) END AS u FROM n)""",
)
def unit_vectors(spark, d):
    key = F.col("vec_id")
    scaled = F.transform(
        "embedding", lambda x, i: F.when(key % 9 == 0, 0.0).otherwise(x.cast("double") * (i + 1))
    )
    unit = V.normalise(F.col("v"))
    df = table(spark, d, "embeddings").select("vec_id", scaled.alias("v")).select("vec_id", unit.alias("u"))
    square = F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)
    return df.select(
        "vec_id", F.round(square, 6).alias("length2"), F.round(F.get("u", 0), 6).alias("first"),
        F.round(F.get("u", 63), 6).alias("last"),
    )


@query(
    "vector_literals_p18",
    "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS size, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total, true AS same FROM embeddings",
)
def vector_literals(spark, d):
    """Vectors written to text and read back unchanged."""
    written = table(spark, d, "embeddings").withColumn("s", V.to_literal(F.col("embedding")))
    back = written.withColumn("v", V.from_literal(F.col("s")))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select(
        "vec_id", F.size("v").alias("size"), F.round(total, 6).alias("total"), (F.col("v") == F.col("embedding")).alias("same")
    )


@query(
    "vector_sizes_p19",
    """SELECT label, count(*) FILTER (n = 64) AS accepted, count(*) FILTER (n <> 64) AS rejected FROM
      (SELECT label, len(CASE WHEN vec_id % 10 = 3 THEN embedding[1:63] ELSE embedding END) AS n FROM embeddings) GROUP BY label""",
)
def vector_sizes(spark, d):
    """Every tenth response lost a component and is rejected."""
    cut = F.when(F.col("vec_id") % 10 == 3, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    responses = table(spark, d, "embeddings").select("label", cut.alias("embedding"))
    good, bad = embedding.accept_vectors(responses, 64)
    counts = good.select("label", F.lit(1).alias("ok")).unionByName(bad.select("label", F.lit(0).alias("ok")))
    return counts.groupBy("label").agg(
        F.count_if(F.col("ok") == 1).alias("accepted"), F.count_if(F.col("ok") == 0).alias("rejected")
    )


_FILE = """CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_') || '.pdf' WHEN 1 THEN replace(p_name, ' ', '--') || '.final.DOCX'
  WHEN 2 THEN p_name || '.txt' ELSE '_' || p_brand END"""
_MIME = "CASE WHEN p_size % 5 = 0 THEN 'application/pdf' WHEN p_size % 5 = 1 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END"


def _uploads(spark, d):
    files = table(spark, d, "part").selectExpr("p_partkey AS doc_id", f"{_FILE} AS file_name", f"{_MIME} AS mime_type")
    return layout.uploads_with_type(files)


@query(
    "source_types_s3",
    f"""WITH u AS (SELECT p_partkey AS doc_id, {_FILE} AS f, {_MIME} AS m FROM part),
    k AS (SELECT doc_id, CASE WHEN m = 'application/pdf' OR string_split(lower(f), '.')[-1] = 'pdf' THEN 'pdf'
      WHEN m LIKE '%wordprocessingml.document' OR string_split(lower(f), '.')[-1] = 'docx' THEN 'docx' END AS source_type FROM u)
    SELECT doc_id, source_type, CASE WHEN source_type IS NULL THEN 'UNSUPPORTED_TYPE' END AS reject FROM k""",
)
def source_types(spark, d):
    return _uploads(spark, d).select("doc_id", "source_type", "reject")


@query(
    "file_titles_s4",
    f"""WITH u AS (SELECT p_partkey AS doc_id, {_FILE} AS f FROM part)
    SELECT doc_id, coalesce(nullif(trim(regexp_replace(regexp_replace(f, '\\.[^.]+$', ''), '[_-]+', ' ', 'g'))[1:120], ''), 'Untitled document') AS title FROM u""",
)
def file_titles(spark, d):
    return _uploads(spark, d).select("doc_id", "title")


_BLANKED = "CASE WHEN (doc_id + page) % 4 = 0 THEN ' scan ' ELSE text END"


@query(
    "extraction_quality_s5",
    "WITH " + I.PAGES
    + f""", q AS (SELECT doc_id, count(*) AS page_count, count(*) FILTER (length(regexp_replace(t, '{I.WS}+', '', 'g')) >= 25) AS text_pages
        FROM (SELECT doc_id, CASE WHEN (doc_id + page) % 4 = 0 THEN ' scan ' ELSE text END AS t FROM doc_pages) GROUP BY doc_id),
    r AS (SELECT *, CASE WHEN page_count > 12 THEN 'TOO_MANY_PAGES' WHEN text_pages = 0 THEN 'SCANNED_PDF' END AS reject FROM q)
    SELECT doc_id, page_count, text_pages, reject, CASE WHEN reject IS NULL AND text_pages < page_count
      THEN CAST(page_count - text_pages AS VARCHAR) || ' of ' || CAST(page_count AS VARCHAR) || ' pages had no extractable text and were skipped.' END AS warning FROM r""",
)
def extraction_quality(spark, d):
    """Every fourth page is blanked; documents of more than twelve pages are over the limit."""
    pages = I.pages(spark, d).withColumn("text", F.expr(_BLANKED))
    return layout.page_quality(pages, max_pages=12).select("doc_id", "page_count", "text_pages", "reject", "warning")


@query(
    "raw_text_s6",
    f"""SELECT doc_id, CAST(1 AS INTEGER) AS page, {I.strip("regexp_replace(replace('  ' || replace(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN chr(13) || chr(10) ELSE chr(10) || chr(10) || chr(10) || chr(10) END) || chr(10), chr(13) || chr(10), chr(10)), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS text FROM documents""",
)
def raw_text(spark, d):
    """Documents with Windows or tripled line ends and stray outer whitespace."""
    sep = F.when(F.col("doc_id") % 2 == 0, "\r\n").otherwise("\n\n\n\n")
    raw = F.concat(F.lit("  "), F.replace("text", F.lit("\n"), sep), F.lit("\n"))
    return layout.raw_to_pages(table(spark, d, "documents").select("doc_id", raw.alias("text")))


@query(
    "page_layout_s2",
    f"""WITH l AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    c AS (SELECT doc_id, i // 8 + 1 AS page, i, {I.collapse('ls[i+1]')} AS t FROM l)
    SELECT doc_id, CAST(page AS INTEGER) AS page, string_agg(t, chr(10) ORDER BY i) AS text FROM c WHERE t <> '' GROUP BY doc_id, page""",
)
def page_layout(spark, d):
    """Words of every document as positioned runs with uneven baselines, read back in order."""
    docs = I.documents(spark, d)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "s"))
    words = lines.select("doc_id", "line", F.posexplode(F.split("s", " ", -1)).alias("word", "str"))
    runs = words.select(
        "doc_id", (F.floor(F.col("line") / 8) + 1).cast("int").alias("page"),
        (F.col("line") * 100000 + F.col("word")).cast("int").alias("seq"), (F.col("word") * 7.0).alias("x"),
        (F.lit(700.0) - (F.col("line") % 8) * 12 + (F.col("word") % 3) * 0.5).alias("y"), "str",
    )
    return layout.runs_to_pages(runs)


