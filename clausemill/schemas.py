"""Explicit schemas of the input and stored tables; nothing is inferred."""

from __future__ import annotations

PAGES = "doc_id string, page int, text string"
RUNS = "doc_id string, page int, seq int, x double, y double, str string"
UPLOADS = "doc_id string, file_name string, mime_type string"
CITATION = "struct<chunk_id:string,page:int,page_end:int,clause_title:string,quote:string>"
RISK_FLAG = (
    "struct<category:string,severity:string,title:string,explanation:string,chunk_id:string,page:int,page_end:int,"
    "clause_title:string,quote:string>"
)
DOCUMENTS = (
    "doc_id string, title string, source_type string, kind string, content_hash string, page_count int, "
    "chunk_count int, is_sample boolean, sample_slug string, status string, created_at timestamp, expires_at timestamp, "
    "warning string, extraction string, contract_facts string, outline string, risk_flags string"
)
CHUNKS = (
    "chunk_id string, doc_id string, chunk_index int, page_start int, page_end int, clause_title string, "
    "content string, token_count int"
)
PII_MAP = "doc_id string, placeholder string, original string"
EMBEDDING_CACHE = "content_hash string, model string, embedding array<float>"
ANSWER_CACHE = "cache_key string, doc_id string, response string"
QUESTIONS = "query_id string, doc_id string, question string, history array<struct<role:string,content:string>>"
RESPONSES = "query_id string, raw string"
TOOL_REQUESTS = "call_id string, name string, args string"
LOANS = (
    "loan_id string, principal double, annual_rate_percent double, tenure_months int, method string, "
    "upfront_fees double, stated_emi double"
)
SAMPLE_INDEX = "slug string, title string, kind string, file string, page_count int"

# fixed values: allowed words
STATUSES = ("parsed", "embedded", "failed")
KINDS = ("loan", "contract", "general")
SOURCE_TYPES = ("pdf", "docx")
