"""Personal data in ``documents`` and the terms that disclose it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .disclosure import CONTEXT, DISCLOSURE, KEPT, KINDS, NEAR, find
from .registry import query, table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}[\p{L}\p{N}]{2,}"


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def holds(kind: str, v: str) -> str:
    if kind == "ip":
        parts = f"string_split({v}, '.')"
        return f"len(list_filter({parts}, lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS BIGINT), 0) > 255)) = 0"
    if kind == "card":
        twice = "2 * digit - 9 * (2 * digit > 9)::INT"
        number = digits(v)
        worth = f"list_transform(string_split(reverse({number}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT ELSE {twice.replace('digit', 'c::INT')} END)"
        return f"(length({number}) BETWEEN 16 AND 19 AND list_sum({worth}) % 10 = 0)"
    if kind == "phone":
        return f"length({digits(v)}) BETWEEN 8 AND 15"
    return "true"


def same_value(kind: str) -> str:
    return "'" + kind + ":' || " + ("lower(v)" if kind == "email" else "v" if kind == "ip" else digits("v"))


def near_terms(gap: str, before: bool) -> str:
    side = f"right({gap}, {CONTEXT})" if before else f"left({gap}, {CONTEXT})"
    cut = r"^[^\x20\x09-\x0D]*" if before else r"[^\x20\x09-\x0D]*$"
    text = f"CASE WHEN length({gap}) > {CONTEXT} THEN regexp_replace({side}, '{cut}', '') ELSE {gap} END"
    for kind in KINDS:
        text = f"regexp_replace({text}, '{PATTERNS[kind]}', ' ', 'g')"
    terms = f"list_transform(regexp_extract_all({text}, '{TERM}'), lambda x: lower(x))"
    return f"({terms})[-{NEAR}:]" if before else f"({terms})[:{NEAR}]"


def general(x: str) -> str:
    return f"left({x}, {KEPT}) || '*'"


def placed(name: str, source: str, text: str, pattern: str, more: str) -> str:
    """All matches of a pattern with their start."""
    return f"""SELECT rid, {more}, hits[i] AS v, gaps[i] AS before, gaps[i + 1] AS after,
      (sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY rid ORDER BY i) - length(hits[i]))::BIGINT AS start
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT *, regexp_extract_all({text}, '{pattern}') AS hits, string_split_regex({text}, '{pattern}') AS gaps FROM {source}))"""


def blanked(kind: str, text: str) -> str:
    hits, gaps = f"regexp_extract_all({text}, '{PATTERNS[kind]}')", f"string_split_regex({text}, '{PATTERNS[kind]}')"
    each = f"g || CASE WHEN i > len(hits) THEN '' WHEN {holds(kind, 'hits[i]')} THEN repeat(' ', length(hits[i])) ELSE hits[i] END"
    return f"array_to_string(list_transform(gaps, lambda g, i: {each}), '')", hits, gaps


def sql() -> str:
    kinds = "\n  UNION ALL ".join(
        f"SELECT rid, kind, ord, v, before, after, start, {same_value(k)} AS value FROM ("
        + placed(k, "docs", "t", PATTERNS[k], f"'{k}' AS kind, {n} AS ord") + f") WHERE {holds(k, 'v')}"
        for n, k in enumerate(KINDS)
    )
    masks, before = "", "held"
    for k in KINDS:
        joined, hits, gaps = blanked(k, "t")
        masks += f", cut_{k} AS (SELECT *, {hits} AS hits, {gaps} AS gaps FROM {before}), no_{k} AS (SELECT rid, {joined} AS t FROM cut_{k})"
        before = f"no_{k}"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
  found AS ({kinds}),
  around AS (SELECT rid, value, list_concat({near_terms('before', True)}, {near_terms('after', False)}) AS near FROM found),
  met AS (SELECT DISTINCT rid, value, array_to_string(near, ' ') AS surroundings,
    unnest(list_distinct(list_concat(near, list_transform(near, lambda x: {general('x')})))) AS term FROM around),
  pairs AS (SELECT value, term, count(DISTINCT rid) AS together FROM met GROUP BY value, term HAVING count(DISTINCT surroundings) > 1),
  worded AS (SELECT rid, list_transform(regexp_extract_all(t, '{TERM}'), lambda x: lower(x)) AS ws FROM docs),
  every AS (SELECT unnest(list_distinct(list_concat(ws, list_transform(ws, lambda x: {general('x')})))) AS term FROM worded),
  counts AS (SELECT term, count(*) AS n FROM every SEMI JOIN pairs USING (term) GROUP BY term),
  holding AS (SELECT value, (SELECT count(*) FROM docs)::DOUBLE / count(DISTINCT rid) AS rare FROM found GROUP BY value),
  told AS (SELECT value, term FROM pairs JOIN counts USING (term) JOIN holding USING (value)
    WHERE rare > 1 AND ln(together / greatest(n, together)::DOUBLE * rare) > {DISCLOSURE} * ln(rare) AND term NOT LIKE '%*'),
  own AS (SELECT DISTINCT rid, term FROM met JOIN told USING (value, term)),
  held AS (SELECT rid, t FROM docs SEMI JOIN own USING (rid)){masks},
  terms AS (SELECT w.rid, 'term' AS kind, {len(KINDS)} AS ord, v, start FROM ({placed('term', before, 't', TERM, "'' AS kind")}) w
    SEMI JOIN own o ON o.rid = w.rid AND o.term = lower(w.v)),
  spans AS (SELECT rid, kind, ord, start, kind || ':' || start || ':' || (start + length(v)) AS shown FROM (
    SELECT rid, kind, ord, v, start FROM found UNION ALL SELECT rid, kind, ord, v, start FROM terms)),
  lists AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)},
    string_agg(shown, ',' ORDER BY ord, start) FILTER (kind <> 'term') AS base, string_agg(shown, ',' ORDER BY ord, start) AS spans FROM spans GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN lists USING (rid)"""


@query("op13_personal_data", sql())
def personal_data(spark, folder):
    found = find(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans"
    )
