"""Texts are cut and trimmed as the expressions that define it would, odd whitespace and letters included."""

import random
import re

import pyarrow as pa
import pytest

from clausemill.functions import patterns as P
from clausemill.functions import text as X

BITS = [
    "the", "ing", "ed", "ES", "İstanbul", "Kelvin K9", "[pan_1]", "[PAN_12]x", "a", "%", "4%", "wishes", "under_score", "of", "s", "ßé", "中",
    " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", " ", " ", "᠎", " ", "　", "﻿", "​", ".", "; ", ": A", "No. 5", "xNo. 5", "Rs.", "(b)", "\u0001",
]


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(11)
    return [None, "", " ", "..", *["".join(pick.choice(BITS) + pick.choice(["", " "]) for _ in range(pick.randrange(30))) for _ in range(1500)]]


def got(spark, texts, column):
    return [r["x"] for r in spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", column.alias("x")).orderBy("n").collect()]


def java(pattern):
    """A pattern in the form that Python reads alike."""
    return re.compile(pattern.replace(r"\z", r"\Z"), re.ASCII)


def test_whitespace(spark, texts):
    run = java(f"{P.WS}+")
    assert set(P.WS_CHARACTERS) == {chr(c) for c in range(0x10000) if java(P.WS).match(chr(c))}
    assert got(spark, texts, X.collapse_ws("t")) == [None if t is None else run.sub(" ", t).strip(" ") for t in texts]
    assert got(spark, texts, X.strip_ws("t")) == [None if t is None else java(f"^{P.WS}+|{P.WS}+\\z").sub("", t) for t in texts]


def test_sentences(spark, texts):
    # Python looks back over one length only: the abbreviations one by one
    words = "".join(rf"(?<!(?<![A-Za-z0-9_]){w})" for w in P.ABBREVIATIONS)
    cut = java("(?<=[.;:])" + P.WS + r"+(?=[A-Z0-9(\[])")
    keeps = java(rf".*{words}[.;:]\Z")
    strip = java(f"^{P.WS}+|{P.WS}+\\z")

    def expected(text):
        pieces, at = [], 0
        for m in cut.finditer(text):
            if re.compile(keeps.pattern, re.ASCII | re.DOTALL).match(text[: m.start()]):
                pieces.append(text[at : m.start()])
                at = m.end()
        return [s for s in (strip.sub("", p) for p in [*pieces, text[at:]]) if s]

    assert got(spark, texts, X.sentences("t")) == [None if t is None else expected(t) for t in texts]


def expected_tokens(text):
    if text is None:
        return None
    lowered = "".join({"İ": "i̇"}.get(c, c.lower()) for c in text)
    kept = [t for t in re.split(P.TOKEN_BREAK, re.sub(P.PLACEHOLDER_TOKEN, " ", lowered, flags=re.ASCII)) if len(t) > 1 and t not in P.STOP_WORDS]
    return [re.sub("(ing|ed|es|s)$", "", t) for t in kept]


def test_tokens(spark, texts):
    assert got(spark, texts, X.search_tokens("t")) == [expected_tokens(t) for t in texts]
    assert got(spark, texts, X.lexemes("t")) == [None if t is None else [w for w in expected_tokens(t) if w] for t in texts]


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_token_batches(monkeypatch, size):
    """Slices of a batch, rows that are null or empty and an array that begins within its buffers."""
    monkeypatch.setattr(X, "_CUT_BYTES", size)
    rows = ["lost", None, "", "the fees, charges and 4% of", "x", "prepaying", "", None, "ing s"]
    found = X.cut_tokens(pa.array(rows).slice(1)).to_pylist()
    assert found == [expected_tokens(t) for t in rows[1:]]
    assert X.cut_tokens(pa.array([], pa.string())).to_pylist() == []


def test_tokens_are_not_looked_at_one_by_one(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(X.search_tokens("t"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan
