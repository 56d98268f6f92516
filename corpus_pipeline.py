"""A training corpus from ``documents``: five stages, each written and read again before the next.

Every stage takes any table with ``doc_id`` and ``text`` (the first one with ``lang`` too, which may be null). Other columns,
whatever their names, stay with their rows; the last stage's own columns replace those of the same names. Keys may be null or repeat,
texts null, empty or very long. A table without rows gives one without rows and with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.llm.decontamination import decontaminate
from clausemill.llm.language import UNDETERMINED, fit, identify
from clausemill.llm.line_dedup import dedup_lines
from clausemill.llm.near_dedup import near_dedup
from clausemill.llm.queries_tokens import vocabulary_path
from clausemill.llm.word_bpe import decode, encode
from clausemill.session import work_folder

#: A text goes if it has no language, or if the model gives its best language less than this probability.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a score of at least ``MIN_LANGUAGE_SCORE``.

    Null texts and those without letters have no language and go. Repeated rows are judged alike; of equally likely
    languages the first by name counts. Without a single label nothing is known and all go.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("body"))
    found = identify(packed, fit(docs), ["row"], "body")
    known = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return found.filter(known).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one line of each group of similar lines; those that lose all their words go.

    So do null and empty texts; one of white space alone stays as it is. A group's first line stays, by key (null last) and line number; where rows repeat, in
    all of them. ``n_chars``, where there is one, follows the text.
    """
    left = dedup_lines(docs).filter(F.col("text").isNotNull() & (F.col("text") != ""))
    size = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return left.withColumns(size) if size else left


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 80 %).

    The smallest key stays (null last), of its rows the one with the smallest hash of its text, of exact repeats one.
    Null texts and those without words are in no group and stay.
    """
    return near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``.

    Null and empty texts hold none and stay; repeated rows are judged alike. An empty benchmark removes nothing.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``docs`` but ``text`` and its ``n_chars``, then ``n_tokens``, the packed ``ids`` and what they decode to.

    A null text counts as empty and has no tokens. Every row is encoded by itself.
    """
    path = vocabulary_path("word_bpe_49k.json")
    kept = [c for c in docs.columns if c not in ("text", "n_chars", "n_tokens", "ids", "decoded")]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), "text")
    encoded = encode(keyed, path, key="doc").select(F.struct("doc", "ids").alias("both"), "ids")
    own = [F.col("both.doc").getField(c).alias(c) for c in kept]
    return decode(encoded, path, key="both").select(
        *own, (F.octet_length("both.ids") / 4).cast("long").alias("n_tokens"), "both.ids", F.col("text").alias("decoded")
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: Trained models and components over several hops are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = work_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
