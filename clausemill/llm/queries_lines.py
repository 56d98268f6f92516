"""Fuzzy duplicate lines of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .line_dedup import line_groups
from .registry import query, table


@query("op2_line_dedup")
def line_dedup(spark, folder):
    found = line_groups(table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.col("n").alias("line_no"), F.col("first_key").alias("first_doc_id"), F.col("first_n").alias("first_line_no"), "kept"
    )
