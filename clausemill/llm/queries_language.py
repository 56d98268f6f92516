"""Language of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .language import fit, held_out, identify
from .registry import query, table


@query("op5_language_id")
def language_id(spark, folder):
    docs = table(spark, folder, "documents").withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    model = fit(docs.filter(~F.col("held_out")))
    return identify(docs, model, ["doc_id", "held_out"])
