"""Toxicity of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .language import held_out
from .registry import query, table
from .toxicity import fit, score


@query("op7_toxicity")
def toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").filter(~held_out(F.col("doc_id"), 5, 0))
    model = fit(docs, labels)
    marked = docs.withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    found = score(marked, model, ["doc_id", "held_out"])
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
