"""Benchmark passages in ``documents``."""

from __future__ import annotations

from .decontamination import contaminated
from .registry import query, table


@query("op9_decontamination")
def decontamination(spark, folder):
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
