"""Near-duplicates among ``documents``."""

from __future__ import annotations

from .near_dedup import near_groups
from .registry import query, table


@query("op6_minhash_near_dedup")
def minhash_near_dedup(spark, folder):
    return near_groups(table(spark, folder, "documents"), width=2)
