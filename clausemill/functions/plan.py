"""Small helpers that shape the plan, not the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, names: list[str]) -> DataFrame:
    """Compute ``names`` once. A filter on one of them would otherwise be merged into the projection below
    and repeat its whole expression; it does not pass a generator."""
    keep = [c for c in df.columns if c not in names]
    return df.select(*keep, F.inline(F.array(F.struct(*names))))
