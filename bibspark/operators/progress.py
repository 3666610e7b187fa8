"""Progress figures of a running query, the stand-in for per-file callbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str, **figures) -> tuple[DataFrame, Observation]:
    """``df`` with an observation of its rows (and of further aggregates) that fills as any action runs over it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in figures.items())), seen
