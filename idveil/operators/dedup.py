"""Keep the first occurrence of a value per source, or per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ORDER = ("sheet_ord", "row", "ord", "chunk_no", "match_no")
FINDING = ("file", "sheet", "row", "column", "entity_type", "masked_value", "confidence")


def first_occurrences(matches: DataFrame, scope: str = "source") -> DataFrame:
    """Findings: the earliest match of each (scope, entity, value), with its confidence.

    ``min`` over a struct that starts with the reading order is a partial aggregate:
    each task sends at most one line per value, however often a value or source
    repeats, so a hot value does not make a hot partition. The key holds a hash of
    the value, which spreads even one dominant source over all partitions.
    """
    keys = {
        "source": ("file", "entity_type", "value_key"),
        "cell": ("file", "entity_type", "value_key", "sheet_ord", "sheet", "row", "ord"),
    }[scope]
    payload = [c for c in ("sheet", "column", "masked_value", "confidence") if c not in keys]
    first = F.min(F.struct(*_ORDER, *payload)).alias("first")
    kept = matches.groupBy(*keys).agg(first)
    return kept.select(
        "file",
        (F.col("sheet") if "sheet" in keys else F.col("first.sheet")).alias("sheet"),
        F.col("first.row").alias("row"),
        F.col("first.column").alias("column"),
        "entity_type",
        F.col("first.masked_value").alias("masked_value"),
        F.col("first.confidence").alias("confidence"),
        F.struct(*[F.col(f"first.{c}").alias(c) for c in _ORDER]).alias("position"),
    )
