"""The same detection over a stream of rows, record by record.

Detection is stateless, so it runs on a streaming DataFrame unchanged. "First
occurrence" needs an end of input; a stream keeps instead one match per value and
source within a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idveil.operators.detect import detect
from idveil.plans.scan import ScanOptions
from idveil.sources.tables import table_rows


def scan_stream(
    stream: DataFrame,
    event_time: str,
    file: str,
    row: str,
    columns: list[str] | None = None,
    lateness: str = "10 minutes",
    options: ScanOptions | None = None,
) -> DataFrame:
    """Findings of a streaming table, each value once per source within the watermark."""
    o = options or ScanOptions()
    names = columns or [c for c in stream.columns if c not in (event_time, file, row)]
    rows = table_rows(
        stream, F.col(file), None, F.col(row), names, keep=(event_time,)
    )
    matches = detect(rows, o.settings(keep=(event_time,)))
    kept = matches.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(
        ["file", "entity_type", "value_key"]
    )
    return kept.select(
        event_time, "file", "row", "column", "entity_type", "masked_value", "confidence"
    )
