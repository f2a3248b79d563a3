"""Scan plans: what users call to find identifiers."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from idveil.functions.registry import RECOGNIZERS, Registry
from idveil.operators.dedup import first_occurrences
from idveil.operators.detect import Settings, detect
from idveil.sources.tables import cell_rows, table_rows

CELL_MODE_ENTITIES = ("AADHAAR", "PAN", "GSTIN", "IN_MOBILE", "VOTER_ID", "PASSPORT")


@dataclass(frozen=True)
class ScanOptions:
    """How to scan.

    entities / disable        narrow the recognizers for this call
    dedup                     "source": once per file or database; "cell": once per cell
    row_context / penalty     neighbour boost and header penalty
    masked                    also report values that are masked already
    keep_clear_pans_as_masked report a clear PAN holding an X as PAN_MASKED too
    """

    entities: Iterable[str] | None = None
    disable: Iterable[str] = ()
    dedup: str = "source"
    row_context: bool = True
    penalty: bool = True
    masked: bool = True
    keep_clear_pans_as_masked: bool = False
    registry: Registry = RECOGNIZERS

    def settings(self, keep: tuple[str, ...] = ()) -> Settings:
        return Settings(
            tuple(self.registry.active(self.entities, self.disable)),
            self.row_context,
            self.penalty,
            self.masked,
            self.keep_clear_pans_as_masked,
            keep,
        )


def cell_mode(**changes) -> ScanOptions:
    """Options of the per-cell mode: six entities, no neighbours, no penalty."""
    base = {"entities": CELL_MODE_ENTITIES, "dedup": "cell", "row_context": False, "penalty": False}
    return ScanOptions(**{**base, **changes})


def scan_rows(rows: DataFrame, options: ScanOptions | None = None, **changes) -> DataFrame:
    """Findings in rows of cells (see ``idveil.sources``)."""
    o = options or ScanOptions(**changes)
    return first_occurrences(detect(rows, o.settings()), o.dedup)


def scan(
    df: DataFrame,
    file: Column | str = "table",
    sheet: Column | str | None = None,
    row: Column | str | None = None,
    columns: list[str] | None = None,
    options: ScanOptions | None = None,
    **changes,
) -> DataFrame:
    """Findings in the columns of any DataFrame.

    ``file`` names the source that values are de-duplicated in, ``row`` the column
    that numbers the rows. Findings have the columns file, sheet, row, column,
    entity_type, masked_value, confidence and position (the reading order).
    """
    o = options or ScanOptions(**changes)
    rows = table_rows(df, file, sheet, row, columns, only_candidates=o.settings().gated)
    return scan_rows(rows, o)


def scan_cells(cells: DataFrame, options: ScanOptions | None = None, **changes) -> DataFrame:
    """Findings in a tidy table of cells (text, and any of file, sheet, row, column, row_context)."""
    return scan_rows(cell_rows(cells), options, **changes)
