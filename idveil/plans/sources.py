"""Scans of paths and databases: pick the sources, then run the one scan plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from idveil.constants import TEXT_SUFFIXES
from idveil.plans.scan import ScanOptions, scan_rows
from idveil.sources import files as f
from idveil.sources.catalog import catalog_tables, database_rows
from idveil.sources.tables import cell_rows

_COLUMNS = ("file", "sheet", "sheet_ord", "row", "cells", "row_context")


def path_rows(
    spark: SparkSession,
    path: str,
    only: tuple[str, ...] | None = None,
    only_candidates: bool = False,
) -> DataFrame | None:
    """Rows of every supported file under *path* (recursive), or None if there is none.

    Suffixes count whatever their case; files with other suffixes are passed over. A
    path that does not exist is an error. ``only_candidates`` leaves out Parquet rows
    and JSON records that cannot yield a finding before anything is built for them.
    """
    found = f.list_path(spark, path)
    sources = {
        "csv": lambda: f.csv_rows(spark, path, splits=found.bound("csv")),
        "tsv": lambda: f.tsv_rows(spark, path, splits=found.bound("tsv")),
        "text": lambda: f.text_rows(spark, path, splits=found.bound(*TEXT_SUFFIXES)),
        "json": lambda: f.json_rows(spark, path, only_candidates),
        "jsonl": lambda: f.jsonl_rows(spark, path, found.bound("jsonl"), only_candidates),
        "parquet": lambda: f.parquet_rows(spark, path, only_candidates),
    }
    suffixes = {name: (TEXT_SUFFIXES if name == "text" else (name,)) for name in sources}
    chosen = [
        make()
        for name, make in sources.items()
        if found.has(*suffixes[name]) and (only is None or name in only)
    ]
    if not chosen:
        return None
    return reduce(lambda a, b: a.unionByName(b), [c.select(*_COLUMNS) for c in chosen])


def scan_path(
    spark: SparkSession,
    path: str,
    options: ScanOptions | None = None,
    **changes,
) -> DataFrame:
    """Findings in a file or directory tree; read errors are findings too.

    Spark's partitions are the parallelism, whatever the number of files.
    """
    o = options or ScanOptions(**changes)
    rows = path_rows(spark, path, only_candidates=o.settings().gated)
    if rows is None:
        rows = cell_rows(spark.createDataFrame([], "text string"))
    return scan_rows(rows, o)


def scan_tables(
    spark: SparkSession,
    database: str | None = None,
    tables: dict[str, DataFrame] | None = None,
    source: str | None = None,
    keys: dict[str, str] | None = None,
    options: ScanOptions | None = None,
    positions: bool | None = None,
    **changes,
) -> DataFrame:
    """Findings in all tables of a catalog schema, or in the given ones, as one source.

    A value counts once for the whole database. ``tables`` may come from ``jdbc_tables``. Rows of Parquet tables without
    a key are numbered from 1 by their position; of given tables only with ``positions=True``, as these must be whole.
    """
    o = options or ScanOptions(**changes)
    if positions is None:
        positions = tables is None
    if tables is None:
        if database is None:
            raise ValueError("give a database or tables")
        tables = catalog_tables(spark, database)
    name = source or database or "database"
    rows = database_rows(tables, name, keys, only_candidates=o.settings().gated, positions=positions)
    return scan_rows(rows, o)
