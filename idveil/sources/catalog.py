"""Databases: every table of a catalog schema, or of a JDBC source, read-only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from idveil.sources.numbering import table_positions
from idveil.sources.tables import table_rows

FETCH_SIZE = 500
PLACE = "_table_row"


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def database_rows(
    tables: dict[str, DataFrame], source: str, keys: dict[str, str] | None = None,
    only_candidates: bool = False, positions: bool = False,
) -> DataFrame:
    """Rows of several tables as one source: ``sheet`` is the table name.

    ``keys`` names the numbering column of a table. Of the others, those kept in Parquet files are numbered from 1 by
    position if ``positions`` is set, which asks for whole tables (``table_positions``); the rest get increasing numbers.
    """
    if not tables:
        raise ValueError(f"no tables found in {source}")
    keys = keys or {}

    def rows(ordinal: int, name: str, df: DataFrame) -> DataFrame:
        number, placed = keys.get(name), None
        if number is None and positions:
            placed = table_positions(df, PLACE)
        if placed is not None:
            number = PLACE
        return table_rows(
            df if placed is None else placed, source, name, number, columns=df.columns, sheet_ord=ordinal,
            only_candidates=only_candidates,
        )

    return _union([rows(i, name, df) for i, (name, df) in enumerate(tables.items())])


def catalog_tables(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """Tables of a catalog schema by name; views hold no data of their own and are left out. A schema that does not exist is an error."""
    if not spark.catalog.databaseExists(database):
        raise ValueError(f"database not found: {database}")
    found = spark.catalog.listTables(database)
    return {
        t.name: spark.table(f"`{database}`.`{t.name}`")
        for t in sorted(found, key=lambda t: t.name)
        if not t.isTemporary and t.tableType != "VIEW"
    }


def jdbc_tables(
    spark: SparkSession,
    url: str,
    tables: list[str],
    properties: dict[str, str] | None = None,
    partitioning: dict[str, dict[str, object]] | None = None,
) -> dict[str, DataFrame]:
    """Tables of a JDBC source, fetched in batches of 500.

    ``partitioning`` gives per table ``partitionColumn``, ``lowerBound``, ``upperBound``
    and ``numPartitions``; without it a table is read over one connection.
    """
    frames = {}
    for name in tables:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
        reader = reader.option("fetchsize", FETCH_SIZE).options(**(properties or {}))
        for key, value in (partitioning or {}).get(name, {}).items():
            reader = reader.option(key, value)
        frames[name] = reader.load()
    return frames


__all__ = ["FETCH_SIZE", "catalog_tables", "database_rows", "jdbc_tables"]
