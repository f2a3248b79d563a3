"""Parquet trees whose files differ in schema, or cannot be read.

Files that agree are read as one, which is the common case and costs nothing more. Only if their schemas cannot be
merged, or a footer cannot be read, are the files told apart.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A Parquet file without rows is smaller than this; a larger one that yields none is broken.
EMPTY_FILE_BYTES = 1 << 20
_MAGIC = "PAR1"
_APART = ("CANNOT_MERGE_SCHEMAS", "CANNOT_MERGE_INCOMPATIBLE_DATA_TYPE", "CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE")


def _merged(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The files as one table, or None if their schemas or footers forbid it."""
    try:
        return spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).option(
            "pathGlobFilter", "*.[pP][aA][rR][qQ][uU][eE][tT]"
        ).parquet(*paths)
    except (PySparkException, Py4JJavaError) as error:
        if any(name in str(error) for name in _APART):
            return None
        raise


def _escaped(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """path, address (as files name themselves in their rows) and length of every Parquet file; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = files.option("pathGlobFilter", "*.[pP][aA][rR][qQ][uU][eE][tT]").load(path)
    return files.select("path", F.col("_metadata.file_path").alias("address"), "length")


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """path, address of the Parquet files whose footer cannot be read.

    The others are those that yield rows when no column is asked for, which reads footers only, and those without rows:
    small files that begin and end as Parquet does.
    """
    listed = _listing(spark, path)
    # Any schema will do: no column of it is read.
    rows = spark.read.schema("none string").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    rows = rows.option("pathGlobFilter", "*.[pP][aA][rR][qQ][uU][eE][tT]").parquet(path)
    seen = rows.select(F.col("_metadata.file_path").alias("address")).groupBy("address").agg(F.count(F.lit(1)).alias("n"))
    missing = listed.join(seen, "address", "left_anti")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    content = content.option("pathGlobFilter", "*.[pP][aA][rR][qQ][uU][eE][tT]").load(path)
    magic = F.lit(_MAGIC).cast("binary")
    whole = (F.col("length") > 12) & F.startswith("content", magic) & F.endswith("content", magic)
    empty = content.where(F.col("length") < EMPTY_FILE_BYTES).where(whole).select(F.col("_metadata.file_path").alias("address"))
    return missing.join(empty, "address", "left_anti").select("path", "address")


def parquet_frames(spark: SparkSession, path: str) -> tuple[list[DataFrame], DataFrame | None]:
    """One table per schema of the files under *path*, and the files that cannot be read (None: all can).

    Files with schemas that can be merged are one table. Where they cannot, the sorted list of files is halved until each
    part can, so that files of a directory, which mostly agree, stay together; parts of equal schema become one table.
    The driver holds the list of files, as it does for any read.
    """
    together = _merged(spark, [path])
    if together is not None:
        return [together], None
    broken = unreadable_files(spark, path)
    bad = {r["path"] for r in broken.collect()}
    good = sorted(r["path"] for r in _listing(spark, path).select("path").collect() if r["path"] not in bad)

    by_schema: dict[str, list[str]] = {}
    todo = [good] if good else []
    while todo:
        part = todo.pop()
        df = _merged(spark, [_escaped(p) for p in part])
        if df is not None:
            by_schema.setdefault(df.schema.json(), []).extend(part)
        elif len(part) == 1:
            bad.add(part[0])  # its schema is not one that Spark reads
        else:
            todo += [part[len(part) // 2 :], part[: len(part) // 2]]
    frames = [df for paths in by_schema.values() if (df := _merged(spark, [_escaped(p) for p in sorted(paths)])) is not None]
    failed = _listing(spark, path).where(F.col("path").isin(*bad)).select("path", "address") if bad else None
    return frames, failed
