"""Exact row numbers for records read from splittable files.

A split file has no global line count. Each split is read by one task in order, so a
record's place in its split is the distance of its increasing id from the first one
there. One small line per split (count of records, first id) and a running sum over the
splits of a file give the rest. No file is read by a single task and no record is moved.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_BROADCAST_SPLITS = 200_000  # lines of a few hundred bytes: tens of megabytes

def tagged(df: DataFrame) -> DataFrame:
    """Records of a file source with their file, split and increasing id."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )


def split_offsets(records: DataFrame, head: Column | None = None) -> DataFrame:
    """Per split: its first id, the number of its records and of those before it in the file.

    With *head*, also the first non-null value of it in the file and the row it is on
    (the header record).
    """
    chosen = F.lit(None).cast("string") if head is None else head
    per_split = records.groupBy("_file", "_block").agg(
        F.min("_id").alias("_first_id"),
        F.count("*").alias("_n"),
        F.min(F.when(chosen.isNotNull(), F.struct(F.col("_id").alias("id"), chosen.alias("value"))))
        .alias("_h"),
    )
    splits = W.partitionBy("_file").orderBy("_block")
    before = F.coalesce(
        F.sum("_n").over(splits.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    placed = per_split.select("*", before.alias("_before"))
    whole = splits.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    head_row = F.col("_before") + F.col("_h.id") - F.col("_first_id") + 1
    return placed.select(
        "_file",
        "_block",
        "_first_id",
        "_n",
        "_before",
        F.first("_h.value", ignorenulls=True).over(whole).alias("_head"),
        F.first(head_row, ignorenulls=True).over(whole).alias("_head_row"),
    )


def numbered(records: DataFrame, offsets: DataFrame, splits: int | None = None) -> DataFrame:
    """Records with ``_row``, counted from 1 per file.

    The offsets hold one line per split (128 MB of input by default). *splits* is an
    upper bound of their number, known from the file listing. Up to ``MAX_BROADCAST_SPLITS``
    they are broadcast, so that no record is shuffled; beyond it, or without a bound,
    Spark chooses the join.
    """
    if splits is not None and splits <= MAX_BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    joined = records.join(offsets, ["_file", "_block"])
    row = F.col("_before") + F.col("_id") - F.col("_first_id") + 1
    return joined.select("*", row.alias("_row"))


def table_positions(df: DataFrame, name: str) -> DataFrame | None:
    """Rows of a Parquet table with their position *name*: from 1, file after file in the order of their paths, whatever
    the splits and partitions. None if *df* is not read from Parquet files.

    For a table, or some of its columns; not for rows that were filtered, joined or exploded before. A count per
    file, which Spark takes from the footers, is all that is gathered; no row is moved for it.
    """
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    except AnalysisException:
        return None
    files = len(df.inputFiles())
    counts = df.select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)  # one line per file
    before = counts.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = placed.join(F.broadcast(before) if files <= MAX_BROADCAST_SPLITS else before, "_file")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_index") + 1).alias(name))
