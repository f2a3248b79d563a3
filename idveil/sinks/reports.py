"""Findings as CSV and JSON datasets with their roll-ups beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idveil.operators.rollups import by_entity, report, summary, top_files


def csv_summary(findings: DataFrame) -> DataFrame:
    """The summary block of a CSV report as rows ``kind, name, findings``."""
    entities = by_entity(findings).select(
        F.lit("entity").alias("kind"), F.col("entity_type").alias("name"), "findings"
    )
    files = top_files(findings).select(
        F.lit("top_file").alias("kind"), F.col("file").alias("name"), "findings"
    )
    total = findings.agg(F.count("*").alias("findings")).select(
        F.lit("total").alias("kind"), F.lit("").alias("name"), "findings"
    )
    return total.unionByName(entities).unionByName(files)


def json_summary(findings: DataFrame) -> DataFrame:
    """One row: ``total_findings``, ``by_entity_type``, ``top_files``."""
    top = top_files(findings).agg(
        F.array_sort(
            F.collect_list(
                F.struct((-F.col("findings")).alias("order"), "file", F.col("findings").alias("count"))
            )
        ).alias("top")
    )
    kinds = summary(findings).select("total_findings", F.col("entity_breakdown").alias("by_entity_type"))
    one = F.lit(1).alias("_one")
    both = kinds.select("*", one).join(top.select("*", one), "_one")
    files = F.transform("top", lambda x: F.struct(x["file"].alias("file"), x["count"].alias("count")))
    return both.select("total_findings", "by_entity_type", files.alias("top_files"))


def write_csv(findings: DataFrame, path: str, mode: str = "error") -> None:
    """``path/findings`` with a header, ``path/summary`` beside it.

    Findings are written once, in parallel; the summary is taken from what was written,
    so the scan behind them runs a single time.
    """
    rows = report(findings)
    rows.write.mode(mode).option("header", True).csv(f"{path}/findings")
    spark = findings.sparkSession
    written = spark.read.schema(rows.schema).option("header", True).csv(f"{path}/findings")
    csv_summary(written).coalesce(1).write.mode(mode).option("header", True).csv(f"{path}/summary")


def write_json(findings: DataFrame, path: str, mode: str = "error") -> None:
    """``path/findings`` as JSON lines, ``path/summary`` as one JSON object."""
    rows = report(findings)
    rows.write.mode(mode).json(f"{path}/findings")
    spark = findings.sparkSession
    written = spark.read.schema(rows.schema).json(f"{path}/findings")
    json_summary(written).coalesce(1).write.mode(mode).json(f"{path}/summary")


def write_summary(
    findings: DataFrame, path: str, target: str, duration_seconds: float, mode: str = "error"
) -> None:
    """The audit summary as one JSON object."""
    summary(findings, target, duration_seconds).coalesce(1).write.mode(mode).json(path)


def write_remediated(df: DataFrame, path: str, format: str = "csv", mode: str = "error") -> None:
    """A remediated table as CSV (with header), text or Parquet."""
    writer = df.write.mode(mode).format(format)
    (writer.option("header", True) if format == "csv" else writer).save(path)
