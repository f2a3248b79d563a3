"""Audit roll-ups over findings: filters, counts, top sources, risk, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from idveil.functions.columns import as_col
from idveil.functions.context import confidence_rank
from idveil.operators.detect import READ_ERROR

REPORT_COLUMNS = ("file", "sheet", "row", "column", "entity_type", "masked_value", "confidence")
SEVERE_ENTITIES = ("AADHAAR", "PAN", "BANK_ACCOUNT")


def at_least(findings: DataFrame, confidence: str = "LOW") -> DataFrame:
    """Findings of the given confidence or higher; an unknown confidence counts as LOW."""
    floor = ("LOW", "MEDIUM", "HIGH").index(confidence.upper())
    return findings.where(confidence_rank("confidence") >= floor)


def search(findings: DataFrame, text: str = "", entity: str = "ALL") -> DataFrame:
    """Case-insensitive substring over location, entity and masked value; one entity or ALL."""
    found = findings
    if text:
        parts = [
            F.coalesce(F.col(c).cast("string"), F.lit(""))
            for c in ("file", "sheet", "column", "entity_type", "masked_value")
        ]
        found = found.where(F.lower(F.concat_ws(" ", *parts)).contains(text.lower()))
    return found if entity == "ALL" else found.where(F.col("entity_type") == entity)


def by_entity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("entity_type").agg(F.count("*").alias("findings")).orderBy("entity_type")


def by_confidence(findings: DataFrame) -> DataFrame:
    return findings.groupBy("confidence").agg(F.count("*").alias("findings"))


def top_files(findings: DataFrame, n: int = 10) -> DataFrame:
    """The *n* sources with most findings; ties in source order. A top-k, not a full sort."""
    counts = findings.groupBy("file").agg(F.count("*").alias("findings"))
    return counts.orderBy(F.desc("findings"), F.asc("file")).limit(n)


def totals(findings: DataFrame) -> DataFrame:
    """One row: all findings and the sources they are in.

    Sources are counted after one aggregation per source, so the distinct count
    handles one line per source and task instead of one per finding.
    """
    per_file = findings.groupBy("file").agg(F.count("*").alias("n"))
    return per_file.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_findings"),
        F.count("file").alias("sources_affected"),
    )


def risk_of(high: Column, medium: Column, total: Column, policy: str = "cli") -> Column:
    """Risk wording from counts. Policies: cli, report, summary, desktop, web."""
    if policy == "cli":
        return (
            F.when(high > 0, F.lit("CRITICAL RISK (Verified PII Exposure Detected)"))
            .when(medium > 0, F.lit("WARNING (Unverified/Pattern PII Candidates Detected)"))
            .otherwise(F.lit("LOW RISK"))
        )
    if policy == "report":
        return (
            F.when(high > 0, F.lit("CRITICAL RISK — ACTION REQUIRED"))
            .when(medium > 0, F.lit("WARNING — REVIEW REQUIRED"))
            .otherwise(F.lit("PASS — LOW RISK"))
        )
    if policy in ("summary", "desktop"):
        calm = "LOW RISK" if policy == "summary" else "PASS — LOW RISK"
        return (
            F.when(high > 0, F.lit("CRITICAL RISK"))
            .when(total > 0, F.lit("WARNING"))
            .otherwise(F.lit(calm))
        )
    if policy == "web":
        return F.when(total > 0, F.lit("CRITICAL EXPOSURE")).otherwise(
            F.lit("COMPLIANT (ZERO PII)")
        )
    raise ValueError(f"unknown risk policy {policy!r}")


def risk_level(findings: DataFrame, policy: str = "cli") -> DataFrame:
    """One row: counts by tier and the risk level they give."""
    counts = findings.agg(
        F.count_if(F.col("confidence") == "HIGH").alias("high"),
        F.count_if(F.col("confidence") == "MEDIUM").alias("medium"),
        F.count("*").alias("total_findings"),
    )
    level = risk_of(F.col("high"), F.col("medium"), F.col("total_findings"), policy)
    return counts.select("*", level.alias("risk_level"))


def severity_table(findings: DataFrame) -> DataFrame:
    severity = F.when(F.col("entity_type").isin(*SEVERE_ENTITIES), F.lit("HIGH")).otherwise(
        F.lit("MEDIUM")
    )
    return by_entity(findings).select("*", severity.alias("severity"))


def share_of_max(findings: DataFrame) -> DataFrame:
    """Count per entity and its percentage of the largest count.

    The window has no partition key, but it sees one row per entity type.
    """
    largest = F.max("findings").over(W.partitionBy())
    share = F.round(F.col("findings") / largest * 100, 1)
    return by_entity(findings).select("*", share.alias("share_pct"))


def summary(
    findings: DataFrame, target: str = "", duration_seconds: float = 0.0, policy: str = "cli"
) -> DataFrame:
    """One row for an audit file: target, totals, risk, maps by entity and confidence.

    One pass: findings are counted map-side by (file, entity, confidence), and grouping
    sets turn those counts into counts per file, per entity and per confidence. Only the
    latter two, a handful of rows, are collected into maps.
    """
    keys = ("file", "entity_type", "confidence")
    counted = findings.groupBy(*keys).agg(F.count("*").alias("n"))
    sets = counted.groupingSets([["file"], ["entity_type"], ["confidence"]], *keys)
    lines = sets.agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    file_line, entity_line, tier_line = (F.col("g") == g for g in (0b011, 0b101, 0b110))

    def counts(line: Column, key: str) -> Column:
        pairs = F.collect_list(F.when(line, F.struct(F.col(key), F.col("n"))))
        return F.map_from_entries(F.array_sort(pairs))

    row = lines.agg(
        F.coalesce(F.sum(F.when(tier_line, F.col("n"))), F.lit(0)).alias("total_findings"),
        F.count_if(file_line).alias("sources_affected"),
        counts(entity_line, "entity_type").alias("entity_breakdown"),
        counts(tier_line, "confidence").alias("confidence_breakdown"),
    )

    def tier(name: str) -> Column:
        return F.coalesce(F.try_element_at("confidence_breakdown", F.lit(name)), F.lit(0))

    return row.select(
        F.lit(target).alias("target_source"),
        F.round(F.lit(float(duration_seconds)), 3).alias("duration_seconds"),
        "sources_affected",
        "total_findings",
        risk_of(tier("HIGH"), tier("MEDIUM"), F.col("total_findings"), policy).alias("risk_level"),
        "entity_breakdown",
        "confidence_breakdown",
    )


def agent_ids(findings: DataFrame) -> DataFrame:
    """Findings with the name of the recognizer that reported them."""
    entity = F.col("entity_type")
    agent = (
        F.when(entity == READ_ERROR, F.lit("agent-ingestion-error"))
        .when(entity.endswith("_MASKED"), F.lit("agent-masked"))
        .otherwise(F.concat(F.lit("agent-"), F.lower(entity)))
    )
    return findings.withColumn("agent_id", agent)


def location_text(sheet: Column | str = "sheet") -> Column:
    """``file!sheet:colrow`` for sheets, ``file:row=r,col=c`` otherwise."""
    sheet = as_col(sheet)
    return F.when(
        F.coalesce(sheet, F.lit("")) != "",
        F.concat(F.col("file"), F.lit("!"), sheet, F.lit(":"), F.col("column"), F.col("row")),
    ).otherwise(
        F.concat(F.col("file"), F.lit(":row="), F.col("row"), F.lit(",col="), F.col("column"))
    )


def position_text() -> Column:
    """``Row r Col c (sheet)`` as reports show it."""
    column = F.when(F.col("column") != "", F.concat(F.lit("Col "), F.col("column")))
    sheet = F.coalesce(F.col("sheet"), F.lit(""))
    shown = F.concat(
        F.lit("Row "),
        F.col("row").cast("string"),
        F.lit(" "),
        F.coalesce(column, F.lit("")),
        F.when(sheet != "", F.concat(F.lit(" ("), sheet, F.lit(")"))).otherwise(F.lit("")),
    )
    return F.trim(shown)


def report(findings: DataFrame) -> DataFrame:
    """The seven report columns, all text, a missing sheet as empty text."""
    return findings.select(
        "file",
        F.coalesce(F.col("sheet"), F.lit("")).alias("sheet"),
        F.col("row").cast("string").alias("row"),
        *REPORT_COLUMNS[3:],
    )


def report_page(findings: DataFrame, n: int = 1000) -> DataFrame:
    """The first *n* findings in reading order, numbered from 1.

    The page is cut by a top-k first; only those rows are numbered in one partition.
    """
    order = ["file", "position"] if "position" in findings.columns else list(REPORT_COLUMNS)
    page = findings.orderBy(*order).limit(n)
    number = F.row_number().over(W.orderBy(*order)).alias("number")
    return page.select(
        number, "file", position_text().alias("location"), "entity_type", "masked_value", "confidence"
    ).orderBy("number")
