"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("idveil-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        # Regex work is bound by the processor: small splits keep all cores busy.
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "1m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scan_lineitem(spark, sf_dir):
    """Every cell of the line items: nearly all fall to the typed candidate filter."""
    from pyspark.sql import functions as F

    import idveil as iv

    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return iv.scan(line, file="lineitem", row=F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def main() -> None:
    from querybook.book import BOOK

    spark = session()
    names = {
        "scan_documents": BOOK["scan_documents"][0],
        "scan_people": BOOK["scan_people"][0],
        "scan_people_per_cell": BOOK["dedup_cell"][0],
        "scan_lineitem": scan_lineitem,
        "summary": BOOK["summary"][0],
        "remediate_documents": BOOK["remediate_documents"][0],
        "remediate_mask": BOOK["sanitize_mask"][0],
        "remediate_tokenize": BOOK["sanitize_tokenize"][0],
        "token_join": BOOK["token_join"][0],
        "split_cells": BOOK["split_cells"][0],
        "flatten_json": BOOK["flatten_json"][0],
        "row_density": BOOK["row_density"][0],
    }
    # Start the JVM, the code generator and the Python workers before the clock runs.
    BOOK["scan_people"][0](spark, SF_DIR).limit(1).collect()

    seconds = {}
    for name, query in names.items():
        start = time.perf_counter()
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)

    rows = {
        "scan_documents": spark.read.parquet(f"{SF_DIR}/documents.parquet").count(),
        "scan_lineitem": spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count(),
        "remediate_documents": spark.read.parquet(f"{SF_DIR}/documents.parquet").count(),
    }
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_second": {n: round(c / seconds[n]) for n, c in rows.items()},
                "sf": os.path.basename(SF_DIR).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
