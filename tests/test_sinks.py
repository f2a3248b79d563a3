import json
import os

import pytest
from pyspark.sql import functions as F

import idveil as iv
from idveil.operators import rollups as ru
from idveil.operators.evaluate import check_feedback
from idveil.sinks.reports import csv_summary, json_summary, write_remediated
from idveil.streaming.scan_stream import scan_stream


@pytest.fixture(scope="module")
def findings(spark):
    df = spark.createDataFrame([("a", 1, "ABCPD1234E"), ("a", 2, "9876543210"), ("b", 1, "ABCPD1234E")],
                               "f string, r int, v string")
    return iv.scan(df, file=df["f"], row="r", columns=["v"]).cache()


def test_csv_and_json(spark, findings, tmp_path):
    iv.write_csv(findings, str(tmp_path / "c"))
    back = spark.read.option("header", True).csv(str(tmp_path / "c/findings"))
    assert back.columns == ["file", "sheet", "row", "column", "entity_type", "masked_value", "confidence"]
    assert back.count() == 3
    lines = [tuple(r) for r in csv_summary(findings).collect()]
    assert lines == [("total", "", 3), ("entity", "IN_MOBILE", 1), ("entity", "PAN", 2),
                     ("top_file", "a", 2), ("top_file", "b", 1)]
    iv.write_json(findings, str(tmp_path / "j"))
    part = next(p for p in os.listdir(tmp_path / "j/summary") if p.startswith("part"))
    with open(tmp_path / "j/summary" / part, encoding="utf-8") as lines:
        assert json.loads(lines.read()) == {
            "total_findings": 3, "by_entity_type": {"IN_MOBILE": 1, "PAN": 2},
            "top_files": [{"file": "a", "count": 2}, {"file": "b", "count": 1}]}
    assert json_summary(findings).count() == 1
    iv.write_summary(findings, str(tmp_path / "s"), "x", 1.0)
    assert spark.read.json(str(tmp_path / "s")).first()["sources_affected"] == 2


def test_remediated_output(spark, tmp_path):
    df = spark.createDataFrame([("ABCPD1234E",)], "v string")
    for kind in ("csv", "text", "parquet"):
        write_remediated(iv.remediate(df), str(tmp_path / kind), kind)
        back = spark.read.format(kind).option("header", True).load(str(tmp_path / kind))
        assert back.first()[0] == "XXXXX1234X"


def test_sealed_findings(spark, findings, tmp_path):
    iv.encrypt_findings(findings, "open sesame").write.parquet(str(tmp_path / "x"))
    sealed = spark.read.parquet(str(tmp_path / "x"))
    assert "PAN" not in str(sealed.collect())
    opened = iv.decrypt_findings(sealed, "open sesame")
    assert sorted(map(tuple, opened.collect())) == sorted(map(tuple, ru.report(findings).collect()))
    with pytest.raises(Exception):  # noqa: B017 - the engine's own error for a wrong key
        iv.decrypt_findings(sealed, "wrong").collect()
    with pytest.raises(ValueError):
        iv.encrypt_findings(findings, "")
    assert iv.decrypt_findings(sealed.where("false"), "x").count() == 0


def test_datasets_sealed_under_two_salts_open_together(spark, findings):
    once, twice = (iv.encrypt_findings(findings, "open sesame", bytes([i]) * 16) for i in (1, 2))
    opened = iv.decrypt_findings(once.unionByName(twice), "open sesame")
    assert sorted(map(tuple, opened.collect())) == sorted(2 * list(map(tuple, ru.report(findings).collect())))
    foreign = twice.withColumn("format", F.lit("other"))
    with pytest.raises(ValueError):
        iv.decrypt_findings(once.unionByName(foreign), "open sesame")


def test_feedback(spark):
    rows = [("FP", "IN_MOBILE", "Rs. 5000000000"), ("FN", "PAN", "ABC PD 5678 K"), ("fp", "aadhaar", "123456789012"),
            ("FN", "PAN", "nothing"), ("FP", "GSTIN", "27AAPFU0939F1ZV"), ("FP", "IFSC", "HDFC0001234"),
            ("FN", "IFSC", "HDFC0001234"), ("FN", "PAN", "  ")]
    df = spark.createDataFrame(rows, "feedback_type string, entity_type string, raw_sample_value string")
    got = [(r["feedback_type"], r["entity_type"], r["passed"]) for r in check_feedback(df).collect()]
    assert got == [("FP", "IN_MOBILE", True), ("FN", "PAN", True), ("FP", "AADHAAR", True), ("FN", "PAN", False),
                   ("FP", "GSTIN", False), ("FP", "IFSC", True), ("FN", "IFSC", False)]


def test_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i}:00", "src", i, v) for i, v in enumerate(
        ["ABCPD1234E", "nothing", "ABCPD1234E", "9876543210"])]
    df = spark.createDataFrame(rows, "t string, f string, n long, v string").selectExpr("timestamp(t) as t", "f", "n", "v")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = scan_stream(stream, "t", "f", "n")
    query = (out.writeStream.format("memory").queryName("stream_findings").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    got = spark.table("stream_findings").select("entity_type", "masked_value").collect()
    assert sorted(map(tuple, got)) == [("IN_MOBILE", "XXXXXX3210"), ("PAN", "XXXXX1234X")]
