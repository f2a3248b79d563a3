import pandas as pd
import pytest
from pyspark.sql import functions as F

import idveil as iv
from idveil.functions.recognizers import MATCH_TYPE
from idveil.functions.registry import Registry
from idveil.operators import rollups as ru

CONTACTS = [
    ("Priya Sharma", "9876543210", "234567890124", "ABCPD1234E"),
    ("Rajesh Kumar", "+91 8765432109", "345678901238", "XYZCA5678F"),
    ("Aisha Begum", "7654321098", "4567.8901.2341", "DEFHG2345K"),
    ("Suresh Pillai", "6543210987", None, "Mnofs6789L"),
    ("Kavita Nair", "9123456789", "567890123458", None),
    ("Multi-value cell", "9876543210, 8765432109", "UID: 234567890124", "PAN: ABCPD1234E"),
]


@pytest.fixture(scope="module")
def contacts(spark):
    rows = [(i, *c) for i, c in enumerate(CONTACTS, 2)]
    return spark.createDataFrame(rows, "r int, name string, mobile string, aadhaar_no string, pan_no string")


def plain(df):
    return sorted(
        (r["row"], r["column"], r["entity_type"], r["masked_value"], r["confidence"]) for r in df.collect()
    )


def cells(spark, *rows):
    return spark.createDataFrame(
        [(i, c, t, x) for i, (c, t, x) in enumerate(rows, 1)],
        "row int, column string, text string, row_context string",
    )


def test_contacts(contacts):
    found = plain(iv.scan(contacts, row="r"))
    assert len(found) == 17
    assert (2, "aadhaar_no", "AADHAAR", "XXXX XXXX 0124", "HIGH") in found
    assert (2, "aadhaar_no", "BANK_ACCOUNT", "XXXXXXXX0124", "MEDIUM") in found
    # The bare form of a number already seen with its country code is another raw value.
    assert (7, "mobile", "IN_MOBILE", "XXXXXX2109", "HIGH") in found
    assert not any(f[0] == 7 and f[2] == "PAN" for f in found)


def test_order_and_partitioning_do_not_matter(contacts):
    base = plain(iv.scan(contacts, row="r"))
    shuffled = contacts.orderBy(F.desc("mobile")).repartition(7)
    assert plain(iv.scan(shuffled, row="r")) == base


def test_hot_value_and_hot_source_keep_the_first(spark):
    rows = spark.range(3000).select(
        F.lit("one").alias("src"), (F.col("id") + 1).alias("n"),
        F.when(F.col("id") % 3 == 0, "ABCPD1234E").otherwise(
            F.concat(F.lit("ABCPD"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit("E"))).alias("v"),
    )
    found = iv.scan(rows, file=F.col("src"), row="n", columns=["v"], entities=["PAN"])
    expected = {"ABCPD1234E"} | {f"ABCPD{i:04d}E" for i in range(3000) if i % 3}
    assert found.count() == len(expected)
    assert found.where("masked_value = 'XXXXX1234X'").first()["row"] == 1


def test_same_value_once_per_source(spark):
    df = spark.createDataFrame([("a", 1, "ABCPD1234E"), ("a", 2, "ABCPD1234E"), ("b", 1, "ABCPD1234E")],
                               "f string, r int, v string")
    found = iv.scan(df, file=F.col("f"), row="r", columns=["v"])
    assert sorted((x["file"], x["row"]) for x in found.collect()) == [("a", 1), ("b", 1)]


def test_penalty_and_boost(spark):
    found = iv.scan_cells(cells(
        spark,
        ("invoice_number", "234567890124", ""),
        ("aadhaar_no", "234567890125", ""),
        ("data", "345678901239", "Mumbai 400001"),
        ("data", "456789012341", ""),
    ), entities=["AADHAAR"], masked=False)
    assert [f[4] for f in plain(found)] == ["LOW", "HIGH", "HIGH", "HIGH"]
    plain_mode = iv.scan_cells(cells(spark, ("invoice_no", "234567890124", "")), options=iv.cell_mode())
    assert plain(plain_mode)[0][4] == "HIGH"


def test_cell_mode_keeps_each_cell(contacts):
    by_cell = plain(iv.scan(contacts, row="r", options=iv.cell_mode()))
    assert {f[2] for f in by_cell} == {"AADHAAR", "PAN", "IN_MOBILE"}
    assert (7, "pan_no", "PAN", "XXXXX1234X", "HIGH") in by_cell


def test_clear_values_leave_no_trace(contacts):
    found = iv.scan(contacts, row="r")
    text = " ".join(str(r) for r in found.collect())
    assert "ABCPD1234E" not in text and "9876543210" not in text and "234567890124" not in text
    assert "raw_value" not in found.columns


def test_clear_pan_is_not_reported_as_masked(spark):
    df = cells(spark, ("data", "XYZCA5678F", ""))
    assert [f[2] for f in plain(iv.scan_cells(df))] == ["PAN"]
    both = plain(iv.scan_cells(df, keep_clear_pans_as_masked=True))
    assert [f[2] for f in both] == ["PAN", "PAN_MASKED"]


def test_whole_texts_are_scanned(spark):
    text = "filler " * 20000 + "ABCPD1234E"
    df = cells(spark, ("text", text, ""))
    assert [f[2] for f in plain(iv.scan_cells(df))] == ["PAN"]


def test_other_scripts(spark):
    df = cells(spark, ("data", "मोबाइल ९८७६५४३२१०", ""), ("data", "\uff21\uff22\uff23\uff30\uff241234\uff25", ""))
    assert [(f[2], f[4]) for f in plain(iv.scan_cells(df))] == [("IN_MOBILE", "HIGH"), ("PAN", "HIGH")]


def test_registry():
    registry = Registry()
    assert registry.all_types() == sorted(
        ["AADHAAR", "PAN", "GSTIN", "IN_MOBILE", "VOTER_ID", "PASSPORT", "BANK_ACCOUNT", "IFSC"])
    order = [x.entity for x in registry.active()]
    assert order == ["AADHAAR", "GSTIN", "IFSC", "BANK_ACCOUNT", "IN_MOBILE", "PAN", "PASSPORT", "VOTER_ID"]
    registry.disable("bank_account")
    assert "BANK_ACCOUNT" not in [x.entity for x in registry.active()]
    assert "IFSC" in [x.entity for x in registry.active()]
    registry.enable("BANK_ACCOUNT")
    assert registry.get("pan").entity == "PAN" and registry.get("nope") is None


def test_own_recognizer_as_pandas_udf(spark):
    @F.pandas_udf(MATCH_TYPE)
    def find_badge(texts: pd.Series) -> pd.Series:
        def one(t):
            hit = [{"entity_type": "BADGE", "raw_value": t, "masked_value": "B-XX", "confidence": "LOW", "extra": None}]
            return hit if t.startswith("badge") else []

        return texts.map(one)

    registry = Registry()
    registry.register("badge", find_badge)
    df = cells(spark, ("badge", "badge seven", ""), ("data", "ABCPD1234E", ""))
    found = plain(iv.scan_cells(df, registry=registry))
    assert [(f[2], f[3]) for f in found] == [("BADGE", "B-XX"), ("PAN", "XXXXX1234X")]


def test_own_recognizer_with_a_test_keeps_the_gates(spark):
    """The same findings as without a test, from a plan that drops other cells before they are normalised."""

    def find(text):
        hit = F.struct(F.lit("BADGE"), text, F.lit("B-XX"), F.lit("LOW"), F.lit(None).cast("map<string,string>"))
        return F.when(text.rlike("B-[0-9]"), F.array(hit)).otherwise(F.array()).cast(MATCH_TYPE)

    texts = ["B-7", "wide \uff22-\uff17", "x | B-1", "ABCPD1234E", "plain words", "", "B-x", "2345 6789 0124 B-2"]
    df = cells(spark, *[("c", t, "") for t in texts])
    found, plans = [], []
    for test in (None, lambda text: text.contains("B-")):
        registry = Registry()
        registry.register("badge", find, test)
        scanned = iv.scan_cells(df, registry=registry, dedup="cell")
        found.append(plain(scanned))
        plans.append(scanned._jdf.queryExecution().optimizedPlan().toString())
    assert found[0] == found[1] and sum(f[2] == "BADGE" for f in found[0]) == 4
    # Normalised text is filtered by the built-in shapes or the own test, and only with the test.
    assert "Contains(clean#" in plans[1] and "Contains(clean#" not in plans[0]


def test_detection_needs_no_shuffle_and_dedup_one(contacts):
    plan = iv.scan(contacts, row="r")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "PythonUDF" not in plan and "ArrowEval" not in plan and "CartesianProduct" not in plan


def test_numbers_and_nested_values(spark):
    df = spark.createDataFrame(
        [(1, 9876543210.0, 234567890124, ["ABCPD1234E"], True)],
        "r int, a double, b bigint, c array<string>, d boolean",
    )
    assert [(f[1], f[2]) for f in plain(iv.scan(df, row="r"))] == [
        ("a", "IN_MOBILE"), ("b", "AADHAAR"), ("b", "BANK_ACCOUNT"), ("c", "PAN")]


def test_rollups(contacts):
    found = iv.scan(contacts, file="contacts.csv", row="r").cache()
    assert {r[0]: r[1] for r in ru.by_entity(found).collect()} == {
        "AADHAAR": 4, "BANK_ACCOUNT": 3, "IN_MOBILE": 6, "PAN": 4}
    assert {r[0]: r[1] for r in ru.by_confidence(found).collect()} == {"HIGH": 14, "MEDIUM": 3}
    assert ru.at_least(found, "HIGH").count() == 14
    assert ru.search(found, "PAN_NO").count() == 4
    assert ru.search(found, "", "AADHAAR").count() == 4
    assert [r[0] for r in ru.top_files(found).collect()] == ["contacts.csv"]
    assert tuple(ru.totals(found).first()) == (17, 1)
    one = ru.summary(found, "contacts.csv", 1.23456).first().asDict()
    assert one == {
        "target_source": "contacts.csv", "duration_seconds": 1.235, "sources_affected": 1,
        "total_findings": 17, "risk_level": "CRITICAL RISK (Verified PII Exposure Detected)",
        "entity_breakdown": {"AADHAAR": 4, "BANK_ACCOUNT": 3, "IN_MOBILE": 6, "PAN": 4},
        "confidence_breakdown": {"HIGH": 14, "MEDIUM": 3},
    }
    page = ru.report_page(found, 3).collect()
    assert [(r["number"], r["location"]) for r in page] == [
        (1, "Row 2 Col mobile"), (2, "Row 2 Col aadhaar_no"), (3, "Row 2 Col aadhaar_no")]
    empty = ru.summary(found.where("false")).first()
    assert (empty["total_findings"], empty["risk_level"], empty["entity_breakdown"]) == (0, "LOW RISK", {})


@pytest.mark.parametrize("policy, none, low, high", [
    ("cli", "LOW RISK", "LOW RISK", "CRITICAL RISK (Verified PII Exposure Detected)"),
    ("summary", "LOW RISK", "WARNING", "CRITICAL RISK"),
    ("desktop", "PASS — LOW RISK", "WARNING", "CRITICAL RISK"),
    ("web", "COMPLIANT (ZERO PII)", "CRITICAL EXPOSURE", "CRITICAL EXPOSURE"),
    ("report", "PASS — LOW RISK", "PASS — LOW RISK", "CRITICAL RISK — ACTION REQUIRED"),
])
def test_risk_policies(spark, policy, none, low, high):
    def level(*tiers):
        df = spark.createDataFrame([(t,) for t in tiers], "confidence string")
        return ru.risk_level(df, policy).first()["risk_level"]

    assert (level(), level("LOW"), level("HIGH", "LOW")) == (none, low, high)
