import pytest
from pyspark.sql import functions as F

from idveil.functions import context as ctx

HEADERS = {
    "aadhaar_no": "AADHAAR", "Aadhaar Number": "AADHAAR", "AADHAR": "AADHAAR", "uid": "AADHAAR",
    "PAN": "PAN", "pan_number": "PAN", "Permanent Account Number": "PAN", "GSTIN": "GSTIN",
    "gst_no": "GSTIN", "GST Number": "GSTIN", "mobile": "IN_MOBILE", "Phone No": "IN_MOBILE",
    "contact_number": "IN_MOBILE", "WhatsApp": "IN_MOBILE", "voter-id": "VOTER_ID",
    "passport.no": "PASSPORT", "acct": "BANK_ACCOUNT", "IFSC Code": "IFSC", "आधार संख्या": "AADHAAR",
    "मोबाइल": "IN_MOBILE", "employee_id": None, "department": None, "name": None, "span": None,
}


def test_headers(evaluate):
    assert evaluate(ctx.column_entity, list(HEADERS)) == list(HEADERS.values())
    assert [ctx.entity_of_header(h) for h in HEADERS] == list(HEADERS.values())


def test_penalty(evaluate):
    names = ["sl_no", "invoice_number", "Order-No", "qty", "item", "data", "serials"]
    expected = [True, True, True, True, True, False, False]
    assert evaluate(ctx.is_penalised, names) == expected
    assert [ctx.header_is_penalised(n) for n in names] == expected


def test_labels(evaluate):
    texts = ["PAN: ABCPD1234E", "Aadhaar No. 234567890124", "PAN: ABCPD1234E, GST: 27AAPFU0939F1ZV",
             "9876543210", "company", "खाता 1"]
    assert evaluate(ctx.inline_labels, texts) == [
        ["PAN"], ["AADHAAR"], ["GSTIN", "PAN"], [], ["PAN"], ["BANK_ACCOUNT"]]


def test_row_density(evaluate):
    texts = ["Mumbai 400001", "call 9876543210", "a.b@c.in", "customer", "Customers", "1234567", "",
             "x@y", "éa.b@c.in", "éab@c.in", "नाम x", "पता x", "पताक", ".@c.in", "a" * 5000 + "." * 5000]
    expected = [True, True, True, True, False, False, False, False, True, False, True, False, True, False, False]
    assert evaluate(ctx.row_is_dense, texts) == expected


@pytest.mark.parametrize(
    "conf, entity, column_entity, labels, name, dense, expected",
    [
        ("MEDIUM", "AADHAAR", "AADHAAR", [], "c", False, "HIGH"),
        ("MEDIUM", "PAN", None, ["PAN"], "c", False, "HIGH"),
        ("MEDIUM", "AADHAAR", None, [], "c", False, "MEDIUM"),
        ("HIGH", "AADHAAR", "AADHAAR", [], "c", False, "HIGH"),
        ("LOW", "GSTIN", "GSTIN", [], "c", False, "MEDIUM"),
        ("MEDIUM", "IN_MOBILE", "AADHAAR", [], "c", False, "MEDIUM"),
        ("HIGH", "AADHAAR", None, [], "sl_no", False, "LOW"),
        ("MEDIUM", "AADHAAR", None, [], "invoice_number", True, "LOW"),
        ("MEDIUM", "AADHAAR", None, [], "c", True, "HIGH"),
        ("ODD", "AADHAAR", None, [], "c", False, "LOW"),
    ],
)
def test_boost(spark, conf, entity, column_entity, labels, name, dense, expected):
    found = F.array(*[F.lit(x) for x in labels]) if labels else F.array().cast("array<string>")
    boosted = ctx.boost_confidence(
        F.lit(conf), F.lit(entity), F.lit(column_entity).cast("string"), found, F.lit(name), F.lit(dense)
    )
    assert spark.range(1).select(boosted).first()[0] == expected
