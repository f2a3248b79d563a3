import pytest
from pyspark.sql import functions as F

import idveil as iv
from idveil.operators.evaluate import make_aadhaar, make_gstin, score_corpus

PREFIXES = ["23456789012", "34567890123", "45678901234", "56789012345", "67890123456",
            "78901234567", "89012345678", "90123456789", "29876543210", "31122334455"]
PANS = ["ABCPD1234E", "XYZCA5678F", "DEFHG2345K", "MNOFS6789L", "PQRAT1111M", "RSTTN2222N",
        "UVWBZ3333P", "GHILR4444Q", "JKLJX5555R", "ABCGK6789S"]
MOBILES = ["9876543210", "8765432109", "7654321098", "6543210987", "9123456789", "8012345678",
           "7098765432", "6789012345"]


def tiers(evaluate, find, texts):
    return [[m["confidence"] for m in ms] for ms in evaluate(find, texts)]


def values(evaluate, find, texts):
    return [[m["raw_value"] for m in ms] for ms in evaluate(find, texts)]


@pytest.fixture(scope="module")
def aadhaar(evaluate):
    return evaluate(make_aadhaar, PREFIXES)


def test_aadhaar(evaluate, aadhaar):
    assert tiers(evaluate, iv.find_aadhaar, aadhaar) == [["HIGH"]] * len(aadhaar)
    a = aadhaar[0]
    forms = [f"{a[:4]} {a[4:8]} {a[8:]}", f"{a[:4]}-{a[4:8]}-{a[8:]}", f"Aadhaar: {a}", f"UID={a}",
             f"{a[:4]}.{a[4:8]}.{a[8:]}", f"{a[:4]}_{a[4:8]}_{a[8:]}", f"{a[:4]}/{a[4:8]}/{a[8:]}"]
    assert values(evaluate, iv.find_aadhaar, forms) == [[a]] * len(forms)
    wrong = a[:-1] + str((int(a[-1]) + 1) % 10)
    assert tiers(evaluate, iv.find_aadhaar, [wrong]) == [["MEDIUM"]]
    negatives = ["012345678901", "112345678901", "23456789012", "2345678901234", f"123{a}456",
                 "000000000000", "888888881234", "+919876543210", "919876543210", "09876543210"]
    assert values(evaluate, iv.find_aadhaar, negatives) == [[]] * len(negatives)
    assert evaluate(iv.find_aadhaar, [a])[0][0]["masked_value"] == f"XXXX XXXX {a[-4:]}"


def test_pan(evaluate):
    assert tiers(evaluate, iv.find_pan, PANS) == [["HIGH"]] * len(PANS)
    forms = ["PAN: ABCPD1234E", "pan no. abcpd1234e", "ABC PD 1234 E", "ABCPD1234E / more", "ABCPD 1234E"]
    assert values(evaluate, iv.find_pan, forms) == [["ABCPD1234E"]] * len(forms)
    assert tiers(evaluate, iv.find_pan, ["ABCDD1234E", "AAAED9999A"]) == [["MEDIUM"]] * 2
    none = ["ABCPD123E", "ABCPD12345E", "123PD1234E", "ABCP1234", "ABCZD1234E", "ABCQD1234E",
            "ABCPD1234E@gmail.com", "x/ABCPD1234E", "c:\\a\\ABCPD1234E", "éABCPD1234E"]
    assert values(evaluate, iv.find_pan, none) == [[]] * len(none)
    once = evaluate(iv.find_pan, ["ABCPD1234E and ABCPD1234E, XYZCA5678F"])[0]
    assert [m["raw_value"] for m in once] == ["ABCPD1234E", "XYZCA5678F"]
    assert once[0]["masked_value"] == "XXXXX1234X"
    assert once[0]["extra"] == {"holder_type": "Individual"}


def test_pan_first_occurrence_decides(evaluate):
    texts = ["ABCPD1234E@x.in or ABCPD1234E", "ABCPD1234E or ABCPD1234E@x.in",
             "ABC PD 1234 E or ABCPD1234E@x.in"]
    assert values(evaluate, iv.find_pan, texts) == [[], ["ABCPD1234E"], []]


def test_gstin(evaluate):
    made = evaluate(make_gstin, ["29ABCPD1234E1Z", "07XYZCA5678F2Z", "33DEFHG2345K1Z", "00ABCPD1234E1Z",
                                 "39ABCPD1234E1Z"])
    assert tiers(evaluate, iv.find_gstin, made) == [["HIGH"]] * 3 + [["LOW"]] * 2
    assert tiers(evaluate, iv.find_gstin, ["gst no 27aapfu0939f1zv", "27AAPFU0939F1ZW"]) == [["HIGH"], ["MEDIUM"]]
    none = ["27AAPFU0939F1Z", "27AAPFU0939F1ZVX", "27AAPFU0939F1XV"]
    assert values(evaluate, iv.find_gstin, none) == [[]] * 3
    match = evaluate(iv.find_gstin, ["27AAPFU0939F1ZV"])[0][0]
    assert (match["masked_value"], match["extra"]) == ("27XXXXXXXXXX1ZV", {"state_code": "27"})


def test_mobile(evaluate):
    assert tiers(evaluate, iv.find_mobile, MOBILES) == [["MEDIUM"]] * len(MOBILES)
    forms = ["+91 9876543210", "+91-9876543210", "91 9876543210", "09876543210", "Mobile: 9876543210",
             "Ph: +919876543210", "98765 43210", "98765.43210", "(91) 9876543210"]
    masks = [[m["masked_value"] for m in ms] for ms in evaluate(iv.find_mobile, forms)]
    assert masks == [["XXXXXX3210"]] * len(forms)
    none = ["5876543210", "1234567890", "987654321", "98765432101", "123987654321045", "0234567890",
            "₹9876543210", "INR 9876543210", "Rs. 9876543210", "2024-01-05 9876543210", "TXN-9 9876543210",
            "customers 9876543210"]
    assert values(evaluate, iv.find_mobile, none) == [[]] * len(none)
    both = values(evaluate, iv.find_mobile, ["9876543210; +91 9876543210; 8765432109"])[0]
    assert both == ["+919876543210", "8765432109"]


def test_bank(evaluate):
    texts = ["IFSC HDFC0001234", "SBIN0012345", "zzzz0abcdef", "Hello World 12345", "XHDFC0001234"]
    assert tiers(evaluate, iv.find_ifsc, texts) == [["MEDIUM"], ["MEDIUM"], ["LOW"], [], []]
    accounts = ["Account No: 12345678901", "01234567890", "1234567890", "123456789", "1" * 18, "1" * 19]
    masks = [[m["masked_value"] for m in ms] for ms in evaluate(iv.find_bank_account, accounts)]
    assert masks == [["XXXXXXX8901"], [], [], ["XXXXX6789"], ["X" * 14 + "1111"], []]


def test_voter_and_passport(evaluate):
    voters = ["ZDB1234567", "card abc7654321.", "ZDB123456", "ZDB12345678", "XZDB1234567"]
    assert values(evaluate, iv.find_voter_id, voters) == [["ZDB1234567"], ["ABC7654321"], [], [], []]
    passports = ["A1234567", "no z9876543", "O1234567", "Q1234567", "X1234567", "11234567"]
    assert values(evaluate, iv.find_passport, passports) == [["A1234567"], ["Z9876543"], [], [], [], []]
    assert evaluate(iv.find_voter_id, ["ZDB1234567"])[0][0]["masked_value"] == "ZDBXXXX567"
    assert evaluate(iv.find_passport, ["A1234567"])[0][0]["masked_value"] == "AXXXX567"


def test_masked(evaluate):
    texts = ["XXXX XXXX 1234", "**** **** 5678", "xxxxxxxx-1234", "1234XXXXXXXX", "*****1234*", "ABC**1234D",
             "ABCXXXX123", "ABC123XXXX", "A****123", "ABCPD1234E"]
    kinds = [[m["entity_type"] for m in ms] for ms in evaluate(iv.find_masked, texts)]
    assert kinds == [["AADHAAR_MASKED"]] * 4 + [["PAN_MASKED"]] * 2 + [["VOTER_ID_MASKED"]] * 2 + [
        ["PASSPORT_MASKED"], []]


def test_corpus_scores(spark, aadhaar):
    rows = [("AADHAAR", "positive", a) for a in aadhaar] + [("PAN", "positive", p) for p in PANS]
    rows += [("IN_MOBILE", "positive", m) for m in MOBILES] + [("IN_MOBILE", "negative", "5876543210")]
    rows += [("AADHAAR", "negative", "112345678901"), ("PAN", "negative", "ABCDD1234E")]
    scored = score_corpus(spark.createDataFrame(rows, "entity string, kind string, value string")).collect()
    assert {r["entity"]: (r["recall"], r["false_positive_rate"], r["precision"]) for r in scored} == {
        e: (1.0, 0.0, 1.0) for e in ("AADHAAR", "PAN", "IN_MOBILE")}


def test_many_matches_in_one_text(spark):
    """Thousands of values in one text stay linear enough to finish at once."""
    text = " ".join(f"ABCPD{i:04d}{chr(65 + i % 26)}" for i in range(5000))
    df = spark.createDataFrame([(text,)], "t string").select(F.size(iv.find_pan("t")))
    assert df.first()[0] == 5000
