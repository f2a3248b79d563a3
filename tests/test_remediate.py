import hashlib
import hmac
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import idveil as iv
from idveil.functions.text import normalise_cell
from idveil.operators.remediate import remediate_cells, remediate_documents

from test_scan import CONTACTS

MASKED = [
    ("Priya Sharma", "XXXXXX3210", "XXXX XXXX 0124", "XXXXX1234X"),
    ("Rajesh Kumar", "+91 XXXXXX2109", "XXXX XXXX 1238", "XXXXX5678X"),
    ("Aisha Begum", "XXXXXX1098", "4567.8901.2341", "XXXXX2345X"),
    ("Suresh Pillai", "XXXXXX0987", None, "XXXXX6789X"),
    ("Kavita Nair", "XXXXXX6789", "XXXX XXXX 3458", None),
    ("Multi-value cell", "XXXXXX3210, XXXXXX2109", "UID: XXXX XXXX 0124", "PAN: XXXXX1234X"),
]


@pytest.fixture(scope="module")
def contacts(spark):
    return spark.createDataFrame(CONTACTS, "name string, mobile string, aadhaar_no string, pan_no string").coalesce(1)


def token(entity, value, salt="known here only"):
    digest = hmac.new(salt.encode(), value.encode(), hashlib.sha256).hexdigest()
    return f"TOK-{entity}-{digest.upper()}"


def test_golden_masks(contacts):
    assert [tuple(r) for r in iv.remediate(contacts, occurrences="first").collect()] == MASKED
    # Every form of a value goes otherwise, dotted numbers too.
    dotted = [tuple("XXXX XXXX 2341" if v == "4567.8901.2341" else v for v in row) for row in MASKED]
    assert [tuple(r) for r in iv.remediate(contacts).collect()] == dotted


def test_redact_and_tokenize(evaluate):
    texts = ["PAN abcpd1234e, tel +91 9876543210", "tel +919876543210", "no identifiers", "", "  "]
    assert evaluate(lambda t: iv.sanitize(t, "redact"), texts) == [
        "PAN [REDACTED_PAN], tel +91 [REDACTED_IN_MOBILE]", "tel [REDACTED_IN_MOBILE]", "no identifiers", "", "  "]
    tokens = evaluate(lambda t: iv.sanitize(t, "tokenize", salt="s" * 80), texts[:2])
    number = token("IN_MOBILE", "+919876543210", "s" * 80)
    assert tokens == [f"PAN {token('PAN', 'ABCPD1234E', 's' * 80)}, tel +91 {number}", f"tel {number}"]
    assert evaluate(lambda t: iv.tokenize(t, "PAN", "known here only"), ["ABCPD1234E"]) == [token("PAN", "ABCPD1234E")]


def test_overlaps_and_repeats(evaluate):
    texts = [
        "234567890124 then 12345678901 and 9876543210",  # Aadhaar beats the account number
        "ABCPD1234E ABCPD1234E",  # the first occurrence only
        "27AAPFU0939F1ZV HDFC0001234 ZDB1234567 A1234567",
        "2345 6789 0124",  # found, but not written that way
        "straße 9876543210 ß",
    ]
    assert evaluate(lambda t: iv.sanitize(t, occurrences="first"), texts) == [
        "XXXX XXXX 0124 then XXXXXXX8901 and XXXXXX3210",
        "XXXXX1234X ABCPD1234E",
        "27XXXXXXXXXX1ZV HDFC0XXXXXX ZDBXXXX567 AXXXX567",
        "2345 6789 0124",
        "straße XXXXXX3210 ß",
    ]
    assert evaluate(lambda t: iv.sanitize(t, mask_token="#"), texts[:1]) == ["# then # and #"]
    assert evaluate(lambda t: iv.sanitize(t, entities=["PAN"]), ["ABCPD1234E 9876543210"]) == ["XXXXX1234X 9876543210"]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        iv.sanitize("t", "shred")


def test_changed_cells(spark, contacts):
    counts = lambda **how: {r["column"]: r["changed"] for r in iv.changed_cells(contacts, **how).collect()}
    assert counts(occurrences="first") == {"name": 0, "mobile": 6, "aadhaar_no": 4, "pan_no": 5}
    assert counts() == {"name": 0, "mobile": 6, "aadhaar_no": 5, "pan_no": 5}
    seen = Observation("remediation")
    out = iv.remediate(contacts, observation=seen, occurrences="first")
    assert [tuple(r) for r in out.collect()] == MASKED
    assert seen.get["changed_cells"] == 15


def test_remediation_is_a_narrow_projection(contacts):
    plan = iv.remediate(contacts.select("name", "mobile"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_hot_tokens_are_dealt_out(spark):
    """Tokens that are hot on the left, on the right, on both sides and nowhere; nulls, repeated rows, clashing names."""
    left = [("l",) * 50 + ("b",) * 30 + ("r",) * 2 + tuple("xyz") + (None,) * 9]
    right = [("r",) * 45 + ("b",) * 25 + ("l",) * 3 + ("x", "x", "w") + (None,) * 7]
    a = spark.createDataFrame([(t, i // 2) for i, t in enumerate(left[0])], "tok string, `_a` int")
    b = spark.createDataFrame([(t, i // 3) for i, t in enumerate(right[0])], "other string, `_left` int")
    want = sorted(map(tuple, iv.correlate(a, b, "tok", "other").collect()))
    assert len(want) == 50 * 3 + 30 * 25 + 2 * 45 + 2
    for slot_rows in (1, 10, 1000):
        joined = iv.correlate(a, b, "tok", "other", slot_rows)
        assert joined.columns == ["tok", "_a", "other", "_left"]
        assert sorted(map(tuple, joined.collect())) == want
    assert iv.correlate(a.where("false"), b, "tok", "other", 10).count() == 0
    with pytest.raises(ValueError):
        iv.correlate(a, b, "tok", "other", 0)


def test_sheet_cells_and_documents(spark):
    df = spark.createDataFrame([(1, "PAN ABCPD1234E"), (2, "nothing"), (3, None)], "id int, text string")
    got = [(r["text"], r["changed"]) for r in remediate_cells(df, "redact").orderBy("id").collect()]
    assert got == [("PAN [REDACTED_PAN]", True), ("nothing", False), (None, False)]
    assert remediate_documents is remediate_cells


def test_tokens_join(spark, contacts):
    left = contacts.select(iv.tokenize("pan_no", "PAN", "k").alias("a"), "name").where("a is not null")
    right = contacts.select(iv.tokenize("pan_no", "PAN", "k").alias("b"), F.col("mobile").alias("m"))
    assert iv.correlate(left, right, "a", "b").count() == left.count()


def test_types_and_nan_stay(spark):
    df = spark.sql("select 'ABCPD1234E' as t, double('NaN') as x, date'2024-01-02' as d, true as b, 9876543210 as n, 1.5D as y")
    out = iv.remediate(df, "redact")
    assert dict(out.dtypes) == {"t": "string", "x": "string", "d": "date", "b": "boolean", "n": "string", "y": "string"}
    row = out.first()
    assert (row["t"], row["x"], row["b"], row["n"], row["y"]) == ("[REDACTED_PAN]", "NaN", True, "[REDACTED_IN_MOBILE]", "1.5")
    assert iv.remediate(df.select("d", "b"), "redact").first()["b"] is True


def test_tokens_need_a_salt():
    with pytest.raises(ValueError):
        iv.sanitize("t", "tokenize")
    with pytest.raises(ValueError):
        iv.tokenize("t", "PAN", "")


def test_every_occurrence_in_any_form(evaluate):
    texts = [
        "PAN ABCPD1234E and again ABCPD1234E, 2345 6789 0124",
        "abcpd 1234 e; ABCPD1234E",
        "tel +91 98765-43210 or 9876543210 or 98765.43210",
        "Rs 500, 9876543210|2345-6789-0124",  # what a scan finds in a part of the text
        "9876543210.0",
        "a 919876543210 b",
    ]
    assert evaluate(lambda t: iv.sanitize(t, "redact"), texts) == [
        "PAN [REDACTED_PAN] and again [REDACTED_PAN], [REDACTED_AADHAAR]",
        "[REDACTED_PAN]; [REDACTED_PAN]",
        "tel +91 [REDACTED_IN_MOBILE] or [REDACTED_IN_MOBILE] or [REDACTED_IN_MOBILE]",
        "Rs 500, [REDACTED_IN_MOBILE]|[REDACTED_AADHAAR]",
        "[REDACTED_IN_MOBILE].0",
        "a [REDACTED_IN_MOBILE] b",
    ]


def test_normalised_characters_keep_their_places(evaluate):
    texts = [
        "ﬂat ９８７６５ ４３２１０ é",  # a ligature becomes two letters before the number
        "​98​765​43210​ x½",
        "२३४५ ६७८९ ०१२४ और ABCPD 1234 E",
        "😀 ＡＢＣＰＤ1234Ｅ 😀 abcpd1234e",
        "é 12 é",
    ]
    assert evaluate(lambda t: iv.sanitize(t, mask_token="#"), texts) == [
        "ﬂat # é",
        "​#​ x½",
        "# और #",
        "😀 # 😀 #",
        "é 12 é",
    ]


def test_nothing_found_before_is_found_after(spark):
    """Values in random forms, order and company: no value a scan finds in a text is in what remediation leaves."""
    rng = random.Random(11)
    values = ["234567890124", "ABCPD1234E", "27AAPFU0939F1ZV", "9876543210", "ZDB1234567", "A1234567", "12345678901", "HDFC0001234"]
    gaps = ["", "", " ", "-", ".", "/", " "]

    def form(v):
        at = rng.randint(1, len(v) - 1)
        v = v[:at] + rng.choice(gaps) + v[at:]
        v = rng.choice([v, v.lower(), v.translate({48 + d: 0xFF10 + d for d in range(10)})])
        return rng.choice(["", "+91", "91", "0", "(", "x"]) + v

    texts = ["".join(form(rng.choice(values)) + rng.choice([" ", ", ", "; ", " and ", "|", " Rs "]) for _ in range(rng.randint(1, 8))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    clean = df.select("i", iv.sanitize("t", mask_token="~").alias("t"))

    def found(rows):
        chunks = rows.select("i", F.explode(normalise_cell("t")).alias("c"))
        kinds = [iv.find_aadhaar, iv.find_pan, iv.find_gstin, iv.find_mobile, iv.find_voter_id, iv.find_passport, iv.find_bank_account, iv.find_ifsc]
        each = chunks.select("i", F.explode(F.concat(*[F.transform(f("c"), lambda m: m["raw_value"]) for f in kinds])).alias("v"))
        return {(r["i"], r["v"]) for r in each.collect()}

    before, after = found(df), found(clean)
    # Numbers that run together across separators are no value of their own any more once their parts are gone.
    assert len(before) > 1500
    assert not {(i, v) for i, v in before & after if v in values}
    assert len(before & after) < 0.01 * len(before)


def test_long_text_of_many_values(evaluate):
    text = " ".join(f"ABCPD{n:04d}E" for n in range(1000))
    (clean,) = evaluate(lambda t: iv.sanitize(t, mask_token="#"), [text + " " + text.lower()])
    assert clean == " ".join(["#"] * 2000)
