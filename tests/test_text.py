import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from idveil.functions import recognizers as r
from idveil.functions import text as tx

CASES = [
    ("ABCPD\u200b1234E", ["ABCPD1234E"]),
    ("2345\u00a06789\u00a00124", ["2345 6789 0124"]),
    ("\u201cPAN\u201d \u2018x\u2019", ["\"PAN\" 'x'"]),
    ("\uff19\uff18\uff17\uff16", ["9876"]),
    ("९८७६५४३२१०", ["9876543210"]),
    ("৯৮৭৬৫৪৩২১০", ["9876543210"]),
    ("9876543210.0", ["9876543210"]),
    ("123.45", ["123.45"]),
    ("1.0.0", ["1.0.0"]),
    ("PAN: ABCPD1234E, Mobile: 9876543210",
     ["PAN: ABCPD1234E, Mobile: 9876543210", "PAN: ABCPD1234E", "Mobile: 9876543210"]),
    ("value1|value2", ["value1|value2", "value1", "value2"]),
    ("ABCPD1234E, AB", ["ABCPD1234E, AB", "ABCPD1234E"]),
    ("alpha/beta1 01/02", ["alpha/beta1 01/02", "alpha", "beta1 01/02"]),
    ("a\\bcdef;;ghijk", ["a\\bcdef;;ghijk", "bcdef", "ghijk"]),
]


def test_normalise_cell(evaluate):
    got = evaluate(tx.normalise_cell, [c[0] for c in CASES])
    assert got == [c[1] for c in CASES]


def test_whole_text_is_read_unless_a_cap_is_asked_for(evaluate):
    long = "x" * 600 + " ABCPD1234E"
    assert evaluate(tx.normalise_cell, [long]) == [[long]]


def test_nfkc_equals_the_standard_library(evaluate):
    rng = random.Random(3)
    points = [p for p in range(0xA0, 0x3400)] + list(range(0xF900, 0xFFFD))
    texts = ["".join(chr(rng.choice(points)) for _ in range(12)) for _ in range(400)]
    known = [t for t in texts if all(unicodedata.category(c) != "Cn" for c in t)]
    assert evaluate(tx.nfkc, known) == [unicodedata.normalize("NFKC", t) for t in known]


ALPHABET = "0123456789" * 3 + "ABCPXZYabpx" + "  .-/_|(),;+@*:\u200b\u00a0९é\uff11"
SEEDS = [
    "ABCPD1234E", "27AAPFU0939F1ZV", "9876543210", "234567890124", "HDFC0001234", "ZDB1234567",
    "A1234567", "XXXX XXXX 1234", "123456789", "AB***1234C", "ABCXXXX123", "A****123",
]


def _texts(n):
    rng = random.Random(11)
    for _ in range(n):
        seed = list(rng.choice(SEEDS))
        for _ in range(rng.randrange(4)):
            seed.insert(rng.randrange(len(seed) + 1), rng.choice(ALPHABET))
        yield "".join(seed) + "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(6)))


@pytest.mark.parametrize("finder", ["aadhaar", "pan", "gstin", "mobile", "ifsc", "bank_account",
                                    "voter_id", "passport", "masked"])
def test_no_identifier_fails_the_candidate_tests(spark, finder):
    """Brute force: whatever a recognizer finds without the tests, the tests let through."""
    find = getattr(r, f"find_{finder}")
    shapes = {"aadhaar": ["aadhaar"], "pan": ["pan"], "gstin": ["pan"], "mobile": ["mobile"],
              "ifsc": ["ifsc"], "bank_account": ["account"], "voter_id": ["letters7"],
              "passport": ["letters7"], "masked": ["masked", "pan"]}[finder]
    df = spark.createDataFrame([(t,) for t in _texts(12000)], "t string")
    df = df.select("t", tx.normalise_text("t").alias("n")).select("t", "n", F.upper("n").alias("u"))
    hits = df.where(F.size(find("n")) > 0)
    shown = F.lit(False)
    for s in shapes:
        shown = shown | tx.has_shape(F.col("n"), F.col("u"), s)
    lost = hits.where(~(tx.may_hold_identifier("t") & tx.is_candidate("n") & shown))
    assert lost.limit(5).collect() == []
    assert hits.count() > 50
