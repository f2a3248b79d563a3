import os
import zlib

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    return SMALL


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and other columns with clashing names."""
    long = " ".join(f"w{i % 977} Word{i}" for i in range(8000))
    rows = [
        (1, None, "x"),
        (2, "", None),
        (3, " \t\n ", "x"),
        (4, "one", "y"),
        (5, "One  two\tthree", "y"),
        (6, "One two three", None),
        (6, "One two three", None),
        (None, "no id at all", "z"),
        (7, long, "z"),
        (8, long + " tail", "z"),
        (9, "päss ▁ 日本 😀   nul\x00end", "z"),
        (10, "a b c d e f g h i j k l " * 30, "z"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = ["hash", "digest", "kept", "rep", "n", "key", "block", "row", "spans", "label", "score", "component", "sequence_id"]
    for name in clash:
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")


def crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus
