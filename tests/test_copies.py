import csv
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

import idveil as iv
from idveil.operators.remediate import remediate_json
from idveil.plans.copies import BLOCK, SOURCE

from test_sources import split_small, write  # noqa: F401


def copy_of(out, name, source):
    """The text of a copy: the parts of its blocks in the order of their names."""
    parts = sorted(glob.glob(os.path.join(str(out), name, f"{SOURCE}={source}", f"{BLOCK}=*", "part-*")))
    texts = []
    for part in parts:
        with open(part, encoding="utf-8", newline="") as file:
            texts.append(file.read())
    return "".join(texts)


def fresh(tmp_path, n=1):
    return str(tmp_path / f"copy{n}")


def test_delimited_copies_keep_header_and_fields(spark, tmp_path):
    write(tmp_path / "in", "data.csv", "﻿Name,Aadhaar,PAN\r\nRahul,999988887777,ABCDE1234F\r\n\"Rao, \"\"R\"\"\",,x\r\n\r\n\"two\nlines\",1\r\n")
    write(tmp_path / "in", "deep/head.csv", "ABCPD1234E,b\nc,9876543210,surplus ABCPD1234E\n")
    write(tmp_path / "in", "t.tsv", "a\tb\n\"x\ty\"\t9876543210\n")
    copies = iv.remediate_path(spark, str(tmp_path / "in"), fresh(tmp_path))
    assert copies.changed == {"csv": 5, "tsv": 1} and copies.unreadable == []
    rows = list(csv.reader(copy_of(fresh(tmp_path), "csv", "data.csv").splitlines(keepends=True)))
    assert rows == [["Name", "Aadhaar", "PAN"], ["Rahul", "XXXX XXXX 7777", "XXXXX1234X"], ['Rao, "R"', "", "x"], ["two\nlines", "1"]]
    assert copy_of(fresh(tmp_path), "csv", "deep%2Fhead.csv") == "XXXXX1234X,b\nc,XXXXXX3210,surplus XXXXX1234X\n"
    assert copy_of(fresh(tmp_path), "tsv", "t.tsv") == 'a\tb\n"x\ty"\tXXXXXX3210\n'


def test_split_files_stay_in_order(spark, tmp_path, split_small):
    records = [["id", "note", "mobile"]] + [[str(i), "x" * (i % 37) + ("\nline" if i % 5 == 0 else ""), f"98765{i:05d}"] for i in range(400)]
    path = os.path.join(str(tmp_path), "in", "big.csv")
    os.makedirs(os.path.dirname(path))
    with open(path, "w", newline="") as file:
        csv.writer(file, lineterminator="\n").writerows(records)
    lines = [f"line {'a' * (i % 7)}: 98765{i:05d}" if i % 3 else "" for i in range(500)]
    write(tmp_path / "in", "big.txt", "\n".join(lines) + "\n")
    copies = iv.remediate_path(spark, str(tmp_path / "in"), fresh(tmp_path))
    assert len(glob.glob(f"{fresh(tmp_path)}/csv/{SOURCE}=big.csv/{BLOCK}=*")) > 5
    got = list(csv.reader(copy_of(fresh(tmp_path), "csv", "big.csv").splitlines(keepends=True)))
    assert got == [records[0]] + [[a, b, "XXXXXX" + c[-4:]] for a, b, c in records[1:]]
    assert copies.changed == {"csv": 400, "text": sum(bool(x) for x in lines)}
    want = [x and x[: x.rindex(" ") + 1] + "XXXXXX" + x[-4:] for x in lines]
    assert copy_of(fresh(tmp_path), "text", "big.txt").split("\n")[:-1] == want


def test_json_stays_json(spark):
    texts = [
        '{"a": 9876543210, "b": [1.5, -3, true, null, "PAN ABCPD1234E"], "c": 9.87654321e9}',
        '{"q": "say \\"ABCPD1234E\\" \\\\ \\u0041BCPD1234E", "ABCPD1234E": {"x": "\\n9876543210"}}',
        '{"a": 1, "b": "nothing", "b": 12}',
        "no json 9876543210",
        '{"a": "9876543210", "a": "ABCPD1234E"}',
        '["unclosed ABCPD1234E]',
        "",
        None,
        '"ABCPD1234E"',
        "[]",
        json.dumps({"long": "\\\"x" * 20_000 + " ABCPD1234E"}),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = remediate_json(df, text="t", mask_token="#").orderBy("i").collect()
    out = [r["t"] for r in got]
    assert json.loads(out[0]) == {"a": "#", "b": [1.5, -3, True, None, "PAN #"], "c": "#"}
    assert json.loads(out[1]) == {"q": 'say "#" \\ #', "#": {"x": "\n#"}}
    assert out[2] == texts[2] and out[3] == "no json #" and out[4] == '{"a": "#", "a": "#"}'
    assert out[5] == '["unclosed #]' and out[6:10] == ["", None, '"#"', "[]"]
    assert json.loads(out[10]) == {"long": "\\\"x" * 20_000 + " #"}
    assert [r["changed"] for r in got] == [True, True, False, True, True, True, False, False, True, False, True]


def test_nothing_is_found_in_a_copy(spark, tmp_path):
    root = str(tmp_path / "in")
    write(root, "a.csv", "name,pan\nAsha,ABCPD1234E\n,2345 6789 0124\n")
    write(root, "b.md", "call 98765 43210\n\nor ABCPD1234E, abcpd1234e\n")
    write(root, "c.jsonl", '{"m": 9876543210}\nbroken ABCPD1234E\n')
    write(root, "sub/d.json", '[{"p": "ABCPD1234E"},\n {"p": 234567890124}]')
    spark.createDataFrame([(1, "ABCPD1234E"), (2, "none")], "id int, pan string").write.parquet(f"{root}/e.parquet")
    spark.createDataFrame([("x", 9876543210)], "id string, m long").write.parquet(f"{root}/f.parquet")
    assert iv.scan_path(spark, root).count() > 5
    copies = iv.remediate_path(spark, root, fresh(tmp_path), mask_token="gone")
    assert copies.changed == {"csv": 2, "text": 2, "jsonl": 2, "json": 1, "parquet": 2}
    whole = [p for p in glob.glob(f"{fresh(tmp_path)}/**/part-*", recursive=True)]
    assert {os.path.relpath(p, fresh(tmp_path)).split("/")[0] for p in whole} == {"csv", "text", "jsonl", "json", "parquet"}
    texts = spark.read.option("recursiveFileLookup", True).text([f"{fresh(tmp_path)}/{n}" for n in ("csv", "text", "jsonl", "json")])
    tables = [spark.read.parquet(d) for d in sorted(glob.glob(f"{fresh(tmp_path)}/parquet/*"))]
    assert iv.scan(texts).count() == 0
    assert sorted(r["id"] for t in tables for r in t.select(F.col("id").cast("string")).collect()) == ["1", "2", "x"]
    assert all(iv.scan(t.drop(SOURCE, BLOCK)).count() == 0 for t in tables)
    assert json.loads(copy_of(fresh(tmp_path), "json", "sub%2Fd.json")) == [{"p": "gone"}, {"p": "gone"}]


def test_copies_refuse_what_would_harm(spark, tmp_path):
    root = str(tmp_path / "in")
    write(root, "a.txt", "x\n")
    with pytest.raises(ValueError):
        iv.remediate_path(spark, root, root + "/copy")
    with pytest.raises(ValueError):
        iv.remediate_path(spark, root, fresh(tmp_path), "tokenize")
    with pytest.raises(FileNotFoundError):
        iv.remediate_path(spark, root + "/none", fresh(tmp_path))
    spark.createDataFrame([("x",)], f"{SOURCE} string").write.parquet(f"{root}/e.parquet")
    with pytest.raises(ValueError):
        iv.remediate_path(spark, root, fresh(tmp_path, 2), only=("parquet",))
    write(root, "broken.parquet", "no table")
    spark.createDataFrame([("ABCPD1234E",)], "p string").write.parquet(f"{tmp_path}/g/ok.parquet")
    write(tmp_path / "g", "broken.parquet", "no table")
    copies = iv.remediate_path(spark, f"{tmp_path}/g", fresh(tmp_path, 3))
    assert copies.changed == {"parquet": 1} and len(copies.unreadable) == 1 and copies.unreadable[0].endswith("broken.parquet")
