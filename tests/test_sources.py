import json
import os

import pytest
from pyspark.sql import functions as F

import idveil as iv
from idveil.plans.scan import scan_rows
from idveil.plans.sources import path_rows
from idveil.sources import documents as docs
from idveil.sources import files as fs
from idveil.sources.catalog import catalog_tables, database_rows
from idveil.sources.numbering import table_positions
from idveil.sources.tables import cell_rows, explode_cells, table_rows


def cells_of(rows):
    got = explode_cells(rows).orderBy("file", "sheet", "row", "ord")
    return [(r["row"], r["column"], r["text"]) for r in got.collect()]


def write(folder, name, text):
    path = os.path.join(str(folder), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write(text)
    return path


@pytest.fixture
def split_small(spark):
    """Let files split after a few bytes, so that row numbers cross splits."""
    keys = {"spark.sql.files.maxPartitionBytes": "200b", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_csv(spark, tmp_path):
    write(tmp_path, "a.csv", "\ufeffname,pan_no\nasha, ABCPD1234E \n\n,XYZCA5678F\n")
    write(tmp_path, "sub/b.CSV", 'note,"no, te"\n"line 1\nline 2","say ""hi"""\nx\n')
    rows = fs.csv_rows(spark, str(tmp_path))
    assert cells_of(rows) == [
        (2, "name", "asha"), (2, "pan_no", "ABCPD1234E"), (3, "pan_no", "XYZCA5678F"),
        (2, "note", "line 1\nline 2"), (2, "no, te", 'say "hi"'), (3, "note", "x"),
    ]
    context = {(r["file"][-5:], r["row"]): r["row_context"] for r in rows.collect()}
    assert context[("a.csv", 2)] == "asha ABCPD1234E"


def test_csv_record_with_too_many_fields_is_reported_and_read(spark, tmp_path):
    write(tmp_path, "a.csv", "id,pan\n1,ABCPD1234E\n2,XYZCA5678F,DEFHG2345K\n3,MNOFS6789L\n")
    found = iv.scan_path(spark, str(tmp_path))
    kinds = sorted((r["row"], r["column"], r["entity_type"]) for r in found.collect())
    assert kinds == [(2, "pan", "PAN"), (3, "(unnamed)", "PAN"), (3, "ERROR", "FILE_READ_ERROR"),
                     (3, "pan", "PAN"), (4, "pan", "PAN")]


def test_csv_row_numbers_across_splits(spark, tmp_path, split_small):
    lines = [f"{i},name {i}" for i in range(2, 502)]
    write(tmp_path, "a.csv", "\n".join(["number,name", *lines]) + "\n")
    rows = fs.csv_rows(spark, str(tmp_path), splits=10_000)
    assert rows.rdd.getNumPartitions() > 1
    got = [(r["row"], r["cells"][0]["text"]) for r in rows.orderBy("row").collect()]
    assert got == [(i, str(i)) for i in range(2, 502)]


def read_by_csv(text, separator):
    import csv
    import io

    return list(csv.reader(io.StringIO(text, newline=""), delimiter=separator))


@pytest.mark.parametrize("splits", [None, 10_000])
def test_records_across_splits_equal_a_record_reader(spark, tmp_path, split_small, splits):
    """Quoted line breaks, stray quotes, blank lines and wide records, in files cut every 200 bytes."""
    import random

    rng = random.Random(4)
    parts = ["a", "long value", '"q, t"', '"two\nlines"', '"say ""x"""', 'stray " quote', "", " ", '"" after', '"a\n\n,b"']
    text = "h1,h2\n" + "\n".join(",".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(400)) + "\n\n  \nend,1\n"
    write(tmp_path, "a.csv", text)
    write(tmp_path, "t.tsv", text.replace(",", "\t"))
    want = [r for r in read_by_csv(text, ",") if r][1:]
    rows = fs._delimited(spark, str(tmp_path), "csv", ",", False, splits).orderBy("_row").collect()
    assert [(r["_row"], r["fields"]) for r in rows] == list(enumerate(want, 2))
    want = [(i, r) for i, r in enumerate(read_by_csv(text.replace(",", "\t"), "\t"), 1) if r][1:]
    rows = fs._delimited(spark, str(tmp_path), "tsv", "\t", True, splits).orderBy("_row").collect()
    assert [(r["_row"], r["fields"]) for r in rows] == want


def test_no_field_is_lost(spark, tmp_path):
    write(tmp_path, "a.csv", 'a,b\n1,"x\ny","p\nq","r\ns",ABCPD1234E\n   \n2,XYZCA5678F\n')
    write(tmp_path, "wide.csv", "a\n\"" + "," * 15_000 + "\"\nABCPD1234E\n")
    got = cells_of(fs.csv_rows(spark, str(tmp_path)))
    assert [g[:2] for g in got if g[2] == "ABCPD1234E"] == [(2, "(unnamed)"), (3, "a")]
    assert (4, "b", "XYZCA5678F") in got  # the line of blanks is a record
    assert (2, "a", "," * 15_000) in got


def test_tsv(spark, tmp_path):
    write(tmp_path, "t.tsv", '\nname\tpan\nasha\tABCPD1234E\textra 1\n\n"q\tr"\tXYZCA5678F\n')
    assert cells_of(fs.tsv_rows(spark, str(tmp_path))) == [
        (3, "name", "asha"), (3, "pan", "ABCPD1234E"), (3, "col_3", "extra 1"),
        (5, "name", "q\tr"), (5, "pan", "XYZCA5678F"),
    ]


def test_text_lines(spark, tmp_path):
    write(tmp_path, "n.txt", "Street 5\r\n\r\n PAN ABCPD1234E\nAadhaar 234567890124\n")
    write(tmp_path, "n.LOG", "one\ntwo\n")
    rows = fs.text_rows(spark, str(tmp_path))
    got = sorted((r["file"][-5:], r["row"], r["cells"][0]["text"], r["row_context"]) for r in rows.collect())
    assert got == [
        ("n.LOG", 1, "one", "one two"), ("n.LOG", 2, "two", "one two"),
        ("n.txt", 1, "Street 5", "Street 5"),
        ("n.txt", 3, "PAN ABCPD1234E", "PAN ABCPD1234E Aadhaar 234567890124"),
        ("n.txt", 4, "Aadhaar 234567890124", "PAN ABCPD1234E Aadhaar 234567890124"),
    ]


@pytest.mark.parametrize("splits", [None, 10_000])
def test_lines_of_split_files_meet_their_neighbours(spark, tmp_path, split_small, splits):
    """Files of many splits, of one split, of one line and of none, against the form that holds whole texts."""
    texts = {
        "big.log": "\n".join("" if i % 9 == 0 else f"line {i} of many" for i in range(1, 400)) + "\n",
        "long.txt": "\r\n".join(f"{i} " + "x" * (i * 37 % 400) for i in range(60)),
        "one.md": "alone",
        "two.md": "first\nsecond",
        "none.txt": "",
        "blank.txt": "\n\n\n",
    }
    for name, text in texts.items():
        write(tmp_path, name, text)
    name = F.element_at(F.split("file", "/"), -1).alias("name")
    pick = (name, "row", "row_context", F.col("cells.text").alias("t"))
    whole = spark.createDataFrame(list(texts.items()), "file string, text string")
    want = sorted(fs.text_line_rows(whole).select(*pick).collect())
    rows = fs.text_rows(spark, str(tmp_path), splits=splits)
    assert sorted(rows.select(*pick).collect()) == want
    assert len([r for r in want if r["name"] == "big.log"]) == 355


def test_only_edge_lines_of_text_travel(spark, tmp_path):
    write(tmp_path, "a.txt", "\n".join(f"line {i}" for i in range(5000)))
    rows = fs.text_rows(spark, str(tmp_path), splits=100)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("Union"):]
    assert "MapInArrow" in moved and "Window [lag" not in plan and "lead(" not in plan
    assert "_halo" in moved or "IN (" in moved  # the lines that are grouped are chosen before
    assert rows.count() == 5000


def test_byte_order_mark_at_every_size(spark, tmp_path, split_small):
    write(tmp_path, "s.txt", "\ufeffABCPD1234E\nnext")
    write(tmp_path, "l.txt", "\ufeffABCPD1234E\n" + "\n".join(f"line {i}" for i in range(400)))
    got = {r["file"][-5:]: r for r in fs.text_rows(spark, str(tmp_path), splits=1000).where("row = 1").collect()}
    assert got["s.txt"]["cells"][0]["text"] == got["l.txt"]["cells"][0]["text"] == "ABCPD1234E"
    assert got["s.txt"]["row_context"] == "ABCPD1234E next"


def test_json(spark, tmp_path):
    item = {"user": {"name": "A", "aadhaar": "2345 6789 0124", "l": [1, {"p": "x"}, [2, 3], None]}, "n": None, "b": True}
    write(tmp_path, "j.json", json.dumps([item, "ABCPD1234E"], indent=1))
    write(tmp_path, "k.json", '{"a": 1.0}')
    write(tmp_path, "s.json", "5")
    assert cells_of(fs.json_rows(spark, str(tmp_path))) == [
        (1, "user.name", "A"), (1, "user.aadhaar", "2345 6789 0124"), (1, "user.l[0]", "1"),
        (1, "user.l[1].p", "x"), (1, "user.l[2]", "[2, 3]"), (1, "b", "True"), (2, "item", "ABCPD1234E"),
        (1, "a", "1.0"),
    ]


def test_broken_json_is_reported(spark, tmp_path):
    write(tmp_path, "bad.json", "{oops")
    found = iv.scan_path(spark, str(tmp_path)).collect()
    assert [(r["row"], r["column"], r["entity_type"], r["confidence"]) for r in found] == [
        (1, "ERROR", "FILE_READ_ERROR", "LOW")]


def test_json_lines(spark, tmp_path):
    write(tmp_path, "l.jsonl", '{"a":{"b":"x"},"n":7}\n\nnot json ABCPD1234E\n[1, 2]\n')
    assert cells_of(fs.jsonl_rows(spark, str(tmp_path))) == [
        (1, "a.b", "x"), (1, "n", "7"), (3, "raw_line", "not json ABCPD1234E"), (4, "value", "[1, 2]")]


def test_parquet(spark, tmp_path):
    df = spark.range(5).select((F.col("id") * 2).alias("id"), F.lit("ABCPD1234E").alias("pan"))
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    assert cells_of(fs.parquet_rows(spark, str(tmp_path)))[:4] == [
        (1, "id", "0"), (1, "pan", "ABCPD1234E"), (2, "id", "2"), (2, "pan", "ABCPD1234E")]


def test_directory(spark, tmp_path):
    write(tmp_path, "a.csv", "pan\nABCPD1234E\n")
    write(tmp_path, "deep/er/b.txt", "ABCPD1234E\n")
    write(tmp_path, "skip.bin", "ABCPD1234E")
    found = iv.scan_path(spark, str(tmp_path))
    assert sorted(r["file"].split("/")[-1] for r in found.collect()) == ["a.csv", "b.txt"]
    only = write(tmp_path, "one/c.csv", "pan\nXYZCA5678F\n")
    assert [r["masked_value"] for r in iv.scan_path(spark, only).collect()] == ["XXXXX5678X"]
    cells = iv.scan_path(spark, str(tmp_path), options=iv.cell_mode())
    assert {r["file"].split("/")[-1] for r in cells.collect()} == {"a.csv", "b.txt", "c.csv"}


def test_nothing_to_read_and_missing_path(spark, tmp_path):
    write(tmp_path, "skip.bin", "ABCPD1234E")
    assert path_rows(spark, str(tmp_path)) is None
    assert iv.scan_path(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        iv.scan_path(spark, str(tmp_path / "nowhere"))


def test_records_are_not_shuffled_for_their_numbers(spark, tmp_path):
    write(tmp_path, "l.jsonl", '{"a": 1}\n')
    plan = fs.jsonl_rows(spark, str(tmp_path), splits=9)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_sheet_rows_of_candidates(spark):
    """The same findings with their context as from all rows; other rows are gone before cells are gathered."""
    cells = spark.range(6000).selectExpr(
        "concat('f', id % 3) as file", "if(id % 2 = 0, 's', null) as sheet", "int(id % 1000) as row", "int(id / 1000) + 1 as col_num",
        "case when id % 97 = 0 then 'ABCPD1234E' when id % 89 = 0 then null else concat('pan ', id) end as value", "'string' as value_type")
    pick = ("file", "sheet", "row", "cells", "row_context")
    whole = docs.sheet_rows(cells)
    for bitmaps in (1, docs.FILTER_BITMAPS):
        few = docs.sheet_rows(cells, only_candidates=True, bitmaps=bitmaps)
        assert few.select(*pick).exceptAll(whole.select(*pick)).count() == 0
        a, b = (sorted(map(tuple, scan_rows(x, dedup="cell").drop("position").collect()), key=str) for x in (whole, few))
        assert a == b and len(a) == 62
    assert few.count() < 0.05 * whole.count()
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("collect_list") < plan.index("bitmap_construct_agg") and "broadcast" in plan
    assert docs.sheet_rows(cells.where("false"), only_candidates=True).count() == 0


def test_sheet_cells(spark):
    rows = [("f", "S", 2, 28, "9876543210.0", "float"), ("f", "S", 2, 1, " pan ", "string"),
            ("f", "S", 2, 3, "true", "bool"), ("f", "S", 2, 4, "2024-01-01", "date"),
            ("f", "S", 2, 703, "1.5", "float"), ("f", "S", 3, 1, "  ", "string")]
    df = spark.createDataFrame(rows, "file string, sheet string, row int, col_num int, value string, value_type string")
    out = docs.sheet_rows(df)
    assert cells_of(out) == [(2, "A", "pan"), (2, "AB", "9876543210"), (2, "AAA", "1.5")]
    assert out.first()["row_context"] == "pan 9876543210 1.5"


def test_column_letters(evaluate):
    letters = evaluate(docs.column_letter, ["1", "26", "27", "52", "702", "703", "16384"])
    assert letters == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "XFD"]


def test_document_parts_and_pages(spark):
    parts = spark.createDataFrame(
        [("d", "paragraph", None, 1, None, "PAN ABCPD1234E"), ("d", "cell", 1, 2, 2, "27AAPFU0939F1ZV")],
        "file string, part string, table_no int, row int, col_num int, text string")
    found = iv.scan_rows(docs.part_rows(parts)).collect()
    assert sorted((r["sheet"], r["row"], r["column"], r["entity_type"]) for r in found if r["sheet"]) == [
        ("Table 1", 2, "B", "GSTIN")]
    assert [(r["row"], r["column"]) for r in found if not r["sheet"]] == [(1, "paragraph")]
    pages = spark.createDataFrame([("p", 10, "x\n\nABCPD1234E"), ("p", 2, "ABCPD1234E\x0by")],
                                  "file string, page int, text string")
    first = iv.scan_rows(docs.page_rows(pages)).collect()
    assert [(r["sheet"], r["row"], r["column"]) for r in first] == [("Page 2", 1, "line")]


def test_database(spark, tmp_path):
    spark.sql("create database if not exists hr")
    spark.createDataFrame([(1, "Asha", "ABCPD1234E"), (2, None, " ")], "id int, name string, pan string") \
        .write.mode("overwrite").option("path", str(tmp_path / "users")).saveAsTable("hr.users")
    spark.createDataFrame([(1, "ABCPD1234E"), (2, "XYZCA5678F")], "id int, pan string") \
        .write.mode("overwrite").option("path", str(tmp_path / "zz")).saveAsTable("hr.zz")
    assert list(catalog_tables(spark, "hr")) == ["users", "zz"]
    found = iv.scan_tables(spark, "hr", keys={"users": "id", "zz": "id"})
    assert sorted((r["file"], r["sheet"], r["row"], r["column"]) for r in found.collect()) == [
        ("hr", "users", 1, "pan"), ("hr", "zz", 2, "pan")]
    with pytest.raises(ValueError):
        iv.scan_tables(spark, "no_such_database")
    spark.sql("drop table hr.users")
    spark.sql("drop table hr.zz")
    spark.sql("drop database hr")


def test_rows_of_a_database_without_keys(spark, tmp_path, split_small):
    spark.sql("create database if not exists plain")
    made = spark.range(3000, numPartitions=5).select(F.concat(F.lit("ABCPD"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit("E")).alias("pan"), "id")
    made.write.mode("overwrite").option("path", str(tmp_path / "a")).saveAsTable("plain.a")
    made.limit(2).coalesce(1).write.mode("overwrite").format("csv").option("path", str(tmp_path / "b")).saveAsTable("plain.b")
    files = sorted(str(p) for p in (tmp_path / "a").glob("*.parquet"))
    assert len(files) == 5
    want = {r["pan"]: n for n, r in enumerate((r for f in files for r in spark.read.parquet(f).collect()), 1)}
    for bytes_, cores in (("1k", 3), ("1g", 200)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
        spark.conf.set("spark.sql.shuffle.partitions", cores)
        found = iv.scan_tables(spark, "plain", entities=["PAN"], masked=False).select("sheet", "row", "column")
        assert sorted(r["row"] for r in found.collect()) == list(range(1, 3001))
    rows = database_rows({"a": spark.table("plain.a")}, "plain", positions=True)
    got = {r["text"]: r["row"] for r in explode_cells(rows).where("ord = 0").collect()}
    assert got == want
    assert table_positions(spark.table("plain.b"), "n") is None and table_positions(spark.range(3).toDF("x"), "n") is None
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.sql("drop database plain cascade")


def test_cells_of_a_table_keep_their_order(spark):
    df = spark.createDataFrame([(7, " a ", None, "c")], "r int, z string, y string, x string")
    assert cells_of(table_rows(df, row="r")) == [(7, "z", "a"), (7, "x", "c")]
    tidy = spark.createDataFrame([("ABCPD1234E",)], "text string")
    assert [c[1:] for c in cells_of(cell_rows(tidy))] == [("text", "ABCPD1234E")]


def test_floats_read_as_python_prints_them(spark):
    values = [0.0, 1.0, 0.1, 123.45, 9876543210.0, 12345678.5, 1e15, 1e16, 1.5e17, 0.001, 0.0005, 1e-5, 1.25e-7, -9876543210.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "r int, v double")
    assert [c[2] for c in cells_of(table_rows(df, row="r"))] == [str(v) for v in values]


def test_views_are_not_scanned_as_tables(spark, tmp_path):
    spark.sql("create database if not exists of_views")
    spark.sql(f"create table of_views.t using parquet location '{tmp_path}/t' as select 'ABCPD1234E' as pan")
    spark.sql("create view of_views.a_view as select * from of_views.t")
    try:
        assert [r["sheet"] for r in iv.scan_tables(spark, "of_views").collect()] == ["t"]
    finally:
        spark.sql("drop database of_views cascade")


def test_cell_mode_reads_every_format(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ABCPD1234E\n")
    (tmp_path / "b.jsonl").write_text('{"p": "ABCPD1234E"}\n')
    (tmp_path / "c.csv").write_text("p\nABCPD1234E\n")
    (tmp_path / "d.1699999999").write_text("ABCPD1234E\n")
    found = iv.scan_path(spark, str(tmp_path), options=iv.cell_mode())
    assert {r["file"].rsplit("/")[-1] for r in found.collect()} == {"a.txt", "b.jsonl", "c.csv"}


def test_json_candidate_test_loses_nothing(spark):
    """Escapes, exponents, numbers, nesting: records with and without the test have the same findings."""
    texts = [
        r'{"a": "98765\n43210"}', r'{"a": "\u0039876543210"}', r'{"a": "98765\/43210"}', '{"a": 9.87654321e9}',
        '{"a": 9876543210}', '{"a": {"b": [1, {"c": "ABCPD 1234 E"}]}}', '{"a": [["ABCPD1234E"]]}', "raw ABCPD1234E",
        '{"a": "９８７６５４３２１０"}', '{"a": "plain"}', "[1, 2]", '"2345 6789 0124"', "not json", '{"a": 1, "a": "ABCPD1234E"}',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    found = []
    for only in (False, True):
        rows = fs.json_text_rows(df, "t", "f", "i", only)
        got = scan_rows(rows, dedup="cell").select("row", "column", "entity_type", "masked_value").collect()
        found.append(sorted(tuple(r) for r in got))
    assert found[0] == found[1] and len({r[0] for r in found[0]}) == 11
    plan = fs.json_text_rows(df, "t", "f", "i", True)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Filter")  # the test is below the parser


def test_json_errors_stay(spark, tmp_path):
    write(tmp_path, "a.json", "{broken")
    write(tmp_path, "b.json", '[{"pan": "ABCPD1234E"}, {"x": "plain"}]')
    write(tmp_path, "c.json", '{"x": "plain"}')
    write(tmp_path, "d.jsonl", '{"x": "plain"}\n{broken PAN XYZCA5678F\n')
    found = iv.scan_path(spark, str(tmp_path)).collect()
    assert sorted((os.path.basename(r["file"]), r["row"], r["column"], r["entity_type"]) for r in found) == [
        ("a.json", 1, "ERROR", "FILE_READ_ERROR"), ("b.json", 1, "pan", "PAN"), ("d.jsonl", 2, "raw_line", "PAN")]


def test_parquet_files_of_any_schema(spark, tmp_path):
    """Types that cannot be merged, other columns, other orders, an empty file and a path with odd characters."""
    parts = {
        "a/ids.parquet": spark.createDataFrame([(1, "ABCPD1234E")], "id int, pan string"),
        "b/ids.parquet": spark.createDataFrame([("9876543210", 7)], "id string, pan int"),
        "c [1]/x y.PARQUET": spark.createDataFrame([(["XYZCA5678F"],)], "id array<string>"),
        "c [1]/empty.parquet": spark.createDataFrame([], "id binary"),
    }
    for name, df in parts.items():
        folder = tmp_path / "made" / name
        df.coalesce(1).write.parquet(str(folder))
        (one,) = folder.glob("part-*.parquet")
        target = tmp_path / "in" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(one.read_bytes())
    found = iv.scan_path(spark, str(tmp_path / "in")).collect()
    assert sorted((r["file"][-9:], r["row"], r["column"], r["entity_type"]) for r in found) == [
        ("s.parquet", 1, "id", "IN_MOBILE"), ("s.parquet", 1, "pan", "PAN"), ("y.PARQUET", 1, "id", "PAN")]


def test_unreadable_parquet_is_one_finding_and_the_rest_is_read(spark, tmp_path):
    good = spark.createDataFrame([(i, f"ABCPD{i:04d}E") for i in range(20)], "id int, pan string")
    good.repartition(2).write.parquet(str(tmp_path / "t"))
    whole = next((tmp_path / "t").glob("part-*.parquet")).read_bytes()
    write(tmp_path, "broken.parquet", "no parquet at all, PAN ABCPD9999E")
    (tmp_path / "cut.parquet").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "zero.parquet").write_bytes(b"")
    spark.createDataFrame([], "id int, pan string").coalesce(1).write.parquet(str(tmp_path / "none"))
    found = iv.scan_path(spark, str(tmp_path)).collect()
    errors = sorted(os.path.basename(r["file"]) for r in found if r["entity_type"] == "FILE_READ_ERROR")
    # Spark itself passes over files without a byte.
    assert [e for e in errors if e != "zero.parquet"] == ["broken.parquet", "cut.parquet"]
    assert sum(r["entity_type"] == "PAN" for r in found) == 20
