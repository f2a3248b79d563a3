import re

import duckdb
import pytest
from pyspark.sql import functions as F

from idveil.llm import line_dedup
from idveil.llm.line_dedup import drop_boilerplate, hashed_lines, spread_lines


def brute(rows, min_sites):
    even = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ")
    sites = {}
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if even(line) and site is not None:
                sites.setdefault(even(line), set()).add(site)
    spread = {x for x, s in sites.items() if len(s) >= min_sites}
    out = []
    for doc_id, text, _ in rows:
        lines = text.split("\n") if text is not None else []
        stay = [x for x in lines if even(x) not in spread]
        gone = len(lines) - len(stay)
        out.append((doc_id, "\n".join(stay) if gone else text, len(lines), gone))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_against_brute_force(spark, monkeypatch, broadcast):
    """Short pages that are boilerplate for the most part, repeated and null ids, and nothing of them kept back."""
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST_DOCS", broadcast)
    rows = [(i, f"own line {i}\n  Cookie   notice \n\n{'long own text ' * 4}{i}", f"s{i % 7}") for i in range(60)]
    rows += [(100 + i, "Cookie notice", f"t{i}") for i in range(5)] + [(200, "rare\nrare two and more", None), (201, None, "a")]
    rows += [(202, "a\rb\n \n", "a"), (203, "", "b"), (None, "Cookie notice\nx", "c"), (None, "y", "d"), (5, "y", "e"), (5, "y", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'c' AS hash", "1 AS line")
    for min_sites in (3, 12, 13, 14) if broadcast else (3,):
        got = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in drop_boilerplate(df, min_sites).collect()]
        assert sorted(got, key=repr) == brute(rows, min_sites), min_sites


def test_clashing_names_and_empty(spark, awkward, empty):
    names = ["row", "doc", "gone", "stays", "__id", "__gone", "site", "hashes", "N_Lines", "a.b"]
    for name in names:
        awkward, empty = (df.withColumn(name, F.lit("clash")) for df in (awkward, empty))
    got = drop_boilerplate(awkward)
    assert got.columns == [*awkward.columns, "n_lines_", "n_removed"]
    assert got.count() == awkward.count() and got.where("`N_Lines` = 'clash' AND `a.b` = 'clash'").count() == got.count()
    assert drop_boilerplate(empty).columns == [*empty.columns, "n_lines_", "n_removed"]
    assert drop_boilerplate(empty).count() == 0


def test_near_threshold_is_exact(spark):
    """Sketches of 16 registers are far off; the lines near the threshold are still decided exactly."""
    rows = [(n * 1000 + i, f"line {n}", f"site {i}") for n in range(60, 100) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert spread_lines(hashed_lines(df), 80, lg_k=4).count() == 20


def test_query_marks_what_is_mostly_boilerplate(spark, tmp_path):
    """More than half of the characters, spaces at the ends of lines apart; marked documents are cleaned all the same."""
    texts = {
        100: ("Share\nFOUR5", False),  # half of it
        101: ("Share\nown4", True),
        102: ("  Share   \n\n \n   own4 ", True),
        103: ("Share", True),
        104: ("Share\nShare\nnine char", True),
        105: ("Share\nñandú😀", False),  # six characters, more bytes
        106: ("own text\nand no more", False),
        107: ("", False),
        108: (None, False),
    }
    rows = [(i, f"Share\nown text of document {i}", f"s{i}") for i in range(10)]
    rows += [(i, text, None if i % 2 else "s1") for i, (text, _) in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    result = line_dedup.op8_line_dedup(spark, str(tmp_path))
    assert result.columns == ["doc_id", "text", "n_lines", "n_removed", "mostly_boilerplate"]
    got = sorted((tuple(r) for r in result.collect()), key=repr)
    assert [r[:4] for r in got] == brute(rows, 10)
    assert {r[0]: r[4] for r in got if r[0] >= 100} == {i: most for i, (_, most) in texts.items()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(line_dedup.OP8_SQL).fetchall(), key=repr)


def test_mark_is_added_where_asked_for(spark, awkward, empty):
    clash = awkward.withColumn("mostly_boilerplate", F.lit("clash"))
    got = drop_boilerplate(clash, min_sites=1, marked=True)
    assert got.columns == [*clash.columns, "n_lines", "n_removed", "mostly_boilerplate_"]
    assert got.where("mostly_boilerplate = 'clash'").count() == clash.count()
    # Every line with words is on a site: the rows with words and without a site have the words of another row.
    with_words = awkward.where("trim(translate(text, '\t\n', '  ')) <> ''").count()
    assert got.where("mostly_boilerplate_").count() == got.where("n_removed > 0").count() == with_words
    assert drop_boilerplate(empty, marked=True).where("NOT mostly_boilerplate").count() == 0
