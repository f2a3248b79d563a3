import hashlib
from html.parser import HTMLParser

import pytest

from idveil.llm import warc


class Text(HTMLParser):
    """An independent conversion: block elements end lines, scripts and styles have no text."""

    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "template", "noscript")
        self.out.append("\n" if tag in warc.BLOCKS else "")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "template", "noscript")
        self.out.append("\n" if tag in warc.BLOCKS else "")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data.replace("\n", " "))


def plain(page):
    parser = Text()
    parser.feed(page)
    parser.close()
    lines = [" ".join(x.split()) for x in "".join(parser.out).split("\n")]
    return "\n".join(x for x in lines if x)


def test_links_digests_and_text(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r["page_id"]: r for r in warc.responses(pages).collect()}
    made = warc.derive(warc.responses(pages), ("page_id",))
    rows = made.collect()
    assert len(rows) == 2 * len(source)
    assert len({r["record_id"] for r in rows}) == len(rows)
    other = {(r["page_id"], r["warc_type"]): r for r in rows}
    bodies = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in rows:
        s = source[r["page_id"]]
        assert r["refers_to"] == s["record_id"] and r["target_uri"] == s["target_uri"] == r["refers_to_uri"]
        assert r["payload_digest"] == s["payload_digest"] == "sha256:" + hashlib.sha256(bodies[r["page_id"]].encode()).hexdigest()
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
        assert r["content_length"] == len(r["block"].encode())
        twin = "conversion" if r["warc_type"] == "metadata" else "metadata"
        assert r["concurrent_to"] == other[r["page_id"], twin]["record_id"]
        if r["warc_type"] == "conversion":
            assert [" ".join(x.split()) for x in r["block"].split("\n")] == plain(bodies[r["page_id"]]).split("\n")
        else:
            assert "source-Content-Type: text/html; charset=utf-8" in r["block"]
            assert f"source-block-length: {len(s['block'].encode())}" in r["block"]
    warc.write_warc(made, str(tmp_path / "w"))
    back = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    for r in rows:
        assert back[r["record_id"]]["complete"]
        for c in ("block", "refers_to", "block_digest", "payload_digest", "warc_type", "content_length", "target_uri"):
            assert back[r["record_id"]][c] == r[c]


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("no markup &amp; 1 < 2", "no markup & 1 < 2"),
        ("<p>a<!-- <p>x --><br>b<script>if (a<b) '</p>'</script>c", "a\nbc"),
        ("<style>p{}</style><P CLASS=x>caf&eacute; &#8364;&#x20AC;</P>tail", "café €€\ntail"),
        ("<script>never closed", ""),
        ("<a href='u&amp;v'>x</a> &lt;p&gt;", "x <p>"),
    ],
)
def test_odd_pages(spark, page, text):
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    rows = {r["warc_type"]: r for r in warc.derive(warc.responses(df), ("page_id",)).collect()}
    assert rows["conversion"]["block"] == text


def test_other_records_nulls_and_empty(spark):
    schema = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, block string, title int"
    rows = [("<a>", "request", "u", None, None, "x", 1), (None, "response", None, None, None, None, 2), ("<b>", "response", "u", "d", "sha1:X", "H\r\n\r\n<p>y", 3)]
    df = spark.createDataFrame(rows, schema)
    made = warc.derive(df).collect()
    assert len(made) == 4
    kept = [r for r in made if r["refers_to"] == "<b>"]
    assert {r["payload_digest"] for r in kept} == {"sha1:X"} and {r["refers_to_date"] for r in kept} == {"d"}
    assert warc.derive(df.where("false")).count() == 0


def test_control_characters_stay_out_of_texts(spark):
    page = "<title>a\0b</title><a href='u\x01v'>x\0y</a>&#0;&#1;z"
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    rows = {r["warc_type"]: r["block"] for r in warc.derive(warc.responses(df), ("page_id",)).collect()}
    assert rows["conversion"] == "ab\nxy\ufffdz"
    assert "title: ab\r\noutlink: uv" in rows["metadata"]


def test_repeated_and_odd_header_fields(spark, tmp_path):
    text = ("WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Concurrent-To: <a>\r\nwarc-concurrent-to: <b>\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
            "WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: many\r\nno colon\r\n\r\ny\r\n\r\n")
    (tmp_path / "f.warc").write_text(text, newline="")
    got = {r["block"]: r for r in warc.read_warc(spark, str(tmp_path / "f.warc")).collect()}
    assert got["x"]["concurrent_to"] == "<a>, <b>" and got["x"]["complete"] and got["x"]["record_id"] is None
    assert got["y"]["content_length"] is None and not got["y"]["complete"]
    (tmp_path / "empty.warc").write_text("")
    assert warc.read_warc(spark, str(tmp_path / "empty.warc")).count() == 0
