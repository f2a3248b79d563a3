"""WARC derivatives: metadata and plain-text conversion records, linked to the responses they come from.

Records are rows with the named header fields as columns, so that they are filtered, joined and written like any
table. Derived identifiers are a function of the source record's identifier and the kind: a task that runs again makes
the same ones, and links hold without a join.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from idveil.llm.common import let, table

#: Date of records whose source has none.
NO_DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"

# Elements that end a line of text.
BLOCKS = (
    "address article aside blockquote br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol option p pre section select table tbody td tfoot th thead title tr ul"
).split()
# Header fields in the order in which they are written.
FIELDS = (
    ("WARC-Type", "warc_type"),
    ("WARC-Record-ID", "record_id"),
    ("WARC-Date", "warc_date"),
    ("WARC-Target-URI", "target_uri"),
    ("WARC-Refers-To", "refers_to"),
    ("WARC-Refers-To-Target-URI", "refers_to_uri"),
    ("WARC-Refers-To-Date", "refers_to_date"),
    ("WARC-Concurrent-To", "concurrent_to"),
    ("WARC-Payload-Digest", "payload_digest"),
    ("WARC-Block-Digest", "block_digest"),
    ("Content-Type", "content_type"),
    ("Content-Length", "content_length"),
)


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def _identifier(*parts: Column | str) -> Column:
    """A urn:uuid made from a digest of the parts."""
    code = F.sha2(F.concat_ws("\n", *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)
    places = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(code, a, n) for a, n in places]), F.lit(">"))


def responses(
    pages: DataFrame,
    url_col: str = "url",
    body_col: str = "html",
    key_cols: tuple[str, ...] = ("page_id",),
    date: str = NO_DATE,
) -> DataFrame:
    """Response records of a table of fetched pages; the key columns stay. A null body is an empty one."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
    rows = pages.select(*key_cols, F.col(url_col).alias("target_uri"), body.alias("body"))
    return rows.select(
        *key_cols,
        F.lit("response").alias("warc_type"),
        _identifier("response", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key_cols],
                    F.coalesce("target_uri", F.lit("")), F.sha2("body", 256)).alias("record_id"),
        F.lit(date).alias("warc_date"),
        "target_uri",
        F.lit("application/http; msgtype=response").alias("content_type"),
        _digest(F.col("body")).alias("payload_digest"),
        F.concat(F.lit(head), "body").alias("block"),
    )


def _parts(block: Column) -> tuple[Column, Column]:
    """HTTP head and body of a response block; a block without a blank line is all body."""
    at = F.instr(block, F.lit(CRLF + CRLF))
    return (
        F.when(at > 0, F.substring(block, F.lit(1), at - 1)).otherwise(""),
        F.when(at > 0, F.substring(block, at + 4, F.length(block))).otherwise(block),
    )


def _markup_free(body: Column) -> Column:
    """Text of HTML with entities still in it: no comments, scripts, styles or tags; block elements end lines."""
    text = F.regexp_replace(body, r"(?s)<!--.*?(-->|\z)", "")
    text = F.regexp_replace(text, r"(?is)<(script|style|template|noscript)\b[^>]*>.*?(</\1\s*>|\z)", "")
    text = F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")
    text = F.regexp_replace(text, rf"(?i)</?({'|'.join(BLOCKS)})(?=[\s/>])[^>]*>", "\n")
    return F.regexp_replace(text, r"<[/!?A-Za-z][^>]*>", "")


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    """Entities as characters; only texts that hold an ampersand take the time."""
    return texts.map(lambda t: html.unescape(t) if t and "&" in t else t)


def _tidy(text: Column) -> Column:
    """No white space at the ends of lines, no empty lines; one line feed at the end of a text that has any."""
    text = F.regexp_replace(text, r"[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*", "\n")
    return F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")


def derive(records: DataFrame, key_cols: tuple[str, ...] = ()) -> DataFrame:
    """Two rows per response record: its metadata record and its conversion record (other record types give none).

    Both refer to the response by its identifier, URI and date, name each other as concurrent, and carry the response's
    payload digest; a response without one gets that of its body. The metadata block holds the source's HTTP
    header fields, its block's digest and length, the title, and the outlinks in order. The conversion block is the text of
    the page. Nulls: a null block is an empty one, a null date is NO_DATE, a null URI leaves its fields out, a
    null identifier leaves refers-to null. Repeated responses give repeated records under the same identifiers. An empty
    table gives none; whole bodies are read, however long; other columns, whatever their names, are ignored. NUL and
    U+0001 have no place in text and are left out of title, links and conversion (digests are of the source as it is).
    """
    rows = records.where("warc_type = 'response'").withColumn("__block", F.coalesce("block", F.lit("")))
    head, body = _parts(F.col("__block"))
    rows = rows.select(
        *[F.col(k).alias(k) for k in key_cols],
        F.col("record_id").alias("__source"),
        F.col("target_uri").alias("__uri"),
        F.coalesce("warc_date", F.lit(NO_DATE)).alias("__date"),
        F.col("payload_digest").alias("__payload"),
        _digest(F.col("__block")).alias("__digest"),
        F.octet_length("__block").alias("__length"),
        head.alias("__head"),
        body.alias("__body"),
    )
    seen = F.translate("__body", "\0\x01", "")  # the marks that part texts below; no entity yields one
    rows = rows.withColumn("__seen", seen)
    title = F.regexp_extract("__seen", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    links = F.regexp_extract_all("__seen", F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    fields = let(F.split("__head", CRLF), lambda x: F.slice(x, 2, F.size(x)))
    rows = rows.select(
        *key_cols, "__source", "__uri", "__date", "__digest", "__length", fields.alias("__fields"),
        F.coalesce("__payload", _digest(F.col("__body"))).alias("__payload"),
        # Entities in all three texts become characters in one call, so each page crosses to Python once.
        _unescaped(F.concat_ws("\0", F.regexp_replace(title, r"\s+", " "), F.array_join(links, "\x01"),
                               _markup_free(F.col("__seen")))).alias("__texts"),
    )
    texts = F.split("__texts", "\0", 3)
    rows = rows.withColumn("__title", F.trim(F.get(texts, F.lit(0)))).withColumn("__links", F.get(texts, F.lit(1)))
    rows = rows.withColumn("__plain", _tidy(F.get(texts, F.lit(2))))
    line = lambda name, value: F.when(value != "", F.concat(F.lit(f"{name}: "), value))
    outlinks = F.transform(F.array_remove(F.split("__links", "\x01"), ""), lambda u: F.concat(F.lit("outlink: "), u))
    about = F.array_join(
        F.concat(
            F.transform("__fields", lambda f: F.concat(F.lit("source-"), f)),
            F.array_compact(F.array(
                line("source-block-digest", F.col("__digest")),
                line("source-block-length", F.col("__length").cast("string")),
                line("title", F.regexp_replace("__title", r"[\r\n]+", " ")),
            )),
            outlinks,
        ),
        CRLF,
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("type"), about.alias("block")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("type"), F.col("__plain").alias("block")),
    )
    rows = rows.select(*key_cols, "__source", "__uri", "__date", "__payload", F.explode(made).alias("m"))
    own = _identifier(F.col("m.kind"), F.col("__source"))
    other = F.when(F.col("m.kind") == "metadata", "conversion").otherwise("metadata")
    return rows.select(
        *key_cols,
        F.col("m.kind").alias("warc_type"),
        own.alias("record_id"),
        F.col("__date").alias("warc_date"),
        F.col("__uri").alias("target_uri"),
        F.col("__source").alias("refers_to"),
        F.col("__uri").alias("refers_to_uri"),
        F.col("__date").alias("refers_to_date"),
        _identifier(other, F.col("__source")).alias("concurrent_to"),
        F.col("__payload").alias("payload_digest"),
        _digest(F.col("m.block")).alias("block_digest"),
        F.col("m.type").alias("content_type"),
        F.octet_length("m.block").cast("long").alias("content_length"),
        F.col("m.block").alias("block"),
    )


def record_text(records: DataFrame) -> DataFrame:
    """text: each record as it stands in a file, without the two line ends that part records."""
    have = set(records.columns)
    head = [
        F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit(CRLF))).otherwise("")
        for name, c in FIELDS
        if c in have
    ]
    return records.select(F.concat(F.lit(f"WARC/1.1{CRLF}"), *head, F.lit(CRLF), "block").alias("text"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Files of records, one per partition; two line ends part records, as the format asks."""
    record_text(records).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of such files: the columns of FIELDS (strings, content_length long; null where missing), block, complete.

    complete is false where a block holds the mark that begins a record, so that its length is not the stated one. The
    values of a repeated field are joined by ", "; field names are read in either case. Empty files have no records.
    """
    mark = f"WARC/1.1{CRLF}"
    rows = spark.read.option("lineSep", mark).text(path).where(F.trim("value") != "")
    at = F.instr("value", F.lit(CRLF + CRLF))
    head = F.substring("value", F.lit(1), at - 1)
    fields = F.split(head, CRLF)
    block = F.substring(F.col("value"), at + 4, F.length("value"))
    rows = rows.select(fields.alias("f"), F.regexp_replace(block, f"{CRLF}{CRLF}\\z", "").alias("block"))

    def values(name: str) -> Column:
        own = F.filter("f", lambda x: F.lower(F.substring_index(x, ":", 1)) == name.lower())
        return F.when(F.size(own) > 0, F.array_join(F.transform(own, lambda x: F.trim(F.substr(x, F.lit(len(name) + 2)))), ", "))

    rows = rows.select(*[values(name).alias(c) for name, c in FIELDS], "block")
    rows = rows.withColumn("content_length", F.col("content_length").try_cast("long"))
    return rows.withColumn("complete", F.octet_length("block") == F.col("content_length"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages")), ("page_id",))
