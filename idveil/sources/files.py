"""File sources: CSV, TSV, text, JSON, JSON lines and Parquet as rows of cells."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idveil.constants import TEXT_SUFFIXES
from idveil.functions.columns import strip
from idveil.functions.text import may_hold_identifier
from idveil.sources.delimited import delimited_records
from idveil.sources.json_cells import document_rows, line_rows
from idveil.sources.numbering import MAX_BROADCAST_SPLITS, numbered, split_offsets, tagged
from idveil.sources.parquet_files import parquet_frames
from idveil.sources.tables import UNNAMED, cell, error_cells, present, row_context, table_rows

_BOM = "^\\ufeff"


# --- listing -----------------------------------------------------------------------
@dataclass(frozen=True)
class Listing:
    """What lies under a path: suffixes, bytes, and how many splits they make at most."""

    path: str
    splits: dict[str, int] = field(default_factory=dict)

    def has(self, *suffixes: str) -> bool:
        return any(s in self.splits for s in suffixes)

    def bound(self, *suffixes: str) -> int:
        return sum(self.splits.get(s, 0) for s in suffixes)


def list_path(spark: SparkSession, path: str) -> Listing:
    """Count files and splits per suffix. Only file status is read, no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        found = files.load(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"path does not exist: {path}") from missing
        raise
    size = F.expr(f"{_split_bytes(spark)}L")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix")
    known = {*TEXT_SUFFIXES, "csv", "tsv", "json", "jsonl", "parquet"}
    counts = found.select("length", suffix).where(F.col("suffix").isin(*known)).groupBy("suffix").agg(F.sum(F.floor(F.col("length") / size) + 1).alias("n"))
    spare = spark.sparkContext.defaultParallelism
    return Listing(path, {r["suffix"]: int(r["n"]) + spare for r in counts.collect()})


def _split_bytes(spark: SparkSession) -> int:
    text = spark.conf.get("spark.sql.files.maxPartitionBytes")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    number = text.lower().rstrip("b")
    unit = units.get(number[-1], 1)
    return max(1, int(number.rstrip("kmg")) * unit)


def _any_case(suffix: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def _reader(spark: SparkSession, *suffixes: str):
    """A recursive reader for the given suffixes, whatever their case."""
    globs = ",".join(_any_case(s) for s in suffixes)
    glob = f"*.{{{globs}}}" if len(suffixes) > 1 else f"*.{globs}"
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)


def plain_path(path: Column) -> Column:
    """Local files by their plain path; other file systems by their address."""
    return F.regexp_replace(path, "^file:/+", "/")


def plain_text(path: str) -> str:
    """The same for a path that is known now."""
    return re.sub("^file:/+", "/", path)


def _row(file: Column, row: Column, cells: Column, context: Column) -> list[Column]:
    return [
        plain_path(file).alias("file"),
        F.lit(None).cast("string").alias("sheet"),
        F.lit(0).alias("sheet_ord"),
        row.cast("bigint").alias("row"),
        cells.alias("cells"),
        context.alias("row_context"),
    ]


def lines_of(spark: SparkSession, path: str, *suffixes: str, whole: bool = False) -> DataFrame:
    """Lines (*whole*: texts) of the files with these suffixes: value, _file, _block, _id (increasing in a split)."""
    return tagged(_reader(spark, *suffixes).text(path, wholetext=whole))


# --- delimited files ---------------------------------------------------------------
def _unmarked(lines: DataFrame) -> DataFrame:
    """A mark at the start of a file is no part of its first name."""
    return lines.withColumn("value", F.when(F.col("_block") == 0, F.regexp_replace("value", _BOM, "")).otherwise(F.col("value")))


def delimited_files(spark: SparkSession, path: str, suffix: str, separator: str, splits: int | None = None) -> DataFrame:
    """All records of delimited files, heads included: _file, _block (where the record begins), _row, fields."""
    return delimited_records(_unmarked(lines_of(spark, path, suffix)), separator, False, splits)[0]


def _delimited(
    spark: SparkSession, path: str, suffix: str, separator: str, blank_counts: bool, splits: int | None
) -> DataFrame:
    """Records after the head of each file: _file, _row, fields, head."""
    records, heads = delimited_records(_unmarked(lines_of(spark, path, suffix)), separator, blank_counts, splits)
    first = records.groupBy("_file").agg(F.min("_row").alias("_head_row")) if blank_counts else None
    joined = records.join(heads, "_file", "left").withColumn("head", F.coalesce("head", F.array().cast("array<string>")))
    if first is None:
        return joined.where(F.col("_row") > 1)
    return joined.join(first, "_file").where(F.col("_row") > F.col("_head_row"))


def csv_rows(spark: SparkSession, path: str, splits: int | None = None) -> DataFrame:
    """CSV files, each with its own header; the first record after it is row 2. Empty lines are no rows.

    Files with different headers may lie in one directory: records are named by the first record of their own file,
    whatever their width. Fields may hold line breaks (read as line feeds). A record with more fields than its header
    is reported as a ``FILE_READ_ERROR``; all its fields and the records after it are still read.
    """
    rows = _delimited(spark, path, "csv", ",", False, splits)
    size = F.size("head")
    cells = F.transform(
        "fields",
        lambda v, i: cell(i, F.coalesce(F.nullif(F.get("head", i), F.lit("")), F.lit(UNNAMED)), strip(v)),
    )
    error = error_cells("CorruptRecord: more fields than the header names")
    filled = F.filter(F.transform("fields", strip), lambda v: v != "")
    return rows.select(
        *_row(
            F.col("_file"),
            F.col("_row"),
            F.when(F.size("fields") > size, F.concat(present(cells), error)).otherwise(present(cells)),
            F.array_join(filled, " "),
        )
    )


def tsv_rows(spark: SparkSession, path: str, splits: int | None = None) -> DataFrame:
    """Tab-separated files: the header is a row, empty lines count, extra cells are ``col_i``.

    Fields in quotes may hold tabs and line breaks (read as line feeds).
    """
    rows = _delimited(spark, path, "tsv", "\t", True, splits)
    cells = F.transform(
        "fields",
        lambda v, i: cell(i, F.coalesce(strip(F.get("head", i)), F.concat(F.lit("col_"), (i + 1).cast("string"))), strip(v)),
    )
    context = F.array_join(F.filter("fields", lambda v: v != ""), " ")
    return rows.select(*_row(F.col("_file"), F.col("_row"), present(cells), context))


# --- text --------------------------------------------------------------------------
def _text_row(file: Column, row: Column, text: Column, context: Column) -> list[Column]:
    return _row(file, row, F.array(cell(F.lit(0), "text", strip(text))), context)


def _near(before: Column, line: Column, after: Column) -> Column:
    parts = [F.coalesce(strip(x), F.lit("")) for x in (before, line, after)]
    return strip(F.concat_ws(" ", *parts))


def text_line_rows(documents: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Lines of documents held in a column; context is the line before and after."""
    lines = documents.select(
        F.col(file).cast("string").alias("_file"),
        F.split(F.col(text), "\r\n|\r|\n").alias("_lines"),
    )
    # Neighbours are picked while exploding, so the array itself is not copied per line.
    trios = F.transform(
        F.col("_lines"),
        lambda line, i: F.struct(
            line.alias("line"), _near_lines(F.col("_lines"), line, i).alias("near")
        ),
    )
    exploded = lines.select("_file", F.posexplode_outer(trios).alias("_at", "_t")).where(
        strip("_t.line") != ""
    )
    return exploded.select(
        *_text_row(F.col("_file"), F.col("_at") + 1, F.col("_t.line"), F.col("_t.near"))
    )


def _near_lines(lines: Column, line: Column, i: Column) -> Column:
    return _near(F.when(i > 0, F.get(lines, i - 1)), line, F.get(lines, i + 1))


def _inner_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with the lines before and after them, but for the first and last line of a split.

    The lines of a split come in order, so the neighbours of all others are next to them; two lines are carried over
    from batch to batch.
    """
    carried: pa.Table | None = None
    for batch in batches:
        lines = pa.Table.from_batches([batch])
        if carried is not None:
            lines = pa.concat_tables([carried, lines])
        lines = lines.combine_chunks()
        n = lines.num_rows
        if n > 2:
            value = lines["value"]
            middle = lines.slice(1, n - 2).select(["_file", "_row", "value", "_edge"])
            near = middle.append_column("_before", value.slice(0, n - 2)).append_column("_after", value.slice(2))
            yield from near.filter(pc.invert(near["_edge"])).drop_columns(["_edge"]).to_batches()
        carried = lines.slice(max(0, n - 2))


def text_rows(spark: SparkSession, path: str, splits: int | None = None) -> DataFrame:
    """Text files line by line, with the line before and after as context, whatever their size.

    Lines are numbered exactly and stay where they are read: within a split, neighbours follow each other. Only the
    two first and two last lines of each split travel to meet the lines of the next one. A byte order mark at
    the beginning of a file is no part of its first line.
    """
    lines = tagged(_reader(spark, *TEXT_SUFFIXES).text(path))
    rows = numbered(lines, split_offsets(lines), splits)
    begin, end = F.col("_before") + 1, F.col("_before") + F.col("_n")
    rows = rows.withColumns({"_edge": F.col("_row").isin(begin, end), "_halo": F.col("_row").isin(begin, begin + 1, end - 1, end)})

    ordered = rows.select("_file", "_block", "_row", "value", "_edge")
    if splits is None or splits > MAX_BROADCAST_SPLITS:  # the join may have moved lines
        ordered = ordered.repartition("_file", "_block").sortWithinPartitions("_file", "_block", "_row")
    inner = ordered.drop("_block").mapInArrow(
        _inner_lines, "_file string, _row long, value string, _before string, _after string"
    )

    nothing = F.lit(None).cast("string")
    def lent(distance: int, name: str) -> Column:
        texts = [(F.col("value") if c == name else nothing).alias(c) for c in ("value", "_before", "_after")]
        return F.struct((F.col("_row") + distance).alias("_row"), *texts, (F.col("_edge") & (name == "value")).alias("_edge"))

    halo = rows.where("_halo").select("_file", F.inline(F.array(lent(0, "value"), lent(1, "_before"), lent(-1, "_after"))))
    edges = (
        halo.groupBy("_file", "_row")
        .agg(F.max("value").alias("value"), F.max("_before").alias("_before"), F.max("_after").alias("_after"), F.bool_or("_edge").alias("_edge"))
        .where("_edge")
        .drop("_edge")
    )
    near = inner.unionByName(edges).where(strip("value") != "")
    return near.select(
        *_text_row(F.col("_file"), F.col("_row"), F.col("value"), _near(F.col("_before"), F.col("value"), F.col("_after")))
    )


# --- JSON --------------------------------------------------------------------------
def _json_rows(flat: DataFrame) -> list[Column]:
    cells = F.transform(
        F.col("_r")["cells"], lambda x, i: cell(i, x["column"], strip(x["text"]))
    )
    error = F.when(F.col("_r").isNull(), error_cells("JSONDecodeError: not a JSON document"))
    return _row(
        F.col("_file"),
        F.coalesce(F.col("_row"), F.lit(1)),
        error.otherwise(present(cells)),
        F.coalesce(F.col("_r")["context"], F.lit("")),
    )


def may_hold_in_json(text: Column) -> Column:
    """Test on JSON text that none fails whose values may hold an identifier.

    A value stands in the text as it is, but for escapes (any backslash counts) and numbers with an exponent.
    """
    return text.contains("\\") | text.rlike(r"[0-9][eE][+\-]?[0-9]") | may_hold_identifier(text)


def json_text_rows(
    df: DataFrame, text: Column | str, file: Column | str, row: Column | str, only_candidates: bool = False
) -> DataFrame:
    """Rows from a column with one JSON value per record.

    ``only_candidates`` leaves out records that cannot yield a finding, before they are parsed.
    """
    source = df.select(
        (F.lit(file) if isinstance(file, str) else file).alias("_file"),
        (F.col(row) if isinstance(row, str) else row).alias("_row"),
        strip(text).alias("_text"),
    ).where(F.col("_text") != "")
    if only_candidates:
        source = source.where(may_hold_in_json(F.col("_text")))
    flat = source.select("_file", "_row", line_rows()(F.col("_text")).alias("_r"))
    return flat.select(*_json_rows(flat))


def jsonl_rows(
    spark: SparkSession, path: str, splits: int | None = None, only_candidates: bool = False
) -> DataFrame:
    """JSON lines: row number is the line number; a line that does not parse is ``raw_line``."""
    records = tagged(_reader(spark, "jsonl").text(path))
    rows = numbered(records, split_offsets(records), splits)
    return json_text_rows(rows, F.col("value"), F.col("_file"), F.col("_row"), only_candidates)


def json_rows(spark: SparkSession, path: str, only_candidates: bool = False) -> DataFrame:
    """JSON documents: a row per item of a list, or one row for an object.

    A document is one value and is parsed by one task; large data belongs in JSON lines.
    A document that does not parse becomes a ``FILE_READ_ERROR``. ``only_candidates`` leaves out, before they go to a
    Python worker, documents that cannot yield a finding and that Spark's own parser accepts, so that all errors stay.
    """
    whole = _reader(spark, "json").text(path, wholetext=True)
    if only_candidates:
        whole = whole.where(may_hold_in_json(F.col("value")) | F.try_parse_json("value").isNull())
    parsed = whole.select(
        F.col("_metadata.file_path").alias("_file"), document_rows()(F.col("value")).alias("_d")
    )
    broken = F.col("_d").isNull()
    flat = parsed.select(
        "_file", broken.alias("_broken"), F.explode_outer("_d").alias("_r")
    ).where(F.col("_broken") | F.col("_r").isNotNull())
    flat = flat.select("_file", F.col("_r.row").alias("_row"), "_r")
    return flat.select(*_json_rows(flat))


# --- Parquet -----------------------------------------------------------------------
def parquet_rows(
    spark: SparkSession, path: str, only_candidates: bool = False
) -> DataFrame:
    """Parquet files, whatever their schemas; row is the position in the file.

    A file that cannot be read is a ``FILE_READ_ERROR``; all others are read.
    """
    frames, failed = parquet_frames(spark, path)
    parts = []
    for df in frames:
        placed = df.select(
            "*",
            plain_path(F.col("_metadata.file_path")).alias("_file"),
            (F.col("_metadata.row_index") + 1).alias("_at"),
        )
        rows = table_rows(placed, F.col("_file"), None, F.col("_at"), df.columns, only_candidates=only_candidates)
        parts.append(rows.withColumn("row_context", row_context()))
    if failed is not None:
        message = error_cells("ParquetError: the file cannot be read")
        parts.append(failed.select(*_row(F.col("address"), F.lit(1), message, F.lit(""))))
    return reduce(lambda a, b: a.unionByName(b), parts)
