"""Extracted content of sheets, word-processor documents and paged documents.

Decoding the binary files is left to whatever extracts them; these sources start from
tables of the extracted cells, parts and pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idveil.functions.columns import as_col, strip
from idveil.functions.text import may_hold_identifier
from idveil.sources.tables import cell, present

# Fixed value: bits in one bitmap of Spark's bitmap functions.
_BITMAP_BITS = 32768
#: Bitmaps of a row filter: at most 16 MB of 4 KB each, which are broadcast.
FILTER_BITMAPS = 4096

_LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


def column_letter(number: Column | str) -> Column:
    """1 is A, 26 is Z, 27 is AA; up to three letters, as sheets have."""
    n = as_col(number).cast("int")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def letter(index: Column) -> Column:
        return F.substring(F.lit(letters), index % 26 + 1, F.lit(1))

    last = n - 1
    middle = F.floor(last / 26).cast("int") - 1
    first = F.floor(middle / 26).cast("int") - 1
    return F.concat(
        F.when(first >= 0, letter(first)).otherwise(F.lit("")),
        F.when(middle >= 0, letter(middle)).otherwise(F.lit("")),
        letter(last),
    )


def sheet_value(value: Column | str, value_type: Column | str) -> Column:
    """Text of a sheet cell: flags and dates do not count, whole floats become integers."""
    value, kind = as_col(value), F.lower(as_col(value_type))
    whole = F.regexp_extract(value, r"^\s*(-?\d+)\.0+\s*$", 1)
    text = (
        F.when(kind.isin("bool", "boolean", "date", "datetime", "time", "timestamp"), F.lit(None))
        .when(kind.isin("float", "double", "number") & (whole != ""), whole)
        .otherwise(strip(value))
    )
    return F.when(text != "", text)


def _rows_of_candidates(texts: DataFrame, bitmaps: int) -> DataFrame:
    """The cells whose row may hold an identifier, and few others.

    Hashed row keys of candidate cells set bits of at most *bitmaps* bitmaps, so the filter's size is bounded whatever
    the number of rows. A hash that meets another one's bit lets its row through, none is lost.
    """
    hashed = F.xxhash64("file", "sheet", "sheet_ord", "row")
    bit = F.pmod(hashed, F.lit(bitmaps * _BITMAP_BITS))
    keyed = texts.select("*", F.floor(bit / _BITMAP_BITS).cast("int").alias("_map"), (bit % _BITMAP_BITS).alias("_bit"))
    maps = keyed.where(may_hold_identifier(F.col("t"))).groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    hit = F.getbit(byte.cast("int"), (F.col("_bit") % 8).cast("int")) == 1
    return keyed.join(F.broadcast(maps), "_map").where(hit).drop("_map", "_bit", "_bits")


def sheet_rows(cells: DataFrame, only_candidates: bool = False, bitmaps: int = FILTER_BITMAPS) -> DataFrame:
    """Rows from ``(file, sheet, row, col_num, value, value_type)``, optionally ``sheet_ord``.

    A sheet row is gathered by its own key; its width is bounded by the sheet format. ``only_candidates`` leaves out
    rows that cannot yield a finding of a built-in recognizer before cells are gathered, so that the shuffle grows with
    the candidates.
    """
    order = F.col("sheet_ord") if "sheet_ord" in cells.columns else F.lit(0)
    texts = cells.select(
        "file", "sheet", order.cast("int").alias("sheet_ord"), F.col("row").cast("bigint").alias("row"),
        F.col("col_num").cast("int").alias("n"), sheet_value("value", "value_type").alias("t"),
    ).where(F.col("t").isNotNull())
    if only_candidates:
        texts = _rows_of_candidates(texts, bitmaps)
    grouped = texts.groupBy("file", "sheet", "sheet_ord", "row").agg(
        F.array_sort(F.collect_list(F.struct("n", "t"))).alias("_cells")
    )
    return grouped.select(
        "file",
        "sheet",
        "sheet_ord",
        "row",
        F.transform("_cells", lambda x: cell(x["n"], column_letter(x["n"]), x["t"])).alias("cells"),
        F.array_join(F.col("_cells")["t"], " ").alias("row_context"),
    )


def _single(df: DataFrame, sheet: Column, sheet_ord: Column, row: Column, ordinal: Column,
            column: Column, text: Column) -> DataFrame:
    return df.select(
        "file",
        sheet.cast("string").alias("sheet"),
        sheet_ord.cast("int").alias("sheet_ord"),
        row.cast("bigint").alias("row"),
        present(F.array(cell(ordinal, column, strip(text)))).alias("cells"),
        F.lit("").alias("row_context"),
    )


def part_rows(parts: DataFrame) -> DataFrame:
    """Rows from ``(file, part, table_no, row, col_num, text)``.

    ``part`` is paragraph or cell. Paragraphs come before tables; there is no row context.
    """
    in_table = F.col("part") != "paragraph"
    return _single(
        parts,
        F.when(in_table, F.concat(F.lit("Table "), F.col("table_no").cast("string"))),
        F.when(in_table, F.col("table_no")).otherwise(F.lit(0)),
        F.col("row"),
        F.when(in_table, F.col("col_num")).otherwise(F.lit(0)),
        F.when(in_table, column_letter("col_num")).otherwise(F.lit("paragraph")),
        F.col("text"),
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """Rows from ``(file, page, text)``: one per non-blank line, no row context."""
    lines = pages.select(
        "file", "page", F.posexplode_outer(F.split("text", _LINE_BREAK)).alias("_at", "_line")
    ).where(strip("_line") != "")
    return _single(
        lines,
        F.concat(F.lit("Page "), F.col("page").cast("string")),
        F.col("page"),
        F.col("_at") + 1,
        F.lit(0),
        F.lit("line"),
        F.col("_line"),
    )
