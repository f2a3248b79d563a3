"""Wide tables as rows of cells.

The engine reads *rows*: one Spark row per source row, holding its non-blank cells
as ``array<struct<ord, column, text, column_entity, penalised,
inert, error>>``. Keeping the cells
of a row together lets it be tested as a whole before anything is exploded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idveil.functions.columns import as_col, strip
from idveil.functions.context import entity_of_header, header_is_penalised
from idveil.functions.text import may_hold_identifier

UNNAMED = "(unnamed)"


def _float_text(name: str) -> Column:
    """Shortest decimal form without an exponent below 1e16, as Python prints floats."""
    x = f"`{name}`"
    return F.expr(
        rf"""
        case when isnan({x}) then null
             when {x} = 0 or (abs({x}) >= 1e-3 and abs({x}) < 1e7) then cast({x} as string)
             when abs({x}) >= 1e-4 and abs({x}) < 1e16
             then regexp_replace(cast(cast({x} as decimal(38, 18)) as string), r'(\.\d+?)0+$', '$1')
             else regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                  cast({x} as string), r'\.0E', 'E'), r'E(\d)', 'e+$1'), r'E-(\d)$', 'e-0$1'), 'E-', 'e-')
        end"""
    )


def text_of(name: str, data_type: T.DataType) -> Column:
    """The values of a column as text; nested values become JSON, missing ones stay null."""
    value = F.col(f"`{name}`")
    if isinstance(data_type, T.StringType):
        return value
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return _float_text(name)
    if isinstance(data_type, T.BooleanType):
        return F.initcap(value.cast("string"))
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")


# Values of these types never spell an identifier; they only count as row context.
INERT = (
    T.BooleanType, T.ByteType, T.ShortType, T.DateType, T.TimestampType, T.TimestampNTZType
)


def cell(
    ordinal: Column, column: Column | str, text: Column, inert: bool = False, error: bool = False
) -> Column:
    """One cell. A name given as text has its header tests done here and now.

    Names that come as data are tested later, and only for the cells that may hold an
    identifier; until then ``penalised`` is null. An *error* cell carries the message of a read error instead of data.
    """
    if isinstance(column, str):
        entity: Column = F.lit(entity_of_header(column)).cast("string")
        penalised: Column = F.lit(header_is_penalised(column))
        column = F.lit(column)
    else:
        entity, penalised = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    return F.struct(
        ordinal.cast("int").alias("ord"),
        column.alias("column"),
        text.alias("text"),
        entity.alias("column_entity"),
        penalised.alias("penalised"),
        F.lit(inert).alias("inert"),
        F.lit(error).alias("error"),
    )


def error_cells(message: str) -> Column:
    """The cells of a record that could not be read."""
    return F.array(cell(F.lit(0), "ERROR", F.lit(message[:120]), error=True))


def present(cells: Column) -> Column:
    """Drop cells that are null or blank."""
    return F.filter(cells, lambda c: c["text"].isNotNull() & (c["text"] != ""))


def _may_hold(name: str, data_type: T.DataType) -> Column | None:
    """Whether a value of this type may hold an identifier, tested before it becomes text."""
    if isinstance(data_type, INERT):
        return None
    value = F.col(f"`{name}`")
    if isinstance(data_type, (T.IntegerType, T.LongType)):
        return (value >= 100_000_000) | (value <= -100_000_000)  # nine digits or more
    test = may_hold_identifier(text_of(name, data_type))
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        # Up to six digits with up to two decimals stay below nine digits.
        short = (F.abs(value) < 1e6) & (F.floor(value * 100 + 0.5) / 100 == value)
        return ~short & test
    return test


def with_candidates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which some column may hold an identifier.

    A plain filter inside whole-stage code, on typed values: most rows of most tables
    end here, before any text, array or struct is built for them.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    tests = [_may_hold(c, types[c]) for c in columns]
    some = reduce(lambda a, b: a | b, [t for t in tests if t is not None], F.lit(False))
    # The increasing id keeps the filter above the projection it stands on. Pushed below,
    # it would repeat the expressions of computed columns once per test.
    here = df.withColumn("_here", F.monotonically_increasing_id())
    return here.where((F.col("_here") >= 0) & some).drop("_here")


def table_rows(
    df: DataFrame,
    file: Column | str = "table",
    sheet: Column | str | None = None,
    row: Column | str | None = None,
    columns: list[str] | None = None,
    sheet_ord: int = 0,
    only_candidates: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows of a DataFrame.

    ``file`` and ``sheet`` are names or Columns. ``row`` numbers the rows; which row
    counts as first occurrence follows it. Without one, rows get increasing but not
    consecutive numbers, which need no shuffle and no second pass.
    ``only_candidates`` leaves out rows that cannot yield a finding; ``keep`` carries
    columns along.
    """
    names = columns or [
        c for c in df.columns if not (isinstance(row, str) and c == row)
    ]
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = F.array(
        *[
            cell(
                F.lit(i),
                n or UNNAMED,
                strip(text_of(n, types[n])),
                isinstance(types[n], INERT),
            )
            for i, n in enumerate(names)
        ]
    )
    number = F.monotonically_increasing_id() + 1 if row is None else as_col(row)
    df = df.select("*", number.cast("bigint").alias("_row"))
    if only_candidates:
        df = with_candidates(df, names)
    return df.select(
        (F.lit(file) if isinstance(file, str) else file).alias("file"),
        (F.lit(sheet) if isinstance(sheet, (str, type(None))) else sheet)
        .cast("string")
        .alias("sheet"),
        F.lit(sheet_ord).alias("sheet_ord"),
        F.col("_row").alias("row"),
        present(cells).alias("cells"),
        *keep,
    )


def row_context(cells: Column | str = "cells") -> Column:
    """All non-blank values of the row, the cell itself included, joined by blanks."""
    return F.array_join(as_col(cells)["text"], " ")


def explode_cells(rows: DataFrame) -> DataFrame:
    """The tidy table of cells: one line per non-blank cell with its row context."""
    context = F.col("row_context") if "row_context" in rows.columns else row_context()
    return rows.select(
        "file", "sheet", "row", context.alias("row_context"), F.inline("cells")
    ).select("file", "sheet", "row", "ord", "column", "text", "row_context")


def cell_rows(cells: DataFrame) -> DataFrame:
    """Rows of one cell each, from a tidy table of cells that carries its row context.

    Needs ``text``; ``file``, ``sheet``, ``row``, ``column``, ``ord`` and
    ``row_context`` are taken where present.
    """

    def given(name: str, default: Column) -> Column:
        return F.col(name) if name in cells.columns else default

    return cells.select(
        given("file", F.lit("table")).alias("file"),
        given("sheet", F.lit(None)).cast("string").alias("sheet"),
        given("sheet_ord", F.lit(0)).cast("int").alias("sheet_ord"),
        given("row", F.monotonically_increasing_id() + 1).cast("bigint").alias("row"),
        present(
            F.array(cell(given("ord", F.lit(0)), given("column", F.lit("text")), F.col("text")))
        ).alias("cells"),
        given("row_context", F.lit("")).alias("row_context"),
    )
