"""Small Column helpers shared by the expression modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from idveil.constants import SPACE_CHARS, WS


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate *value* once and hand it to *body* as a bound variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup_table(values: list[int]) -> Column:
    """A constant array, built in one call instead of one per element."""
    return F.expr(f"array({', '.join(map(str, values))})")


def strip(text: Column | str) -> Column:
    """Trim all Unicode white space (plain ``trim`` only removes blanks)."""
    return F.btrim(as_col(text), F.lit(SPACE_CHARS))


def drop_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WS}]+", "")


def is_ascii(text: Column | str) -> Column:
    """Byte length equals character length: no regex needed to tell ASCII apart."""
    text = as_col(text)
    return F.octet_length(text) == F.length(text)


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_per_key(items: Column) -> Column:
    """Keep the first item per key of an array of ``struct<key, pos, ...>``.

    Sorting makes it n log n in the number of matches of a text, where looking
    each key up again would be quadratic on texts that hold thousands.
    """

    def keep_first(ordered: Column) -> Column:
        def is_first(item: Column, i: Column) -> Column:
            return (i == 0) | (F.get(ordered, i - 1)["key"] != item["key"])

        return F.filter(ordered, is_first)

    kept = let(F.array_sort(items), keep_first)
    by_pos = F.array_sort(F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), x.alias("item"))))
    return F.when(F.size(items) > 1, F.transform(by_pos, lambda x: x["item"])).otherwise(items)
