"""Checksums of the identifier formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from idveil.constants import BASE36, VERHOEFF_PERMUTATION
from idveil.functions.columns import as_col, lookup_table


def _dihedral(a: int, b: int) -> int:
    """Product in the symmetry group of the pentagon: 0-4 rotate, 5-9 reflect."""
    turn = a % 5 + b % 5 if a < 5 else a % 5 - b % 5
    return turn % 5 + (5 if (a < 5) != (b < 5) else 0)


def _position_tables() -> list[list[int]]:
    rows = [list(range(10))]
    while len(rows) < 8:
        rows.append([rows[-1][d] for d in VERHOEFF_PERMUTATION])
    return rows


PRODUCT = [_dihedral(a, b) for a in range(10) for b in range(10)]
POSITION = [d for row in _position_tables() for d in row]
INVERSE = [next(b for b in range(10) if _dihedral(a, b) == 0) for a in range(10)]


def _digit(char: Column) -> Column:
    return F.ascii(char) - F.lit(48)


def _verhoeff_state(digits: Column, first_position: int) -> Column:
    placed = F.transform(
        F.split(F.reverse(digits), ""),
        lambda ch, i: F.get(lookup_table(POSITION), (i + first_position) % 8 * 10 + _digit(ch)),
    )
    return F.aggregate(placed, F.lit(0), lambda c, p: F.get(lookup_table(PRODUCT), c * 10 + p))


def verhoeff_valid(number: Column | str) -> Column:
    number = as_col(number)
    return F.when(F.length(number) == 0, F.lit(True)).otherwise(
        F.coalesce(_verhoeff_state(number, 0) == 0, F.lit(False))
    )


def verhoeff_check_digit(prefix: Column | str) -> Column:
    """The one digit that makes ``prefix || digit`` valid."""
    state = _verhoeff_state(as_col(prefix), 1)
    return F.get(lookup_table(INVERSE), state).cast("string")


def gstin_check_digit(prefix14: Column | str) -> Column:
    """Weights 1 and 2 in turn over base 36; each product adds its two base-36 digits."""

    def term(ch: Column, i: Column) -> Column:
        product = (F.position(ch, F.lit(BASE36)) - 1) * (i % 2 + 1)
        return F.floor(product / 36).cast("int") + product % 36

    total = F.aggregate(
        F.transform(F.split(as_col(prefix14), ""), term), F.lit(0), lambda s, t: s + t
    )
    return F.substring(F.lit(BASE36), (F.lit(36) - total % 36) % 36 + 1, F.lit(1))


def gstin_valid(gstin: Column | str) -> Column:
    gstin = as_col(gstin)
    shaped = (F.length(gstin) == 15) & gstin.rlike("^[0-9A-Z]{14}")
    return F.when(
        shaped, gstin_check_digit(F.substring(gstin, 1, 14)) == F.substring(gstin, 15, 1)
    ).otherwise(F.lit(False))
