"""Verhoeff check digits as array lookups, the tables built from their group rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dihedral(a: int, b: int) -> int:
    """Product in the symmetry group of the pentagon: 0-4 are rotations, 5-9 reflections."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


_STEP = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def product_table() -> list[int]:
    return [_dihedral(a, b) for a in range(10) for b in range(10)]


def permutation_table() -> list[int]:
    row, flat = list(range(10)), []
    for _ in range(8):
        flat += row
        row = [_STEP[v] for v in row]
    return flat


def inverse_table() -> list[int]:
    return [next(b for b in range(10) if _dihedral(a, b) == 0) for a in range(10)]


def _fold(digits: str, shift: int) -> str:
    product = "array(" + ", ".join(map(str, product_table())) + ")"
    permuted = "array(" + ", ".join(map(str, permutation_table())) + ")"
    places = f"transform(split(reverse({digits}), ''), (v, p) -> {permuted}[((p + {shift}) % 8) * 10 + CAST(v AS int)])"
    return f"aggregate({places}, 0, (c, v) -> {product}[c * 10 + v])"


def valid_sql(digits: str) -> str:
    """SQL text: false for anything that is not all digits."""
    return f"CASE WHEN {digits} RLIKE '^[0-9]+\\\\z' THEN {_fold(digits, 0)} = 0 ELSE false END"


def verhoeff_valid(digits: str) -> Column:
    """Whether a column or SQL expression of digits ends in its right check digit."""
    return F.expr(valid_sql(digits))


def verhoeff_digit(digits: str) -> Column:
    """The check digit to append; null for anything that is not all digits."""
    inverse = "array(" + ", ".join(map(str, inverse_table())) + ")"
    return F.expr(f"CASE WHEN {digits} RLIKE '^[0-9]+\\\\z' THEN {inverse}[{_fold(digits, 1)}] END")
