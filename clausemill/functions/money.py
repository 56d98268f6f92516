"""Money columns: rounding, Indian digit grouping and display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16
DASH = "—"


def round2(x: Column) -> Column:
    """Two decimals, halves towards plus infinity."""
    return F.floor((x + F.lit(EPSILON)) * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def group_indian(digits: Column) -> Column:
    """``615197`` to ``6,15,197``: a comma before the last three digits and every two before them."""
    return F.regexp_replace(digits, r"(?<=\d)(?=(?:\d\d)*\d{3}\z)", ",")


def _signed(x: Column, text: Column) -> Column:
    return F.when(x < 0, F.concat(F.lit("-"), text)).otherwise(text)


def indian_number(x: Column, digits: int = 2) -> Column:
    """Grouped number with exactly ``digits`` decimals."""
    plain = F.format_string(f"%.{digits}f", F.abs(x))
    whole = group_indian(F.substring_index(plain, ".", 1))
    text = whole if digits == 0 else F.concat(whole, F.lit("."), F.substring_index(plain, ".", -1))
    return F.when(x.isNotNull(), _signed(x, text))


def format_inr(x: Column) -> Column:
    """Grouped number, decimals only when there are some."""
    return F.when(x % 1 == 0, indian_number(x, 0)).otherwise(indian_number(x, 2))


def rupees(x: Column) -> Column:
    return F.concat(F.lit("Rs. "), indian_number(x, 2))


def money(x: Column, whole: bool = False) -> Column:
    text = F.concat(F.lit("₹"), indian_number(F.abs(x), 0 if whole else 2))
    return F.coalesce(_signed(x, text), F.lit(DASH))


def percent(x: Column, digits: int = 2) -> Column:
    return F.when(x.isNotNull(), F.concat(F.format_string(f"%.{digits}f", x), F.lit("%"))).otherwise(DASH)


def short_number(x: Column) -> Column:
    """A double as people write it: ``2`` for 2.0, ``2.5`` for 2.5."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def months(n: Column) -> Column:
    years, rest = F.floor(n / 12), n % 12
    year_text = F.when(
        years > 0, F.concat(years.cast("string"), F.when(years > 1, " yrs").otherwise(" yr"))
    )
    rest_text = F.when(rest > 0, F.concat(rest.cast("string"), F.lit(" mo")))
    inner = F.concat_ws(" ", year_text, rest_text)
    tail = F.when(inner != "", F.concat(F.lit(" ("), inner, F.lit(")"))).otherwise(F.lit(""))
    return F.coalesce(F.concat(n.cast("string"), F.lit(" months"), tail), F.lit(DASH))


def fee(amount: Column, pct: Column, not_found: Column, description: Column) -> Column:
    parts = F.concat_ws(
        " / ",
        F.when(pct > 0, F.concat(short_number(pct), F.lit("%"))),
        F.when(amount > 0, money(amount)),
    )
    return (
        F.when(not_found, "Not stated")
        .when((amount == 0) & ((pct == 0) | pct.isNull()), "Nil")
        .when(parts != "", parts)
        .otherwise(F.coalesce(description, F.lit("Stated")))
    )


def display(name: str, value: Column) -> Column:
    """Calculator display string, chosen by the field's name."""
    lowered = name.lower()
    if "percent" in lowered or "rate" in lowered:
        return percent(value)
    if name == "tenureMonths":
        return F.concat(value.cast("string"), F.lit(" months"))
    return rupees(value)


def fraction_percent(x: Column) -> Column:
    """0.934 as ``93.4%``."""
    return F.when(x.isNotNull(), F.concat(F.format_string("%.1f", x * 100), F.lit("%")))
