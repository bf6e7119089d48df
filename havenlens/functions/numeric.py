"""Rounding, clipping and money labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, digits: int = 0) -> Column:
    """Round ties to the even neighbour. `rint` stays on primitives, where `bround` builds a BigDecimal per row."""
    if digits == 0:
        return F.rint(value)
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def clip(value: Column, low: float, high: float) -> Column:
    """Bound a value; null stays null (greatest/least alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.nullif(whole, F.lit(0))


def exact_mean(value: Column, digits: int, when: Column | None = None) -> Column:
    """Mean of values held at `digits` decimals, summed as whole units so that the order of rows cannot matter."""
    units = F.rint(value * F.lit(float(10**digits))).cast("long")
    if when is not None:
        units = F.when(when, units)
    return half_even(F.sum(units).cast("double") / F.nullif(F.count(units), F.lit(0))) / F.lit(float(10**digits))


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, ties to even; null stays null (format_string would print it)."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", half_even(value, digits)))


def grouped_digits(value: Column) -> Column:
    """Whole number as text with Indian digit groups: last three digits, then pairs."""
    whole = F.abs(half_even(value)).cast("decimal(38,0)").cast("string")
    split_at = F.length(whole) - 3
    lead = F.when(split_at > 0, F.substr(whole, F.lit(1), split_at)).otherwise(F.lit(""))
    tail = F.when(split_at > 0, F.substr(whole, split_at + 1)).otherwise(whole)
    pairs = F.regexp_replace(lead, r"(?<=\d)(?=(\d\d)+$)", ",")
    return F.concat(F.when(half_even(value) < 0, F.lit("-")).otherwise(F.lit("")),
                    pairs, F.when(split_at > 0, F.lit(",")).otherwise(F.lit("")), tail)


def inr_label(value: Column, decimals: int = 1, indian_groups: bool = False) -> Column:
    """₹ text: crore from 1e7 (two decimals), lakh from 1e5 (`decimals`), plain digits below."""
    amount = F.coalesce(value.cast("double"), F.lit(0.0))
    plain = grouped_digits(amount) if indian_groups else F.regexp_replace(
        half_even(amount).cast("decimal(38,0)").cast("string"), r"(?<=\d)(?=(\d{3})+$)", ",")
    return (
        F.when(F.abs(amount) >= 1e7, F.concat(F.lit("₹"), fixed(amount / 1e7, 2), F.lit(" Cr")))
        .when(F.abs(amount) >= 1e5, F.concat(F.lit("₹"), fixed(amount / 1e5, decimals), F.lit(" L")))
        .otherwise(F.concat(F.lit("₹"), plain))
    )
