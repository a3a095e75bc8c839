"""Column expressions shared by the marts and the metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from martwright import labels as L


def days_between(start: str, end: str) -> Column:
    """Fractional days. Timestamps without zone subtract exactly, whatever the session zone is."""
    gap = (F.col(end) - F.col(start)).cast("interval second").cast("decimal(18,6)")
    return gap.cast("double") / F.lit(86400.0)


def flag(condition: Column) -> Column:
    """1, 0, or NULL where the condition is unknown."""
    return F.when(condition, 1).when(~condition, 0)


def blank_to_null(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def resolved_category(native: Column, english: Column) -> Column:
    return (
        F.when(blank_to_null(native).isNull(), L.MISSING_PRODUCT_CATEGORY)
        .when(english.isNull(), L.MISSING_TRANSLATION)
        .otherwise(english)
    )


def month_key(timestamp: str) -> Column:
    """yyyy-MM of a timestamp without zone; stays off the session zone, unlike date_format."""
    month = F.lpad(F.month(timestamp).cast("string"), 2, "0")
    return F.concat(F.lpad(F.year(timestamp).cast("string"), 4, "0"), F.lit("-"), month)


def exact_money(amount: Column) -> Column:
    """Money in whole ten-thousandths: its sums do not depend on the order of addition, so ranks
    and ties by them are the same in every run. Sums beyond 64 bits raise an error."""
    return F.rint(amount * 10_000).cast("long")


def as_money(exact: Column) -> Column:
    """Whole ten-thousandths as the double nearest to the amount."""
    return exact.cast("double") / F.lit(10_000.0)


def largest_first(amount: Column, name: Column) -> Column:
    """Ordering for min_by: biggest amount, then the first name; unknown amounts come last."""
    return F.struct(amount.isNull(), -amount, name)


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator.cast("double") / denominator)


def finite(column: Column) -> Column:
    """NULL in place of NaN and the infinities."""
    value = column.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def right_closed_bin(value: Column, edges: Sequence[float]) -> Column:
    """Position of the first edge that is not below the value; len(edges) beyond the last one."""
    result = F.when(value <= edges[0], 0)
    for position, edge in enumerate(edges[1:], start=1):
        result = result.when(value <= edge, position)
    return result.when(value.isNotNull(), len(edges))


def delay_bucket() -> Column:
    known = (F.col("is_delivered") == 1) & F.col("delay_days").isNotNull()
    return F.when(known, right_closed_bin(F.col("delay_days"), L.DELAY_BUCKET_EDGES))


def delay_stage() -> Column:
    seller, transit = F.col("seller_overrun_days") > 0, F.col("transit_overrun_days") > 0
    return F.when(seller & transit, 2).when(seller, 0).when(transit, 1).otherwise(3)


def freight_bin() -> Column:
    share = F.col("freight_share")
    return F.when(
        share > L.FREIGHT_EDGES[0], right_closed_bin(share, L.FREIGHT_EDGES[1:])
    )


def label_of(position: Column, texts: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(text) for text in texts]), position + 1)


# Interval formulas are SQL text over column names: one expression instead of dozens of calls.


def wilson_interval(hits: str, n: str, z: float = L.Z95) -> tuple[str, str]:
    """Score interval for a share; NULL without trials."""
    middle = f"({hits} + {z * z / 2}D)"
    spread = f"{z}D * sqrt({hits} * ({n} - {hits}) / {n} + {z * z / 4}D)"
    ends = [f"({middle} {sign} {spread}) / ({n} + {z * z}D)" for sign in "-+"]
    low, high = [f"CASE WHEN {n} > 0 THEN {end} END" for end in ends]
    return low, high


def mean_interval(mean: str, deviation: str, n: str, z: float = L.Z95) -> tuple[str, str]:
    """Normal interval for a mean; NULL below two values."""
    low, high = [
        f"CASE WHEN {n} >= 2 THEN {mean} {sign} {z}D * {deviation} / sqrt({n}) END"
        for sign in "-+"
    ]
    return low, high


def correlation_interval(rho: str, n: str, z: float = L.Z95) -> tuple[str, str]:
    """Fisher interval; NULL below four pairs or for a perfect correlation."""
    low, high = [
        f"CASE WHEN {n} >= 4 AND abs({rho}) < 1 "
        f"THEN tanh(atanh({rho}) {sign} {z}D / sqrt({n} - 3)) END"
        for sign in "-+"
    ]
    return low, high


def effect_magnitude(effect: Column) -> Column:
    size = F.abs(effect)
    result = F.when(effect.isNull(), L.EFFECT_UNDEFINED)
    for edge, text in zip(L.EFFECT_EDGES, L.EFFECT_SIZES):
        result = result.when(size < edge, text)
    return result.otherwise(L.EFFECT_SIZES[-1])
