"""Slices of the marts and the KPIs of a slice against the whole. Inputs are prepared tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.functions.columns import flag
from martwright.operators.ranks import among_smallest

SLICE_COLUMNS = ("product_category_name", "customer_state", "seller_state", "main_payment_type")

PREVIEW = (
    "order_id order_purchase_timestamp order_status product_category_name customer_state "
    "seller_state total_price total_freight freight_share main_payment_type review_score "
    "is_bad_review is_delayed delivery_time_days delay_days"
).split()


def slice_condition(
    categories: Sequence[str] = (),
    customer_states: Sequence[str] = (),
    seller_states: Sequence[str] = (),
    payment_types: Sequence[str] = (),
    start: date | None = None,
    end: date | None = None,
) -> Column:
    """Rows of the chosen values and days; an empty choice does not filter.

    A date range also bounds the month, which is the partition column of the stored marts.
    """
    condition = F.lit(True)
    chosen = (categories, customer_states, seller_states, payment_types)
    for name, values in zip(SLICE_COLUMNS, chosen):
        if values:
            condition = condition & F.col(name).isin(list(values))
    day, month = F.to_date("order_purchase_timestamp"), F.col("order_year_month")
    if start is not None:
        condition = condition & (month >= f"{start:%Y-%m}") & (day >= F.lit(start))
    if end is not None:
        condition = condition & (month <= f"{end:%Y-%m}") & (day <= F.lit(end))
    return condition


def slice_orders(prepared: DataFrame, **choice) -> DataFrame:
    return prepared.where(slice_condition(**choice))


def slice_order_seller(prepared: DataFrame, **choice) -> DataFrame:
    """Order-and-seller rows of a slice; they carry no payment type, so that choice is ignored."""
    choice.pop("payment_types", None)
    return prepared.where(slice_condition(**choice))


def slice_values(prepared: DataFrame) -> DataFrame:
    """Every value to choose from as (field, value), from one pass."""
    found = prepared.groupingSets([[name] for name in SLICE_COLUMNS], *SLICE_COLUMNS).agg(
        F.grouping_id().alias("used")
    )
    # grouping_id has one bit per column, first column highest; the used column's bit is clear
    top = len(SLICE_COLUMNS) - 1
    field, value = None, None
    for position, name in enumerate(SLICE_COLUMNS):
        is_used = F.col("used").bitwiseAND(1 << (top - position)) == 0
        field = F.when(is_used, name) if field is None else field.when(is_used, name)
        value = F.when(is_used, F.col(name)) if value is None else value.when(is_used, F.col(name))
    return (
        found.select(field.alias("field"), value.alias("value"))
        .where(F.col("value").isNotNull())
        .orderBy("field", "value")
    )


def slice_period(prepared: DataFrame) -> DataFrame:
    """First and last purchase day."""
    day = F.to_date("order_purchase_timestamp")
    return prepared.agg(F.min(day).alias("min_date"), F.max(day).alias("max_date"))


def slice_preview(prepared: DataFrame, rows: int = 10_000) -> DataFrame:
    """The first rows by order id, report columns only.

    Rows beyond a bound on the id leave before the sort, so the tasks together send about as many
    wide rows as the preview has, not that many each.
    """
    within = among_smallest(prepared, "order_id", rows)
    return prepared.select(*PREVIEW).where(within).orderBy("order_id").limit(rows)


def _kpis(within: Column | None) -> list[Column]:
    """KPI aggregates over all rows or over those within a condition; zero where nothing counts."""

    def only(column: Column) -> Column:
        return column if within is None else F.when(within, column)

    delivered = F.col("is_delivered") == 1

    def mean(column: Column) -> Column:
        return F.coalesce(F.avg(only(column)), F.lit(0.0))

    return [
        F.count(only(F.lit(1))).cast("double").alias("orders"),
        F.coalesce(F.sum(only(F.col("total_price"))), F.lit(0.0)).alias("gmv"),
        mean(F.col("total_price")).alias("aov"),
        mean(F.col("review_score")).alias("avg_review_score"),
        mean(F.col("is_bad_review")).alias("bad_review_rate"),
        mean(F.when(delivered, F.col("is_delayed"))).alias("delay_rate"),
        mean(F.when(delivered, F.col("delivery_time_days"))).alias("avg_delivery_time_days"),
        mean(F.col("is_cancelled")).alias("cancel_rate"),
    ]


KPIS = (
    "orders gmv aov avg_review_score bad_review_rate delay_rate avg_delivery_time_days "
    "cancel_rate repeat_purchase_rate"
).split()

# How a difference reads: as money, percentage points or a plain number.
KPI_KINDS = {
    "gmv": "money", "bad_review_rate": "pct", "delay_rate": "pct", "cancel_rate": "pct",
    "repeat_purchase_rate": "pct",
}


def kpi_summary(prepared: DataFrame) -> DataFrame:
    """One row of KPIs of a table (a slice or the whole)."""
    return prepared.agg(*_kpis(None)).withColumn(
        "repeat_purchase_rate", _repeat_rates(prepared, F.lit(True)).scalar()["slice"]
    )


def kpi_delta(prepared: DataFrame, within: Column) -> DataFrame:
    """(metric, kind, current, base, delta) of a slice against the whole, from the same passes."""
    slice_part = F.struct(*_kpis(flag(within) == 1)).alias("slice")
    totals = prepared.agg(slice_part, F.struct(*_kpis(None)).alias("whole"))
    both = totals.withColumn("repeat", _repeat_rates(prepared, within).scalar())

    def value(side: str, name: str) -> Column:
        if name == "repeat_purchase_rate":
            return F.col("repeat")[side]
        return F.col(side)[name]

    lines = [
        F.struct(
            F.lit(name).alias("metric"),
            F.lit(KPI_KINDS.get(name, "number")).alias("kind"),
            value("slice", name).alias("current"),
            value("whole", name).alias("base"),
        )
        for name in KPIS
    ]
    return both.select(F.inline(F.array(*lines))).withColumn(
        "delta", F.col("current") - F.col("base")
    )


def _repeat_rates(prepared: DataFrame, within: Column) -> DataFrame:
    """Repeat-purchase rate in the slice and in the whole as one struct.

    Customers are counted once for both: a narrow aggregate of their orders, inside and overall.
    """
    customers = (
        prepared.where(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(F.count("*").alias("all_orders"), F.count_if(within).alias("slice_orders"))
    )
    seen = F.when(F.col("slice_orders") > 0, (F.col("slice_orders") > 1).cast("double"))
    every = (F.col("all_orders") > 1).cast("double")
    return customers.agg(
        F.struct(
            F.coalesce(F.avg(seen), F.lit(0.0)).alias("slice"),
            F.coalesce(F.avg(every), F.lit(0.0)).alias("whole"),
        ).alias("repeat")
    )
