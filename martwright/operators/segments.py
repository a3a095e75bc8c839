"""KPI, monthly and segment tables of the orders mart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martwright import labels as L
from martwright.functions.columns import finite, freight_bin
from martwright.operators.shared import (
    all_segments,
    complete_labels,
    label_rows,
    measures,
    pooled,
)

QUALITY = "orders gmv aov avg_review_score bad_review_rate delay_rate avg_delivery_time_days"


def repeat_purchase_rate(mart: DataFrame) -> DataFrame:
    """Share of customers with more than one order: one row, one column."""
    customers = (
        mart.where(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(F.count("*").alias("orders"))
    )
    return customers.agg(
        F.avg((F.col("orders") > 1).cast("double")).alias("repeat_purchase_rate")
    )


def summary_metrics(mart: DataFrame) -> DataFrame:
    """One row with the overall KPIs.

    The customer-grain part is a scalar subquery: it reads and shuffles the customer id only,
    while the rest is a global aggregate without a shuffle of rows.
    """
    reviewed = F.coalesce(F.col("review_count"), F.lit(0)) > 0
    return mart.agg(
        F.count("*").alias("total_orders"),
        F.coalesce(F.sum("is_delivered"), F.lit(0)).alias("delivered_orders"),
        F.coalesce(F.sum("is_cancelled"), F.lit(0)).alias("cancelled_orders"),
        F.count_if(reviewed).alias("reviewed_orders"),
        F.avg(reviewed.cast("double")).alias("review_coverage"),
        F.coalesce(F.sum("total_price"), F.lit(0.0)).alias("gmv"),
        *measures("aov avg_review_score bad_review_rate"),
        F.avg(F.when(F.col("is_delivered") == 1, F.col("is_delayed"))).alias("delay_rate"),
        *measures("avg_delivery_time_days avg_delay_days avg_freight_share"),
        F.avg("is_cancelled").alias("cancelled_rate"),
    ).withColumn("repeat_purchase_rate", repeat_purchase_rate(mart).scalar())


def segment_metrics(mart: DataFrame, group_col: str, min_orders: int = 30) -> DataFrame:
    """Metrics per value of any column, the unknown value included; worst segments first."""
    return (
        mart.groupBy(group_col)
        .agg(*measures(f"{QUALITY} avg_freight_share"))
        .where(F.col("orders") >= min_orders)
        .orderBy(F.desc_nulls_last("bad_review_rate"), F.desc("orders"), group_col)
    )


def monthly_metrics(mart: DataFrame) -> DataFrame:
    return (
        mart.where(F.col("order_year_month").isNotNull())
        .groupBy("order_year_month")
        .agg(*measures(QUALITY))
        .orderBy("order_year_month")
    )


def monthly_trend(prepared: DataFrame, smooth_short_series: bool = False) -> DataFrame:
    """Monthly table with means over the last three observed months.

    Below three months the plain values stand in for the means, unless smooth_short_series.
    """
    months = (
        prepared.where(F.col("order_month").isNotNull())
        .groupBy("order_month")
        .agg(*measures("orders gmv aov avg_review_score bad_review_rate delay_rate"))
    )
    last_three = Window.orderBy("order_month").rowsBetween(-2, 0)
    enough = F.lit(smooth_short_series) | (F.count("*").over(all_segments()) >= 3)

    def smooth(name: str):
        return F.when(enough, F.avg(name).over(last_three)).otherwise(F.col(name).cast("double"))

    return months.withColumns({
        "orders_ma3": smooth("orders"), "gmv_ma3": smooth("gmv"),
    }).orderBy("order_month")


def monthly_extremes(prepared: DataFrame) -> DataFrame:
    """Peak month (the first of equals) and last month, by orders and by GMV: one row."""
    months = (
        prepared.where(F.col("order_month").isNotNull())
        .groupBy("order_month")
        .agg(*measures("orders gmv"))
    )

    def peak_month(measure: str):
        return F.min_by("order_month", F.struct(-F.col(measure), F.col("order_month")))

    return months.agg(
        peak_month("orders").alias("peak_orders_month"),
        F.max("orders").alias("peak_orders"),
        peak_month("gmv").alias("peak_gmv_month"),
        F.max("gmv").alias("peak_gmv"),
        F.max("order_month").alias("last_month"),
        F.max_by("orders", "order_month").alias("last_orders"),
        F.max_by("gmv", "order_month").alias("last_gmv"),
    )


def category_priority(prepared: DataFrame, min_orders: int = 50) -> DataFrame:
    """Categories with bad reviews beyond expectation, weighed by the logarithm of their GMV."""
    return _scored_categories(prepared, min_orders).drop("overall_bad_review_rate")


def category_priority_chart(
    prepared: DataFrame, min_orders: int = 50, named: int = 8
) -> DataFrame:
    """The priority table with its reference lines, the flag of categories above the overall rate
    and the categories to name."""
    place = F.row_number().over(
        all_segments().orderBy(F.desc_nulls_last("business_priority_score"), "product_category_name")
    )
    above = F.col("bad_review_rate") > F.col("overall_bad_review_rate")
    return _scored_categories(prepared, min_orders).withColumns({
        "median_orders": F.median("orders").over(all_segments()),
        "is_above_overall": F.coalesce(above.cast("int"), F.lit(0)),
        "is_named": (place <= named).cast("int"),
    })


def _scored_categories(prepared: DataFrame, min_orders: int) -> DataFrame:
    """The overall bad rate comes from the same aggregate, before small categories drop out."""
    categories = prepared.groupBy("product_category_name").agg(
        *measures(QUALITY),
        F.sum("is_bad_review").alias("_bad"), F.count("is_bad_review").alias("_known"),
    )
    orders = F.col("orders")
    scored = (
        categories.withColumn(
            "overall_bad_review_rate", F.coalesce(pooled("_bad", "_known"), F.lit(0.0))
        )
        .where(orders >= min_orders)
        .withColumn("bad_reviews", orders * F.col("bad_review_rate"))
        .withColumn("expected_bad_reviews", orders * F.col("overall_bad_review_rate"))
        .withColumn("excess_bad_reviews", F.col("bad_reviews") - F.col("expected_bad_reviews"))
    )
    # greatest() would skip an unknown excess and turn it into zero
    known_excess = F.when(
        F.col("excess_bad_reviews").isNotNull(),
        F.greatest(F.col("excess_bad_reviews"), F.lit(0.0)),
    )
    return (
        scored.withColumn("business_priority_score", finite(known_excess * F.log1p("gmv")))
        .drop("_bad", "_known")
    )


def top_category_risk(prepared: DataFrame, min_orders: int = 50, top: int = 15) -> DataFrame:
    """Categories with the highest priority score."""
    return category_priority(prepared, min_orders).orderBy(
        F.desc_nulls_last("business_priority_score"), "product_category_name"
    ).limit(top)


def state_metrics(prepared: DataFrame, min_orders: int = 50) -> DataFrame:
    """Delivered orders by customer state."""
    return (
        prepared.where(F.col("is_delivered") == 1)
        .groupBy("customer_state")
        .agg(
            *measures(
                "orders gmv avg_review_score bad_review_rate delay_rate avg_delivery_time_days "
                "avg_delay_days"
            )
        )
        .where(F.col("orders") >= min_orders)
    )


def payment_metrics(prepared: DataFrame) -> DataFrame:
    return (
        prepared.groupBy("main_payment_type")
        .agg(*measures("orders gmv aov avg_review_score bad_review_rate"))
        .orderBy(F.desc("orders"), "main_payment_type")
    )


def freight_share_bins(prepared: DataFrame) -> DataFrame:
    """Fixed bins of the freight share; empty bins stay with zero orders."""
    bins = (
        prepared.withColumn("bin_id", freight_bin())
        .where(F.col("bin_id").isNotNull())
        .groupBy("bin_id")
        .agg(*measures("orders avg_review_score bad_review_rate delay_rate aov"))
    )
    labels = label_rows(prepared.sparkSession, L.FREIGHT_BINS, "bin_id", "freight_share_bin")
    return complete_labels(labels, bins, "bin_id").withColumn(
        "orders", F.coalesce("orders", F.lit(0))
    ).orderBy("bin_id")
