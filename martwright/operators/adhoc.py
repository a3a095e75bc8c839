"""Seven quick checks of the marts. They round first and sort on the rounded values.

Money is summed as decimals here: rounding to cents must not hang on the last bit of a sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.operators.shared import measures

_PLACES = {
    "gmv": 2, "aov": 2, "avg_review_score": 3, "bad_review_rate": 3, "delay_rate": 3,
    "late_handover_rate": 3, "cancelled_rate": 3, "avg_delivery_time_days": 2,
    "avg_handover_days": 2, "avg_transit_days": 2, "avg_total_days": 2,
}


def _rounded(table: DataFrame) -> DataFrame:
    return table.withColumns({
        name: F.round(F.col(name).cast("double"), places)
        for name, places in _PLACES.items()
        if name in table.columns
    })


def _exact_price(mart: DataFrame) -> DataFrame:
    return mart.withColumn("total_price", F.col("total_price").cast("decimal(18,4)"))


def overall(mart: DataFrame) -> DataFrame:
    table = _exact_price(mart).agg(
        *measures(
            "orders gmv aov avg_review_score bad_review_rate delay_rate avg_delivery_time_days"
        ),
        F.avg("is_cancelled").alias("cancelled_rate"),
    )
    return _rounded(table.withColumnRenamed("orders", "total_orders"))


def months(mart: DataFrame) -> DataFrame:
    wanted = measures("orders gmv aov avg_review_score bad_review_rate delay_rate")
    return _rounded(
        _exact_price(mart).groupBy("order_year_month").agg(*wanted)
    ).orderBy("order_year_month")


def worst_categories(mart: DataFrame, min_orders: int = 100, top: int = 20) -> DataFrame:
    table = (
        _exact_price(mart.where(F.col("product_category_name").isNotNull()))
        .groupBy("product_category_name")
        .agg(*measures("orders gmv avg_review_score bad_review_rate delay_rate"))
        .where(F.col("orders") >= min_orders)
    )
    worst = (F.desc("bad_review_rate"), F.desc("orders"), "product_category_name")
    return _rounded(table).orderBy(*worst).limit(top)


def late_states(mart: DataFrame, min_orders: int = 100) -> DataFrame:
    table = (
        mart.where(F.col("customer_state").isNotNull())
        .groupBy("customer_state")
        .agg(*measures("orders delay_rate avg_delivery_time_days avg_review_score"))
        .where(F.col("orders") >= min_orders)
    )
    return _rounded(table).orderBy(F.desc("delay_rate"), F.desc("orders"), "customer_state")


def worst_sellers(seller_mart: DataFrame, min_orders: int = 30, top: int = 20) -> DataFrame:
    table = seller_mart.where(F.col("orders") >= min_orders).select(
        "seller_id", "seller_state", "top_category", "orders", "delay_rate",
        "late_handover_rate", "bad_review_rate", "avg_review_score",
    )
    worst = (F.desc("bad_review_rate"), F.desc("orders"), "seller_id")
    return _rounded(table).orderBy(*worst).limit(top)


def sellers_in_category(order_seller: DataFrame, min_orders: int = 30) -> DataFrame:
    table = (
        order_seller.where(F.col("is_single_seller_order") == 1)
        .groupBy("product_category_name", "seller_id")
        .agg(*measures("orders bad_review_rate delay_rate late_handover_rate"))
        .where(F.col("orders") >= min_orders)
    )
    return _rounded(table).orderBy(
        "product_category_name", F.desc("bad_review_rate"), "seller_id"
    )


def stages_by_delay(mart: DataFrame) -> DataFrame:
    delivered = mart.where(F.col("is_delivered") == 1).groupBy("is_delayed")
    return _rounded(delivered.agg(
        *measures("orders"),
        F.avg("handover_time_days").alias("avg_handover_days"),
        F.avg("transit_time_days").alias("avg_transit_days"),
        F.avg("delivery_time_days").alias("avg_total_days"),
    ))
