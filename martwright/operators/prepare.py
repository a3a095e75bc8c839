"""Marts made ready for reports: unknown groups named, label columns added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright import labels as L


def prepare_orders(mart: DataFrame) -> DataFrame:
    delayed, bad = F.col("is_delayed"), F.col("is_bad_review")
    return mart.fillna({
        "product_category_name": L.NO_ORDER_ITEMS,
        "customer_state": L.UNKNOWN,
        "seller_state": L.UNKNOWN,
        "main_payment_type": L.UNKNOWN,
        "is_delivered": 0,
        "is_cancelled": 0,
    }).withColumns({
        "order_month": F.trunc(F.to_date("order_purchase_timestamp"), "month"),
        "bad_review_label": F.when(bad == 1, L.BAD_REVIEW)
        .when(bad == 0, L.GOOD_REVIEW)
        .otherwise(L.NO_REVIEW),
        "bad_review_flag": F.when(F.col("review_score").isNotNull(), bad),
        "delay_group": F.when(delayed == 1, L.DELAYED)
        .when(delayed == 0, L.NOT_DELAYED)
        .otherwise(L.NOT_DELIVERED_GROUP),
        "delivered_group": F.when(F.col("is_delivered") == 1, L.DELIVERED).otherwise(
            L.NOT_DELIVERED
        ),
    })


def prepare_order_seller(order_seller: DataFrame) -> DataFrame:
    return order_seller.fillna({
        "product_category_name": L.UNKNOWN,
        "seller_state": L.UNKNOWN,
        "customer_state": L.UNKNOWN,
        "is_delivered": 0,
        "is_cancelled": 0,
        "is_single_seller_order": 0,
    })
