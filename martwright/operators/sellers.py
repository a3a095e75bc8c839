"""Seller tables: ranking, sellers against their category, spread inside categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.functions.columns import ratio, wilson_interval
from martwright.operators.ranks import histogram, quantiles
from martwright.operators.shared import measures

# The columns of the ranking, in their order.
RANKING = (
    "seller_id seller_state top_category orders items single_seller_orders distinct_categories "
    "gmv delay_rate late_handover_rate bad_review_rate avg_review_score review_coverage "
    "avg_delivery_time_days avg_handover_time_days avg_transit_time_days"
).split()

# Rates lie between 0 and 1, so fixed cut points are enough to spread their ordering.
RATE_CUTS = tuple(i / 64 for i in range(1, 64))


def seller_ranking(seller_mart: DataFrame, min_orders: int = 30) -> DataFrame:
    return (
        seller_mart.select(*RANKING)
        .where(F.col("orders") >= min_orders)
        .orderBy(F.desc_nulls_last("bad_review_rate"), F.desc("orders"), "seller_id")
    )


def seller_metrics(order_seller: DataFrame, min_orders: int = 30) -> DataFrame:
    """Seller table from order-and-seller rows, so that it can follow a slice of them."""
    return (
        order_seller.groupBy("seller_id")
        .agg(
            F.max("seller_state").alias("seller_state"),
            *measures(
                "orders gmv delay_rate late_handover_rate bad_review_rate avg_review_score "
                "avg_handover_time_days avg_transit_time_days",
                gmv="seller_price",
            ),
        )
        .where(F.col("orders") >= min_orders)
    )


#: Columns whose means are told per seller and category.
_AVERAGED = {
    "avg_review_score": "review_score",
    "delay_rate": "is_delayed",
    "late_handover_rate": "is_late_handover",
    "avg_handover_time_days": "handover_time_days",
    "avg_transit_time_days": "transit_time_days",
}


def seller_sums(order_seller: DataFrame) -> DataFrame:
    """Sums of reviewed order-and-seller rows by category, seller and whether the order has one seller:
    orders, bad reviews, and for each averaged column its sum and the number of known values.

    Such sums merge, so the seller tables need no order rows; a refresh stores them. Rows that are
    such sums already come back as they are. Columns that the rows do not have are left out.
    """
    if "bad_reviews" in order_seller.columns:
        return order_seller
    known = [name for name in _AVERAGED.values() if name in order_seller.columns]
    return order_seller.where(F.col("is_bad_review").isNotNull()).groupBy(
        "product_category_name", "seller_id", "is_single_seller_order"
    ).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("is_bad_review").alias("bad_reviews"),
        *[F.sum(name).alias(f"{name}__sum") for name in known],
        *[F.count(name).alias(f"{name}__n") for name in known],
    )


def per_seller(rows: DataFrame, single_seller_only: bool) -> DataFrame:
    """Orders, bad reviews, their share and means of each seller in each category."""
    sums = seller_sums(rows).where(F.col("product_category_name").isNotNull())
    if single_seller_only:
        sums = sums.where(F.col("is_single_seller_order") == 1)
    keys = ["product_category_name", "seller_id"]
    added = [name for name in sums.columns if name not in (*keys, "is_single_seller_order")]
    merged = sums.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in added])
    return merged.select(
        *keys, "orders", "bad_reviews",
        ratio(F.col("bad_reviews"), F.col("orders")).alias("bad_review_rate"),
        *[
            ratio(F.col(f"{source}__sum"), F.col(f"{source}__n")).alias(name)
            for name, source in _AVERAGED.items() if f"{source}__n" in added
        ],
    )


def seller_vs_category(
    order_seller: DataFrame,
    min_seller_orders: int = 30,
    min_sellers: int = 3,
    single_seller_only: bool = True,
) -> DataFrame:
    """Each seller's bad-review share against that of its category.

    The category rate covers all reviewed rows of the category, small sellers included; it is
    summed from the seller aggregate before the thresholds apply. Takes order-and-seller rows or
    their seller_sums.
    """
    each = per_seller(order_seller, single_seller_only)
    large = F.col("orders") >= min_seller_orders
    categories = each.groupBy("product_category_name").agg(
        (F.sum("bad_reviews") / F.sum("orders")).alias("category_bad_review_rate"),
        F.count_if(large).alias("n_sellers_in_category"),
    ).where(F.col("n_sellers_in_category") >= min_sellers)
    low, high = wilson_interval("bad_reviews", "orders")
    difference = F.col("bad_review_rate") - F.col("category_bad_review_rate")
    return (
        each.where(large)
        .join(categories, "product_category_name")
        .select(
            "product_category_name", "seller_id", "n_sellers_in_category", "orders",
            "bad_review_rate",
            F.expr(low).alias("bad_review_rate_ci_low"),
            F.expr(high).alias("bad_review_rate_ci_high"),
            "category_bad_review_rate",
            difference.alias("bad_review_rate_diff"),
            "delay_rate", "late_handover_rate", "avg_review_score",
            "avg_handover_time_days", "avg_transit_time_days",
        )
        .orderBy("product_category_name", F.desc_nulls_last("bad_review_rate_diff"), "seller_id")
    )


def seller_top_categories(
    order_seller: DataFrame,
    min_orders: int = 30,
    min_sellers: int = 3,
    top_categories: int = 6,
    single_seller_only: bool = True,
) -> DataFrame:
    """Sellers of the categories with the most reviewed orders. Takes order-and-seller rows or their
    seller_sums."""
    each = per_seller(order_seller, single_seller_only).where(F.col("orders") >= min_orders).select(
        "product_category_name", "seller_id", "orders", "bad_review_rate", "delay_rate",
        "avg_review_score",
    )
    top = (
        each.groupBy("product_category_name")
        .agg(F.count("*").alias("sellers"), F.sum("orders").alias("volume"))
        .where(F.col("sellers") >= min_sellers)
        .orderBy(F.desc("volume"), "product_category_name")
        .limit(top_categories)
    )
    return each.join(top, "product_category_name", "left_semi")


def seller_category_spread(sellers: DataFrame) -> DataFrame:
    """Spread of seller rates per category, largest median first.

    Takes the rows of seller_top_categories. Quartiles are exact and interpolated, without
    gathering the sellers of a category in one task.
    """
    named = {"q1": 0.25, "median": 0.5, "q3": 0.75, "lowest": 0.0, "highest": 1.0}
    cells = histogram(sellers, "bad_review_rate", ["product_category_name"])
    sizes = cells.groupBy("product_category_name").agg(F.sum("n").alias("sellers"))
    spread = quantiles(cells, "bad_review_rate", named, RATE_CUTS, ["product_category_name"])
    return spread.join(sizes, "product_category_name").orderBy(
        F.desc("median"), "product_category_name"
    )
