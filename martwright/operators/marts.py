"""Order, order-and-seller, and seller marts.

Items are merged once, to lines of (order, seller, product); both item marts roll up from these.
Every step that argmaxes or counts distinct names first aggregates at the grain of that name. Lines of
ordinary orders move once, by order; those of a huge order are merged by name within their tasks before
they move, so a hot order or seller is never gathered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright import labels as L
from martwright import schemas
from martwright.functions.columns import (
    as_money,
    days_between,
    exact_money,
    flag,
    largest_first,
    month_key,
    ratio,
    resolved_category,
)

Raw = dict[str, DataFrame]

# Lines of an order, from which on they are too many to be brought to one task.
HUGE_ORDER = 100_000


def product_categories(products: DataFrame, translation: DataFrame) -> DataFrame:
    """product_id and its resolved category, joined at product grain before any item is touched."""
    english = translation.select("product_category_name", "product_category_name_english")
    return products.join(english, "product_category_name", "left").select(
        "product_id",
        resolved_category(
            F.col("product_category_name"), F.col("product_category_name_english")
        ).alias("category"),
    )


def _items(raw: Raw) -> DataFrame:
    """Raw items as lines of one item each, money in whole ten-thousandths."""
    return raw["raw_order_items"].select(
        "order_id", "seller_id", "product_id",
        F.lit(1).cast("long").alias("items"),
        exact_money(F.col("price").cast("double")).alias("price"),
        exact_money(F.col("freight_value").cast("double")).alias("freight"),
        F.col("shipping_limit_date").alias("limit_date"),
    )


def _with_category(lines: DataFrame, raw: Raw) -> DataFrame:
    categories = product_categories(raw["raw_products"], raw["raw_category_translation"])
    return lines.join(categories, "product_id", "left").withColumn(
        "category", F.coalesce("category", F.lit(L.MISSING_PRODUCT_CATEGORY))
    )


def item_lines(raw: Raw) -> DataFrame:
    """One row per item with its category: for one mart alone, as its first aggregate merges them."""
    return _with_category(_items(raw), raw)


def order_lines(raw: Raw) -> DataFrame:
    """One row per order, seller and product with its category: what both marts are rolled up from.

    Repeated items of an order are merged before the product join, so a huge order is at most its
    distinct (seller, product) pairs afterwards. Money stays in whole ten-thousandths.
    """
    merged = _items(raw).groupBy("order_id", "seller_id", "product_id").agg(*_sums())
    return _with_category(merged, raw)


def _sums() -> list[Column]:
    added = [F.sum(name).alias(name) for name in ("items", "price", "freight")]
    return [*added, F.max("limit_date").alias("limit_date")]


def _merged_by_order(
    items: DataFrame,
    lines: DataFrame,
    in_place: Callable[[DataFrame], DataFrame],
    by_name: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """The lines merged, each order by itself. Items are the lines before their joins.

    The lines of ordinary orders are brought together once, so that in_place need not move them. Those of
    huge orders, of which there are at most as many as HUGE_ORDER goes into all lines, stay where they are
    and are left to by_name.
    """
    huge = F.broadcast(
        items.groupBy(F.col("order_id").alias("huge_id"))
        .agg(F.count(F.lit(1)).alias("lines"))
        .where(F.col("lines") > HUGE_ORDER)
        .select("huge_id")
    )
    is_huge = F.col("order_id").eqNullSafe(F.col("huge_id"))
    ordinary = lines.join(huge, is_huge, "left_anti").repartition("order_id")
    return in_place(ordinary).unionByName(by_name(lines.join(huge, is_huge, "left_semi")))


def _same(*names: str):
    """All lines of an order that have the same names."""
    return (
        Window.partitionBy("order_id", *names).orderBy(names[-1])
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )


def _main_category(price: str) -> Column:
    """The category that earned most."""
    return F.min_by("category", largest_first(F.col(price), F.col("category")))


def _item_totals(lines: DataFrame) -> DataFrame:
    """Item totals per order with the category and the seller that earned most.

    Each line becomes a row for its seller, one for its category and one for its product, which hold
    only what their kind is asked for: empty cells cost next to nothing when rows move. They are merged
    by name, then to orders. Both steps merge within their tasks before they move rows, so an order with
    much of all lines is spread over the tasks until one row a task is left of it.
    """
    kinds = ("seller_id", "category", "product_id")
    kind = F.col("kind")

    def of(own: str, value: Column) -> Column:
        """The value in rows of one kind."""
        return F.when(kind == kinds.index(own), value)

    whole = ("items", "freight", "limit_date")  # told once an order, by its categories
    rolled = (
        lines.withColumn("kind", F.explode(F.array(*[F.lit(i) for i in range(len(kinds))])))
        .select(
            "order_id", "kind", *[of(own, F.col(own)).alias(own) for own in kinds],
            *[of("category", F.col(name)).alias(name) for name in whole],
            F.when(kind != kinds.index("product_id"), F.col("price")).alias("price"),
        )
        .groupBy("order_id", "kind", *kinds)
        .agg(*_sums())
    )

    def main(own: str) -> Column:
        """The name that earned most."""
        return F.min(of(own, largest_first(F.col("price"), F.col(own))))[own]

    totals = rolled.groupBy("order_id").agg(
        F.sum(of("category", F.col("items"))).alias("order_item_count"),
        *[
            F.count(of(own, F.col(own))).alias(name)
            for name, own in (
                ("distinct_products", "product_id"), ("distinct_sellers", "seller_id"),
                ("distinct_categories", "category"),
            )
        ],
        *[
            as_money(F.sum(of("category", F.col(name)))).alias(f"total_{name}")
            for name in ("price", "freight")
        ],
        F.max("limit_date").alias("max_shipping_limit_date"),
        main("category").alias("product_category_name"),
        main("seller_id").alias("main_seller_id"),
    )
    return _with_mixed(totals)


def _item_totals_in_place(lines: DataFrame) -> DataFrame:
    """As _item_totals, from lines whose orders are each in one task.

    Lines are sorted by order and name and told what the name earned in the order. A task holds its lines
    for that, which spill if they must, and no map of all names.
    """
    for own in ("category", "seller_id", "product_id"):
        place = F.row_number().over(Window.partitionBy("order_id", own).orderBy(own))
        lines = lines.withColumns({
            f"{own}_price": F.sum("price").over(_same(own)),
            f"{own}_first": F.when(F.col(own).isNotNull(), place == 1),
        })

    def main(own: str) -> Column:
        return F.min(largest_first(F.col(f"{own}_price"), F.col(own)))[own]

    return _with_mixed(lines.groupBy("order_id").agg(
        F.sum("items").alias("order_item_count"),
        F.count_if("product_id_first").alias("distinct_products"),
        F.count_if("seller_id_first").alias("distinct_sellers"),
        F.count_if("category_first").alias("distinct_categories"),
        as_money(F.sum("price")).alias("total_price"),
        as_money(F.sum("freight")).alias("total_freight"),
        F.max("limit_date").alias("max_shipping_limit_date"),
        main("category").alias("product_category_name"),
        main("seller_id").alias("main_seller_id"),
    ))


def _with_mixed(totals: DataFrame) -> DataFrame:
    return totals.withColumn(
        "is_mixed_category", F.when(F.col("distinct_categories") > 1, 1).otherwise(0)
    )


def _with_seller_state(orders: DataFrame, raw: Raw) -> DataFrame:
    states = raw["raw_sellers"].select(
        F.col("seller_id").alias("main_seller_id"), "seller_state"
    )
    return orders.join(states, "main_seller_id", "left")


def build_items_agg(raw: Raw) -> DataFrame:
    """Item totals per order, with the state of the main seller."""
    return _with_seller_state(_item_totals(item_lines(raw)), raw).select(
        "order_id", "order_item_count", "distinct_products", "distinct_sellers",
        "distinct_categories", "total_price", "total_freight", "max_shipping_limit_date",
        "product_category_name", "main_seller_id", "seller_state", "is_mixed_category",
    )


def build_payments_agg(raw: Raw) -> DataFrame:
    """Payment totals per order with the type that paid most."""
    value = F.col("payment_value").cast("double")
    by_type = raw["raw_order_payments"].groupBy("order_id", "payment_type").agg(
        F.sum(value).alias("value"),
        F.sum(exact_money(value)).alias("rank_value"),
        F.count("*").alias("payments"),
        F.max(F.col("payment_installments").cast("int")).alias("installments"),
    )
    best = largest_first(F.col("rank_value"), F.col("payment_type"))
    return by_type.groupBy("order_id").agg(
        F.sum("value").alias("payment_value"),
        F.sum("payments").alias("payment_count"),
        F.max("installments").alias("max_installments"),
        F.min_by("payment_type", best).alias("main_payment_type"),
    )


def build_reviews_agg(raw: Raw) -> DataFrame:
    """Mean and lowest score per order; bad if any review scores 2 or less."""
    score = F.col("review_score")
    return raw["raw_order_reviews"].groupBy("order_id").agg(
        F.avg(score.cast("double")).alias("review_score"),
        F.min(score.cast("int")).alias("min_review_score"),
        F.count("*").alias("review_count"),
        F.max(F.when(score <= 2, 1).otherwise(0)).alias("is_bad_review"),
    )


def build_orders_mart(raw: Raw, lines: DataFrame | None = None) -> DataFrame:
    """One row per order; lines are the stored order lines, derived from the raw items if absent."""
    return with_durations(joined_orders(raw, order_totals(raw, lines)))


def order_totals(raw: Raw, lines: DataFrame | None = None) -> DataFrame:
    """Item totals per order that has items, from stored order lines or else from the raw items."""
    items = _items(raw) if lines is None else lines
    lines = item_lines(raw) if lines is None else lines
    return _merged_by_order(items, lines, _item_totals_in_place, _item_totals)


def joined_orders(raw: Raw, totals: DataFrame) -> DataFrame:
    """Orders with their month and their details, which are aggregated to orders before they are joined.

    The seller state, whose key differs, is joined to the item totals: they are narrow, so that little
    moves by seller. What follows from an order's own columns is left to with_durations, so that a
    writer can move the rows before they have it.
    """
    customers = raw["raw_customers"].select(
        "customer_id", "customer_unique_id", "customer_city", "customer_state"
    )
    joined = (
        raw["raw_orders"]
        .join(customers, "customer_id", "left")
        .join(_with_seller_state(totals, raw), "order_id", "left")
        .join(build_payments_agg(raw), "order_id", "left")
        .join(build_reviews_agg(raw), "order_id", "left")
    )
    defaults = {
        "is_mixed_category": 0, "order_item_count": 0, "distinct_products": 0,
        "distinct_sellers": 0, "distinct_categories": 0, "total_price": 0.0,
        "total_freight": 0.0, "payment_value": 0.0, "payment_count": 0, "max_installments": 0,
        "main_payment_type": L.UNKNOWN, "review_count": 0,
        "product_category_name": L.NO_ORDER_ITEMS,
    }
    return joined.withColumns({
        name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()
    }).withColumn("order_year_month", month_key("order_purchase_timestamp"))


def with_durations(joined: DataFrame) -> DataFrame:
    """The orders mart from joined orders: flags, durations and overruns of each row."""
    purchase, approved = "order_purchase_timestamp", "order_approved_at"
    carrier, delivered = "order_delivered_carrier_date", "order_delivered_customer_date"
    estimated, limit_date = "order_estimated_delivery_date", "max_shipping_limit_date"
    mart = joined.withColumns({
        "has_review": F.when(F.col("review_count") > 0, 1).otherwise(0),
        "is_delivered": F.when(F.col(delivered).isNotNull(), 1).otherwise(0),
        "is_cancelled": F.when(F.col("order_status") == "canceled", 1).otherwise(0),
        "delivery_time_days": days_between(purchase, delivered),
        "estimated_delivery_time_days": days_between(purchase, estimated),
        "delay_days": days_between(estimated, delivered),
        "is_delayed": flag(F.col(delivered) > F.col(estimated)),
        "freight_share": F.when(
            F.col("total_price") > 0, ratio(F.col("total_freight"), F.col("total_price"))
        ),
        "approval_time_days": days_between(purchase, approved),
        "handover_time_days": days_between(approved, carrier),
        "transit_time_days": days_between(carrier, delivered),
        "is_late_handover": flag(F.col(carrier) > F.col(limit_date)),
        "seller_overrun_days": days_between(limit_date, carrier),
        "transit_overrun_days": days_between(carrier, delivered)
        - days_between(limit_date, estimated),
    })
    return mart.select(*schemas.mart_columns("orders_mart"))


def build_order_seller(
    raw: Raw, orders_mart: DataFrame, lines: DataFrame | None = None
) -> DataFrame:
    """One row per order and seller; order-level facts repeat on each seller of the order.

    Lines get the seller's place, are brought to their order, and are merged there by category, then to
    sellers, and joined with the facts of the order.
    """
    items = _items(raw) if lines is None else lines
    lines = item_lines(raw) if lines is None else lines
    sellers = raw["raw_sellers"].select("seller_id", "seller_state", "seller_city")
    order_facts = orders_mart.select(
        "order_id", "distinct_sellers", "order_year_month", "order_purchase_timestamp",
        "order_delivered_carrier_date", "customer_state", "is_delivered", "is_cancelled",
        "is_delayed", "delivery_time_days", "handover_time_days", "transit_time_days",
        "review_score", "is_bad_review", "has_review",
    )
    place = [F.max(name).alias(name) for name in ("seller_state", "seller_city")]

    def to_sellers(rows: DataFrame, main_category: Column) -> DataFrame:
        totals = rows.groupBy("order_id", "seller_id").agg(
            *place,
            F.sum("items").alias("seller_item_count"),
            as_money(F.sum("price")).alias("seller_price"),
            as_money(F.sum("freight")).alias("seller_freight"),
            F.max("limit_date").alias("seller_limit_date"),
            main_category.alias("product_category_name"),
        )
        return totals.join(order_facts, "order_id", "left")

    def in_place(lines: DataFrame) -> DataFrame:
        earned = F.sum("price").over(_same("seller_id", "category"))
        return to_sellers(lines.withColumn("earned", earned), _main_category("earned"))

    def by_name(lines: DataFrame) -> DataFrame:
        merged = lines.groupBy("order_id", "seller_id", "category").agg(*_sums(), *place)
        return to_sellers(merged, _main_category("price"))

    return (
        _merged_by_order(items, lines.join(sellers, "seller_id", "left"), in_place, by_name)
        .withColumns({
            "is_single_seller_order": F.when(F.col("distinct_sellers") == 1, 1).otherwise(0),
            "is_late_handover": flag(
                F.col("order_delivered_carrier_date") > F.col("seller_limit_date")
            ),
        })
        .select(*schemas.mart_columns("order_seller"))
    )


# seller_mart column -> order_seller column whose mean it is
SELLER_MEANS = {
    "delivered_rate": "is_delivered",
    "delay_rate": "is_delayed",
    "bad_review_rate": "is_bad_review",
    "avg_review_score": "review_score",
    "review_coverage": "has_review",
    "avg_delivery_time_days": "delivery_time_days",
    "avg_handover_time_days": "handover_time_days",
    "avg_transit_time_days": "transit_time_days",
    "late_handover_rate": "is_late_handover",
}


def build_seller_mart(order_seller: DataFrame) -> DataFrame:
    """One row per seller, rolled up from (seller, category) so one pass gives every column.

    Order rows are first merged with the texts as keys: sums of numbers alone merge in place, while a
    largest text among them would have every task sort all its order rows.
    """
    added = [
        "orders", "items", "gmv", "rank_gmv", "freight", "single_seller_orders",
        *[f"{name}__{part}" for part in ("sum", "n") for name in SELLER_MEANS],
    ]
    merged = order_seller.groupBy(
        "seller_id", "product_category_name", "seller_state", "seller_city"
    ).agg(
        F.count("order_id").alias("orders"),
        F.sum("seller_item_count").alias("items"),
        F.sum("seller_price").alias("gmv"),
        F.sum(exact_money(F.col("seller_price"))).alias("rank_gmv"),
        F.sum("seller_freight").alias("freight"),
        F.sum("is_single_seller_order").alias("single_seller_orders"),
        *[F.sum(source).alias(f"{name}__sum") for name, source in SELLER_MEANS.items()],
        *[F.count(source).alias(f"{name}__n") for name, source in SELLER_MEANS.items()],
    )
    by_category = merged.groupBy("seller_id", "product_category_name").agg(
        F.max("seller_state").alias("seller_state"),
        F.max("seller_city").alias("seller_city"),
        *[F.sum(name).alias(name) for name in added],
    )
    best = largest_first(F.col("rank_gmv"), F.col("product_category_name"))
    sellers = by_category.groupBy("seller_id").agg(
        F.max("seller_state").alias("seller_state"),
        F.max("seller_city").alias("seller_city"),
        F.min_by("product_category_name", best).alias("top_category"),
        F.count("product_category_name").alias("distinct_categories"),
        *[
            F.sum(name).alias(name)
            for name in ("orders", "items", "gmv", "freight", "single_seller_orders")
        ],
        *[
            ratio(F.sum(f"{name}__sum"), F.sum(f"{name}__n")).alias(name)
            for name in SELLER_MEANS
        ],
    )
    return sellers.select(*schemas.mart_columns("seller_mart"))
