"""Column names and types of the raw tables and marts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "ts": T.TimestampNTZType(),
}


def _schema(**groups: str) -> dict[str, T.DataType]:
    return {name: _TYPES[kind] for kind, names in groups.items() for name in names.split()}


RAW: dict[str, dict[str, T.DataType]] = {
    "raw_customers": _schema(string="customer_id customer_unique_id customer_city customer_state"),
    "raw_orders": _schema(
        string="order_id customer_id order_status",
        ts="order_purchase_timestamp order_approved_at order_delivered_carrier_date "
        "order_delivered_customer_date order_estimated_delivery_date",
    ),
    "raw_order_items": _schema(
        string="order_id product_id seller_id", int="order_item_id",
        double="price freight_value", ts="shipping_limit_date",
    ),
    "raw_order_payments": _schema(
        string="order_id payment_type", double="payment_value", int="payment_installments"
    ),
    "raw_order_reviews": _schema(string="order_id", int="review_score"),
    "raw_products": _schema(string="product_id product_category_name"),
    "raw_sellers": _schema(string="seller_id seller_state seller_city"),
    "raw_category_translation": _schema(
        string="product_category_name product_category_name_english"
    ),
}

# Keys that must be unique, or the left joins of the marts would repeat rows.
RAW_KEYS = {
    "raw_customers": "customer_id",
    "raw_orders": "order_id",
    "raw_products": "product_id",
    "raw_sellers": "seller_id",
    "raw_category_translation": "product_category_name",
}

# Mart columns in order. A type of the form table.column is an id: it has the type of that raw
# column, so that marts follow text ids and numeric ids alike.
MARTS: dict[str, dict[str, str]] = {
    "orders_mart": {
        "order_id": "raw_orders.order_id",
        "customer_id": "raw_orders.customer_id",
        "customer_unique_id": "raw_customers.customer_unique_id",
        "order_status": "string",
        "order_purchase_timestamp": "ts",
        "order_approved_at": "ts",
        "order_delivered_carrier_date": "ts",
        "order_delivered_customer_date": "ts",
        "order_estimated_delivery_date": "ts",
        "order_year_month": "string",
        "customer_city": "string",
        "customer_state": "string",
        "main_seller_id": "raw_order_items.seller_id",
        "seller_state": "string",
        "product_category_name": "string",
        "is_mixed_category": "int",
        "order_item_count": "long",
        "distinct_products": "long",
        "distinct_sellers": "long",
        "distinct_categories": "long",
        "total_price": "double",
        "total_freight": "double",
        "payment_value": "double",
        "payment_count": "long",
        "max_installments": "int",
        "main_payment_type": "string",
        "review_score": "double",
        "min_review_score": "int",
        "review_count": "long",
        "has_review": "int",
        "is_bad_review": "int",
        "is_delivered": "int",
        "is_cancelled": "int",
        "delivery_time_days": "double",
        "estimated_delivery_time_days": "double",
        "delay_days": "double",
        "is_delayed": "int",
        "freight_share": "double",
        "approval_time_days": "double",
        "handover_time_days": "double",
        "transit_time_days": "double",
        "is_late_handover": "int",
        "seller_overrun_days": "double",
        "transit_overrun_days": "double",
    },
    "order_seller": {
        "order_id": "raw_order_items.order_id",
        "seller_id": "raw_order_items.seller_id",
        "seller_state": "string",
        "seller_city": "string",
        "product_category_name": "string",
        "seller_item_count": "long",
        "seller_price": "double",
        "seller_freight": "double",
        "distinct_sellers": "long",
        "is_single_seller_order": "int",
        "order_year_month": "string",
        "order_purchase_timestamp": "ts",
        "customer_state": "string",
        "is_delivered": "int",
        "is_cancelled": "int",
        "is_delayed": "int",
        "delivery_time_days": "double",
        "handover_time_days": "double",
        "transit_time_days": "double",
        "review_score": "double",
        "is_bad_review": "int",
        "has_review": "int",
        "is_late_handover": "int",
    },
    "seller_mart": {
        "seller_id": "raw_order_items.seller_id",
        "seller_state": "string",
        "seller_city": "string",
        "top_category": "string",
        "orders": "long",
        "items": "long",
        "distinct_categories": "long",
        "gmv": "double",
        "freight": "double",
        "single_seller_orders": "long",
        "delivered_rate": "double",
        "delay_rate": "double",
        "bad_review_rate": "double",
        "avg_review_score": "double",
        "review_coverage": "double",
        "avg_delivery_time_days": "double",
        "avg_handover_time_days": "double",
        "avg_transit_time_days": "double",
        "late_handover_rate": "double",
    },
}


def mart_columns(name: str) -> list[str]:
    return list(MARTS[name])


def mart_schema(name: str, raw: dict[str, DataFrame]) -> T.StructType:
    """Schema of a stored mart built from the given raw tables."""

    def kind(text: str) -> T.DataType:
        if text in _TYPES:
            return _TYPES[text]
        table, column = text.split(".")
        return raw[table].schema[column].dataType

    return T.StructType([T.StructField(c, kind(text)) for c, text in MARTS[name].items()])


def raw_schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in RAW[table].items()])


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """The same DataFrame, or an error that lists every absent column."""
    absent = [name for name in columns if name not in df.columns]
    if absent:
        raise ValueError(f"{what} lacks columns: {', '.join(absent)}")
    return df


_SEGMENT_RESULT = """
    orders long, gmv double, aov double, avg_review_score double, bad_review_rate double,
    delay_rate double, avg_delivery_time_days double"""
_POSTHOC_RESULT = """
    orders long, rate double, rate_ci_low double, rate_ci_high double, overall_rate double,
    rate_diff double, direction string, statistic double, p_value double,
    p_value_adjusted double, significant boolean"""

# Written result tables, in DDL. The type of seller_id is that of the source.
RESULTS: dict[str, str] = {
    "metrics_summary": """
        total_orders long, delivered_orders long, cancelled_orders long, reviewed_orders long,
        review_coverage double, gmv double, aov double, avg_review_score double,
        bad_review_rate double, delay_rate double, avg_delivery_time_days double,
        avg_delay_days double, avg_freight_share double, cancelled_rate double,
        repeat_purchase_rate double""",
    "category_metrics": f"product_category_name string, {_SEGMENT_RESULT}, avg_freight_share double",
    "customer_state_metrics": f"customer_state string, {_SEGMENT_RESULT}, avg_freight_share double",
    "seller_state_metrics": f"seller_state string, {_SEGMENT_RESULT}, avg_freight_share double",
    "monthly_metrics": f"order_year_month string, {_SEGMENT_RESULT}",
    "delay_bucket_metrics": """
        delay_bucket string, orders long, reviewed_orders long, bad_review_rate double,
        bad_review_rate_ci_low double, bad_review_rate_ci_high double, avg_review_score double""",
    "delay_stage_breakdown": """
        delay_stage string, delayed_orders long, share_of_delayed double, avg_delay_days double,
        bad_review_rate double, avg_review_score double""",
    "seller_metrics": """
        seller_id {seller_id}, seller_state string, top_category string, orders long, items long,
        single_seller_orders long, distinct_categories long, gmv double, delay_rate double,
        late_handover_rate double, bad_review_rate double, avg_review_score double,
        review_coverage double, avg_delivery_time_days double, avg_handover_time_days double,
        avg_transit_time_days double""",
    "seller_category_comparison": """
        product_category_name string, seller_id {seller_id}, n_sellers_in_category long,
        orders long, bad_review_rate double, bad_review_rate_ci_low double,
        bad_review_rate_ci_high double, category_bad_review_rate double,
        bad_review_rate_diff double, delay_rate double, late_handover_rate double,
        avg_review_score double, avg_handover_time_days double, avg_transit_time_days double""",
    "category_posthoc": f"product_category_name string, {_POSTHOC_RESULT}",
    "state_posthoc": f"customer_state string, {_POSTHOC_RESULT}",
    "seller_within_category_tests": """
        product_category_name string, n_sellers long, n_observations long,
        category_bad_review_rate double, min_seller_bad_review_rate double,
        max_seller_bad_review_rate double, statistic double, effect_size_name string,
        effect_size double, effect_magnitude string, p_value double, p_value_adjusted double,
        significant boolean""",
    "hypothesis_tests": """
        hypothesis string, test string, scope string, metric_1 string, value_1 double,
        ci_low_1 double, ci_high_1 double, metric_2 string, value_2 double, ci_low_2 double,
        ci_high_2 double, n_observations long, statistic double, effect_size_name string,
        effect_size double, effect_magnitude string, p_value double, p_value_adjusted double,
        significant boolean, interpretation string""",
}


def result_schema(name: str, seller_id: str = "string") -> T.StructType:
    """Schema of a written result table."""
    return T.StructType.fromDDL(RESULTS[name].replace("{seller_id}", seller_id))
