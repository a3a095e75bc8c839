"""The eight raw tables derived from an order-and-lineitem star schema.

That schema has no reviews, payments or delivery dates; they follow from the keys by modular
arithmetic, so any engine can derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_star_schema(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    orders, lineitem = table("orders"), table("lineitem")
    nation = table("nation").select(F.col("n_nationkey"), "n_name", "n_regionkey")
    region = table("region")
    customers = table("customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    suppliers = (
        table("supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    )
    part = table("part")
    return {
        "raw_customers": customers.select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_custkey").alias("customer_unique_id"),
            F.col("c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        ),
        "raw_sellers": suppliers.select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("n_name").alias("seller_state"),
            F.col("r_name").alias("seller_city"),
        ),
        "raw_products": part.selectExpr(
            "p_partkey AS product_id",
            "CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_type END AS product_category_name",
        ),
        "raw_category_translation": part.where("p_type <> 'SMALL'").selectExpr(
            "p_type AS product_category_name",
            "lower(p_type) AS product_category_name_english",
        ).distinct(),
        "raw_order_items": _items(lineitem, orders),
        "raw_orders": _orders(orders),
        "raw_order_payments": _payments(orders),
        "raw_order_reviews": _reviews(orders),
    }


def _items(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    dates = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return lineitem.join(dates, "l_orderkey").selectExpr(
        "l_orderkey AS order_id",
        "l_linenumber AS order_item_id",
        "l_partkey AS product_id",
        "l_suppkey AS seller_id",
        "l_extendedprice AS price",
        "l_extendedprice * abs(l_tax) * 8 AS freight_value",
        "o_orderdate + INTERVAL '1' DAY * (2 + l_suppkey % 7) AS shipping_limit_date",
    )


def _orders(orders: DataFrame) -> DataFrame:
    to_carrier = "INTERVAL '1' HOUR * (30 + (o_orderkey * 37) % 167)"
    in_transit = "INTERVAL '1' HOUR * (24 + (o_orderkey * 53) % 601 + 24 * (o_custkey % 5))"
    return orders.selectExpr(
        "o_orderkey AS order_id",
        "o_custkey AS customer_id",
        """CASE WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderkey % 9 = 4 THEN 'canceled'
                WHEN o_orderstatus = 'O' THEN 'delivered' ELSE 'shipped' END AS order_status""",
        "o_orderdate AS order_purchase_timestamp",
        """CASE WHEN o_orderkey % 101 <> 0
                THEN o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 30) END
           AS order_approved_at""",
        f"""CASE WHEN NOT (o_orderstatus = 'P' AND o_orderkey % 3 = 0)
                 THEN o_orderdate + {to_carrier} END AS order_delivered_carrier_date""",
        f"""CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + {to_carrier} + {in_transit} END
            AS order_delivered_customer_date""",
        "o_orderdate + INTERVAL '1' DAY * (14 + o_orderkey % 11) AS order_estimated_delivery_date",
    )


def _payments(orders: DataFrame) -> DataFrame:
    paid = orders.where("o_orderkey % 211 <> 0")
    first = paid.selectExpr(
        "o_orderkey AS order_id",
        """CASE o_orderkey % 4 WHEN 0 THEN 'boleto' WHEN 3 THEN 'debit_card'
           ELSE 'credit_card' END AS payment_type""",
        "CAST(1 + o_orderkey % 10 AS INT) AS payment_installments",
        "CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 0.4D ELSE o_totalprice END"
        " AS payment_value",
    )
    second = paid.where("o_orderkey % 5 = 0").selectExpr(
        "o_orderkey AS order_id",
        "'voucher' AS payment_type",
        "1 AS payment_installments",
        "o_totalprice * 0.6D AS payment_value",
    )
    return first.unionByName(second)


def _reviews(orders: DataFrame) -> DataFrame:
    late = """(o_orderkey * 37) % 167 + (o_orderkey * 53) % 601 + 24 * (o_custkey % 5) + 54
              > 24 * (14 + o_orderkey % 11)"""
    lost = f"CASE WHEN o_orderstatus = 'P' THEN 1 WHEN {late} THEN 2 ELSE 0 END"
    first = orders.where("o_orderkey % 20 <> 0").selectExpr(
        "o_orderkey AS order_id",
        f"CAST(greatest(1, least(5, 5 - (o_orderkey * 31) % 3 - {lost})) AS INT) AS review_score",
    )
    second = orders.where("o_orderkey % 25 = 1").selectExpr(
        "o_orderkey AS order_id", "2 AS review_score"
    )
    return first.unionByName(second)
