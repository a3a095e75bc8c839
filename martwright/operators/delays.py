"""Delay buckets, delay attribution and delivery stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright import labels as L
from martwright.functions.columns import delay_bucket, delay_stage, label_of, ratio, wilson_interval
from martwright.operators.shared import (
    all_segments,
    complete_labels,
    label_rows,
    measures,
)


def delay_buckets(mart: DataFrame) -> DataFrame:
    """Bad-review share by length of the delay, with interval; empty buckets stay."""
    reviewed = F.col("is_bad_review").isNotNull()
    buckets = (
        mart.withColumn("bucket_id", delay_bucket())
        .where(F.col("bucket_id").isNotNull())
        .groupBy("bucket_id")
        .agg(
            *measures("orders"),
            F.count("is_bad_review").alias("reviewed_orders"),
            F.sum("is_bad_review").alias("_bad"),
            F.avg(F.when(reviewed, F.col("review_score"))).alias("avg_review_score"),
        )
    )
    labels = label_rows(mart.sparkSession, L.DELAY_BUCKETS, "bucket_id", "delay_bucket")
    low, high = wilson_interval("_bad", "reviewed_orders")
    return (
        complete_labels(labels, buckets, "bucket_id")
        .withColumns({
            name: F.coalesce(name, F.lit(0)) for name in ("orders", "reviewed_orders", "_bad")
        })
        .withColumn("_all", F.sum("orders").over(all_segments()))
        .where("_all > 0")
        .select(
            "bucket_id", "delay_bucket", "orders", "reviewed_orders",
            ratio(F.col("_bad"), F.col("reviewed_orders")).alias("bad_review_rate"),
            F.expr(low).alias("bad_review_rate_ci_low"),
            F.expr(high).alias("bad_review_rate_ci_high"),
            "avg_review_score",
        )
        .orderBy("bucket_id")
    )


def delay_stages(mart: DataFrame) -> DataFrame:
    """Delayed orders by the stage that overran: seller, transport, both."""
    reviewed = F.col("is_bad_review").isNotNull()
    delayed = mart.where(
        (F.col("is_delayed") == 1)
        & F.col("seller_overrun_days").isNotNull()
        & F.col("transit_overrun_days").isNotNull()
    )
    return (
        delayed.withColumn("stage_id", delay_stage())
        .groupBy("stage_id")
        .agg(
            F.count("*").alias("delayed_orders"),
            F.avg("delay_days").alias("avg_delay_days"),
            F.avg("is_bad_review").alias("bad_review_rate"),
            F.avg(F.when(reviewed, F.col("review_score"))).alias("avg_review_score"),
        )
        .select(
            "stage_id",
            label_of(F.col("stage_id"), L.DELAY_STAGES).alias("delay_stage"),
            "delayed_orders",
            (F.col("delayed_orders") / F.sum("delayed_orders").over(all_segments())).alias(
                "share_of_delayed"
            ),
            "avg_delay_days", "bad_review_rate", "avg_review_score",
        )
        .orderBy("stage_id")
    )


def stage_decomposition(rows: DataFrame, one_per_order: bool = False) -> DataFrame:
    """Mean seller and transport days by delay group, from orders or order-and-seller rows.

    Delivered orders whose delay is unknown count as not delayed. An order occurs once per seller
    in order-and-seller rows, so orders are counted as distinct ids, unless there is one row each.
    """
    orders = F.count("*") if one_per_order else F.countDistinct("order_id")
    late = F.coalesce((F.col("is_delayed") == 1).cast("int"), F.lit(0))
    return (
        rows.where(F.col("is_delivered") == 1)
        .withColumn("group_id", late)
        .groupBy("group_id")
        .agg(
            F.avg("handover_time_days").alias("handover"),
            F.avg("transit_time_days").alias("transit"),
            orders.alias("orders"),
        )
        .select(
            "group_id",
            label_of(F.col("group_id"), (L.NOT_DELAYED, L.DELAYED)).alias("delay_group"),
            "handover", "transit", "orders",
        )
        .orderBy("group_id")
    )
