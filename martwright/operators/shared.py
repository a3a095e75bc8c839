"""Pieces used by several metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martwright.functions.columns import label_of

# Measure -> (aggregate, source column). The orders mart has one row per order, so counting rows
# counts orders without a distinct shuffle.
_MEASURES = {
    "orders": ("count", "*"),
    "gmv": ("sum", "total_price"),
    "aov": ("avg", "total_price"),
    "avg_review_score": ("avg", "review_score"),
    "bad_review_rate": ("avg", "is_bad_review"),
    "delay_rate": ("avg", "is_delayed"),
    "late_handover_rate": ("avg", "is_late_handover"),
    "avg_delivery_time_days": ("avg", "delivery_time_days"),
    "avg_delay_days": ("avg", "delay_days"),
    "avg_handover_time_days": ("avg", "handover_time_days"),
    "avg_transit_time_days": ("avg", "transit_time_days"),
    "avg_freight_share": ("avg", "freight_share"),
}


def measures(names: str, **sources: str) -> list[Column]:
    """Named aggregates, in the given order; sources replace the source column of a measure."""
    result = []
    for name in names.split():
        function, source = _MEASURES[name]
        result.append(getattr(F, function)(sources.get(name, source)).alias(name))
    return result


def all_segments():
    """Window over all rows of an aggregated table. Only for segment-grain tables (months, buckets,
    categories, states, tests), never for rows that grow with the orders or the sellers."""
    return Window.partitionBy()


def label_rows(spark: SparkSession, texts: Sequence[str], key: str, label: str) -> DataFrame:
    """One row per fixed label: (key, label), keys in label order."""
    return spark.range(0, len(texts), 1, 1).select(
        F.col("id").cast("int").alias(key), label_of(F.col("id").cast("int"), texts).alias(label)
    )


def complete_labels(labels: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The table with a row for every label, empty ones included.

    The label side has a handful of literal rows; the table side is already aggregated by label.
    """
    return labels.join(F.broadcast(table), key, "left")


def keep_or_all(segments: DataFrame, condition: Column) -> DataFrame:
    """Segments that meet the condition; all of them if none does."""
    passes = F.coalesce(condition, F.lit(False))
    return (
        segments.withColumn("_passes", passes)
        .withColumn("_any", F.max("_passes").over(all_segments()))
        .where("_passes OR NOT _any")
        .drop("_passes", "_any")
    )


def pooled(hits: str, trials: str) -> Column:
    """Rate over all segments of an aggregated table."""
    total = F.sum(trials).over(all_segments())
    return F.when(total > 0, F.sum(hits).over(all_segments()) / total)


def rounded(table: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded half to even, for output only."""
    doubles = [name for name, kind in table.dtypes if kind == "double"]
    return table.withColumns({name: half_even(name, digits) for name in doubles})


def half_even(name: str, digits: int) -> Column:
    """A double rounded half to even. Ten places first: in a mean that ends in a half, the last bits,
    which depend on the order of addition, would decide."""
    return F.bround(F.round(name, 10), digits)
