"""The sets of result tables that a full run delivers."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.operators import delays, hypotheses, inference, reports, segments, sellers
from martwright.operators.prepare import prepare_orders
from martwright.operators.shared import half_even, rounded
from martwright.operators.slices import kpi_summary
from martwright.plans.refresh import Marts
from martwright.schemas import RESULTS, result_schema
from martwright.sources.tables import export_results, path_exists, read_csv_table

# Result tables that are left out when they have no rows.
OPTIONAL = {
    "delay_bucket_metrics", "delay_stage_breakdown", "seller_metrics",
    "seller_category_comparison", "category_posthoc", "state_posthoc",
    "seller_within_category_tests",
}


def _metric_plans(marts: Marts) -> dict[str, Callable[[], DataFrame]]:
    """What makes each metric table. Only the marts of the tables in use are touched."""
    return {
        "metrics_summary": lambda: segments.summary_metrics(marts.orders),
        "category_metrics": lambda: segments.segment_metrics(
            marts.orders, "product_category_name"
        ),
        "customer_state_metrics": lambda: segments.segment_metrics(marts.orders, "customer_state"),
        "seller_state_metrics": lambda: segments.segment_metrics(marts.orders, "seller_state"),
        "monthly_metrics": lambda: segments.monthly_metrics(marts.orders),
        "delay_bucket_metrics": lambda: delays.delay_buckets(marts.orders).drop("bucket_id"),
        "delay_stage_breakdown": lambda: delays.delay_stages(marts.orders)
        .drop("stage_id")
        .withColumn("avg_delay_days", half_even("avg_delay_days", 2)),
        "seller_metrics": lambda: sellers.seller_ranking(marts.sellers),
        "seller_category_comparison": lambda: sellers.seller_vs_category(marts.seller_sums),
    }


def _test_plans(marts: Marts) -> dict[str, Callable[[], DataFrame]]:
    return {
        "category_posthoc": lambda: _posthoc_as_written(
            inference.category_posthoc(marts.orders), "product_category_name"
        ),
        "state_posthoc": lambda: _posthoc_as_written(
            inference.state_posthoc(marts.orders), "customer_state"
        ),
        "seller_within_category_tests": lambda: inference.seller_heterogeneity(
            marts.seller_sums
        ).drop("dof"),
        "hypothesis_tests": lambda: hypotheses.hypothesis_table(marts.orders, marts.seller_sums),
    }


def _made(
    plans: dict[str, Callable[[], DataFrame]], names: Collection[str] | None, digits: int
) -> dict[str, DataFrame]:
    return {
        name: rounded(make(), digits)
        for name, make in plans.items() if names is None or name in names
    }


def metric_tables(
    marts: Marts, names: Collection[str] | None = None
) -> dict[str, DataFrame]:
    """Metric tables (the named ones, else all), rounded to four places; the mean delay of a stage
    to two."""
    return _made(_metric_plans(marts), names, 4)


def test_tables(marts: Marts, names: Collection[str] | None = None) -> dict[str, DataFrame]:
    """Hypothesis tests and post-hoc comparisons (the named ones, else all), rounded to six places;
    rates and statistics of the post-hoc tables to four, sorted by the rounded difference."""
    return _made(_test_plans(marts), names, 6)


def _posthoc_as_written(table: DataFrame, segment: str) -> DataFrame:
    short = "rate rate_ci_low rate_ci_high overall_rate rate_diff statistic".split()
    written = table.withColumns({name: half_even(name, 4) for name in short})
    return written.orderBy(F.desc("rate_diff"), segment)


def report_tables(marts: Marts, min_orders: int = 50, top: int = 15) -> dict[str, DataFrame]:
    """The data of the report: KPIs and the table behind each figure."""
    orders = prepare_orders(marts.orders)
    return {
        "kpi": kpi_summary(orders),
        "01_monthly_overview": segments.monthly_trend(orders),
        "02_gmv_monthly": segments.monthly_trend(orders).select("order_month", "gmv", "aov"),
        "03_review_distribution": reports.score_distribution(orders, complete=False),
        "04_delay_vs_review": reports.delay_group_profile(orders),
        "05_category_priority_matrix": segments.category_priority(orders, min_orders),
        "06_top_category_risk": segments.top_category_risk(orders, min_orders, top),
        "07_state_experience_matrix": segments.state_metrics(orders, min_orders),
        "08_freight_share": segments.freight_share_bins(orders),
        "09_payment_type": segments.payment_metrics(orders),
        "10_seller_customer_heatmap": reports.lane_matrix(orders, max(20, min_orders // 2)),
    }


def save_results(
    marts: Marts, folder: str, names: Collection[str] | None = None
) -> list[str]:
    """Writes the named metric and test tables, else all, as CSV folders; returns the names written."""
    made = {**metric_tables(marts, names), **test_tables(marts, names)}
    return export_results(made, folder, OPTIONAL)


def read_results(
    spark: SparkSession, folder: str, seller_id: str = "string",
    names: Collection[str] | None = None,
) -> dict[str, DataFrame]:
    """The named result tables, else all, of a folder that save_results wrote, typed; seller_id is the
    type of that column. Optional tables that were left out are empty; absent others are an error that
    names them."""
    found, absent = {}, []
    for name in RESULTS if names is None else names:
        path, schema = f"{folder.rstrip('/')}/{name}", result_schema(name, seller_id)
        if path_exists(spark, path):
            found[name] = read_csv_table(spark, path, schema)
        elif name in OPTIONAL:
            found[name] = spark.createDataFrame([], schema)
        else:
            absent.append(path)
    if absent:
        raise FileNotFoundError("result tables not found:\n" + "\n".join(absent))
    return found
