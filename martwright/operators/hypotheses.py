"""The hypothesis table: one row per tested hypothesis, with joint false-discovery control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright import labels as L
from martwright.functions.columns import effect_magnitude
from martwright.functions.pvalues import short_number, tail_p
from martwright.operators import inference

COLUMNS = (
    "hypothesis test scope metric_1 value_1 ci_low_1 ci_high_1 metric_2 value_2 ci_low_2 "
    "ci_high_2 n_observations statistic effect_size_name effect_size effect_magnitude p_value "
    "p_value_adjusted significant interpretation"
).split()

MIN_SEGMENT_ORDERS = 30


def _text(value: str) -> str:
    quoted = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{quoted}'"


def _layout(
    tested: DataFrame,
    names: Sequence[str],
    test: str,
    first: Sequence[str],
    second: Sequence[str],
    statistic: str,
    effect: tuple[str, str],
    tail: tuple[str, str, str],
    scope: str | None = None,
) -> DataFrame:
    """Common columns of rows whose `hypothesis` is one of the names.

    first and second are (value, low, high), tail is (kind, statistic, degrees of freedom), all as
    SQL over the columns of the tested rows.
    """

    def fixed(part: int) -> str:
        cases = " ".join(f"WHEN '{n}' THEN {_text(L.HYPOTHESES[n][part])}" for n in names)
        return f"CASE hypothesis {cases} END"

    order = " ".join(f"WHEN '{n}' THEN {L.HYPOTHESIS_ORDER.index(n)}" for n in names)
    ends = ("value", "ci_low", "ci_high")
    return tested.selectExpr(
        f"CASE hypothesis {order} END AS position",
        f"{fixed(0)} AS statement",
        f"{_text(test)} AS test",
        f"{scope or fixed(1)} AS scope",
        f"{fixed(2)} AS metric_1",
        *[f"double({each}) AS {end}_1" for each, end in zip(first, ends)],
        f"{fixed(3)} AS metric_2",
        *[f"double({each}) AS {end}_2" for each, end in zip(second, ends)],
        "n_observations",
        f"double({statistic}) AS statistic",
        f"{_text(effect[0])} AS effect_size_name",
        f"double({effect[1]}) AS effect_size",
        f"'{tail[0]}' AS tail_kind",
        f"double({tail[1]}) AS tail_statistic",
        f"double({tail[2]}) AS tail_dof",
    ).where("tail_statistic IS NOT NULL").withColumnRenamed("statement", "hypothesis")


_NO_INTERVAL = ("NULL", "NULL")


def _order_tests(mart: DataFrame) -> list[DataFrame]:
    """Six tests over one stacked count of the orders."""
    counts = inference.stacked_counts(mart, MIN_SEGMENT_ORDERS)

    def only(*names: str) -> DataFrame:
        return counts.where(F.col("test").isin(*names))

    chi_square = ("chi-square", "statistic", "dof")
    pairs = inference.two_groups(only("H1", "H7"), ["test"]).withColumnRenamed(
        "test", "hypothesis"
    )
    segments = inference.chi_square(only("H4", "H5"), ["test"]).withColumnRenamed(
        "test", "hypothesis"
    )
    scores = inference.rank_sum_test(only("H2")).withColumn("hypothesis", F.lit("H2"))
    buckets = inference.trend(only("H8")).withColumn("hypothesis", F.lit("H8"))
    return [
        _layout(
            pairs, ("H1", "H7"), L.CHI_SQUARE_TEST,
            ("rate_1", "ci_low_1", "ci_high_1"), ("rate_0", "ci_low_0", "ci_high_0"),
            "statistic", (L.CRAMERS_V, "effect_size"), chi_square,
        ),
        _layout(
            segments, ("H4", "H5"), L.CHI_SQUARE_TEST,
            ("n_groups", *_NO_INTERVAL), (str(MIN_SEGMENT_ORDERS), *_NO_INTERVAL),
            "statistic", (L.CRAMERS_V, "effect_size"), chi_square,
        ),
        _layout(
            scores, ("H2",), L.RANK_SUM_TEST,
            ("mean_1", "ci_low_1", "ci_high_1"), ("mean_2", "ci_low_2", "ci_high_2"),
            "statistic", (L.RANK_BISERIAL, "effect_size"), ("known", "p_value", "0"),
        ),
        _layout(
            buckets, ("H8",), L.TREND_TEST,
            ("rate_first", *_NO_INTERVAL), ("rate_last", *_NO_INTERVAL),
            "z", (L.BUCKET_RHO, "rho"), ("normal", "z", "0"),
        ),
    ]


def _freight_test(mart: DataFrame) -> DataFrame:
    return _layout(
        inference.freight_score_test(mart).withColumn("hypothesis", F.lit("H3")),
        ("H3",), L.SPEARMAN_TEST,
        ("rho", "ci_low", "ci_high"), ("n_observations", *_NO_INTERVAL),
        "rho", (L.SPEARMAN_RHO, "rho"), ("student", "t", "dof"),
    )


def _focal_category_test(
    order_seller: DataFrame, min_seller_orders: int = 30, single_seller_only: bool = True, **options
) -> DataFrame:
    """The seller test of the category with most observations. Its table is rounded first."""
    tests = inference.seller_heterogeneity(
        order_seller, min_seller_orders, single_seller_only=single_seller_only, **options
    )
    population = L.SINGLE_SELLER if single_seller_only else L.ANY_SELLER
    focal = tests.orderBy(F.desc("n_observations"), "product_category_name").limit(1)
    rounded = focal.withColumns({
        name: F.bround(name, 6) for name, kind in focal.dtypes if kind == "double"
    })
    return _layout(
        rounded.withColumn("hypothesis", F.lit("H6")),
        ("H6",), L.CHI_SQUARE_TEST,
        ("n_sellers", *_NO_INTERVAL),
        ("category_bad_review_rate", "min_seller_bad_review_rate", "max_seller_bad_review_rate"),
        "statistic", (L.CRAMERS_V, "effect_size"), ("known", "p_value", "0"),
        f"format_string({_text(L.HYPOTHESES['H6'][1])}, {_text(population)}, "
        f"product_category_name, '{min_seller_orders}')",
    )


def hypothesis_table(mart: DataFrame, order_seller: DataFrame, **seller_options) -> DataFrame:
    """All testable hypotheses in report order; seller_options go to the seller test."""
    parts = [
        *_order_tests(mart),
        _freight_test(mart),
        _focal_category_test(order_seller, **seller_options),
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    p = tail_p(F.col("tail_kind"), F.col("tail_statistic"), F.col("tail_dof"))
    return (
        inference.adjust_p(table.withColumn("p_value", p))
        .withColumn("effect_magnitude", effect_magnitude(F.col("effect_size")))
        .withColumn("interpretation", _interpretation())
        .orderBy("position")
        .select(*COLUMNS)
    )


def _interpretation() -> Column:
    verdict = F.when(F.col("significant"), L.SIGNIFICANT).otherwise(L.NOT_SIGNIFICANT)
    sentence = F.format_string(
        L.INTERPRETATION,
        verdict,
        short_number(F.col("p_value_adjusted"), F.lit(4)),
        F.col("effect_magnitude"),
        F.col("effect_size_name"),
        short_number(F.col("effect_size"), F.lit(3)),
    )
    return F.when(F.col("p_value").isNull(), L.NOT_TESTED).otherwise(sentence)
