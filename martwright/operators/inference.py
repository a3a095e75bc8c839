"""Statistical tests as DataFrames.

Almost every test here is a statistic of a table with one row per group and two outcomes: x (the
group, where it has an order), n (rows) and hits (rows with the outcome). A distributed aggregate
yields that table; the closed formulas run on it, for one table or for many at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martwright import labels as L
from martwright.functions.columns import (
    correlation_interval,
    delay_bucket,
    effect_magnitude,
    finite,
    mean_interval,
    ratio,
    wilson_interval,
)
from martwright.functions.pvalues import rank_sum_p, tail_p
from martwright.operators.ranks import weighted_rank_correlation, with_positions
from martwright.operators.sellers import per_seller
from martwright.operators.shared import all_segments


def outcome_counts(rows: DataFrame, group: str | Sequence[str], outcome: str) -> DataFrame:
    """(group.., n, hits) over rows whose group and 0/1 outcome are known."""
    keys = [group] if isinstance(group, str) else list(group)
    known = rows.where(F.col(outcome).isNotNull())
    return known.dropna(subset=keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(outcome).alias("hits")
    )


def _grouped(counts: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    return counts.groupBy(*by).agg(*[F.expr(each) for each in sums])


_TOTALS = ["coalesce(sum(n), 0) AS n_observations", "sum(hits) AS n_hits"]


def chi_square(
    counts: DataFrame, by: Sequence[str] = (), extra: Sequence[str] = ()
) -> DataFrame:
    """Independence of group and outcome, one row per table; extra are further aggregates.

    For two outcomes the statistic needs only sums over the groups, so it is one aggregate however
    many groups there are. A two by two table takes the continuity correction: all four cells then
    differ from expectation by the same amount, the gap, which the sums also give. Without a second
    group or both outcomes the statistic is NULL. The effect is Cramér's V.
    """
    sums = [
        "count(*) AS n_groups", *_TOTALS,
        "sum(double(hits) * hits / n) AS _between",
        "sum(double(n) * n) AS _squares",
        *extra,
    ]
    return _grouped(counts, by, sums).selectExpr(
        "*",
        """CASE WHEN n_groups >= 2 AND n_hits > 0 AND n_hits < n_observations
                THEN double(n_observations) END AS _total""",
        "n_hits / _total AS _rate",
        "greatest(_between - n_hits * _rate, 0D) / (_rate * (1 - _rate)) AS _plain",
        """sqrt(_plain * (_total * _total - _squares) / 2 * _rate * (1 - _rate) / _total)
           AS _gap""",
        """CASE WHEN n_groups <> 2 THEN _plain
                WHEN _gap > 0.5D THEN _plain * power((_gap - 0.5D) / _gap, 2)
                WHEN _gap >= 0 THEN 0D END AS statistic""",
        "sqrt(statistic / _total) AS effect_size",
        "double(n_groups - 1) AS dof",
    ).drop("_between", "_squares", "_total", "_rate", "_plain", "_gap")


def two_groups(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Chi-square with n, hits, rate and interval of the groups 1 and 0 where x is one of them."""
    parts = [
        f"max(CASE WHEN x = {which} THEN {name} END) AS {name}_{which}"
        for which in (1, 0)
        for name in ("n", "hits")
    ]
    rates = []
    for which in (1, 0):
        low, high = wilson_interval(f"hits_{which}", f"n_{which}")
        rates += [
            f"CASE WHEN n_{which} > 0 THEN hits_{which} / n_{which} END AS rate_{which}",
            f"{low} AS ci_low_{which}", f"{high} AS ci_high_{which}",
        ]
    return chi_square(counts, by, parts).selectExpr("*", *rates)


# A sample of at most this size, and no ties: U follows its exact law, else a normal one.
SMALL_SAMPLE = 8


def rank_sum(
    counts: DataFrame,
    cuts: Sequence[float] | None = (),
    extra: Sequence[str] = (),
    by: Sequence[str] = (),
) -> DataFrame:
    """Mann-Whitney U of two samples from rows (by.., x, n, hits): at most one row per group.

    hits counts the first sample, n - hits the second; x is the value that both are ranked by. U
    belongs to the first sample. z is the tie-corrected normal approximation with continuity
    correction; rho is the Spearman correlation of value and sample. All follow from the rank sum
    and the ties. is_exact tells whether the exact law of U applies: one sample is small and no
    value occurs twice. extra are further aggregates.
    """
    sums = [
        *_TOTALS,
        "sum(hits * average_rank) AS _ranks",
        "sum(double(n) * n * n - n) AS _ties",
        "sum(hits * double(x)) AS _sum1",
        "sum((n - hits) * double(x)) AS _sum2",
        "sum(hits * double(x) * x) AS _squares1",
        "sum((n - hits) * double(x) * x) AS _squares2",
        *extra,
    ]
    means = []
    for i in (1, 2):
        low, high = mean_interval(f"mean_{i}", f"_sd{i}", f"_n{i}")
        means += [
            f"_sum{i} / _n{i} AS mean_{i}",
            f"""CASE WHEN _n{i} > 1 THEN sqrt(
                greatest(_squares{i} - _sum{i} * mean_{i}, 0D) / (_n{i} - 1)) END AS _sd{i}""",
            f"{low} AS ci_low_{i}", f"{high} AS ci_high_{i}",
        ]
    both = "n_hits > 0 AND n_hits < n_observations"
    result = _grouped(with_positions(counts, "x", cuts, by), by, sums).where(both).selectExpr(
        "*",
        "n_hits AS n1", "n_observations - n_hits AS n2",
        "double(n_observations) AS _n", "double(n1) AS _n1", "double(n2) AS _n2",
        "_ranks - _n1 * (_n1 + 1) / 2 AS statistic",
        "_n * _n * _n - _n - _ties AS _spread",
        "greatest(abs(statistic - _n1 * _n2 / 2) - 0.5D, 0D) AS _beyond",
        """CASE WHEN _spread > 0
                THEN _beyond / sqrt(_n1 * _n2 * _spread / (_n * (_n - 1) * 12))
                ELSE 0D END AS z""",
        "1 - 2 * statistic / (_n1 * _n2) AS effect_size",
        """CASE WHEN _spread > 0 THEN (_ranks - _n1 * (_n + 1) / 2) * sqrt(_n)
                / (sqrt(_n1 * _n2) * sqrt(_spread / 12)) END AS rho""",
        f"_ties = 0 AND least(n1, n2) <= {SMALL_SAMPLE} AS is_exact",
        *means,
    )
    return result.drop(*[name for name in result.columns if name.startswith("_")])


def rank_sum_test(counts: DataFrame, **options) -> DataFrame:
    """rank_sum with its two-sided p_value: exact for a small sample without ties, else normal."""
    p = rank_sum_p("is_exact", "statistic", "n1", "n2", "z")
    return rank_sum(counts, **options).withColumn("p_value", p)


def trend(counts: DataFrame) -> DataFrame:
    """Cochran-Armitage z for a rising share of hits over x, from rows (x, n, hits): one row.

    NULL-free: without variation there is no row. rate_first and rate_last are the shares of the
    first and last delay bucket; rho correlates group and outcome by rank.
    """
    sums = [
        "sum(x * hits) AS x_hits", "sum(x * n) AS x_n", "sum(double(x) * x * n) AS xx_n",
        "max(CASE WHEN x = 0 THEN hits / n END) AS rate_first",
        f"max(CASE WHEN x = {len(L.DELAY_BUCKETS) - 1} THEN hits / n END) AS rate_last",
    ]
    return rank_sum(counts, (), sums).selectExpr(
        "n_observations", "rate_first", "rate_last", "rho",
        "n1 / n_observations AS p",
        "p * (1 - p) * (xx_n - double(x_n) * x_n / n_observations) AS variance",
        "CASE WHEN variance > 0 THEN (x_hits - x_n * p) / sqrt(variance) END AS z",
    ).where("z IS NOT NULL").select("n_observations", "z", "rate_first", "rate_last", "rho")


# Tests of the orders mart.


def _by_x(counts: DataFrame, group: str) -> DataFrame:
    return counts.withColumnRenamed(group, "x")


def _compared(counts: DataFrame, group: str) -> DataFrame:
    return two_groups(_by_x(counts, group)).where("statistic IS NOT NULL").select(
        "n_observations", "statistic", "dof", "effect_size",
        "rate_1", "ci_low_1", "ci_high_1", "rate_0", "ci_low_0", "ci_high_0",
    )


def delay_review_test(mart: DataFrame) -> DataFrame:
    """Bad reviews of late against on-time orders."""
    return _compared(outcome_counts(mart, "is_delayed", "is_bad_review"), "is_delayed")


def handover_review_test(mart: DataFrame) -> DataFrame:
    """Bad reviews of orders handed over late against on time."""
    counts = outcome_counts(mart, "is_late_handover", "is_bad_review")
    return _compared(counts, "is_late_handover")


def _segment_test(counts: DataFrame, min_orders: int) -> DataFrame:
    tested = chi_square(counts.where(F.col("n") >= min_orders))
    return tested.where(F.col("statistic").isNotNull()).select(
        "n_groups", "n_observations", "statistic", "dof", "effect_size"
    )


def category_review_test(mart: DataFrame, min_orders: int = 30) -> DataFrame:
    """Bad reviews across categories."""
    return _segment_test(
        outcome_counts(mart, "product_category_name", "is_bad_review"), min_orders
    )


def state_delay_test(mart: DataFrame, min_orders: int = 30) -> DataFrame:
    """Delays across customer states."""
    return _segment_test(outcome_counts(mart, "customer_state", "is_delayed"), min_orders)


def delay_score_test(mart: DataFrame) -> DataFrame:
    """Scores of late (first sample) against on-time orders."""
    counts = outcome_counts(mart, "review_score", "is_delayed")
    return rank_sum(_by_x(counts, "review_score")).drop("n_hits", "rho", "is_exact")


def delay_score_tests(mart: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same test within each slice that holds late and on-time orders with a score.

    Rows whose slice is unknown take no part. Orders merge to one row per slice and score before
    they are ranked, so a window holds the distinct scores of a slice, whatever its size.
    """
    counts = _by_x(outcome_counts(mart, [*by, "review_score"], "is_delayed"), "review_score")
    return rank_sum_test(counts, by=by).select(
        *by, "n1", "n2", "n_observations", "mean_1", "mean_2", "statistic", "effect_size", "z",
        "is_exact", "p_value",
    )


def delay_trend_test(mart: DataFrame) -> DataFrame:
    """Share of bad reviews over the delay buckets, and their rank correlation."""
    buckets = mart.withColumn("x", delay_bucket())
    return trend(outcome_counts(buckets, "x", "is_bad_review"))


# Hypothesis -> (grouping column, outcome, whether small groups drop out).
STACKED_TESTS = {
    "H1": ("is_delayed", "is_bad_review", False),
    "H2": ("review_score", "is_delayed", False),
    "H4": ("product_category_name", "is_bad_review", True),
    "H5": ("customer_state", "is_delayed", True),
    "H7": ("is_late_handover", "is_bad_review", False),
    "H8": ("bucket_id", "is_bad_review", False),
}


def stacked_counts(mart: DataFrame, min_orders: int) -> DataFrame:
    """(test, x, n, hits) of all six tables from one scan and one small shuffle."""
    groups = [group for group, _, _ in STACKED_TESTS.values()]
    counted = mart.withColumn("bucket_id", delay_bucket()).groupingSets(
        [[group] for group in groups], *groups
    ).agg(
        F.grouping_id().alias("unused"),
        *[F.count(o).alias(f"{o}__n") for o in ("is_bad_review", "is_delayed")],
        *[F.sum(o).alias(f"{o}__hits") for o in ("is_bad_review", "is_delayed")],
    )
    # grouping_id: one bit per column, first column highest, clear for the column in use
    everything, top = (1 << len(groups)) - 1, len(groups) - 1
    cases = {name: [] for name in ("test", "x", "n", "hits")}
    for position, (name, (group, outcome, large)) in enumerate(STACKED_TESTS.items()):
        grain = everything - (1 << (top - position))
        least = min_orders if large else 1
        when = f"WHEN unused = {grain}"
        cases["test"].append(
            f"{when} AND {group} IS NOT NULL AND {outcome}__n >= {least} THEN '{name}'"
        )
        cases["x"].append(f"{when} THEN {'NULL' if large else f'double({group})'}")
        cases["n"].append(f"{when} THEN {outcome}__n")
        cases["hits"].append(f"{when} THEN {outcome}__hits")
    return counted.selectExpr(
        *[f"CASE {' '.join(parts)} END AS {name}" for name, parts in cases.items()]
    ).where("test IS NOT NULL")


def spearman(
    rows: DataFrame,
    x: str,
    y: str,
    x_cuts: Sequence[float] | None = None,
    y_cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Rank correlation with average ranks, its interval and t: one row.

    Pairs first collapse to distinct (x, y) with counts; cuts are those of with_positions and never
    change the result.
    """
    known = rows.select(finite(F.col(x)).alias("x"), finite(F.col(y)).alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull()
    )
    cells = known.groupBy("x", "y").agg(F.count("*").alias("n"))
    low, high = correlation_interval("rho", "n_observations")
    return weighted_rank_correlation(cells, "x", "y", x_cuts, y_cuts).selectExpr(
        "n AS n_observations", "rho", f"{low} AS ci_low", f"{high} AS ci_high",
        "double(n - 2) AS dof",
        """CASE WHEN dof > 0 AND abs(rho) < 1 THEN rho * sqrt(dof / ((rho + 1) * (1 - rho)))
                WHEN dof > 0 AND rho IS NOT NULL THEN double('inf') END AS t""",
    ).select("n_observations", "rho", "ci_low", "ci_high", "t", "dof")


def freight_score_test(mart: DataFrame, freight_cuts: Sequence[float] | None = None) -> DataFrame:
    """Freight share against score; needs more than ten orders."""
    tested = spearman(mart, "freight_share", "review_score", freight_cuts, ())
    return tested.where(F.col("n_observations") > 10)


def adjust_p(tests: DataFrame, p: str = "p_value") -> DataFrame:
    """Benjamini-Hochberg over the known p-values: p_value_adjusted and significant.

    One row per test, so the windows run over a handful of rows.
    """
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last(p)))
    ranked = tests.withColumns({"_rank": rank, "_tests": F.count(p).over(all_segments())})
    scaled = F.col(p) * F.col("_tests") / F.col("_rank")
    from_largest = Window.orderBy(F.desc_nulls_last("_rank")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    adjusted = F.least(F.lit(1.0), F.min(scaled).over(from_largest))
    return (
        ranked.withColumn("p_value_adjusted", F.when(F.col(p).isNotNull(), adjusted))
        .withColumn("significant", F.coalesce(F.col("p_value_adjusted") < 0.05, F.lit(False)))
        .drop("_rank", "_tests")
    )


def proportion_posthoc(
    rows: DataFrame, group: str, outcome: str, min_orders: int = 100
) -> DataFrame:
    """Each large segment against all other rows: rate, interval, two by two test, adjusted p.

    Totals include small and unknown segments. A segment without a counterpart gets no test.
    """
    known = rows.where(F.col(outcome).isNotNull())
    counts = known.groupBy(group).agg(F.count("*").alias("n"), F.sum(outcome).alias("hits"))
    everything = all_segments()
    with_totals = counts.withColumns({
        "_total": F.sum("n").over(everything), "_all": F.sum("hits").over(everything),
    })
    low, high = wilson_interval("hits", "n")
    tests = with_totals.where(F.col(group).isNotNull() & (F.col("n") >= min_orders)).selectExpr(
        group, "n AS orders", "hits / n AS rate",
        f"{low} AS rate_ci_low", f"{high} AS rate_ci_high",
        "_all / _total AS overall_rate", "rate - overall_rate AS rate_diff",
        f"""CASE WHEN rate > overall_rate THEN '{L.ABOVE_AVERAGE}' ELSE '{L.BELOW_AVERAGE}' END
            AS direction""",
        "double(_total) * n - double(n) * n AS _rows",
        "double(_all) * _total - double(_all) * _all AS _columns",
        "greatest(abs(double(hits) * _total - double(n) * _all) - _total / 2, 0D) AS _beyond",
        """CASE WHEN _rows > 0 AND _columns > 0
                THEN _total * (_beyond / _rows) * (_beyond / _columns) END AS statistic""",
    ).drop("_rows", "_columns", "_beyond")
    p = tail_p(F.lit("chi-square"), F.col("statistic"), F.lit(1.0))
    return adjust_p(tests.withColumn("p_value", p)).orderBy(F.desc("rate_diff"), group)


def category_posthoc(mart: DataFrame, min_orders: int = 100) -> DataFrame:
    return proportion_posthoc(mart, "product_category_name", "is_bad_review", min_orders)


def state_posthoc(mart: DataFrame, min_orders: int = 100) -> DataFrame:
    delivered = mart.where(F.col("is_delivered") == 1)
    return proportion_posthoc(delivered, "customer_state", "is_delayed", min_orders)


def seller_heterogeneity(
    order_seller: DataFrame,
    min_seller_orders: int = 30,
    min_sellers: int = 3,
    single_seller_only: bool = True,
) -> DataFrame:
    """Do sellers of one category differ in bad reviews? One test per category. Takes order-and-seller
    rows or their seller_sums."""
    sellers = per_seller(order_seller, single_seller_only).dropna(subset=["seller_id"]).select(
        "product_category_name", "seller_id", F.col("orders").alias("n"), F.col("bad_reviews").alias("hits")
    )
    tests = chi_square(
        sellers.where(F.col("n") >= min_seller_orders),
        ["product_category_name"],
        [
            "min(hits / n) AS min_seller_bad_review_rate",
            "max(hits / n) AS max_seller_bad_review_rate",
        ],
    ).where((F.col("n_groups") >= min_sellers) & F.col("statistic").isNotNull())
    tests = tests.withColumn(
        "p_value", tail_p(F.lit("chi-square"), F.col("statistic"), F.col("dof"))
    )
    return adjust_p(tests).select(
        "product_category_name",
        F.col("n_groups").alias("n_sellers"),
        "n_observations",
        ratio(F.col("n_hits"), F.col("n_observations")).alias("category_bad_review_rate"),
        "min_seller_bad_review_rate", "max_seller_bad_review_rate",
        "statistic", F.lit(L.CRAMERS_V).alias("effect_size_name"), "effect_size",
        effect_magnitude(F.col("effect_size")).alias("effect_magnitude"),
        "dof", "p_value", "p_value_adjusted", "significant",
    ).orderBy(F.desc("n_observations"), "product_category_name")
