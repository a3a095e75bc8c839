"""Statistics against textbook values and brute force."""

import itertools
import math
import random
from fractions import Fraction

import pytest
from martwright.functions import pvalues
from martwright.operators import inference, ranks
from martwright.operators.shared import rounded
from pyspark.sql import functions as F


def table(spark, rows):
    return spark.createDataFrame(rows, "x double, n long, hits long")


def average_ranks(values):
    return [
        sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values
    ]


def pearson(a, b):
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    sab = sum((x - ma) * (y - mb) for x, y in zip(a, b))
    return sab / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))


# tails


@pytest.mark.parametrize("statistic, dof, expected", [
    (3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05),
    (18.307038053275146, 10, 0.05), (124.34211340400407, 100, 0.05),
    (0.0, 3, 1.0), (1.0, 4, 0.9097959895689501), (50.0, 2, math.exp(-25)),
])
def test_chi_square_tail(statistic, dof, expected):
    assert pvalues.chi_square_tail(statistic, dof) == pytest.approx(expected, rel=1e-9)


def test_chi_square_tail_for_even_dof_is_a_poisson_sum():
    for dof, x in itertools.product((2, 6, 40, 300), (0.5, 5.0, 40.0, 350.0)):
        terms = [math.exp(-x / 2 + k * math.log(x / 2) - math.lgamma(k + 1))
                 for k in range(dof // 2)]
        assert pvalues.chi_square_tail(x, dof) == pytest.approx(math.fsum(terms), rel=1e-8)


@pytest.mark.parametrize("t, dof, expected", [
    (12.706204736432095, 1, 0.05), (2.228138851964939, 10, 0.05),
    (1.9839715184496334, 100, 0.05), (0.0, 7, 1.0), (math.inf, 5, 0.0),
    (1.0, 1, 0.5), (2.0, 2, 1 - 2 / math.sqrt(6)),
])
def test_student_two_sided(t, dof, expected):
    assert pvalues.student_two_sided(t, dof) == pytest.approx(expected, rel=1e-9, abs=1e-15)


def test_student_approximation_joins_the_exact_tail():
    for t in (0.3, 2.0, 6.0):
        assert pvalues.student_two_sided(t, 1e6) == pytest.approx(
            pvalues.student_two_sided(t, 1e6 + 1), rel=1e-5
        )


def test_normal_two_sided():
    assert pvalues.normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-12)


# chi-square


def cells_chi_square(counts):
    total, hits = sum(n for n, _ in counts), sum(h for _, h in counts)
    result = 0.0
    for n, h in counts:
        for observed, share in ((h, hits / total), (n - h, 1 - hits / total)):
            expected = n * share
            gap = abs(observed - expected)
            if len(counts) == 2:
                gap -= min(0.5, gap)
            result += gap * gap / expected
    return result


@pytest.mark.parametrize("counts", [
    [(40, 12), (60, 30)], [(10, 5), (10, 5)], [(101, 50), (99, 50)], [(9, 4), (8, 4)],
    [(30, 3), (40, 9), (50, 21)], [(100, 10), (7, 6), (13, 0), (80, 40)],
])
def test_chi_square_equals_the_sum_over_cells(spark, counts):
    rows = [(float(i), n, h) for i, (n, h) in enumerate(counts)]
    row = inference.chi_square(table(spark, rows)).first()
    assert row.statistic == pytest.approx(cells_chi_square(counts), rel=1e-9, abs=1e-9)
    assert row.dof == len(counts) - 1
    assert row.effect_size == pytest.approx(math.sqrt(row.statistic / row.n_observations))


def test_chi_square_needs_two_groups_and_two_outcomes(spark):
    for rows in ([(0.0, 5, 2)], [(0.0, 5, 0), (1.0, 6, 0)], [(0.0, 5, 5), (1.0, 6, 6)]):
        assert inference.chi_square(table(spark, rows)).first().statistic is None


def test_two_by_two_with_yates_textbook(spark):
    # 10/30 against 20/30: uncorrected 6.667, corrected 5.4
    row = inference.two_groups(table(spark, [(1.0, 30, 10), (0.0, 30, 20)])).first()
    assert row.statistic == pytest.approx(5.4)
    assert (row.rate_1, row.rate_0) == (pytest.approx(1 / 3), pytest.approx(2 / 3))
    assert row.ci_low_1 == pytest.approx(0.1923, abs=5e-4)  # Wilson interval of 10 in 30
    assert row.ci_high_1 == pytest.approx(0.5122, abs=5e-4)


# ranks


def test_rank_sum_against_all_pairs(spark):
    random.seed(5)
    first = [random.choice([1, 2, 2.5, 3, 4, 5]) for _ in range(23)]
    second = [random.choice([1, 2, 3, 3.5, 4, 5, 5]) for _ in range(31)]
    u = sum((a > b) + 0.5 * (a == b) for a in first for b in second)
    rows = [
        (float(v), first.count(v) + second.count(v), first.count(v))
        for v in sorted({*first, *second})
    ]
    for cuts in ((), (2.0, 3.0), (0.0, 99.0)):
        row = inference.rank_sum(table(spark, rows), cuts).first()
        assert row.statistic == pytest.approx(u)
        assert row.effect_size == pytest.approx(1 - 2 * u / (23 * 31))
        assert row.rho == pytest.approx(
            pearson(average_ranks(first + second), average_ranks([1] * 23 + [0] * 31))
        )
    n = 54
    ties = sum(k**3 - k for k in (r[1] for r in rows))
    sigma = math.sqrt(23 * 31 / 12 * (n + 1 - ties / (n * (n - 1))))
    assert row.z == pytest.approx((abs(u - 23 * 31 / 2) - 0.5) / sigma)
    mean = sum(first) / 23
    deviation = math.sqrt(sum((v - mean) ** 2 for v in first) / 22)
    assert row.mean_1 == pytest.approx(mean)
    assert row.ci_high_1 == pytest.approx(mean + 1.959963984540054 * deviation / math.sqrt(23))


def test_rank_sum_of_equal_values_has_no_evidence(spark):
    row = inference.rank_sum(table(spark, [(3.0, 10, 4)])).first()
    assert (row.z, row.rho) == (0.0, None)


def listed_p(first, second):
    """Two-sided p of U from every choice of len(first) among all values."""
    values = sorted([*first, *second])

    def u(chosen):
        others = [v for v in values if v not in chosen]
        return sum(a > b for a in chosen for b in others)

    largest = max(u(first), len(first) * len(second) - u(first))
    found = [u(c) >= largest for c in itertools.combinations(values, len(first))]
    return min(1.0, 2 * sum(found) / len(found))


@pytest.mark.parametrize("sizes", [(1, 1), (1, 7), (2, 3), (3, 3), (5, 6), (8, 4), (8, 8), (7, 9)])
def test_exact_law_against_all_choices(spark, sizes):
    rng = random.Random(repr(sizes))
    for _ in range(2):
        values = rng.sample(range(1000), sum(sizes))
        first, second = values[:sizes[0]], values[sizes[0]:]
        rows = [(float(v), 1, int(v in first)) for v in values]
        row = inference.rank_sum_test(table(spark, rows)).first()
        assert row.is_exact and row.p_value == pytest.approx(listed_p(first, second), rel=1e-12)


def test_exact_law_sums_to_one_and_is_even():
    for n1, n2 in ((3, 50), (8, 200), (8, 3), (1, 4000)):
        product = n1 * n2
        for u in (0, 1, product // 3, product // 2):
            p = pvalues.rank_sum_two_sided(u, n1, n2)
            assert p == pvalues.rank_sum_two_sided(product - u, n2, n1) <= 1
        assert pvalues.rank_sum_two_sided(0, n1, n2) == 2 / math.comb(n1 + n2, n1)
        assert pvalues.rank_sum_two_sided(product // 2, n1, n2) == 1.0
    # large samples come near the normal law
    u, n1, n2 = 500.0, 8, 200
    z = (abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    assert pvalues.rank_sum_two_sided(u, n1, n2) == pytest.approx(
        pvalues.normal_two_sided(z), rel=0.02)


def test_ties_or_two_large_samples_take_the_normal_law(spark):
    tied = inference.rank_sum_test(table(spark, [(1.0, 2, 1), (2.0, 1, 1), (3.0, 1, 0)])).first()
    large = [(float(v), 1, v % 2) for v in range(18)]
    for row in (tied, inference.rank_sum_test(table(spark, large)).first()):
        assert not row.is_exact
        assert row.p_value == pytest.approx(pvalues.normal_two_sided(row.z))
    assert inference.rank_sum_test(table(spark, large[:17])).first().is_exact


def test_tests_of_slices_are_those_of_each_slice(spark, marts):
    by = {r.customer_state: r for r in
          inference.delay_score_tests(marts.orders, ["customer_state"]).collect()}
    assert len(by) > 5 and None not in by
    for state in sorted(by)[:3]:
        alone = inference.delay_score_test(marts.orders.where(F.col("customer_state") == state)).first()
        assert (by[state].statistic, by[state].z, by[state].n1) == pytest.approx(
            (alone.statistic, alone.z, alone.n1))


def test_rank_sum_needs_both_samples(spark):
    assert inference.rank_sum(table(spark, [(3.0, 4, 4), (4.0, 2, 2)])).count() == 0


def test_spearman_against_brute_force(spark):
    random.seed(11)
    x = [random.choice([0.1, 0.2, 0.2, 0.5]) + random.choice([0, 0, random.random()])
         for _ in range(200)]
    y = [random.randint(1, 5) for _ in range(200)]
    frame = spark.createDataFrame(list(zip(x, map(float, y))), "a double, b double")
    noise = spark.createDataFrame([(None, 1.0), (float("nan"), 2.0), (float("inf"), 3.0)],
                                  frame.schema)
    expected = pearson(average_ranks(x), average_ranks(y))
    for cuts in (None, (), (0.15, 0.2, 0.4)):
        row = inference.spearman(frame.union(noise), "a", "b", cuts, ()).first()
        assert row.n_observations == 200
        assert row.rho == pytest.approx(expected, abs=1e-12)
    assert row.t == pytest.approx(expected * math.sqrt(198 / (1 - expected**2)))
    assert math.tanh(math.atanh(expected) - 1.959963984540054 / math.sqrt(197)) == pytest.approx(
        row.ci_low
    )


def test_perfect_correlation(spark):
    frame = spark.range(20).select(F.col("id").cast("double").alias("a"))
    row = inference.spearman(frame.withColumn("b", -F.col("a")), "a", "b", (), ()).first()
    assert row.rho == pytest.approx(-1.0) and row.ci_low is None and row.t in (math.inf, -math.inf)


@pytest.mark.parametrize("cuts", [(), (0.0,), (3.0, 3.5, 8.0), None])
def test_quantiles_interpolate_like_sorted_data(spark, cuts):
    random.seed(3)
    values = [random.choice([1.0, 3.0, 3.0, 3.0, 7.5, random.uniform(0, 10)]) for _ in range(173)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    if cuts is None:
        cuts = ranks.cut_points(frame, "v", 16)
    shares = {"a": 0.0, "b": 0.02, "c": 0.25, "d": 0.5, "e": 0.98, "f": 1.0}
    row = ranks.quantiles(ranks.histogram(frame, "v"), "v", shares, cuts).first()
    ordered = sorted(values)
    for name, share in shares.items():
        position = share * (len(ordered) - 1)
        low = math.floor(position)
        high = min(low + 1, len(ordered) - 1)
        expected = ordered[low] + (ordered[high] - ordered[low]) * (position - low)
        assert row[name] == pytest.approx(expected, abs=1e-12)


def test_quantiles_per_group_with_a_hot_value(spark):
    rows = [("hot", 5.0)] * 500 + [("hot", float(i)) for i in range(11)] + [("few", 2.0)]
    frame = spark.createDataFrame(rows, "g string, v double")
    cells = ranks.histogram(frame, "v", ["g"])
    found = {
        r.g: (r.q1, r.median) for r in
        ranks.quantiles(cells, "v", {"q1": 0.25, "median": 0.5}, (4.0, 5.0, 6.0), ["g"]).collect()
    }
    assert found == {"hot": (5.0, 5.0), "few": (2.0, 2.0)}


# trend


def test_trend_textbook(spark):
    counts = [(0, 100, 10), (1, 100, 20), (2, 100, 30), (3, 100, 40), (4, 100, 50)]
    row = inference.trend(table(spark, [(float(s), n, h) for s, n, h in counts])).first()
    total, hits = 500, 150
    p = hits / total
    t = sum(s * (h - n * p) for s, n, h in counts)
    variance = p * (1 - p) * (
        sum(n * s * s for s, n, _ in counts) - sum(n * s for s, n, _ in counts) ** 2 / total
    )
    assert row.z == pytest.approx(t / math.sqrt(variance))
    xs = [s for s, n, _ in counts for _ in range(n)]
    ys = [int(i < h) for _, n, h in counts for i in range(n)]
    assert row.rho == pytest.approx(pearson(average_ranks(xs), average_ranks(ys)))
    assert (row.rate_first, row.rate_last) == (0.1, 0.5)


def test_trend_without_variation_gives_no_row(spark):
    assert inference.trend(table(spark, [(0.0, 10, 0), (1.0, 10, 0)])).count() == 0
    assert inference.trend(table(spark, [(2.0, 10, 4)])).count() == 0


# false discovery


def test_benjamini_hochberg_textbook(spark):
    p = [0.01, 0.04, 0.03, 0.005, None, 0.5, 0.04]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p_value double")
    found = {r.i: r for r in inference.adjust_p(frame).collect()}
    known = sorted((v, i) for i, v in enumerate(p) if v is not None)
    expected, smallest = {}, 1.0
    for rank in range(len(known), 0, -1):
        value, i = known[rank - 1]
        smallest = min(smallest, value * len(known) / rank)
        expected[i] = smallest
    for i, value in expected.items():
        assert found[i].p_value_adjusted == pytest.approx(value)
        assert found[i].p_value_adjusted >= p[i]
        assert found[i].significant == (value < 0.05)
    assert found[4].p_value_adjusted is None and found[4].significant is False


def test_posthoc_against_cells(spark):
    data = {"a": (120, 40), "b": (200, 20), "c": (150, 50), "tiny": (5, 5), None: (30, 3)}
    rows = [(g, int(i < h)) for g, (n, h) in data.items() for i in range(n)] + [("a", None)]
    frame = spark.createDataFrame(rows, "g string, bad int")
    found = {r.g: r for r in inference.proportion_posthoc(frame, "g", "bad").collect()}
    assert set(found) == {"a", "b", "c"}
    total, hits = sum(n for n, _ in data.values()), sum(h for _, h in data.values())
    for group, row in found.items():
        n, h = data[group]
        assert row.statistic == pytest.approx(cells_chi_square([(n, h), (total - n, hits - h)]))
        assert row.overall_rate == pytest.approx(hits / total)
        assert row.p_value == pytest.approx(math.erfc(math.sqrt(row.statistic / 2)))
        assert row.direction == ("выше среднего" if h / n > hits / total else "ниже среднего")


def test_posthoc_of_a_single_segment_has_no_test(spark):
    frame = spark.createDataFrame([("a", i % 2) for i in range(200)], "g string, bad int")
    row = inference.proportion_posthoc(frame, "g", "bad").first()
    assert row.statistic is None and row.p_value is None and row.significant is False


def test_seller_heterogeneity_skips_one_sided_categories(spark):
    rows = [
        (f"o{c}{s}{i}", c, f"{c}{s}", 1, 1 if c == "all_bad" else int(i % (s + 2) == 0))
        for c in ("mixed", "all_bad", "two") for s in range(2 if c == "two" else 4)
        for i in range(30)
    ]
    frame = spark.createDataFrame(
        rows, "order_id string, product_category_name string, seller_id string, "
        "is_single_seller_order int, is_bad_review int")
    result = inference.seller_heterogeneity(frame).collect()
    assert [r.product_category_name for r in result] == ["mixed"]
    counts = [(30, sum(i % (s + 2) == 0 for i in range(30))) for s in range(4)]
    assert result[0].statistic == pytest.approx(cells_chi_square(counts))
    assert (result[0].n_sellers, result[0].n_observations) == (4, 120)


# hypothesis table


def test_hypothesis_table_agrees_with_single_tests(spark, marts):
    from martwright import labels
    from martwright.operators.hypotheses import COLUMNS, hypothesis_table

    table = hypothesis_table(
        marts.orders, marts.order_seller, single_seller_only=False, min_seller_orders=5
    )
    assert table.columns == COLUMNS
    rows = table.collect()
    assert [r.hypothesis[:2] for r in rows] == list(labels.HYPOTHESIS_ORDER)
    by = {r.hypothesis[:2]: r for r in rows}
    for name, test in {
        "H1": inference.delay_review_test, "H4": inference.category_review_test,
        "H5": inference.state_delay_test, "H7": inference.handover_review_test,
    }.items():
        single = test(marts.orders).first()
        assert by[name].statistic == pytest.approx(single.statistic)
        assert by[name].n_observations == single.n_observations
        assert by[name].p_value == pytest.approx(
            pvalues.chi_square_tail(single.statistic, single.dof)
        )
    scores = inference.delay_score_test(marts.orders).first()
    assert (by["H2"].statistic, by["H2"].value_1) == pytest.approx(
        (scores.statistic, scores.mean_1)
    )
    assert by["H2"].p_value == pytest.approx(pvalues.normal_two_sided(scores.z))
    freight = inference.freight_score_test(marts.orders).first()
    assert by["H3"].p_value == pytest.approx(pvalues.student_two_sided(freight.t, freight.dof))
    trend = inference.delay_trend_test(marts.orders).first()
    assert (by["H8"].statistic, by["H8"].effect_size) == pytest.approx((trend.z, trend.rho))
    adjusted = sorted((r.p_value, r.p_value_adjusted) for r in rows)
    assert [a for _, a in adjusted] == sorted(a for _, a in adjusted)
    assert all(a >= p for p, a in adjusted)
    assert by["H1"].interpretation.startswith("После поправки BH: статистически значимо (p_adj=")
    assert by["H1"].interpretation.endswith(f"(Cramér's V={by['H1'].effect_size:.3g})")


def test_hypotheses_without_data_are_left_out(spark, marts):
    from martwright.operators.hypotheses import hypothesis_table

    empty = marts.orders.where("false")
    assert hypothesis_table(empty, marts.order_seller.where("false")).count() == 0


def test_rounding_is_half_to_even(spark):
    frame = spark.createDataFrame([(0.00005, 1), (0.00015, 2), (None, 3)], "v double, i int")
    assert [r.v for r in rounded(frame).orderBy("i").collect()] == [0.0, 0.0002, None]


def test_exact_counts_survive_large_numbers(spark):
    big = [(0.0, 3_000_000_000, 1_000_000_000), (1.0, 2_000_000_000, 700_000_000),
           (2.0, 1_000_000_000, 300_000_000)]
    row = inference.chi_square(table(spark, big)).first()
    total, hits = 6_000_000_000, 2_000_000_000
    exact = sum(
        Fraction(h * total - n * hits) ** 2 / (Fraction(total) * n * hits * (total - hits)) * total
        for _, n, h in big
    )
    assert row.statistic == pytest.approx(float(exact), rel=1e-6)


def test_student_tail_is_one_formula_for_every_dof():
    for t in (1e-9, 0.5, 3.0):
        values = [pvalues.student_two_sided(t, dof) for dof in (999_999, 1_000_000, 1_000_001)]
        assert max(values) - min(values) < 1e-10
        assert abs((values[0] + values[2]) / 2 - values[1]) < 1e-12


def test_tails_of_infinite_statistics_are_zero():
    assert pvalues.chi_square_tail(math.inf, 5) == 0
    assert pvalues.student_two_sided(math.inf, 5) == 0


def test_cuts_spread_the_distinct_values(spark):
    """A value that holds 99 % of the rows takes no more cuts than any other."""
    frame = spark.range(100_000).selectExpr("IF(id % 100 = 0, double(id), 50.5D) AS v")
    cuts = ranks.cut_points(frame, "v", 50)
    values = frame.distinct().selectExpr("v", f"aggregate(array({','.join(map(str, cuts))}), 0, "
                                         "(n, c) -> n + int(v >= c)) AS bucket")
    largest = values.groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert largest <= 0.05 * values.count()
