"""Metric and report tables on hand-made marts, and the shape of their plans."""

import re
from datetime import date, datetime

import pytest
from martwright import labels, schemas
from martwright.operators import delays, reports, segments, sellers, slices
from martwright.operators.prepare import prepare_orders
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def orders(spark):
    """An orders mart with given columns, the others NULL."""
    schema = schemas.mart_schema("orders_mart", {
        "raw_orders": spark.createDataFrame([], "order_id string, customer_id string"),
        "raw_customers": spark.createDataFrame([], "customer_unique_id string"),
        "raw_order_items": spark.createDataFrame([], "seller_id string"),
    })

    def build(*rows):
        data = []
        for i, row in enumerate(rows):
            full = {"order_id": f"o{i}", "is_delivered": 0, "is_cancelled": 0,
                    "total_price": 0.0, "review_count": 0, **row}
            data.append(tuple(full.get(f.name) for f in schema))
        return spark.createDataFrame(data, schema)

    return build


def late(days, bad=None, **more):
    return {"is_delivered": 1, "delay_days": days, "is_delayed": int(days > 0),
            "is_bad_review": bad, "review_score": None if bad is None else (1.5 if bad else 4.5),
            **more}


def test_bucket_edges_are_right_closed(orders):
    days = [-1.0, 0.0, 0.5, 3.0, 3.01, 7.0, 14.0, 14.5]
    mart = orders(*[late(d, 1) for d in days], {"delay_days": 5.0}, {"is_delivered": 1})
    rows = delays.delay_buckets(mart).collect()
    assert [r.orders for r in rows] == [2, 2, 2, 1, 1]
    assert [r.delay_bucket for r in rows] == list(labels.DELAY_BUCKETS)


def test_empty_buckets_stay_unless_there_is_nothing(orders):
    rows = delays.delay_buckets(orders(late(20.0, 1), late(1.0))).collect()
    assert [r.orders for r in rows] == [0, 1, 0, 0, 1]
    assert rows[0].bad_review_rate is None and rows[1].bad_review_rate_ci_low is None
    assert rows[4].bad_review_rate == 1.0 and 0 < rows[4].bad_review_rate_ci_low < 1
    assert rows[4].bad_review_rate_ci_high == pytest.approx(1.0)
    assert delays.delay_buckets(orders({"is_delivered": 0})).count() == 0


def test_delay_stages(orders):
    mart = orders(
        late(1.0, 1, seller_overrun_days=1.0, transit_overrun_days=0.0),
        late(1.0, 0, seller_overrun_days=-1.0, transit_overrun_days=2.0),
        late(3.0, None, seller_overrun_days=1.0, transit_overrun_days=2.0),
        late(2.0, 1, seller_overrun_days=1.0, transit_overrun_days=1.0),
        late(2.0, 1, seller_overrun_days=None, transit_overrun_days=1.0),
        late(-2.0, 1, seller_overrun_days=-1.0, transit_overrun_days=-1.0),
    )
    rows = {r.stage_id: r for r in delays.delay_stages(mart).collect()}
    assert {i: r.delayed_orders for i, r in rows.items()} == {0: 1, 1: 1, 2: 2}
    assert rows[2].share_of_delayed == 0.5 and rows[2].avg_delay_days == 2.5
    assert rows[2].bad_review_rate == 1.0 and rows[2].delay_stage == "Оба этапа"


def test_stage_decomposition_counts_orders_once(orders):
    mart = orders(late(1.0, handover_time_days=2.0), {"is_delivered": 1, "transit_time_days": 4.0})
    twice = mart.union(mart)
    rows = delays.stage_decomposition(twice).collect()
    assert [(r.group_id, r.orders) for r in rows] == [(0, 1), (1, 1)]
    assert rows[0].transit == 4.0 and rows[1].handover == 2.0


def test_freight_bins(orders):
    shares = [0.0, 0.05, 0.050001, 0.1, 0.2, 0.1 + 0.1 + 1e-16, 0.51, None]
    rows = segments.freight_share_bins(orders(*[{"freight_share": s} for s in shares])).collect()
    assert [r.orders for r in rows] == [2, 2, 1, 1, 0, 1]
    assert [r.freight_share_bin for r in rows] == list(labels.FREIGHT_BINS)


def test_unknown_groups_stay_in_segments(orders):
    mart = orders({"customer_state": None}, {"customer_state": "SP", "is_bad_review": 1})
    rows = segments.segment_metrics(mart, "customer_state", 1).collect()
    assert [r.customer_state for r in rows] == ["SP", None]
    assert segments.segment_metrics(mart, "customer_state", 2).count() == 0


def test_summary(orders):
    mart = orders(
        {"customer_unique_id": "a", "total_price": 10.0, **late(1.0, 1), "review_count": 1},
        {"customer_unique_id": "a", "total_price": 20.0, "is_cancelled": 1},
        {"customer_unique_id": "b"}, {"customer_unique_id": None}, {"customer_unique_id": None},
    )
    row = segments.summary_metrics(mart).first()
    assert (row.total_orders, row.delivered_orders, row.cancelled_orders) == (5, 1, 1)
    assert (row.gmv, row.aov, row.repeat_purchase_rate) == (30.0, 6.0, 0.5)
    assert (row.delay_rate, row.review_coverage) == (1.0, 0.2)
    empty = segments.summary_metrics(mart.where("false")).first()
    assert (empty.total_orders, empty.gmv, empty.aov) == (0, 0.0, None)


def month(text, price):
    return {"order_purchase_timestamp": datetime.fromisoformat(f"{text}-15 10:00:00"),
            "order_year_month": text, "total_price": price}


def test_moving_mean_counts_observed_months(orders):
    few = prepare_orders(orders(month("2018-01", 1.0), month("2018-06", 3.0)))
    assert [r.gmv_ma3 for r in segments.monthly_trend(few).collect()] == [1.0, 3.0]
    assert [r.gmv_ma3 for r in segments.monthly_trend(few, True).collect()] == [1.0, 2.0]
    more = prepare_orders(orders(*[month(f"2018-{m:02}", float(m)) for m in (1, 2, 5, 9)]))
    assert [r.gmv_ma3 for r in segments.monthly_trend(more).collect()] == pytest.approx(
        [1.0, 1.5, 8 / 3, 16 / 3])


def test_peak_is_the_first_of_equals(orders):
    data = prepare_orders(orders(month("2018-01", 5.0), month("2018-02", 5.0)))
    row = segments.monthly_extremes(data).first()
    assert (row.peak_orders_month, row.peak_gmv_month) == (date(2018, 1, 1), date(2018, 1, 1))
    assert (row.last_month, row.last_orders, row.last_gmv) == (date(2018, 2, 1), 1, 5.0)


def test_prepared_labels(orders):
    rows = prepare_orders(orders(late(1.0, 1), late(-1.0, 0), {})).orderBy("order_id").collect()
    assert [r.bad_review_label for r in rows] == ["Плохой отзыв", "Не плохой отзыв", "Без отзыва"]
    assert [r.delay_group for r in rows] == ["С задержкой", "Без задержки", "Не доставлено"]
    assert [r.delivered_group for r in rows] == ["Доставлен", "Доставлен", "Не доставлен"]
    assert {(r.customer_state, r.seller_state, r.main_payment_type) for r in rows} == {
        ("unknown",) * 3}
    assert rows[0].product_category_name == "no_order_items"


def test_scores_are_cut_to_whole(orders):
    data = prepare_orders(orders(*[{"review_score": s} for s in (1.0, 3.5, 3.9, 5.0, None)]))
    assert [(r.review_score, r.orders) for r in reports.score_distribution(data).collect()] == [
        (1, 1), (2, 0), (3, 2), (4, 0), (5, 1)]
    observed = reports.score_distribution(data, complete=False).collect()
    assert [(r.review_score, r.share) for r in observed] == [(1, 0.25), (3, 0.5), (5, 0.25)]


def test_priority_threshold_falls_back_to_all(orders):
    rows = [{"product_category_name": c, "review_score": 3.0, "is_bad_review": b}
            for c, b in (("a", 1), ("a", 1), ("a", 0), ("b", 0), ("b", 1), ("c", 0))]
    data = prepare_orders(orders(*rows))
    kept = reports.priority_categories(data, 2).collect()
    assert [r.product_category_name for r in kept] == ["a", "b"]
    assert kept[0].global_bad_review_rate == 0.5
    everything = reports.priority_categories(data, 99, 2).collect()
    assert [r.product_category_name for r in everything] == ["a", "b"]
    assert reports.category_impact(data, 99).count() == 3


def test_categories_without_reviews_keep_an_unknown_priority(orders):
    data = prepare_orders(orders(
        {"product_category_name": "a", "is_bad_review": 1, "total_price": 9.0},
        {"product_category_name": "b", "is_bad_review": 0}, {"product_category_name": "c"}))
    rows = {r.product_category_name: r for r in segments.category_priority(data, 1).collect()}
    assert rows["a"].excess_bad_reviews == 0.5 and rows["a"].business_priority_score > 0
    assert rows["b"].business_priority_score == 0.0
    assert rows["c"].business_priority_score is None


def test_quantile_bins_merge_equal_edges(orders):
    shares = [0.1] * 60 + [0.2 + i / 1000 for i in range(40)]
    data = prepare_orders(orders(*[{"freight_share": s, "review_score": 3.0} for s in shares]))
    rows = reports.freight_quantile_bins(data, cuts=(0.15, 0.22)).collect()
    assert sum(r.orders for r in rows) == 98  # the two largest lie beyond the cap
    assert rows[0].lower_edge == pytest.approx(0.1) and len(rows) < 6
    constant = prepare_orders(orders(*[{"freight_share": 0.3, "review_score": 3.0}] * 5))
    assert reports.freight_quantile_bins(constant).count() == 0


def test_share_labels():
    assert reports.share_labels([0.0, 0.123456, 0.25, 1.5]) == ["0–12%", "12–25%", "25–150%"]
    assert reports.share_labels([0.1, 0.2]) == ["10–20%"]


def test_lane_square(orders):
    rows = [late(1.0, seller_state=a, customer_state=b) for a, b in
            (("x", "y"), ("x", "y"), ("y", "z"))]
    lanes = reports.lane_matrix(prepare_orders(orders(*rows)), 1)
    states = [r.state for r in reports.lane_states(lanes).collect()]
    assert states == ["x", "y", "z"]
    square = {r.seller_state: r for r in reports.lane_square(lanes, states, "orders").collect()}
    assert square["x"].y == 2 and square["y"].z == 1 and square["z"].x is None


def test_slices(orders):
    def bought(day, **more):
        return {"order_purchase_timestamp": datetime.fromisoformat(f"{day} 23:59:00"),
                "order_year_month": day[:7], **more}

    data = prepare_orders(orders(
        bought("2018-01-31", product_category_name="a", customer_unique_id="u", total_price=2.0),
        bought("2018-02-01", product_category_name="a", customer_unique_id="u", total_price=4.0),
        bought("2018-02-28", product_category_name="b", customer_unique_id="v"),
        {"product_category_name": "a"},
    ))
    assert slices.slice_orders(data).count() == 4
    assert slices.slice_orders(data, categories=["a"]).count() == 3
    february = {"start": date(2018, 2, 1), "end": date(2018, 2, 28)}
    assert slices.slice_orders(data, **february).count() == 2
    rows = {r.metric: r for r in
            slices.kpi_delta(data, slices.slice_condition(categories=["a"], **february)).collect()}
    assert (rows["orders"].current, rows["orders"].base) == (1.0, 4.0)
    assert (rows["gmv"].current, rows["gmv"].delta, rows["gmv"].kind) == (4.0, -2.0, "money")
    assert (rows["repeat_purchase_rate"].current, rows["repeat_purchase_rate"].base) == (0.0, 0.5)
    nothing = slices.kpi_summary(slices.slice_orders(data, categories=["zzz"])).first()
    assert set(nothing.asDict().values()) == {0.0}
    values = {(r.field, r.value) for r in slices.slice_values(data).collect()}
    assert ("product_category_name", "b") in values and ("seller_state", "unknown") in values


def seller_rows(spark, counts):
    """(category, seller, reviewed, bad) -> order-and-seller rows of single-seller orders."""
    data = [(f"{c}{s}{i}", s, c, 1, int(i < bad), 3.0, 0, 0, 1.0, 1.0)
            for c, s, n, bad in counts for i in range(n)]
    return spark.createDataFrame(
        data, "order_id string, seller_id string, product_category_name string, "
        "is_single_seller_order int, is_bad_review int, review_score double, is_delayed int, "
        "is_late_handover int, handover_time_days double, transit_time_days double")


def test_seller_against_category(spark):
    rows = seller_rows(spark, [("a", "s1", 30, 3), ("a", "s2", 40, 20), ("a", "s3", 30, 6),
                               ("a", "tiny", 10, 10), ("b", "s1", 30, 1), ("b", "s2", 30, 1)])
    found = {r.seller_id: r for r in sellers.seller_vs_category(rows).collect()}
    assert set(found) == {"s1", "s2", "s3"}  # category b has two sellers
    assert found["s1"].category_bad_review_rate == pytest.approx(39 / 110)  # tiny counts here
    assert found["s2"].bad_review_rate_diff == pytest.approx(0.5 - 39 / 110)
    assert found["s1"].n_sellers_in_category == 3
    assert sellers.seller_vs_category(rows, single_seller_only=False).count() == 3


def test_top_categories_and_their_spread(spark):
    counts = [(c, f"s{i}", 30 + 10 * k, 3 * i) for k, c in enumerate("abc") for i in range(5)]
    top = sellers.seller_top_categories(seller_rows(spark, counts), top_categories=2)
    assert {r.product_category_name for r in top.collect()} == {"b", "c"}
    spread = sellers.seller_category_spread(top).collect()
    assert [r.product_category_name for r in spread] == ["b", "c"]
    assert spread[0].median == pytest.approx(6 / 40) and spread[0].q3 == pytest.approx(9 / 40)
    assert (spread[0].lowest, spread[0].highest, spread[0].sellers) == (
        0.0, pytest.approx(12 / 40), 5)


# plans


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_joins_and_no_row_at_a_time_python(spark, small, marts):
    import __spark_entry__ as entry

    for name, query in entry.queries().items():
        plan = plan_of(query(spark, small))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "BatchEvalPython" not in plan, name


def test_unpartitioned_windows_only_after_aggregation(spark, small, marts):
    """A window over all rows must have an aggregate between itself and the scan.

    Exchanges that a query asks for with a number of parts by its input are not meant.
    """
    import __spark_entry__ as entry

    for name, query in entry.queries().items():
        text = plan_of(query(spark, small))
        for place in re.finditer(r"Exchange SinglePartition, ENSURE_REQUIREMENTS", text):
            below = text[place.end():]
            assert "HashAggregate" in below or "SortAggregate" in below, name


def test_scans_read_only_what_they_need(marts):
    plan = plan_of(segments.segment_metrics(marts.orders, "customer_state"))
    columns = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert "customer_state" in columns and "customer_city" not in columns


def test_date_slices_prune_months(marts):
    chosen = slices.slice_orders(
        prepare_orders(marts.orders), start=date(1996, 3, 5), end=date(1996, 4, 2))
    plan = plan_of(chosen.groupBy("customer_state").agg(F.count("*")))
    filters = re.search(r"PartitionFilters: \[(.*?)\]", plan).group(1)
    assert "1996-03" in filters and "1996-04" in filters


def test_summary_shuffles_only_customer_ids(marts):
    plan = plan_of(segments.summary_metrics(marts.orders))
    assert plan.count("Exchange hashpartitioning(customer_unique_id") <= 1
    assert "Exchange hashpartitioning(order_id" not in plan


def test_lane_grid_has_every_pair_of_states(orders):
    rows = [late(1.0, seller_state=a, customer_state=b) for a, b in
            (("x", "y"), ("x", "y"), ("y", "z"))]
    lanes = reports.lane_matrix(prepare_orders(orders(*rows)), 1)
    states = [r.state for r in reports.lane_states(lanes).collect()]
    grid = {(r.seller_state, r.customer_state): r.orders for r in reports.lane_grid(lanes).collect()}
    assert set(grid) == {(a, b) for a in states for b in states}
    known = {(r.seller_state, r.customer_state): r.orders for r in lanes.collect()}
    assert {k: n for k, n in grid.items() if n} == known
    empty = [r for r in reports.lane_grid(lanes).collect() if not r.orders]
    assert empty and all((r.orders, r.avg_delivery_time_days, r.delay_rate) == (0, 0, None) for r in empty)
