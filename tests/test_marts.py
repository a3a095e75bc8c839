"""Mart rules on hand-made rows, and invariants on the test tables."""

import pytest
from martwright import schemas
from martwright.operators import marts as build
from martwright.plans import refresh
from martwright.sources.star_schema import read_star_schema
from micro import BOUGHT, item, order, raw_tables
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def raw(spark):
    return raw_tables(
        spark,
        raw_customers=[("c1", "u1", "Rio", "RJ"), ("c2", "u1", "Rio", None)],
        raw_orders=[
            order("on_time", "2018-01-10 00:00:00"),
            order("exact", "2018-01-11 00:00:00"),
            order("same_day", "2018-01-11 10:00:00"),  # due at midnight, so this is late
            order("no_carrier", "2018-01-20 00:00:00", carrier=None),
            order("canceled", None, carrier=None, status="canceled", customer="c2"),
            order("unavailable", None, status="unavailable", approved=None),
            order("no_due", "2018-01-10 00:00:00", estimated=None),
            order("stranger", "2018-01-10 00:00:00", customer="nobody"),
        ],
        raw_order_items=[
            item("on_time", "p_toy", "s1", 10.0, 2.0), item("on_time", "p_toy", "s1", 10.0, 3.0),
            item("exact", "p_toy", "s2", 30.0), item("exact", "p_blank", "s1", 10.0),
            item("exact", "p_null", "s1", 20.0),  # s1 and s2 both earn 30
            item("same_day", "p_odd", "s1", 5.0, limit="2018-01-03 00:00:00"),
            item("same_day", "p_unknown", "s3", 4.0, limit="2018-01-04 12:00:00"),
            item("no_carrier", "p_toy", "s1", 0.0),
            # 0.1 + 0.2 and 0.3 are a tie in money, not in doubles
            item("canceled", "p_toy", "s2", 0.1), item("canceled", "p_toy", "s2", 0.2),
            item("canceled", "p_pet", "s1", 0.3),
        ],
        raw_products=[
            ("p_toy", "brinquedos"), ("p_blank", ""), ("p_null", None), ("p_odd", "sem_par"),
            ("p_pet", "pet"),
        ],
        raw_category_translation=[("brinquedos", "toys"), ("pet", "animals")],
        raw_sellers=[("s1", "SP", "Campinas"), ("s2", "MG", "Betim")],
        raw_order_payments=[
            ("on_time", "voucher", 10.0, 1), ("on_time", "boleto", 10.0, 3),
            ("exact", "credit_card", 5.0, 2), ("exact", "voucher", 6.0, 1),
        ],
        raw_order_reviews=[("on_time", 5), ("on_time", 2), ("exact", 3), ("same_day", None)],
    )


@pytest.fixture(scope="module")
def orders(raw):
    return {row.order_id: row for row in build.build_orders_mart(raw).collect()}


def test_every_order_stays(orders):
    assert len(orders) == 8


def test_lateness_compares_timestamps(orders):
    assert orders["on_time"].is_delayed == 0 and orders["on_time"].delay_days == -1.0
    assert orders["exact"].is_delayed == 0 and orders["exact"].delay_days == 0.0
    assert orders["same_day"].is_delayed == 1
    assert orders["same_day"].delay_days == pytest.approx(10 / 24, abs=1e-12)


def test_unknown_inputs_give_unknown_flags(orders):
    assert orders["canceled"].is_delayed is None and orders["canceled"].is_delivered == 0
    assert orders["no_due"].is_delayed is None and orders["no_due"].is_delivered == 1
    assert orders["no_carrier"].is_late_handover is None
    assert orders["no_carrier"].transit_overrun_days is None
    assert orders["canceled"].is_bad_review is None and orders["canceled"].has_review == 0


def test_only_canceled_counts_as_cancelled(orders):
    assert [o for o, r in orders.items() if r.is_cancelled] == ["canceled"]


def test_categories(orders):
    assert orders["on_time"].product_category_name == "toys"
    assert orders["exact"].product_category_name == "missing_product_category"  # 30 each, by name
    assert orders["exact"].distinct_categories == 2 and orders["exact"].is_mixed_category == 1
    assert orders["same_day"].product_category_name == "missing_translation"
    assert orders["unavailable"].product_category_name == "no_order_items"


def test_main_seller_breaks_ties_by_id(orders):
    assert orders["exact"].main_seller_id == "s1" and orders["exact"].seller_state == "SP"


def test_ties_are_judged_on_money(orders):
    assert orders["canceled"].product_category_name == "animals"
    assert orders["canceled"].main_seller_id == "s1"


def test_counts_and_sums(orders):
    row = orders["on_time"]
    assert (row.order_item_count, row.distinct_products, row.distinct_sellers) == (2, 1, 1)
    assert (row.total_price, row.total_freight, row.freight_share) == (20.0, 5.0, 0.25)
    assert (row.payment_value, row.payment_count, row.max_installments) == (20.0, 2, 3)
    assert row.main_payment_type == "boleto"
    assert orders["exact"].main_payment_type == "voucher"


def test_defaults_without_details(orders):
    row = orders["unavailable"]
    assert (row.order_item_count, row.total_price, row.payment_value) == (0, 0.0, 0.0)
    assert row.main_payment_type == "unknown" and row.freight_share is None
    assert row.main_seller_id is None and row.approval_time_days is None
    assert orders["no_carrier"].freight_share is None  # price 0
    assert orders["stranger"].customer_state is None


def test_reviews(orders):
    row = orders["on_time"]
    assert (row.review_score, row.min_review_score, row.review_count) == (3.5, 2, 2)
    assert row.is_bad_review == 1 and orders["exact"].is_bad_review == 0
    unknown = orders["same_day"]  # a review without score: counted, not bad, no mean
    assert (unknown.review_count, unknown.is_bad_review, unknown.review_score) == (1, 0, None)


def test_overruns_add_up_to_the_delay(orders):
    for row in orders.values():
        if row.transit_overrun_days is not None:
            assert row.seller_overrun_days + row.transit_overrun_days == pytest.approx(
                row.delay_days
            )


def test_month_and_durations(orders):
    row = orders["on_time"]
    assert row.order_year_month == "2018-01" and str(row.order_purchase_timestamp) == BOUGHT
    assert (row.approval_time_days, row.handover_time_days) == (0.5, 2.5)
    assert (row.transit_time_days, row.delivery_time_days) == (6.0, 9.0)


def test_order_seller_judges_handover_per_seller(raw):
    mart = build.build_orders_mart(raw)
    rows = {(r.order_id, r.seller_id): r for r in build.build_order_seller(raw, mart).collect()}
    assert len(rows) == 8
    assert rows["same_day", "s1"].is_late_handover == 1
    assert rows["same_day", "s3"].is_late_handover == 0
    assert rows["same_day", "s3"].seller_state is None
    assert rows["same_day", "s1"].is_single_seller_order == 0
    assert rows["on_time", "s1"].is_single_seller_order == 1
    assert rows["exact", "s1"].seller_price == 30.0


def test_seller_mart(raw):
    mart = build.build_orders_mart(raw)
    sellers = {
        r.seller_id: r
        for r in build.build_seller_mart(build.build_order_seller(raw, mart)).collect()
    }
    s1 = sellers["s1"]
    assert (s1.orders, s1.items, s1.single_seller_orders) == (5, 7, 2)
    assert s1.distinct_categories == 4 and s1.top_category == "missing_product_category"
    assert s1.delay_rate == pytest.approx(2 / 4) and s1.delivered_rate == pytest.approx(4 / 5)
    assert s1.late_handover_rate == pytest.approx(1 / 3)


def test_durations_do_not_depend_on_the_session_zone(spark, raw):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        stamps = spark.sql(
            "SELECT TIMESTAMP_NTZ'2018-11-03 12:00:00' AS a, TIMESTAMP_NTZ'2018-11-04 00:30:00' AS b"
        )
        from martwright.functions.columns import days_between, month_key

        row = stamps.select(days_between("a", "b").alias("d"), month_key("b").alias("m")).first()
        assert row.d == pytest.approx(12.5 / 24) and row.m == "2018-11"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_one_huge_order_gives_the_same_mart(spark):
    """A third of all items in one order, many sellers and products."""
    items = [item("big", f"p{i % 50}", f"s{i % 20}", float(i % 7 + 1)) for i in range(3000)]
    items += [item(f"o{i}", f"p{i % 50}", f"s{i % 20}", 1.0) for i in range(6000)]
    raw = raw_tables(
        spark,
        raw_orders=[order("big", "2018-01-09 00:00:00")],
        raw_order_items=items,
        raw_products=[(f"p{i}", f"c{i % 5}") for i in range(50)],
        raw_category_translation=[(f"c{i}", f"cat{i}") for i in range(5)],
    )
    row = build.build_orders_mart(raw).first()
    assert (row.order_item_count, row.distinct_products, row.distinct_sellers) == (3000, 50, 20)
    assert row.distinct_categories == 5
    earned = {}
    for i in range(3000):
        for key in (f"cat{i % 50 % 5}", f"s{i % 20}"):
            earned[key] = earned.get(key, 0) + i % 7 + 1
    best = {p: min((k for k in earned if k.startswith(p)), key=lambda k: (-earned[k], k))
            for p in ("cat", "s")}
    assert (row.product_category_name, row.main_seller_id) == (best["cat"], best["s"])


def test_invariants(spark, small, marts):
    raw = read_star_schema(spark, small)
    assert marts.orders.count() == raw["raw_orders"].count()
    assert marts.orders.select("order_id").distinct().count() == marts.orders.count()
    price = raw["raw_order_items"].agg(F.sum("price")).first()[0]
    assert marts.sellers.agg(F.sum("gmv")).first()[0] == pytest.approx(price)
    assert marts.orders.agg(F.sum("total_price")).first()[0] == pytest.approx(price)


def test_stored_schemas_match_the_builders(spark, small, marts):
    raw = read_star_schema(spark, small)
    built = {
        "orders_mart": build.build_orders_mart(raw),
        "order_seller": build.build_order_seller(raw, marts.orders),
        "seller_mart": build.build_seller_mart(marts.order_seller),
    }
    for name, df in built.items():
        declared = schemas.mart_schema(name, raw)
        assert [(f.name, f.dataType) for f in df.schema] == [
            (f.name, f.dataType) for f in declared
        ]


def test_refresh_replaces_and_absent_seller_marts_read_empty(spark, small, tmp_path):
    raw = read_star_schema(spark, small)
    folder = str(tmp_path / "marts")
    with pytest.raises(FileNotFoundError):
        refresh.read_marts(spark, folder, raw)
    built = refresh.refresh_marts(raw, folder)
    assert built.rows["orders_mart"] == raw["raw_orders"].count()
    again = refresh.refresh_marts(raw, folder)
    assert again.orders.count() == built.rows["orders_mart"]
    read = refresh.read_marts(spark, folder, raw)
    assert read.sellers.count() == built.rows["seller_mart"]
    only_orders = str(tmp_path / "partial")
    again.orders.write.parquet(f"{only_orders}/orders_mart")
    partial = refresh.read_marts(spark, only_orders, raw)
    assert partial.order_seller.count() == 0 and partial.sellers.columns == read.sellers.columns


def test_items_move_few_times(spark, raw):
    """One product join in the plan, and one exchange by order after it."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = build.build_items_agg(raw)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") <= 8
    assert plan.count("Join [product_id") == 1


def test_an_order_with_a_third_of_all_lines_is_spread(spark, raw):
    """The lines of a hot order are merged in the tasks that hold them: what reaches the task of its
    key is at most a row from each task before, and the tasks before share its names."""
    n = 6000
    lines = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("o"), "id")).alias("order_id"),
        F.concat(F.lit("s"), F.col("id") % 700).alias("seller_id"),
        F.concat(F.lit("p"), "id").alias("product_id"),
        F.concat(F.lit("c"), F.col("id") % 300).alias("category"),
        F.lit(1).cast("long").alias("items"), (F.col("id") % 97).alias("price"),
        F.lit(5).cast("long").alias("freight"), F.lit(None).cast("timestamp_ntz").alias("limit_date"),
    ).repartition(8)
    totals = build._item_totals(lines)
    got = totals.where("order_id = 'hot'").first()
    assert (got.order_item_count, got.distinct_products, got.distinct_sellers) == (2000, 2000, 700)
    assert got.distinct_categories == 100
    earned = {}
    for i in range(0, n, 3):
        for name in (f"s{i % 700}", f"c{i % 300}"):
            earned[name] = earned.get(name, 0) + i % 97
    for kind, name in (("s", got.main_seller_id), ("c", got.product_category_name)):
        assert name == min((v for v in earned if v[0] == kind), key=lambda v: (-earned[v], v))
    plan = totals._jdf.queryExecution().executedPlan().toString()
    exchanges = [i for i, row in enumerate(plan.splitlines()) if "Exchange hashpartitioning" in row]
    rows = plan.splitlines()
    assert len(exchanges) == 2 and all("partial_" in rows[i + 1] for i in exchanges)
    assert "RoundRobin" in plan  # of this test's input; nothing else moves rows that are not merged


def test_stored_lines_give_the_same_marts(raw):
    lines = build.order_lines(raw)
    orders = build.build_orders_mart(raw)
    assert build.build_orders_mart(raw, lines).exceptAll(orders).isEmpty()
    sellers = build.build_order_seller(raw, orders)
    assert build.build_order_seller(raw, orders, lines).exceptAll(sellers).isEmpty()
