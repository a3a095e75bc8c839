"""Single results cost the marts they need, and little moves on the way to them."""

import random
import time
from pathlib import Path

import __spark_entry__ as entry
import pytest
from martwright.operators import marts as build
from martwright.plans import refresh
from martwright.sources import tables
from micro import item, order, raw_tables
from pyspark.sql import functions as F


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def raw(spark):
    return raw_tables(
        spark,
        raw_customers=[("c1", "u1", "Rio", "RJ")],
        raw_orders=[order("a", "2018-01-10 00:00:00"), order("b", "2018-02-11 00:00:00")],
        raw_order_items=[
            item("a", "p1", "s1", 10.0, 2.0), item("a", "p1", "s1", 10.0, 3.0),
            item("a", "p2", "s2", 30.0), item("b", "p3", None, 7.0), item("b", "p1", "s1", 2.0),
        ],
        raw_products=[("p1", "x"), ("p2", "y"), ("p3", "x")],
        raw_category_translation=[("x", "toys"), ("y", "pets")],
        raw_sellers=[("s1", "SP", "Campinas"), ("s2", "MG", "Betim")],
        raw_order_reviews=[("a", 5), ("a", 1)],
    )


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reviews_and_payments_build_no_mart(spark, small, monkeypatch):
    def none(*_):
        raise AssertionError("a mart was built")

    monkeypatch.setattr(entry, "stored_marts", none)
    for name in ("reviews_agg", "payments_agg", "order_items_agg", "orders_mart"):
        assert entry.queries()[name](spark, small).limit(1).count() == 1


def test_marts_are_stored_when_asked_for(raw, tmp_path):
    stored = refresh.MartsOnDemand(raw, str(tmp_path))
    assert list(tmp_path.iterdir()) == []
    assert stored.orders.exceptAll(build.build_orders_mart(raw)).isEmpty()
    assert {p.name for p in tmp_path.iterdir()} == {"orders_mart"}
    again = refresh.MartsOnDemand(raw, str(tmp_path))
    assert again.sellers.count() == 3
    assert {p.name for p in tmp_path.iterdir()} == {"orders_mart", "order_seller", "seller_mart"}
    assert sorted(f.name for f in stored.orders.schema) == sorted(build.build_orders_mart(raw).columns)


def test_lines_on_demand_are_merged_once(raw, tmp_path, monkeypatch):
    """Order-and-seller rows come from the items in one merge by category, not by product before."""
    want = build.build_order_seller(raw, build.build_orders_mart(raw))
    stored = refresh.MartsOnDemand(raw, str(tmp_path))
    monkeypatch.delattr(build, "order_lines")
    assert stored.order_seller.exceptAll(want).isEmpty() and want.exceptAll(stored.order_seller).isEmpty()


def test_repeated_keys_store_nothing(raw, tmp_path):
    twice = raw | {"raw_orders": raw["raw_orders"].union(raw["raw_orders"])}
    with pytest.raises(ValueError, match="more than once"):
        refresh.MartsOnDemand(twice, str(tmp_path)).orders
    assert list(tmp_path.iterdir()) == []


def test_a_result_of_orders_leaves_the_seller_marts(spark, raw, tmp_path, monkeypatch):
    stored = refresh.MartsOnDemand(raw, str(tmp_path / "marts"))
    monkeypatch.setattr(entry, "stored_marts", lambda *_: stored)
    for name in ("saved_state_posthoc", "saved_category_metrics", "saved_delay_stage_breakdown",
                 "monthly_peak_last", "adhoc_categories"):
        entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert {p.name for p in (tmp_path / "marts").iterdir()} == {"orders_mart"}


def test_rows_of_item_totals_hold_their_kind_only(raw):
    """Neither the seller nor the product of a line moves with the money of its category."""
    totals = build._item_totals(build.item_lines(raw))
    plan = plan_of(totals)
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning(order_id") == 2
    got = {r.order_id: r for r in totals.collect()}
    a, b = got["a"], got["b"]
    assert (a.order_item_count, a.distinct_products, a.distinct_sellers, a.distinct_categories) == (3, 2, 2, 2)
    assert (a.total_price, a.total_freight, a.main_seller_id) == (50.0, 6.0, "s2")
    # an unknown seller is none to count, but may be the one that earned most
    assert (b.distinct_sellers, b.main_seller_id, b.product_category_name) == (1, None, "toys")


def test_orders_reach_their_month_without_what_follows_from_them(spark, raw, no_broadcast):
    spark.conf.set("spark.sql.debug.maxToStringFields", "200")
    try:
        plan = plan_of(refresh._orders_mart(raw))
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    above = plan[: plan.index("REBALANCE_PARTITIONS_BY_COL")]
    below = plan[plan.index("REBALANCE_PARTITIONS_BY_COL"):]
    assert "delivery_time_days" in above and "delivery_time_days" not in below
    assert "Exchange" not in above.rsplit("Exchange", 1)[0]
    # by seller only the narrow totals move, not whole orders
    moved = below[below.index("Exchange hashpartitioning(main_seller_id"):].splitlines()[:2]
    assert not any("customer_id" in row for row in moved)


def test_seller_mart_sorts_no_order_rows(spark, raw):
    """Texts are keys of the first merge, so that it is a hash aggregate; results stay."""
    rows = build.build_order_seller(raw, build.build_orders_mart(raw))
    stated = rows.withColumn("seller_state", F.when(F.col("order_id") == "a", F.col("seller_state")))
    plan = plan_of(build.build_seller_mart(rows.localCheckpoint()))
    lowest = [row for row in plan.splitlines() if "Aggregate" in row][-1]
    assert "HashAggregate" in lowest and "partial_sum" in lowest
    got = {r.seller_id: r for r in build.build_seller_mart(stated).collect()}
    assert got["s1"].seller_state == "SP" and got["s1"].orders == 2 and got["s1"].distinct_categories == 1


def same_rows(one, other):
    return one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


@pytest.fixture(scope="module")
def many(spark):
    """Orders of 1 to 40 lines with repeated, unknown and tied names, lines without an order, and one order
    with a third of all."""
    rng = random.Random(5)
    ids = [f"o{i}" for i in range(30)]
    items = [
        item(rng.choice([*ids, *ids[:4] * 3, "big", None]), f"p{rng.randint(0, 9)}",
             rng.choice(["s1", "s2", "s3", "s4", None]), rng.choice([1.0, 2.0, 3.5, None]), 0.25,
             f"2018-01-0{rng.randint(1, 9)} 00:00:00")
        for _ in range(400)
    ]
    items += [item("big", f"p{i % 10}", f"s{i % 7}", float(i % 3)) for i in range(200)]
    return raw_tables(
        spark,
        raw_orders=[order(i, "2018-01-10 00:00:00") for i in [*ids, "big", "none"]],
        raw_order_items=items,
        raw_products=[(f"p{i}", f"c{i % 4}") for i in range(8)],
        raw_category_translation=[(f"c{i}", f"cat{i}") for i in range(3)],
        raw_sellers=[("s1", "SP", "Campinas"), ("s2", "MG", None), ("s3", None, "Betim")],
    )


def test_orders_merged_in_place_equal_those_merged_by_name(many, monkeypatch):
    by_name = build._item_totals(build.item_lines(many)).localCheckpoint()
    assert by_name.count() == 32  # one for lines without an order
    got = {}
    for lines in (0, 30, 10**9):  # all orders are huge, some, none
        monkeypatch.setattr(build, "HUGE_ORDER", lines)
        assert same_rows(build.order_totals(many).select(by_name.columns), by_name)
        assert same_rows(
            build.order_totals(many, build.order_lines(many)).select(by_name.columns), by_name
        )
        got[lines] = build.build_order_seller(many, build.build_orders_mart(many)).localCheckpoint()
    assert same_rows(got[0], got[30]) and same_rows(got[0], got[10**9])
    sellers = {(r.order_id, r.seller_id): r for r in got[30].collect()}
    assert len(sellers) == got[30].count() and (None, "s1") in sellers
    lines = [r for r in many["raw_order_items"].collect() if (r.order_id, r.seller_id) == ("big", "s2")]
    big = sellers["big", "s2"]
    assert (big.seller_item_count, big.seller_state, big.seller_city) == (len(lines), "MG", None)
    assert big.seller_price == sum(r.price or 0 for r in lines)


def test_lines_of_an_ordinary_order_move_once_by_order(spark, many, no_broadcast):
    """Beyond the product and the seller, lines move to their order only; what is merged or joined there
    stays. The rows of huge orders are merged before they move."""
    facts = build.build_orders_mart(many).localCheckpoint()
    for rows in (build.order_totals(many), build.build_order_seller(many, facts)):
        plan = plan_of(rows)
        assert plan.count("REPARTITION_BY_COL") == 1
        above = plan[: plan.index("REPARTITION_BY_COL")]
        assert above.count("Exchange") == 1
        rest = plan[plan.index("REPARTITION_BY_COL"):].splitlines()
        merged = [i for i, row in enumerate(rest) if "Exchange hashpartitioning(order_id" in row]
        assert any("partial_" in rest[i + 1] for i in merged)


def shuffled(spark):
    disks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [Path(str(f)) for f in disks.localDirs()]
    return {f for folder in folders for f in folder.rglob("shuffle_*.data")}


def test_shuffles_leave_the_disk_when_a_mart_is_stored(spark, many, tmp_path, no_broadcast, monkeypatch):
    """What was shuffled for item totals is gone when orders are joined, and so on."""
    left = []
    write = refresh.tables.write_table

    def watched(df, path, *args):
        before = shuffled(spark)
        written = write(df, path, *args)
        for _ in range(50):  # removed in the background
            if not shuffled(spark) - before:
                break
            time.sleep(0.2)
        left.append((Path(path).name, len(shuffled(spark) - before)))
        return written

    monkeypatch.setattr(refresh.tables, "write_table", watched)
    setting = spark.conf.get(tables._DROP_SHUFFLES)
    stored = refresh.MartsOnDemand(many, str(tmp_path))
    assert stored.order_seller.count() > 30
    assert left == [("item_totals", 0), ("orders_mart", 0), ("order_seller", 0)]
    assert spark.conf.get(tables._DROP_SHUFFLES) == setting
    assert {p.name for p in tmp_path.iterdir()} == {"orders_mart", "order_seller"}
