"""Ranks, correlations and quantile bins: nothing runs early, and the orders are read once."""

import random

import pytest
from martwright.operators import hypotheses, inference, ranks, reports
from martwright.operators.prepare import prepare_orders
from pyspark.sql import functions as F


def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def counted(frame):
    """The frame, and an accumulator of the rows that are read from it."""
    rows = frame.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    return frame.mapInArrow(count, frame.schema), rows


@pytest.mark.parametrize("build", [
    inference.freight_score_test,
    lambda orders: inference.spearman(orders, "freight_share", "delivery_time_days"),
    lambda orders: reports.freight_quantile_bins(prepare_orders(orders)),
])
def test_orders_are_read_once_and_late(spark, marts, build):
    # columns in use, in equal pieces, as a scan would prune them
    orders, rows = counted(marts.orders.repartition(4))
    total = marts.orders.count()
    before = jobs(spark)
    frame = build(orders)
    assert jobs(spark) == before
    found = frame.collect()
    assert rows.value == total
    assert repr(found) == repr(build(marts.orders).collect())


def test_the_hypothesis_table_starts_nothing_early(spark, marts):
    before = jobs(spark)
    hypotheses.hypothesis_table(marts.orders, marts.order_seller, single_seller_only=False)
    assert jobs(spark) == before


@pytest.mark.parametrize("seed", range(4))
def test_ranged_positions(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([0.0, -1.5, 3.25, rng.random(), rng.gauss(0, 1e6)]) for _ in range(400)]
    values += [0.0] * 200
    rows = [(v, rng.randint(0, 2), rng.randint(1, 5)) for v in values]
    cells = spark.createDataFrame(rows, "v double, other int, n long").repartition(5)
    got = ranks.with_positions(cells, "v").collect()
    everything = sorted(v for v, _, n in rows for _ in range(n))
    assert sum(r.n for r in got) == len(everything)
    for r in got:
        below, ties = sum(v < r.v for v in everything), everything.count(r.v)
        assert (r.below, r.ties, r.group_rows) == (below, ties, len(everything))
        assert r.average_rank == below + (ties + 1) / 2


def test_ranged_positions_of_few_rows(spark):
    none = spark.createDataFrame([], "v double, n long")
    assert ranks.with_positions(none, "v").count() == 0
    one = ranks.with_positions(spark.createDataFrame([(2.0, 7)], "v double, n long"), "v").first()
    assert (one.below, one.ties, one.average_rank, one.group_rows) == (0, 7, 4.0, 7)
    with pytest.raises(ValueError, match="cut points"):
        ranks.with_positions(none, "v", None, ["n"])


def test_ranges_that_differ_fail(spark):
    """Without the reuse of the exchange its two uses may not agree; that is told, not counted wrong."""
    rows = [(float(i % 7919), 1) for i in range(20_000)]
    cells = spark.createDataFrame(rows, "v double, n long").repartition(6)
    want = sorted((r.v, r.below) for r in ranks.with_positions(cells, "v").collect())
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert sorted((r.v, r.below) for r in ranks.with_positions(cells, "v").collect()) == want
    except Exception as error:  # noqa: BLE001
        assert "computed twice" in str(error)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_bins_of_equal_and_few_shares(spark, marts):
    prepared = prepare_orders(marts.orders)
    few = prepared.withColumn("freight_share", F.lit(0.25))
    assert reports.freight_quantile_bins(few).collect() == []
    assert reports.freight_quantile_bins(prepared.limit(0)).collect() == []
    two = prepared.withColumn("freight_share", F.when(F.col("order_id") % 2 == 0, 0.125).otherwise(0.375))
    found = reports.freight_quantile_bins(two).collect()
    assert [(r.bin_id, r.bin_label, r.lower_edge, r.upper_edge) for r in found] == [(0, "12–38%", 0.125, 0.375)]


def preview_keys(kind, seed):
    rng = random.Random(seed)
    return {
        "digits": [f"order_{i:06d}" for i in rng.sample(range(10**6), 900)],
        "hex": [f"{rng.getrandbits(128):032x}" for _ in range(900)],
        "ragged": ["".join(rng.choices("ab\u00e9z", k=rng.randint(0, 7))) for _ in range(900)],
        "prefixes": ["a" * i for i in range(40)],
        "hot": ["m"] * 500 + [rng.choice("abcxyz") * rng.randint(1, 9) for _ in range(300)],
        "one": ["same"] * 300,
        "long": [rng.randint(-2**63, 2**63 - 1) for _ in range(500)] + [-1, 0, 1, 2**63 - 1, -2**63],
        "near": list(range(-50, 900)),
        "none": [],
    }[kind]


@pytest.mark.parametrize("kind", "digits hex ragged prefixes hot one long near none".split())
@pytest.mark.parametrize("rows", [1, 37, 5000])
def test_smallest_keys(spark, kind, rows):
    keys = preview_keys(kind, rows)
    kind_of = "long" if kind in ("long", "near") else "string"
    frame = spark.createDataFrame([(k,) for k in [*keys, None]], f"k {kind_of}").repartition(5)
    kept = [r.k for r in frame.where(ranks.among_smallest(frame, "k", rows)).collect()]

    def first(values):
        known = sorted(v for v in values if v is not None)
        return known[:rows]

    assert first(kept) == first(keys) and None in kept
    assert len(kept) == len(keys) + 1 or len(kept) > rows
    if kind == "hex" and rows < 900:
        assert len(kept) <= rows + 2


def test_preview_sorts_few_rows(spark, marts):
    """The wide rows that reach the sort are those of the preview, however many tasks there are."""
    from martwright.operators.slices import PREVIEW, slice_preview

    prepared = prepare_orders(marts.orders)
    want = sorted(prepared.select(*PREVIEW).collect(), key=lambda r: r.order_id)[:50]
    for parts in (3, 40):
        spread = prepared.repartition(parts)
        assert slice_preview(spread, 50).collect() == want
        kept = spread.where(ranks.among_smallest(spread, "order_id", 50)).count()
        assert 50 <= kept < 60
    before = jobs(spark)
    slice_preview(prepared)
    assert jobs(spark) == before
