"""CSV input, stored tables, result export."""

import csv

import pytest
from martwright import schemas
from martwright.operators import marts as build
from martwright.plans import refresh, result_tables
from martwright.sources import csv_raw, tables
from martwright.sources.star_schema import read_star_schema
from pyspark.sql import functions as F


def write_csv(path, header, rows, encoding="utf-8"):
    with open(path, "w", newline="", encoding=encoding) as file:
        writer = csv.writer(file)
        writer.writerow(header)
        writer.writerows(rows)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    place = tmp_path_factory.mktemp("csv")
    files = csv_raw.file_names("shop_")
    content = {
        # columns out of order and more than needed
        "raw_customers": (
            ["customer_state", "customer_id", "zip", "customer_unique_id", "customer_city"],
            [["RJ", "c1", "1", "u1", "Rio"], ["NA", "c2", "2", "u2", ""]]),
        "raw_orders": (list(schemas.RAW["raw_orders"]), [
            ["o1", "c1", "delivered", "2018-01-01 10:00:00", "", "2018-01-02 10:00:00",
             "2018-01-05 10:00:00", "2018-01-05 00:00:00"],
            ["o2", "c2", "created", "not a date", "NULL", "", "", "2018-01-09 00:00:00"]]),
        "raw_order_items": (list(schemas.RAW["raw_order_items"]), [
            ["o1", "p1", "s1", "1", "10.5", "1.25", "2018-01-03 00:00:00"],
            ["o1", "p1", "s1", "2", "oops", "1.25", "2018-01-03 00:00:00"]]),
        "raw_order_payments": (
            ["order_id", "payment_sequential", "payment_type", "payment_installments",
             "payment_value"],
            [["o1", "1", "boleto", "2.0", "12.75"]]),
        "raw_order_reviews": (
            ["review_id", "order_id", "review_score", "review_comment_message"],
            [["r1", "o1", "2", 'late,\nand "broken"\n'], ["r2", "o1", "5", "fine"]]),
        "raw_products": (["product_id", "product_category_name"], [["p1", "moveis"]]),
        "raw_sellers": (["seller_id", "seller_city", "seller_state"], [["s1", "Betim", "MG"]]),
    }
    for table, (header, rows) in content.items():
        write_csv(place / files[table], header, rows)
    write_csv(place / files["raw_category_translation"],
              ["product_category_name", "product_category_name_english"],
              [["moveis", "furniture"]], "utf-8-sig")
    return str(place), files


def test_csv_tables(spark, folder):
    raw = csv_raw.read_raw_csv(spark, *folder)
    assert {t: df.schema for t, df in raw.items()} == {
        t: schemas.raw_schema(t) for t in schemas.RAW
    }
    customers = {r.customer_id: r for r in raw["raw_customers"].collect()}
    assert customers["c1"].customer_state == "RJ"
    assert customers["c2"].customer_state is None and customers["c2"].customer_city is None
    orders = {r.order_id: r for r in raw["raw_orders"].collect()}
    assert str(orders["o1"].order_purchase_timestamp) == "2018-01-01 10:00:00"
    assert orders["o2"].order_purchase_timestamp is None and orders["o2"].order_approved_at is None
    assert sorted(r.price or 0 for r in raw["raw_order_items"].collect()) == [0, 10.5]
    assert raw["raw_order_payments"].first().payment_installments == 2
    assert [r.review_score for r in raw["raw_order_reviews"].orderBy("review_score").collect()] == [
        2, 5]
    assert raw["raw_category_translation"].first().product_category_name == "moveis"


def test_reviews_as_a_folder_of_files(spark, folder, tmp_path):
    place, files = folder
    reviews = tmp_path / "reviews"
    reviews.mkdir()
    header = ["review_id", "order_id", "review_score", "review_comment_message"]
    for i in range(5):
        write_csv(reviews / f"part-{i}.csv", header, [
            [f"r{i}-{j}", f"o{j}", str(1 + (i + j) % 5), 'two\nlines, "quoted"\n\n'] for j in range(6)
        ])
    named = {**files, "raw_order_reviews": str(reviews).lstrip("/")}
    others = {t: f"{place.lstrip('/')}/{n}" for t, n in files.items() if t != "raw_order_reviews"}
    found = csv_raw.read_raw_csv(spark, "/", {**named, **others})["raw_order_reviews"]
    rows = found.collect()
    assert len(rows) == 30
    assert sorted(r.review_score for r in rows) == sorted(1 + (i + j) % 5 for i in range(5) for j in range(6))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE" in plan and "review_comment_message" not in plan.split("ReadSchema")[1]
    tasks = spark.read.option("header", True).option("multiLine", True).csv(str(reviews))
    assert tasks.select(F.spark_partition_id()).distinct().count() == 5


def test_marts_from_csv(spark, folder, tmp_path):
    raw = csv_raw.read_raw_csv(spark, *folder)
    stored, rows = refresh.store_raw(raw, str(tmp_path / "raw"))
    assert rows["raw_order_reviews"] == 2 and rows["raw_customers"] == 2
    assert {r.table: r.rows for r in csv_raw.row_counts(stored).collect()} == rows
    built = refresh.refresh_marts(stored, str(tmp_path / "marts"))
    mart = {r.order_id: r for r in built.orders.collect()}
    assert mart["o1"].is_delayed == 1 and mart["o1"].product_category_name == "furniture"
    assert mart["o1"].total_price == 10.5 and mart["o1"].order_item_count == 2
    assert mart["o2"].order_year_month is None and mart["o2"].is_delivered == 0
    assert built.sellers.first().seller_id == "s1"


def test_missing_files_are_all_listed(spark, tmp_path):
    with pytest.raises(csv_raw.MissingDataError) as error:
        csv_raw.read_raw_csv(spark, str(tmp_path))
    assert len(str(error.value).splitlines()) == 1 + 8


def test_missing_columns_are_listed(spark, folder):
    df = spark.range(1)
    with pytest.raises(ValueError, match="order_id, review_score"):
        schemas.require_columns(df, schemas.RAW["raw_order_reviews"], "raw_order_reviews")


def test_duplicate_keys(spark, small):
    raw = read_star_schema(spark, small)
    assert csv_raw.duplicate_keys(raw).count() == 0
    raw["raw_sellers"] = raw["raw_sellers"].union(raw["raw_sellers"].limit(1))
    found = csv_raw.duplicate_keys(raw).collect()
    assert [(r.table, r.rows) for r in found] == [("raw_sellers", 2)]


def test_partitions_prune_and_keep_their_type(spark, marts):
    one = marts.orders.where(F.col("order_year_month") == "1996-05")
    assert dict(marts.orders.dtypes)["order_year_month"] == "string"
    files = {f.split("order_year_month=")[1][:7] for f in one.inputFiles()}
    assert files >= {"1996-05"} and one.count() > 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_year_month" in plan


class _Session:
    """The parts of a session that name the shared folder."""

    def __init__(self, master, **conf):
        context = {"master": master, "applicationId": f"app-{master}"}
        self.sparkContext = type("Context", (), context)
        self.conf = conf


def test_shared_folder_comes_from_the_cluster():
    named = {"spark.checkpoint.dir": "hdfs:///shared/"}
    assert tables.shared_dir(_Session("yarn", **named)) == "hdfs:///shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_dir(_Session("spark://host:7077"))
    local = _Session("local[2]")
    assert tables.shared_dir(local) == tables.shared_dir(local)


def test_results_as_csv(spark, marts, tmp_path):
    names = result_tables.save_results(marts, str(tmp_path))
    assert "metrics_summary" in names and "hypothesis_tests" in names
    assert "seller_category_comparison" not in names  # no seller has 30 single-seller orders
    back = spark.read.option("header", True).csv(f"{tmp_path}/delay_bucket_metrics")
    assert back.count() == 5 and "bucket_id" not in back.columns
    assert len(result_tables.report_tables(marts)) == 11


def test_results_read_back(spark, marts, tmp_path):
    folder = str(tmp_path / "results")
    wanted = result_tables.metric_tables(marts) | result_tables.test_tables(marts)
    result_tables.save_results(marts, folder)
    back = result_tables.read_results(spark, folder, "long")
    assert list(back) == list(schemas.RESULTS) and set(back) == set(wanted)
    for name, table in back.items():
        assert table.dtypes == wanted[name].dtypes, name
    for name in ("metrics_summary", "seller_metrics", "hypothesis_tests"):
        assert sorted(map(repr, back[name].collect())) == sorted(map(repr, wanted[name].collect()))
    assert back["seller_category_comparison"].count() == 0


def test_results_of_an_earlier_export_do_not_stay(spark, tmp_path):
    folder = str(tmp_path)
    table = spark.createDataFrame([("a", 1, 1.0)], "delay_stage string, n long, x double")
    assert tables.export_results({"t": table}, folder, {"t"}) == ["t"]
    assert tables.export_results({"t": table.limit(0)}, folder, {"t"}) == []
    assert not tables.path_exists(spark, f"{folder}/t")
    assert tables.export_results({"t": table.limit(0)}, folder, set()) == ["t"]
    with pytest.raises(FileNotFoundError, match="(?s)metrics_summary.*hypothesis_tests"):
        result_tables.read_results(spark, folder)


def test_results_with_other_columns_fail(spark, tmp_path):
    tables.export_csv(spark.createDataFrame([("a", 1.5)], "x string, y double"), f"{tmp_path}/t")
    with pytest.raises(Exception, match="(?i)header|malformed|column"):
        tables.read_csv_table(spark, f"{tmp_path}/t", schemas.T.StructType.fromDDL(
            "x string, z double")).collect()
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        tables.read_csv_table(spark, f"{tmp_path}/t", schemas.T.StructType.fromDDL(
            "x string, y long")).collect()


def test_export_of_a_slice(spark, marts, tmp_path):
    from martwright.operators.prepare import prepare_orders
    from martwright.operators.slices import PREVIEW, slice_orders

    chosen = slice_orders(prepare_orders(marts.orders), categories=["economy"])
    tables.export_csv(chosen, str(tmp_path / "slice"), PREVIEW)
    back = spark.read.option("header", True).csv(str(tmp_path / "slice"))
    assert back.columns == PREVIEW and back.count() == chosen.count() > 0


def test_text_and_numeric_ids_give_the_same_marts(spark, small):
    raw = read_star_schema(spark, small)
    text = {
        name: df.select(*[
            F.col(c).cast("string").alias(c) if c.endswith("_id") and c != "order_item_id"
            else F.col(c) for c in df.columns
        ]) for name, df in raw.items()
    }
    columns = ["order_item_count", "distinct_products", "product_category_name", "delay_days"]
    one = build.build_orders_mart(raw).select(F.col("order_id").cast("string"), *columns)
    other = build.build_orders_mart(text).select("order_id", *columns)
    assert one.exceptAll(other).count() == 0 and other.count() == one.count()


def test_refresh_names_repeated_keys(spark, small, tmp_path):
    from martwright.plans.refresh import refresh_marts
    from martwright.sources.star_schema import read_star_schema

    raw = dict(read_star_schema(spark, small))
    raw["raw_customers"] = raw["raw_customers"].unionByName(raw["raw_customers"].limit(1))
    with pytest.raises(ValueError, match=r"raw_customers .*\(2 rows\)"):
        refresh_marts(raw, str(tmp_path / "marts"))
