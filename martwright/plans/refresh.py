"""Full refresh: raw tables to stored marts, published as one set."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from martwright import schemas
from martwright.operators import marts as build
from martwright.operators.sellers import seller_sums
from martwright.sources import tables, versions
from martwright.sources.csv_raw import duplicate_keys

PARTITION = "order_year_month"


@dataclass(frozen=True)
class Marts:
    orders: DataFrame
    order_seller: DataFrame
    sellers: DataFrame
    rows: dict[str, int] | None = None
    sums: DataFrame | None = None

    @property
    def seller_sums(self) -> DataFrame:
        """Sums by category and seller: stored ones, else made from the order-and-seller rows."""
        return seller_sums(self.order_seller) if self.sums is None else self.sums


def _orders_mart(raw: dict[str, DataFrame], totals: DataFrame | None = None) -> DataFrame:
    """The orders mart with its rows brought to their month before the columns are added that follow
    from the others, about half of all. Item totals come from the raw items unless they are given."""
    totals = build.order_totals(raw) if totals is None else totals
    return build.with_durations(
        tables.by_partition(build.joined_orders(raw, totals), PARTITION)
    )


@contextmanager
def _job_group(spark: SparkSession, text: str) -> Iterator[None]:
    """Jobs in here have a group of their own, apart from those of the query that asks for a mart."""
    context = spark.sparkContext
    names = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")
    before = {name: context.getLocalProperty(name) for name in names}
    context.setJobGroup(f"martwright {text}", f"martwright: {text}")
    try:
        yield
    finally:
        for name, value in before.items():
            context.setLocalProperty(name, value)


def _path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def store_raw(
    raw: dict[str, DataFrame], folder: str
) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """Replaces the stored raw tables; returns them read back, and the rows written to each."""
    stored, rows = {}, {}
    for name, df in raw.items():
        path = f"{folder}/{name}"
        rows[name] = tables.write_table(df, path).get["rows"]
        stored[name] = tables.read_table(df.sparkSession, path, df.schema)
    return stored, rows


def require_unique_keys(raw: dict[str, DataFrame]) -> None:
    """Raises if a key occurs more than once: a join would multiply rows, and with them every count."""
    repeated = duplicate_keys(raw).limit(20).collect()
    if repeated:
        found = ", ".join(f"{r.table} {r.key} ({r.rows} rows)" for r in repeated)
        raise ValueError(f"keys that occur more than once: {found}")


class MartsOnDemand:
    """The marts of raw tables, each stored in a folder when it is first asked for.

    For single results: one that is made from orders costs the orders mart alone. Item totals are stored
    on the way to it, so that what was shuffled for them has left the disks when orders are joined, and
    go once it is written. Later marts read the stored ones. A whole set, published at once, is made by
    refresh_marts.
    """

    def __init__(self, raw: dict[str, DataFrame], folder: str):
        self._raw, self._folder = raw, folder
        self._spark = raw["raw_orders"].sparkSession

    def _is_ready(self, name: str) -> bool:
        return tables.is_complete(self._spark, _path(self._folder, name))

    def _ready(
        self, name: str, df: DataFrame, partition: str | None = None, moved: bool = False
    ) -> DataFrame:
        path = _path(self._folder, name)
        with _job_group(self._spark, f"store {name}"):
            if not self._is_ready(name):
                tables.write_table(df, path, partition, moved)
            return tables.read_table(self._spark, path, df.schema)  # many folders are listed by a job

    @cached_property
    def orders(self) -> DataFrame:
        with _job_group(self._spark, "keys"):
            require_unique_keys(self._raw)
        totals = build.order_totals(self._raw)
        if not self._is_ready("orders_mart"):
            totals = self._ready("item_totals", totals)
        orders = self._ready(
            "orders_mart", _orders_mart(self._raw, totals), PARTITION, moved=True
        )
        tables.remove_table(self._spark, _path(self._folder, "item_totals"))
        return orders

    @cached_property
    def order_seller(self) -> DataFrame:
        """Not in partitions: to move all rows to their month would cost more than a slice of them spares."""
        return self._ready("order_seller", build.build_order_seller(self._raw, self.orders))

    @cached_property
    def sellers(self) -> DataFrame:
        return self._ready("seller_mart", build.build_seller_mart(self.order_seller))

    @cached_property
    def seller_sums(self) -> DataFrame:
        return self._ready("seller_sums", seller_sums(self.order_seller))


def refresh_marts(raw: dict[str, DataFrame], folder: str, kept: int = 1) -> Marts:
    """Builds the order lines, the three marts and the sums by category and seller as a new version of the folder, and publishes it.

    Each mart reads the one before from storage, so a lost executor costs one step and no plan
    recomputes the whole lineage; items are joined with products once. Readers see the version before
    until all tables are written, then this one; a refresh that dies leaves them the old set. Of the
    superseded versions the last kept ones stay for whoever still reads them. Repeated keys raise
    before anything is written: a join would multiply rows, and with them every count.
    """
    require_unique_keys(raw)
    spark = raw["raw_orders"].sparkSession
    version = versions.new_version()
    path = version.path(folder)
    rows = {}

    def store(
        name: str, df: DataFrame, partition: str | None = None, moved: bool = False
    ) -> DataFrame:
        rows[name] = tables.write_table(df, _path(path, name), partition, moved).get["rows"]
        return tables.read_table(spark, _path(path, name), schemas.mart_schema(name, raw))

    lines = build.order_lines(raw)
    tables.write_table(lines, _path(path, "order_lines"))
    lines = tables.read_table(spark, _path(path, "order_lines"), lines.schema)
    totals = build.order_totals(raw, lines)
    orders = store("orders_mart", _orders_mart(raw, totals), PARTITION, moved=True)
    order_seller = store(
        "order_seller", build.build_order_seller(raw, orders, lines), PARTITION
    )
    sellers = store("seller_mart", build.build_seller_mart(order_seller))
    sums = seller_sums(order_seller)
    rows["seller_sums"] = tables.write_table(sums, _path(path, "seller_sums")).get["rows"]
    sums = tables.read_table(spark, _path(path, "seller_sums"), sums.schema)
    versions.publish(spark, folder, version, rows)
    versions.remove_superseded(spark, folder, kept)
    return Marts(orders, order_seller, sellers, rows, sums)


def read_marts(spark: SparkSession, folder: str, raw: dict[str, DataFrame]) -> Marts:
    """The marts of the published version, or of a folder that holds the tables themselves. The
    orders mart must exist; absent seller marts read as empty tables."""
    version = versions.current_version(spark, folder)
    path = version.path(folder) if version else folder
    if not tables.path_exists(spark, _path(path, "orders_mart")):
        raise FileNotFoundError(f"no orders mart in {folder}; run a refresh first")
    orders, order_seller, sellers = [
        tables.read_optional(spark, _path(path, name), schemas.mart_schema(name, raw))
        for name in schemas.MARTS
    ]
    sums = None
    if tables.path_exists(spark, _path(path, "seller_sums")):
        sums = tables.read_table(spark, _path(path, "seller_sums"), seller_sums(order_seller).schema)
    return Marts(orders, order_seller, sellers, version.rows if version else None, sums)


def ready_marts(spark: SparkSession, folder: str, raw: dict[str, DataFrame]) -> Marts:
    """Stored marts, built first unless a version is published."""
    if versions.current_version(spark, folder):
        return read_marts(spark, folder, raw)
    return refresh_marts(raw, folder)
