"""The eight raw tables from CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright import labels, schemas
from martwright.sources.tables import path_exists

# Review texts may hold line breaks, so one task reads a file of them whole; the others split. A name may
# be that of a folder: its files are read by a task each.
MULTI_LINE = frozenset({"raw_order_reviews"})


class MissingDataError(FileNotFoundError):
    """Raised with every absent file."""


def file_names(prefix: str = "", suffix: str = "_dataset.csv") -> dict[str, str]:
    """Raw table -> file name, for a given naming pattern."""
    named = {
        table: f"{prefix}{table.removeprefix('raw_')}{suffix}"
        for table in schemas.RAW
        if table != "raw_category_translation"
    }
    return {**named, "raw_category_translation": "product_category_name_translation.csv"}


def require_files(spark: SparkSession, folder: str, files: dict[str, str]) -> None:
    paths = [f"{folder.rstrip('/')}/{name}" for name in files.values()]
    absent = [path for path in paths if not path_exists(spark, path)]
    if absent:
        raise MissingDataError("required CSV files not found:\n" + "\n".join(absent))


def _typed(name: str, kind) -> Column:
    text = F.col(f"`{name}`")
    known = F.when(~text.isin(*labels.MISSING_TOKENS), text)
    if kind.simpleString() == "int":  # "5.0" is an integer too
        return known.try_cast("double").try_cast("int").alias(name)
    return known.try_cast(kind).alias(name)


def read_raw_csv(
    spark: SparkSession, folder: str, files: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    """Tables with fixed types, matched by header name; unreadable cells become NULL.

    Each name is that of a file or of a folder of files with the same header. Rows of tables whose
    files do not split are spread over tasks, without the columns that are not in use.
    """
    files = files or file_names()
    require_files(spark, folder, files)
    tables = {}
    for table, name in files.items():
        text = (
            spark.read.option("header", True)
            .option("multiLine", table in MULTI_LINE)
            .option("quote", '"').option("escape", '"')
            .csv(f"{folder.rstrip('/')}/{name}")
        )
        columns = schemas.RAW[table]
        schemas.require_columns(text, columns, table)
        typed = text.select(*[_typed(column, kind) for column, kind in columns.items()])
        tables[table] = typed.hint("rebalance") if table in MULTI_LINE else typed
    return tables


def duplicate_keys(raw: dict[str, DataFrame]) -> DataFrame:
    """Keys that occur more than once: (table, key, rows). Empty if the marts are safe to build."""
    parts = [
        raw[table].groupBy(F.col(key).cast("string").alias("key"))
        .agg(F.count("*").alias("rows"))
        .where(F.col("rows") > 1)
        .select(F.lit(table).alias("table"), "key", "rows")
        for table, key in schemas.RAW_KEYS.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def row_counts(raw: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) for every raw table."""
    result = None
    for table, df in raw.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(table).alias("table"), "rows")
        result = part if result is None else result.unionByName(part)
    return result
