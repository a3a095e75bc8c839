"""Global ranks and exact quantiles without sorting the data in one task.

Rows first collapse to one row per distinct value, so a value that holds a third of the data is
one row. The distinct values are cut into ordered buckets, positions are counted inside each
bucket, and the number of rows in earlier buckets is added from a table that has one row per
bucket. Cuts only balance the work; results are exact wherever they fall. By default they are those
of a range exchange within the plan, so nothing runs before the result is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cut_points(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Approximate quantiles of the distinct values, which are what a bucket counts: a value that
    holds most rows takes no more cuts than any other. Runs one pass; returns few numbers."""
    if buckets is None:
        buckets = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    distinct = df.where(F.col(value).isNotNull()).select(value).distinct()
    cuts = distinct.approxQuantile(value, shares, 0.25 / buckets)
    return sorted(set(cuts))


# A level of the key histogram tells this many characters apart: 4,096 cells of hexadecimal keys.
CELL_WIDTH, CELL_LEVELS = 3, 2


def among_smallest(df: DataFrame, key: str, rows: int, levels: int = CELL_LEVELS) -> Column:
    """A condition on df that its first rows by key meet, and of the others only those in the same
    cell as the last of them.

    Keys are counted by their leading characters after the part that all have in common, one pass
    over the key column per level, merged within tasks; a level looks into the cell where the one
    before reached the number of rows. All of this is scalar subqueries of the plan. NULL keys, which
    sort first, meet the condition, and so do all rows of a table that has fewer. Keys are text or
    whole numbers. Rows that share one key are in one cell.
    """
    text = _as_sorted_text(df, key)
    keys = df.where(F.col(key).isNotNull()).select(text.alias("_key"))
    shared = keys.agg(F.min("_key").alias("low"), F.max("_key").alias("high")).selectExpr(
        """aggregate(sequence(1, greatest(length(low), 1)), 0, (same, at) -> CASE
               WHEN same = at - 1 AND substr(low, at, 1) = substr(high, at, 1) AND at <= length(high)
               THEN at ELSE same END) AS shared"""
    ).scalar()

    def cell(source: Column, level: int, width: int = CELL_WIDTH) -> Column:
        return F.substr(source, shared + level * CELL_WIDTH + 1, F.lit(width))

    bound, before = F.lit(""), F.lit(0)
    for level in range(levels):
        inside = keys.where(cell(F.col("_key"), 0, level * CELL_WIDTH) == bound) if level else keys
        cells = inside.groupBy(cell(F.col("_key"), level).alias("cell")).agg(
            F.count("*").alias("n")
        )
        # each cell has a row, so no more cells than rows are of use
        first = cells.orderBy("cell").limit(rows)
        up_to = F.sum("n").over(Window.partitionBy().orderBy("cell"))
        reached = (
            first.withColumn("up_to", before + up_to)
            .where(F.col("up_to") >= rows)
            .agg(F.min_by(
                F.struct("cell", (F.col("up_to") - F.col("n")).alias("before")), "cell"
            ).alias("reached"))
            .scalar()
        )
        bound, before = F.concat(bound, reached["cell"]), reached["before"]
    return F.coalesce(cell(text, 0, levels * CELL_WIDTH) <= bound, F.lit(True))


def _as_sorted_text(df: DataFrame, key: str) -> Column:
    """Text that sorts as the key does: whole numbers by their distance from the smallest one."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.StringType):
        return F.col(key)
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{key} is neither text nor a whole number")
    distance = F.col(key).cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")
    return F.lpad(distance.cast("decimal(20,0)").cast("string"), 20, "0")


def histogram(df: DataFrame, value: str, by: Sequence[str] = (), **extra: Column) -> DataFrame:
    """One row per distinct known value (per group) with its row count."""
    known = df.where(F.col(value).isNotNull())
    counts = [F.count("*").alias("n"), *[c.alias(name) for name, c in extra.items()]]
    return known.groupBy(*by, value).agg(*counts)


def with_positions(
    cells: DataFrame,
    value: str,
    cuts: Sequence[float] | None = None,
    by: Sequence[str] = (),
    weight: str = "n",
) -> DataFrame:
    """Adds below, ties, average_rank and group_rows to rows that each stand for `weight` rows.

    Several rows may share a value; ties then counts them together. Rows that agree in all columns
    but the weight may come back as one. cuts are the cut points of buckets; None stands for a range
    exchange, of all rows as one group. With no cut points each group is counted in one window, which
    suits tables of few distinct values.
    """
    if cuts is None:
        if by:
            raise ValueError("groups are not ranked by a range exchange: give cut points")
        placed = _ranged_positions(cells, value, weight)
    elif cuts:
        placed = _bucketed_positions(cells, value, cuts, by, weight)
    else:
        group = Window.partitionBy(*by)
        placed = cells.withColumns({
            "ties": F.sum(weight).over(Window.partitionBy(*by, value)),
            "group_rows": F.sum(weight).over(group),
            "up_to": F.sum(weight).over(group.orderBy(value)),
        }).withColumn("below", F.col("up_to") - F.col("ties")).drop("up_to")
    return placed.withColumn("average_rank", F.col("below") + (F.col("ties") + 1) / F.lit(2.0))


def _ranged_positions(cells: DataFrame, value: str, weight: str) -> DataFrame:
    """Positions within the partitions of a range exchange, and the rows of the partitions before.

    Partition sizes and rows both read that exchange. Grouping by every column keeps the columns of
    both uses alike, so that it runs once; were it to run twice with other ranges, sizes would not
    agree and the query would fail.
    """
    parts = max(2, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    others = [name for name in cells.columns if name != weight]
    ranged = cells.repartitionByRange(parts, value).withColumn("_part", F.spark_partition_id())
    placed = ranged.groupBy("_part", *others).agg(F.sum(weight).alias(weight))
    sizes = placed.groupBy("_part").agg(F.sum(weight).alias("_size"))
    # as many rows as the exchange has partitions
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", "_size",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_earlier"),
        F.sum("_size").over(Window.partitionBy()).alias("group_rows"),
    )
    part = Window.partitionBy("_part")
    counted = placed.withColumns({
        "_up_to": F.sum(weight).over(part.orderBy(value)),
        "ties": F.sum(weight).over(Window.partitionBy("_part", value)),
        "_here": F.sum(weight).over(part),
    }).join(F.broadcast(offsets), "_part")
    earlier = F.when(F.col("_size") == F.col("_here"), F.col("_earlier")).otherwise(
        F.raise_error(F.lit("the ranges of a global rank were computed twice and differ"))
    )
    below = earlier + F.col("_up_to") - F.col("ties")
    return counted.withColumn("below", below).drop("_part", "_size", "_earlier", "_up_to", "_here")


def _bucketed_positions(
    cells: DataFrame, value: str, cuts: Sequence[float], by: Sequence[str], weight: str
) -> DataFrame:
    splits = [float("-inf"), *cuts, float("inf")]
    cut = Bucketizer(splits=splits, inputCol=value, outputCol="bucket").transform(cells)
    keys = [*by, "bucket"]
    per_bucket = cut.groupBy(*keys).agg(F.sum(weight).alias("bucket_rows"))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys,
        F.coalesce(F.sum("bucket_rows").over(before), F.lit(0)).alias("earlier"),
        F.sum("bucket_rows").over(Window.partitionBy(*by)).alias("group_rows"),
    )
    counted = cut.withColumns({
        "up_to": F.sum(weight).over(Window.partitionBy(*keys).orderBy(value)),
        "ties": F.sum(weight).over(Window.partitionBy(*keys, value)),
    })
    below = F.col("earlier") + F.col("up_to") - F.col("ties")
    return (
        counted.join(offsets, keys)
        .withColumn("below", below)
        .drop("bucket", "up_to", "earlier")
    )


def quantiles(
    cells: DataFrame,
    value: str,
    names: dict[str, float],
    cuts: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per name, one row per group."""
    placed = with_positions(cells, value, cuts, by)
    return read_quantiles(placed, value, names, F.col("group_rows"), by)


def read_quantiles(
    placed: DataFrame, value: str, names: dict[str, float], rows: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Quantiles of the first `rows` values in order, from rows that carry positions."""
    until = F.col("below") + F.col("ties")

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("below") <= position) & (position < until), F.col(value)))

    picks, result = [], []
    for name, share in names.items():
        position = F.lit(share) * (rows - 1)
        lower = F.floor(position)
        picks += [
            at(lower).alias(f"{name}__low"),
            at(F.least(lower + 1, rows - 1)).alias(f"{name}__high"),
            F.max(position - lower).alias(f"{name}__part"),
        ]
        low, high = F.col(f"{name}__low"), F.col(f"{name}__high")
        result.append((low + (high - low) * F.col(f"{name}__part")).alias(name))
    return placed.groupBy(*by).agg(*picks).select(*by, *result)


def weighted_rank_correlation(
    cells: DataFrame,
    x: str,
    y: str,
    x_cuts: Sequence[float] | None = None,
    y_cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Spearman's rho with average ranks from rows (x, y, n): one row with n and rho.

    Ranks of x are summed per y before y is ranked, so a frequent y is merged map-side and the two
    rankings need no join. cuts are those of with_positions.
    """
    centred = F.col("average_rank") - (F.col("group_rows") + 1) / F.lit(2.0)
    per_y = (
        with_positions(cells, x, x_cuts)
        .select(y, "n", centred.alias("dx"))
        .groupBy(y)
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.expr("n * dx")).alias("sum_dx"),
            F.sum(F.expr("n * dx * dx")).alias("sum_dx2"),
        )
    )
    sums = with_positions(per_y, y, y_cuts).withColumn("dy", centred).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.sum(F.expr("sum_dx * dy")).alias("sxy"),
        F.sum("sum_dx2").alias("sxx"),
        F.sum(F.expr("n * dy * dy")).alias("syy"),
    )
    return sums.selectExpr(
        "n",
        """CASE WHEN sxx > 0 AND syy > 0
                THEN greatest(-1D, least(1D, sxy / (sqrt(sxx) * sqrt(syy)))) END AS rho""",
    )
