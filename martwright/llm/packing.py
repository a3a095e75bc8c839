"""Best-fit packing of token sequences into bins of several permitted lengths.

Best-fit decreasing looks only at lengths, and there are at most as many lengths as the largest
permitted bin is long. So the bins are planned from the histogram of lengths: a run of equal lengths
is put into a run of equal bins at once, with the same result as one item after the other. Every
item then finds its place by its rank among the items of its length.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright.llm.common import stored

CAPACITIES = (2048, 4096, 8192, 16384)
#: Cost of a bin beyond its slots, in slots: padding, attention masks and scheduling of a sequence.
BIN_COST = 64
#: Least items of the commonest length that a bucket is made for; the root of all items if larger.
_BUCKET_ROWS = 500


@dataclass(frozen=True)
class Plan:
    """Where items go. runs: rows (length, rank, bin, each, offset): from that rank on, each items of
    the length share a bin, the first bin being bin, the first offset being offset. bins: rows
    (bin, capacity): from that bin on, bins have that capacity. Both ascend."""

    runs: np.ndarray
    bins: np.ndarray
    n_bins: int


class _Open:
    """Runs of equal open bins, ordered by the room left and then by their first bin."""

    def __init__(self):
        self.runs: list[tuple[int, int, int, int]] = []  # room, first bin, number, capacity

    def take(self, length: int):
        """The fullest run that has room for the length."""
        at = bisect_left(self.runs, (length, -1, -1, -1))
        return self.runs.pop(at) if at < len(self.runs) else None

    def put(self, room: int, first: int, number: int, capacity: int) -> None:
        if number:
            insort(self.runs, (room, first, number, capacity))


def _filled(capacity: int, length: int, lengths: list[int], left: Mapping[int, int]) -> int:
    """Slots that a new bin would fill if it took the longest items that still fit, one by one."""
    room = capacity - length
    taken = {length: 1}
    at = bisect_left(lengths, room + 1) - 1
    while room > 0 and at >= 0:
        item = lengths[at]
        n = min(left[item] - taken.get(item, 0), room // item)
        room -= max(n, 0) * item
        at = min(at - 1, bisect_left(lengths, room + 1) - 1)
    return capacity - room


def plan_bins(
    histogram: Mapping[int, int],
    capacities: Sequence[int] = CAPACITIES,
    bin_cost: int = BIN_COST,
) -> Plan:
    """Best-fit decreasing over a histogram of lengths, none above the largest capacity.

    Lengths are taken from the longest. An item goes to the open bin with the least room that fits
    it. If none does, a bin is opened: of the capacities that hold the item the one with the least
    cost (slots plus bin_cost) for each slot that the items still unplaced would fill; the smaller one
    if equal. At the end every bin shrinks to the least capacity that holds its contents.
    """
    sizes = sorted(set(capacities))
    left = {k: int(n) for k, n in histogram.items() if n > 0}
    lengths = sorted(left)
    if lengths and (lengths[0] < 1 or lengths[-1] > sizes[-1]):
        raise ValueError("lengths go from 1 to the largest capacity")
    open_bins, runs, n_bins = _Open(), [], 0
    for length in reversed(lengths):
        count, rank, chosen = left[length], 0, None
        while rank < count:
            run = open_bins.take(length)
            if run is None:
                if chosen is None:
                    chosen = min(
                        (c for c in sizes if c >= length),
                        key=lambda c: ((c + bin_cost) / _filled(c, length, lengths, left), c),
                    )
                each = chosen // length
                run = chosen, n_bins, -(-(count - rank) // each), chosen
                n_bins += run[2]
            room, first, number, capacity = run
            each = room // length
            placed = min(count - rank, each * number)
            runs.append((length, rank, first, each, capacity - room))
            full, rest = divmod(placed, each)
            open_bins.put(room - each * length, first, full, capacity)
            open_bins.put(room - rest * length, first + full, 1 if rest else 0, capacity)
            used = full + (1 if rest else 0)
            open_bins.put(room, first + used, number - used, capacity)
            rank += placed
        del left[length]
        lengths.pop()
    final = sorted(
        (first, sizes[bisect_left(sizes, capacity - room)])
        for room, first, _, capacity in open_bins.runs
    )
    runs.sort()
    return Plan(np.array(runs, np.int64).reshape(-1, 5), np.array(final, np.int64).reshape(-1, 2), n_bins)


def _pieces(length: Column, largest: int) -> Column:
    """Starts of the pieces of a sequence: cut at every largest token."""
    return F.when(length > 0, F.sequence(F.lit(0).cast("long"), length - 1, F.lit(largest).cast("long")))


def pack_documents(
    docs: DataFrame,
    capacities: Sequence[int] = CAPACITIES,
    bin_cost: int = BIN_COST,
    length: Column | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row for each piece of a document: doc_id, piece, start, length, bin_id, capacity, offset.

    length: tokens of a row; by default bytes of the text and one end mark, as a byte-level model
    reads them. A sequence longer than the largest capacity is cut into pieces of that length and a
    rest, so nothing is dropped. Null and empty texts have the end mark only; rows whose length is
    null or below 1 have no piece. Repeated rows and null ids are packed like others, an empty table
    gives no rows. Texts are read for their length only.

    The driver holds the histogram, at most as many rows as the largest capacity, and the plan, which
    grows with the histogram and not with the documents. Items of one length are ranked in buckets
    of the id's hash, so a length that a third of the rows have is split.
    """
    largest = max(capacities)
    if length is None:
        length = F.coalesce(F.octet_length(F.col(text_column)), F.lit(0)) + 1
    whole = docs.select(F.col(id_column).alias("doc_id"), length.cast("long").alias("tokens"))
    pieces = whole.select(
        "doc_id", "tokens", F.posexplode(_pieces(F.col("tokens"), largest)).alias("piece", "start")
    )
    size = F.least(F.lit(largest).cast("long"), F.col("tokens") - F.col("start"))
    items = stored(pieces.select("doc_id", "piece", "start", size.alias("length")))
    rows = items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = {r["length"]: r["n"] for r in rows}
    plan = plan_bins(histogram, capacities, bin_cost)
    bucket_rows = max(_BUCKET_ROWS, math.isqrt(sum(histogram.values())))
    buckets = max(1, -(-max(histogram.values(), default=0) // bucket_rows))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = items.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")
    )
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = items.withColumn("place", F.row_number().over(order) - 1).join(
        offsets, ["length", "bucket"]
    )

    @F.pandas_udf("bin_id long, capacity int, offset int")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        return _places(shared.value, lengths.to_numpy(), ranks.to_numpy())

    placed = ranked.withColumn("placed", place("length", F.col("place") + F.col("earlier")))
    return placed.select("doc_id", "piece", "start", "length", "placed.*")


def _places(plan: Plan, lengths: np.ndarray, ranks: np.ndarray) -> pd.DataFrame:
    runs = plan.runs
    # the last run of the length that begins at or before the rank
    keys = np.rec.fromarrays([runs[:, 0], runs[:, 1]])
    at = np.searchsorted(keys, np.rec.fromarrays([lengths, ranks]), side="right") - 1
    nth = ranks - runs[at, 1]
    bins = runs[at, 2] + nth // runs[at, 3]
    capacity = plan.bins[np.searchsorted(plan.bins[:, 0], bins, side="right") - 1, 1]
    return pd.DataFrame({
        "bin_id": bins,
        "capacity": capacity.astype(np.int32),
        "offset": (runs[at, 4] + nth % runs[at, 3] * lengths).astype(np.int32),
    })


