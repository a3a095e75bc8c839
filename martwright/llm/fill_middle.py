"""Fill-in-middle texts: prefix, middle and suffix cut at units and put in another order.

A unit is a word with the white space before it; white space at the end is a unit too. A text's UTF-8
bytes lie in fixed blocks, and a Fenwick tree over the blocks holds how many units end and how many
code points begin in each. A binary-lifting descent finds the block in which a unit ends together
with the units and code points before it; only that block is then read for the boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from martwright.llm.common import record_batch

#: Bytes of a block.
BLOCK_BYTES = 1024
#: Blocks that are counted at a time.
_WINDOW = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _unit_ends(text: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Whether a unit ends with each byte from start to stop of one text."""
    space = _SPACE[text[start : stop + 1]]
    ends = np.empty(stop - start, bool)
    ends[: len(space) - 1] = ~space[:-1] & space[1:]
    if stop == len(text):
        ends[-1] = True
    return ends


def _points(text: np.ndarray) -> np.ndarray:
    """Whether a code point begins with each byte."""
    return (text & 0xC0) != 0x80


class BlockTree:
    """Unit ends and code points of a text's blocks, in a Fenwick tree."""

    def __init__(self, text: np.ndarray, block_bytes: int = BLOCK_BYTES):
        self.text, self.block_bytes = text, block_bytes
        blocks = -(-len(text) // block_bytes)
        sums = np.zeros((blocks + 1, 2), np.int64)  # of all blocks before
        for first in range(0, blocks, _WINDOW):
            start = first * block_bytes
            stop = min(len(text), (first + _WINDOW) * block_bytes)
            cuts = np.arange(0, stop - start, block_bytes)
            for column, marks in enumerate(
                (_unit_ends(text, start, stop), _points(text[start:stop]))
            ):
                found = np.add.reduceat(marks, cuts, dtype=np.int64)
                sums[first + 1 : first + 1 + len(cuts), column] = found
        np.cumsum(sums, axis=0, out=sums)
        nodes = np.arange(blocks + 1)
        self.tree = (sums - sums[nodes & (nodes - 1)]).tolist()  # node i covers its low bit's blocks
        self.units = int(sums[-1, 0])

    def block_of(self, unit: int) -> tuple[int, int, int]:
        """The block in which the unit-th unit (from 1) ends; units and code points before it."""
        node, units, points = 0, 0, 0
        step = 1 << (len(self.tree) - 1).bit_length()
        while step:
            after = node + step
            if after < len(self.tree) and units + self.tree[after][0] < unit:
                node = after
                units += self.tree[after][0]
                points += self.tree[after][1]
            step >>= 1
        return node, units, points

    def boundary(self, unit: int) -> tuple[int, int]:
        """Bytes and code points of the first units of the text."""
        if unit == 0:
            return 0, 0
        block, units, points = self.block_of(unit)
        start = block * self.block_bytes
        stop = min(len(self.text), start + self.block_bytes)
        ends = np.flatnonzero(_unit_ends(self.text, start, stop))
        end = start + int(ends[unit - units - 1]) + 1
        return end, points + int(np.count_nonzero(_points(self.text[start:end])))


def _arranged(text: bytes, draws: tuple[int, int, int, int], rate: int, spm_rate: int) -> tuple:
    """n, form, prefix_chars, middle_chars and the text in its new order."""
    if not text:
        return 0, "plain", None, None, text
    tree = BlockTree(np.frombuffer(text, np.uint8))
    n = tree.units
    marks = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if draws[2] % 100 >= rate or any(mark in text for mark in marks):
        return n, "plain", None, None, text
    cuts = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    (a, before), (b, until) = map(tree.boundary, cuts)
    prefix, middle, suffix = marks[0] + text[:a], marks[2] + text[a:b], marks[1] + text[b:]
    spm = draws[3] % 100 < spm_rate
    parts = (suffix, prefix, middle) if spm else (prefix, suffix, middle)
    return n, "spm" if spm else "psm", before, until - before, b"".join(parts)


def draws_of(doc_id: Column, seed: int = 42) -> Column:
    """Four numbers below 2 ** 32 from the sha256 of seed, a colon and the decimal id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[
        F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)
    ])


def fill_in_middle(
    docs: DataFrame,
    rate: int = 50,
    spm_rate: int = 80,
    seed: int = 42,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every row.

    Both cuts are drawn from the id among the n + 1 places between units. Of a hundred drawn texts
    rate are rearranged, and of a hundred of these spm_rate in the form spm (suffix first), the rest in
    the form psm (prefix first). Texts that are empty or hold one of the three marks stay plain; for
    plain texts output is the text and both lengths are null. A null text is empty; a null id draws
    as an empty one. Repeated rows have the same result each time. An empty table gives no rows. Other
    columns are not read, and nothing is shuffled.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.select(F.col(id_column)).schema[0].dataType),
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.BinaryType()),
    ])
    out_schema = to_arrow_schema(schema)

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, draws = part["text"].to_pylist(), part["draws"].to_pylist()
                found = [
                    _arranged(text, own, rate, spm_rate)
                    for text, own in zip(texts, draws, strict=True)
                ]
                columns = zip(*found, strict=True)
                yield record_batch(
                    out_schema, doc_id=part["doc_id"],
                    **dict(zip(schema.names[1:], map(list, columns), strict=True)),
                )

    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"),
        draws_of(F.col(id_column), seed).alias("draws"),
    )
    return rows.mapInArrow(arrange, schema).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text before it was rearranged: each mark stands once in what is not plain."""

    def after(mark: str) -> Column:
        return F.substring_index(output, mark, -1)

    def between(first: str, second: str) -> Column:
        return F.substring_index(F.substring_index(output, first, -1), second, 1)

    psm = F.concat(between(PREFIX, SUFFIX), after(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
