"""One-permutation MinHash fingerprints of word shingles, packed to low bits.

Every shingle is hashed once: the top bits choose a bin, the rest compete for the bin's minimum.
Empty bins take the value of a bin that their own random order of bins meets first (optimal
densification). A bin keeps its lowest bits only; the share of equal bins is corrected for
chance matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import (
    id_part,
    id_splits,
    mix,
    parts_for,
    record_batch,
    slices,
    text_bytes,
)

BINS, BITS, WORDS = 256, 4, 5
_BIN_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(WORDS, 0x9E3779B97F4A7C15, np.uint64))


def _orders() -> np.ndarray:
    """For each bin the order in which it asks the others, from hashes of (bin, asked bin)."""
    pairs = np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(1)
    return np.argsort(mix(mix(pairs)).reshape(BINS, BINS), axis=1)


_ORDERS = _orders()


def shingle_hashes(text: str) -> np.ndarray:
    """A hash for each run of five words; of all words if there are fewer; none without words."""
    words = text.encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        return mix(sum(hashes[j : j + n] * _POWERS[j] for j in range(width)))


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of BINS values below 2**BITS for each text; texts without words get zeros."""
    hashes = [shingle_hashes(t) for t in texts]
    lengths = np.fromiter(map(len, hashes), np.int64, len(hashes))
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    cell = np.repeat(np.arange(len(texts)), lengths) * BINS + (flat >> _BIN_SHIFT).astype(np.int64)
    lowest = np.full(len(texts) * BINS, _EMPTY)
    np.minimum.at(lowest, cell, flat)
    lowest = lowest.reshape(len(texts), BINS)
    full = lowest != _EMPTY
    out = lowest.copy()
    rows, bins = np.nonzero(~full & (lengths > 0)[:, None])
    for step in range(BINS):
        if not len(rows):
            break
        asked = _ORDERS[bins, step]
        found = full[rows, asked]
        out[rows[found], bins[found]] = lowest[rows[found], asked[found]]
        rows, bins = rows[~found], bins[~found]
    out[lengths == 0] = 0
    # minima are small numbers within a bin: their bits are spread before the lowest are kept
    out[lengths > 0] = mix(out[lengths > 0])
    return (out & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def pack(values: np.ndarray) -> list[str]:
    """Two bins to a byte, in hex."""
    return [row.tobytes().hex() for row in (values[:, ::2] << BITS) | values[:, 1::2]]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of rows, 0 to 1: equal bins beyond those that chance makes equal."""
    chance = 1 / (1 << BITS)
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come part by part, descending; the last row of a part is the next part's first."""
    part, ident, text, print_ = None, None, None, None  # the row that waits for its successor
    for batch in batches:
        parts, ids = batch["part"].to_pylist(), batch["doc_id"].to_pylist()
        texts = batch["text"].to_pylist()
        for piece in slices(texts):
            own_parts, own_ids, own = parts[piece], ids[piece], texts[piece]
            prints = fingerprints(own)
            if part is not None:
                own_parts, own_ids, own = [part, *own_parts], [ident, *own_ids], [text, *own]
                prints = np.concatenate([print_[None], prints])
            at = [i for i in range(len(own) - 1) if own_parts[i] == own_parts[i + 1]]
            if at:
                here, there = np.array(at), np.array(at) + 1
                edited = [edited_text(own[i], own[i + 1]) for i in at]
                edited_prints = fingerprints(edited)
                yield record_batch(
                    _OUT,
                    doc_id=[own_ids[i] for i in at],
                    n_chars=[len(own[i]) for i in at],
                    edited_sha256=[hashlib.sha256(e.encode()).hexdigest() for e in edited],
                    fingerprint=pack(prints[here]),
                    edited_fingerprint=pack(edited_prints),
                    near_edited=likeness(prints[here], edited_prints),
                    near_next=likeness(prints[here], prints[there]),
                )
            part, ident, text, print_ = own_parts[-1], own_ids[-1], own[-1], prints[-1]


def fingerprint_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Fingerprints of every row's text and of its edited text, and two likenesses.

    The next document is the one with the next smaller id; after the last comes the first. Rows with
    equal ids follow each other by text, null ids come last; null texts are empty. A single row is
    its own next. Texts without words have an all-zero fingerprint and are alike. An empty table
    gives no rows. Ids must be whole numbers; other columns are not read.

    Ids are cut into parts of about equal size. Each part is one partition, sorted, and also gets the
    first row of the part after it, so no order over the whole table is needed.
    """
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    parts = parts_for(text_bytes(rows, "text"), most=10_000)
    splits = id_splits(rows, "doc_id", parts)
    number = id_part(F.col("doc_id"), splits)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    # the first row of each part, by its id and text; at most one for each part comes to the driver
    firsts = rows.select(number.alias("part"), "doc_id").groupBy("part").agg(
        F.max("doc_id").alias("doc_id")
    ).collect()
    first = {r.part: r.doc_id for r in firsts}
    present = sorted(first, reverse=True)
    before = dict(zip(present, present[-1:] + present[:-1], strict=True))
    heads = F.array(*[F.struct(
        F.lit(p).alias("part"), F.lit(first[p]).cast("long").alias("doc_id"),
        F.lit(before[p]).alias("before"),
    ) for p in present]) if present else F.array()
    placed = rows.select(number.alias("own"), "doc_id", "text")
    if not present:
        return _empty(docs)
    return _with_heads(placed, heads, order, len(present))


def _with_heads(placed: DataFrame, heads: F.Column, order: list, parts: int) -> DataFrame:
    """Rows with the head of each part repeated at the end of the part before it."""
    own = placed.select(F.col("own").alias("part"), F.lit(0).alias("late"), "doc_id", "text")
    table = placed.sparkSession.range(1).select(F.explode(heads).alias("h")).select(
        F.col("h.part").alias("own"), F.col("h.doc_id").alias("head_id"), F.col("h.before").alias("before")
    )
    # one row for each part: its size is bounded by their number
    heads_rows = placed.join(F.broadcast(table), "own").where(F.col("doc_id").eqNullSafe(F.col("head_id")))
    late = heads_rows.groupBy("own", "before", "doc_id").agg(F.min("text").alias("text")).select(
        F.col("before").alias("part"), F.lit(1).alias("late"), "doc_id", "text"
    )
    ordered = own.unionByName(late).repartitionById(parts, "part").sortWithinPartitions(
        "part", "late", *order
    )
    return ordered.select("part", "doc_id", "text").mapInArrow(_fingerprint_rows, _ddl(_OUT))


def _empty(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], _ddl(_OUT))


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)
