"""SimHash near-duplicates through an inverted index of fingerprint bytes.

Fingerprints that differ in at most k of 64 bits share at least 8 - k of their eight bytes, position
for position. The index is split by runs of matching bytes: sets of positions are chosen such that
any 8 - k positions contain one of them, and fingerprints equal on such a set form a block. Within a
block the shared positional bytes of each pair are tallied, pairs with fewer than 8 - k are passed
over, the rest are verified on all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martwright.llm.common import record_batch, slices, stored
from martwright.llm.components import components

SEED = 42
#: Matching bytes that a block's key holds at most.
_KEY_BYTES = 3
#: Fingerprints of a block that one step compares; larger blocks are split by another byte.
BLOCK_ROWS = 4096

_BITS = 64
_SHIFTS = np.arange(0, _BITS, 8, dtype=np.uint64)


def simhash(text: bytes, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of width-word shingles; of the whole sequence if there are fewer."""
    return int(simhashes([text], width)[0])


def simhashes(texts: list[bytes], width: int = 4) -> np.ndarray:
    """A bit is set if it is set in over half of the shingles' XXH64; without words it is 0."""
    out = np.zeros(len(texts), np.uint64)
    hashes, rows, counts = [], [], []
    for i, text in enumerate(texts):
        words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
        if not words:
            continue
        line = b" ".join(words)
        if len(words) <= width:
            found = [xxhash.xxh64_intdigest(line, SEED)]
        else:
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = np.concatenate([[0], ends[:-width]]).tolist()
            ends = (ends[width - 1 :] - 1).tolist()
            digest = xxhash.xxh64_intdigest
            found = [digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)]
        hashes.append(np.array(found, np.uint64))
        rows.append(i)
        counts.append(len(found))
    if not rows:
        return out
    flat = np.concatenate(hashes)
    bits = np.unpackbits(flat.astype(">u8").view(np.uint8)).reshape(-1, _BITS)
    starts = np.cumsum(counts) - counts
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    majority = 2 * ones > np.array(counts)[:, None]
    out[rows] = np.packbits(majority, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprint_of(width: int = 4):
    """A text column's fingerprint as a signed long; a null text has no words."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        rows = texts.tolist()
        found = [simhashes(rows[part], width) for part in slices(rows, 1 << 20)]
        return pd.Series(np.concatenate(found).view(np.int64) if found else [], dtype="int64")

    return lambda text: fingerprint(F.coalesce(text, F.lit("")).cast("binary"))


def position_sets(matches: int, size: int) -> list[tuple[int, ...]]:
    """Sets of size byte positions of which any choice of matches positions contains one.

    Greedy: the set that settles most of the open choices comes next.
    """
    wanted = {frozenset(c) for c in combinations(range(8), matches)}
    sets = list(combinations(range(8), size))
    chosen = []
    while wanted:
        best = max(sets, key=lambda s: sum(wanted_one.issuperset(s) for wanted_one in wanted))
        chosen.append(best)
        wanted = {w for w in wanted if not w.issuperset(best)}
    return chosen


def _mask(positions: tuple[int, ...]) -> int:
    bits = sum(0xFF << 8 * p for p in positions)
    return bits - (1 << _BITS) if bits >> 63 else bits


def _matching_bytes(different: np.ndarray) -> np.ndarray:
    """Byte positions that hold no differing bit."""
    return (((different[:, None] >> _SHIFTS) & np.uint64(0xFF)) == 0).sum(axis=1)


class _Roots:
    """Least linked row of each row of a block."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def flatten(self) -> None:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return
            self.parent = up


def block_links(block: np.ndarray, prints: np.ndarray, matches: int, bits: int) -> np.ndarray:
    """Pairs of rows of one block that join all its linked rows; block is ascending.

    Row i meets row i + 1, then i + 2, and so on while the block lasts. A pair whose rows are joined
    already adds nothing to the components and is passed over.
    """
    n = len(prints)
    last = np.searchsorted(block, block, side="right")  # end of each row's block
    roots, links, step = _Roots(n), [], 1
    rows = np.flatnonzero(np.arange(n) + 1 < last)
    while len(rows):
        other = rows + step
        open_pairs = roots.parent[rows] != roots.parent[other]
        a, b = rows[open_pairs], other[open_pairs]
        different = prints[a] ^ prints[b]
        enough = _matching_bytes(different) >= matches  # count filter on positional bytes
        a, b, different = a[enough], b[enough], different[enough]
        near = np.bitwise_count(different) <= bits
        for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
            x, y = roots.find(i), roots.find(j)
            if x != y:
                roots.parent[max(x, y)] = min(x, y)
                links.append((i, j))
        roots.flatten()
        step += 1
        rows = rows[rows + step < last[rows]]
    return np.array(links, np.int64).reshape(-1, 2)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linker(matches: int, bits: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are sorted by block; a block that goes on in the next batch waits for it."""
        kept_keys: list = []
        kept_prints: list = []

        def links(keys, prints):
            if len(prints) < 2:
                return None
            found = block_links(keys, prints, matches, bits)
            if not len(found):
                return None
            signed = prints.view(np.int64)
            return record_batch(_LINKS, a=signed[found[:, 0]], b=signed[found[:, 1]])

        for batch in batches:
            keys = batch["block"].to_numpy()
            prints = batch["fingerprint"].to_numpy().view(np.uint64)
            if not len(keys):
                continue
            if kept_keys and kept_keys[-1][-1] == keys[0] == keys[-1]:
                kept_keys.append(keys)
                kept_prints.append(prints)
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            done = links(
                np.concatenate([*kept_keys, keys[:cut]]), np.concatenate([*kept_prints, prints[:cut]])
            )
            if done is not None:
                yield done
            kept_keys, kept_prints = [keys[cut:]], [prints[cut:]]
        if kept_keys:
            done = links(np.concatenate(kept_keys), np.concatenate(kept_prints))
            if done is not None:
                yield done

    return link


def _block_keys(prints: DataFrame, positions: list[tuple[int, ...]]) -> DataFrame:
    """A row for each fingerprint and set of positions."""
    sets = F.array(*[
        F.struct(F.lit(i).alias("set"), F.lit(_mask(p)).cast("long").alias("mask"))
        for i, p in enumerate(positions)
    ])
    rows = prints.select("fingerprint", F.explode(sets).alias("s"))
    return rows.select(
        "fingerprint",
        F.col("s.set").alias("set"),
        F.col("fingerprint").bitwiseAND(F.col("s.mask")).alias("shared"),
    )


def _refined(rows: DataFrame, positions: list[tuple[int, ...]], matches: int, most: int) -> DataFrame:
    """Blocks of at most about most rows: a larger one is split by each further byte in turn.

    Any linked pair of a block shares a further byte while the key holds fewer than matches. Blocks
    whose keys hold them all are cut into chunks, and every two chunks meet.
    """
    n_sets = len(positions)
    rows = rows.withColumn("block", F.xxhash64("set", "shared"))
    table = {p: i for i, p in enumerate(positions)}
    large = stored(rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most))
    if large.isEmpty():
        return rows.select("block", "fingerprint")
    marked = rows.join(large, "block", "left")
    small = marked.where("n is null").select("block", "fingerprint")
    over = marked.where("n is not null")
    if len(positions[0]) < matches:
        deeper = sorted({tuple(sorted({*p, q})) for p in positions for q in range(8) if q not in p})
        number = {p: i for i, p in enumerate(deeper)}
        steps = F.array(*[
            F.array(*[
                F.struct(
                    F.lit(number[tuple(sorted({*p, q}))]).alias("set"),
                    F.lit(_mask(tuple(sorted({*p, q})))).cast("long").alias("mask"),
                )
                for q in range(8) if q not in p
            ])
            for p in sorted(table, key=table.get)
        ])
        again = over.select("fingerprint", "block", F.explode(F.element_at(steps, F.col("set") + 1)).alias("s"))
        again = again.select(
            "fingerprint", F.col("s.set").alias("set"),
            F.col("fingerprint").bitwiseAND(F.col("s.mask")).alias("shared"),
        ).distinct()
        return small.unionByName(_refined(again, deeper, matches, most))
    chunks = F.ceil(2 * F.col("n") / most).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), chunks).cast("int")
    cut = over.select("fingerprint", "block", chunks.alias("chunks"), own.alias("own"))
    meet = cut.select(
        "fingerprint", "block", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    )
    return small.unionByName(meet.select(
        F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other")).alias("block"),
        "fingerprint",
    ).distinct())


def fingerprint_links(
    prints: DataFrame, bits: int = 4, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """a, b: fingerprints (distinct, in column fingerprint) within bits of each other.

    Not all pairs: within a block only those that join its linked rows, so a group of n near copies
    gives about n links and no link between two groups is lost. bits from 0 to 7.
    """
    if not 0 <= bits <= 7:
        raise ValueError("the index needs a byte in common: bits from 0 to 7")
    matches = 8 - bits
    positions = position_sets(matches, min(_KEY_BYTES, matches))
    rows = _block_keys(prints, positions)
    blocks = _refined(rows, positions, matches, block_rows)
    placed = blocks.repartition("block").sortWithinPartitions("block", "fingerprint")
    return placed.mapInArrow(_linker(matches, bits), "a long, b long").distinct()


def _text_key(text: F.Column) -> F.Column:
    """128 bits of hash that stand for a text."""
    return F.struct(F.xxhash64(text).alias("low"), F.xxhash64(F.lit(1), text).alias("high"))


def _with_components(
    docs: DataFrame, width: int, bits: int, id_column: str, text_column: str
) -> DataFrame:
    """doc_id, text_key, fingerprint, root (the component's least fingerprint) and component_id."""
    prints = stored(docs.select(
        F.col(id_column).alias("doc_id"), _text_key(F.col(text_column)).alias("text_key"),
        fingerprint_of(width)(F.col(text_column)).alias("fingerprint"),
    ))
    firsts = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    roots = components(fingerprint_links(firsts.select("fingerprint"), bits))
    by_root = firsts.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")
    )
    least = by_root.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = by_root.join(least, "root").select("fingerprint", "root", "component_id")
    return prints.join(named, "fingerprint")


def near_duplicates(
    docs: DataFrame,
    width: int = 4,
    bits: int = 4,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Documents are linked if their fingerprints differ in at most bits bits; component_id is the
    least id that links reach. Null and empty texts and texts without words have fingerprint 0.
    Null ids stay; a component without any id has a null component_id. Repeated rows stay. An empty
    table gives no rows. Other columns are not read.
    """
    rows = _with_components(docs, width, bits, id_column, text_column)
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return rows.select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_first(
    docs: DataFrame,
    width: int = 4,
    bits: int = 4,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One document of each component, that with the least id, with all its columns.

    Null ids come last. Of several rows with that id the least fingerprint, then the least hash of
    the text stays; of rows that agree in id and text, one. Survivors are chosen on ids and hashes; the
    documents are then only filtered. An empty table gives no rows.
    """
    ranked = _with_components(docs, width, bits, id_column, text_column)
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "fingerprint", "text_key")
    rows = ranked.groupBy("root", place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct("place", "n")).alias("first"))
    kept = stored(first.select(
        F.col("first.place.doc_id").alias("first_id"), F.col("first.place.text_key").alias("first_key"),
        F.col("first.n").alias("n"),
    ))
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_column).alias("own_id"), _text_key(F.col(text_column)).alias("own_key"),
    )
    same = F.col("own_id").eqNullSafe(F.col("first_id")) & (F.col("own_key") == F.col("first_key"))
    once = own.join(kept.where("n = 1"), same, "left_semi").select("row")
    # rows alike in id and text are merged in their tasks before they meet
    several = own.join(kept.where("n > 1"), same, "left_semi")
    several = several.groupBy("own_id", "own_key").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(several).select("row.*")
