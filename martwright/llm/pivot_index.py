"""Approximate nearest neighbours by permutations of pivots.

A vector is represented by the order of its nearest pivots. Each block of vectors keeps an inverted
file for every pivot: the vectors that have it among their nearest ones, with its place there. A query
adds up, over the files of its own nearest pivots, how far the places agree, which gives the footrule
distance of the two orders; the vectors with the least distances of a block are ranked again by their
true inner products. Blocks are searched apart from each other and their best results merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright.llm.common import parts_for, ranges, record_batch, send_package, stored

#: Pivots, and how many of them stand for a vector.
PIVOTS, NEAREST = 256, 64
#: Share of a block's vectors, and at least so many, that are ranked again.
RERANKED, LEAST_RERANKED = 0.2, 500
#: Distinct vectors that pivots are chosen from.
SAMPLE_ROWS = 4096
#: Bytes of a block's vectors, and of the queries that go through a block at a time.
_BLOCK_BYTES, _QUERY_BYTES = 4 << 20, 1 << 20
#: Blocks of queries that one task takes through a block of the index.
_QUERY_BLOCKS = 32


def usable(vector: Column, size: int | None = None) -> Column:
    """Neither null nor zero, without null or non-finite components and, if given, of that size."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    fit = vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)
    return F.coalesce(fit & (F.size(vector) == size) if size is not None else fit, F.lit(False))


def _dots(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products whose rounding does not hang on a row's place, so that copies tie."""
    return (vectors * query).sum(axis=1)


@dataclass(frozen=True)
class PivotOrder:
    """Pivots, with the components that bring vectors to one length, and that length's square."""

    pivots: np.ndarray
    last: np.ndarray
    square: float
    nearest: int

    @classmethod
    def build(cls, pivots: np.ndarray, square: float, nearest: int) -> PivotOrder:
        last = np.sqrt(np.maximum(0.0, square - (pivots**2).sum(axis=1)))
        return cls(pivots, last, square, min(nearest, len(pivots)))

    def of(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        """The nearest pivots of each vector in order. With a component more all vectors have one
        length, so that a greater inner product is a smaller distance; queries have none there."""
        near = vectors @ self.pivots.T
        if not queries:
            rest = np.sqrt(np.maximum(0.0, self.square - (vectors**2).sum(axis=1)))
            near += rest[:, None] * self.last
        return np.argsort(-near, axis=1, kind="stable")[:, : self.nearest]


@dataclass(frozen=True)
class IndexBlock:
    """Rows by ascending id, their distinct vectors, and the inverted files of the pivots."""

    rows: np.ndarray
    ids: np.ndarray
    known: np.ndarray
    copies: np.ndarray  # rows by vector
    copy_starts: np.ndarray  # of each distinct vector
    vectors: np.ndarray  # distinct ones, in the order of their first rows
    starts: np.ndarray  # of each pivot's file
    members: np.ndarray  # distinct vectors in the files
    closeness: np.ndarray  # nearest pivots minus the place of the file's one

    @classmethod
    def build(cls, order: PivotOrder, rows, ids, known, vectors) -> IndexBlock:
        by_id = np.lexsort([rows, ids, ~known])
        rows, ids, known, vectors = rows[by_id], ids[by_id], known[by_id], vectors[by_id]
        whole = np.ascontiguousarray(vectors).view(np.dtype((np.void, 8 * vectors.shape[1]))).ravel()
        _, firsts, kinds = np.unique(whole, return_index=True, return_inverse=True)
        number = np.empty(len(firsts), np.int64)
        number[np.argsort(firsts)] = np.arange(len(firsts))
        kinds = number[kinds]
        copies = np.argsort(kinds, kind="stable")
        copy_starts = np.searchsorted(kinds[copies], np.arange(len(firsts) + 1))
        vectors = vectors[np.sort(firsts)]
        near = order.of(vectors).ravel()
        by_pivot = np.argsort(near, kind="stable")
        starts = np.searchsorted(near[by_pivot], np.arange(len(order.pivots) + 1))
        closeness = (order.nearest - by_pivot % order.nearest).astype(np.int32)
        return cls(rows, ids, known, copies, copy_starts, vectors, starts,
                   by_pivot // order.nearest, closeness)

    def footrule(self, near: np.ndarray) -> np.ndarray:
        """Distance of each vector's order from a query's: places beyond the nearest pivots count as
        the one after them, so only the files of the query's pivots are read."""
        k = len(near)
        shared = np.zeros(len(self.vectors), np.int32)
        for place, pivot in enumerate(near.tolist()):
            file = slice(self.starts[pivot], self.starts[pivot + 1])
            shared[self.members[file]] += np.minimum(self.closeness[file], k - place)
        return k * (k + 1) - 2 * shared

    def search(self, near: np.ndarray, vector: np.ndarray, row: int, depth: int, top: int):
        """Places and scores of the best top rows with one of the depth nearest orders, without row."""
        n = len(self.vectors)
        keys = self.footrule(near).astype(np.int64) * n + np.arange(n)
        chosen = np.sort(np.argpartition(keys, depth)[: depth + 1]) if depth + 1 < n else np.arange(n)
        scores = _dots(self.vectors[chosen], vector)
        if len(chosen) > top + 1:
            least = np.partition(scores, -top - 1)[-top - 1]
            chosen, scores = chosen[scores >= least], scores[scores >= least]
        # copies of a vector have ascending ids: the first ones, and one more if row is among them
        counts = np.minimum(self.copy_starts[chosen + 1] - self.copy_starts[chosen], top + 1)
        at = self.copies[ranges(self.copy_starts[chosen], counts)]
        scores = np.repeat(scores, counts)
        at, scores = at[self.rows[at] != row], scores[self.rows[at] != row]
        best = np.lexsort([at, -scores])[:top]
        return at[best], scores[best]


_PACKED = [("row", np.dtype("<i8")), ("id", np.dtype("<i8")), ("known", np.dtype("?"))]
_BLOB = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
_BLOB_DDL = "block long, n long, body binary"


def _unpacked(body: bytes, n: int) -> list[np.ndarray]:
    out, at = [], 0
    for _, kind in _PACKED:
        out.append(np.frombuffer(body, kind, n, at))
        at += n * kind.itemsize
    return [*out, np.frombuffer(body, "<f8", -1, at).reshape(n, -1)]


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (row, vec_id, vector) of a partition as one block with the partition's number."""
    from pyspark import TaskContext

    held = [batch for batch in batches if batch.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        ids = table["vec_id"]
        vectors = table["vector"].combine_chunks()
        body = b"".join([
            table["row"].to_numpy().astype("<i8").tobytes(),
            ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
            ids.is_valid().to_numpy().tobytes(),
            vectors.flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes(),
        ])
        yield record_batch(
            _BLOB, block=[TaskContext.get().partitionId()], n=[table.num_rows], body=[body]
        )


_FOUND = pa.schema([
    ("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()),
])
_FOUND_DDL = "query_row long, query_id long, vec_id long, score double"


def _search_blocks(shared: Broadcast, share: float, least: int, top: int):
    """Rows of a place: its block of the index first, then blocks of queries, one after the other."""

    def answers(index: IndexBlock, depth: int, block: list[np.ndarray]) -> pa.RecordBatch:
        rows, ids, _, vectors = block
        found = [
            index.search(near, vector, row, depth, top)
            for near, vector, row in zip(
                shared.value.of(vectors, queries=True), vectors, rows.tolist(), strict=True
            )
        ]
        counts = [len(at) for at, _ in found]
        at = np.concatenate([at for at, _ in found])
        return record_batch(
            _FOUND, query_row=np.repeat(rows, counts), query_id=np.repeat(ids, counts),
            vec_id=pa.array(index.ids[at], pa.int64(), mask=~index.known[at]),
            score=np.concatenate([scores for _, scores in found]),
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, index = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                own, asks, n, body = (batch[c][i].as_py() for c in ("place", "asks", "n", "body"))
                block = _unpacked(body, n)
                if not asks:
                    place, index = own, IndexBlock.build(shared.value, *block)
                elif own == place:
                    yield answers(index, max(least, math.ceil(share * len(index.vectors))), block)

    return search


def far_apart(sample: np.ndarray, most: int) -> np.ndarray:
    """At most so many of the vectors, each the farthest from all before: near copies give one."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(most, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _sample(rows: DataFrame) -> np.ndarray:
    """Distinct vectors with the least hashes: the bounded sample that the index is fitted on."""
    keyed = rows.select(F.xxhash64("vector").alias("key"), "vector")
    keys = keyed.select("key").distinct().orderBy("key").limit(SAMPLE_ROWS)
    chosen = keyed.join(F.broadcast(keys), "key").groupBy("key").agg(F.first("vector").alias("vector"))
    return np.array([r.vector for r in chosen.orderBy("key").collect()], float)


def nearest_vectors(
    vectors: DataFrame,
    is_query: Column,
    top: int = 20,
    pivots: int = PIVOTS,
    nearest: int = NEAREST,
    share: float = RERANKED,
    least: int = LEAST_RERANKED,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the top rows found for each row in is_query.

    score is the inner product of the vectors as they are given, in double precision; greater ones
    come first, equal ones by vec_id, null ids last. Vectors that are null, empty or zero, that hold
    null or non-finite components, or whose size is not the commonest (the larger one, if several are
    equally common) take no part. A query is not its own result, but a copy of its row is; a query
    without other vectors has no rows. Repeated query rows are all answered. An empty table gives no
    rows. Other columns are not read.

    All vectors are indexed. The search is approximate in which vectors are ranked again: those with
    the least footrule distances of each block, share of its distinct vectors and at least least of
    them, equal distances by id; all copies of a vector count as one. Pivots are chosen far apart from
    the SAMPLE_ROWS distinct vectors with the least hashes. Rows are dealt to blocks in turn, so copies
    spread over all of them; the query set passes each block in blocks of its own.
    """
    send_package(vectors.sparkSession)
    vector = F.col(vector_column)
    fit = vectors.where(usable(vector))
    sizes = fit.groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, count = sizes["size"], sizes["n"]
    rows = fit.where(F.size(vector) == size).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).cast("long").alias("vec_id"),
        vector.cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    row_bytes = 8 * size
    blocks = parts_for(count * row_bytes, _BLOCK_BYTES)
    # dealt in turn; row numbers are stored, so that a lost executor changes none of them
    rows = stored(rows.repartition(blocks))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    longest = rows.agg(F.max(square)).first()[0]
    order = PivotOrder.build(
        far_apart(_sample(rows), pivots), longest, nearest
    )
    shared = vectors.sparkSession.sparkContext.broadcast(order)
    packed = ["row", "vec_id", "vector"]
    index = rows.select(*packed).mapInArrow(_pack_blocks, _BLOB_DDL)
    queries = rows.where("asks")
    query_blocks = parts_for(queries.count() * row_bytes, _QUERY_BYTES)
    asked = queries.select(*packed).repartition(query_blocks).mapInArrow(_pack_blocks, _BLOB_DDL)
    groups = -(-query_blocks // _QUERY_BLOCKS)

    def at(frame: DataFrame, asks: bool, block: Column, group: Column) -> DataFrame:
        place = (block * groups + group).cast("int")
        return frame.select(place.alias("place"), F.lit(asks).alias("asks"), "n", "body")

    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    index = index.withColumn("group", every_group)
    asked = asked.withColumn("number", every_block)
    met = at(index, False, F.col("block"), F.col("group")).unionByName(
        at(asked, True, F.col("number"), F.col("block") % groups)
    )
    met = met.repartitionById(blocks * groups, "place").sortWithinPartitions("place", "asks")
    found = met.mapInArrow(_search_blocks(shared, share, least, top), _FOUND_DDL)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
