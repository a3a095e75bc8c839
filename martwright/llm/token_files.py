"""Token ids in flat binary files, found by document key through minimal perfect hashes.

Shards hold nothing but little-endian ids, documents in ascending order of id, each closed by the end
id. Index files hold the hash of a share of the keys and, by slot, shard, offset and length. A
manifest written last names the files that count: a task that runs twice writes two files, and only
that of the attempt whose rows Spark took is named.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.llm.common import (
    id_part,
    id_splits,
    parts_for,
    record_batch,
    slices,
    stored,
    text_bytes,
)
from martwright.llm.perfect_hash import KeySlots
from martwright.llm.word_pieces import tokenizer_file, worker_store
from martwright.sources.tables import shared_dir

#: Keys of an index file.
INDEX_KEYS = 100_000

_ENTRIES = pa.schema([
    ("part", pa.int32()), ("file", pa.string()), ("doc_id", pa.int64()), ("copy", pa.int64()),
    ("offset", pa.int64()), ("n_tokens", pa.int64()),
])
_ENTRY_DDL = "part int, file string, doc_id long, copy long, offset long, n_tokens long"
_SLOT = np.dtype([("part", "<i4"), ("n_tokens", "<i8"), ("offset", "<i8")])


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, local or shared, as tasks see it."""
    return fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")


def _key(doc_id: Column, copy: Column) -> list[Column]:
    """Two numbers that stand for an id and the place among rows of that id; null ids are apart."""
    return [
        F.coalesce(doc_id, F.lit(0)).alias("key"),
        F.when(doc_id.isNull(), -1 - copy).otherwise(copy).alias("place"),
    ]


def _shard_writer(folder: str, file: str, end_id: int, kind: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store(file, with_ids=True)
        system, path = _open(folder)
        part, out, name, offset, last, copy = None, None, "", 0, None, 0
        try:
            for batch in batches:
                parts, ids = batch["part"].to_pylist(), batch["doc_id"].to_pylist()
                texts = batch["text"].to_pylist()
                for piece in slices(texts):
                    flat, lengths = store.encode(texts[piece])
                    ends = np.cumsum(lengths)
                    closed = np.insert(flat, ends, end_id).astype(kind)
                    ends += np.arange(1, len(ends) + 1)
                    rows = {f.name: [] for f in _ENTRIES}
                    for i, (own, doc_id) in enumerate(zip(parts[piece], ids[piece], strict=True)):
                        if own != part:
                            if out:
                                out.close()
                            part, offset, last, copy = own, 0, None, 0
                            name = f"{part + 1:06d}-{uuid.uuid4().hex}.ids"
                            out = system.open_output_stream(f"{path}/{name}")
                        # rows of one id, null included, stand together within a part
                        copy = copy + 1 if last == (doc_id,) else 0
                        last = (doc_id,)
                        n = int(lengths[i]) + 1
                        out.write(closed[ends[i] - n : ends[i]].tobytes())
                        for column, value in zip(
                            rows, (part, name, doc_id, copy, offset, n), strict=True
                        ):
                            rows[column].append(value)
                        offset += n
                    yield record_batch(_ENTRIES, **rows)
        finally:
            if out:
                out.close()

    return write


_INDEX_FILES = pa.schema([("bucket", pa.int32()), ("file", pa.string()), ("n_keys", pa.int64())])


def _index_writer(folder: str):
    def index(bucket: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        keys, places = table["key"].to_numpy(), table["place"].to_numpy()
        found, slots = KeySlots.build(keys, places)
        entries = np.zeros(len(keys), _SLOT)
        for column in _SLOT.names:
            entries[column][slots] = table[column].to_numpy()
        system, path = _open(folder)
        name = f"{bucket:06d}-{uuid.uuid4().hex}.idx"
        with system.open_output_stream(f"{path}/{name}") as out:
            out.write(found.to_bytes() + entries.tobytes())
        return record_batch(_INDEX_FILES, bucket=[bucket], file=[name], n_keys=[len(keys)])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            buckets = batch["bucket"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if bucket is not None and buckets[a] != bucket:
                    yield index(bucket, held)
                    held = []
                bucket = int(buckets[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield index(bucket, held)

    return write


@dataclass(frozen=True)
class TokenFiles:
    """A folder of shards, index files and their manifest."""

    folder: str
    kind: str
    end_id: int
    shards: dict[int, tuple[str, int, int]]  # part to file, ids before it, ids in it
    indexes: dict[int, str]
    buckets: int

    @classmethod
    def open(cls, folder: str) -> TokenFiles:
        system, path = _open(folder)
        with system.open_input_stream(f"{path}/manifest.json") as source:
            told = json.loads(source.read())
        shards = {int(k): tuple(v) for k, v in told["shards"].items()}
        indexes = {int(k): v for k, v in told["indexes"].items()}
        return cls(folder, told["kind"], told["end_id"], shards, indexes, told["buckets"])

    def locate(self, keys: DataFrame) -> DataFrame:
        """doc_id, copy, part, offset and n_tokens of keys (doc_id, copy) that the files hold."""
        key, place = _key(F.col("doc_id"), F.col("copy"))
        asked = keys.select("doc_id", "copy", key, place)
        asked = asked.withColumn("bucket", _bucket(self.buckets))
        schema = pa.schema([
            ("doc_id", pa.int64()), ("copy", pa.int64()), ("part", pa.int32()),
            ("offset", pa.int64()), ("n_tokens", pa.int64()),
        ])
        folder, files = self.folder, self.indexes

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, path = _open(folder)
            held = None, None, None
            for batch in batches:
                buckets = batch["bucket"].to_numpy()
                for bucket in np.unique(buckets).tolist():
                    if bucket not in files:
                        continue
                    if held[0] != bucket:
                        with system.open_input_file(f"{path}/{files[bucket]}") as source:
                            data = source.read()
                        slots, size = KeySlots.from_bytes(data)
                        held = bucket, slots, np.frombuffer(data, _SLOT, offset=size)
                    own = batch.filter(pa.array(buckets == bucket))
                    at = held[1].find(own["key"].to_numpy(), own["place"].to_numpy())
                    own, entries = own.filter(pa.array(at >= 0)), held[2][at[at >= 0]]
                    yield record_batch(
                        schema, doc_id=own["doc_id"], copy=own["copy"],
                        **{c: np.ascontiguousarray(entries[c]) for c in _SLOT.names},
                    )

        placed = asked.repartition("bucket").sortWithinPartitions("bucket")
        return placed.mapInArrow(look, "doc_id long, copy long, part int, offset long, n_tokens long")

    def read(self, keys: DataFrame, use, schema: pa.Schema, ddl: str) -> DataFrame:
        """doc_id, start and what use(list of id arrays) gives, for keys (doc_id, copy).

        start is the number of ids of all documents before. A task reads the documents of a shard in
        order, and of the shard only the range that a batch needs.
        """
        folder, shards, kind = self.folder, self.shards, np.dtype(self.kind)
        out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), *schema])

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, path = _open(folder)
            for batch in batches:
                parts = batch["part"].to_numpy()
                for part in np.unique(parts).tolist():
                    own = batch.filter(pa.array(parts == part))
                    name, before, _ = shards[part]
                    offsets, counts = own["offset"].to_numpy(), own["n_tokens"].to_numpy()
                    with system.open_input_file(f"{path}/{name}") as source:
                        for rows in slices([range(n) for n in counts.tolist()]):
                            low = int(offsets[rows][0])
                            high = int((offsets[rows] + counts[rows]).max())
                            data = source.read_at((high - low) * kind.itemsize, low * kind.itemsize)
                            ids = np.frombuffer(data, kind)
                            each = [
                                ids[a - low : a - low + n]
                                for a, n in zip(offsets[rows].tolist(), counts[rows].tolist(), strict=True)
                            ]
                            yield record_batch(
                                out, doc_id=own["doc_id"].slice(rows.start, rows.stop - rows.start),
                                start=before + offsets[rows], **use(each),
                            )

        ordered = self.locate(keys).repartition("part").sortWithinPartitions("part", "offset")
        return ordered.mapInArrow(fetch, f"doc_id long, start long, {ddl}")

    def delete(self, spark: SparkSession) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key", "place"), F.lit(buckets)).cast("int")


def write_token_files(
    docs: DataFrame,
    folder: str | None = None,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> TokenFiles:
    """Encodes every text, appends end_id, and writes shards, index and manifest to a shared folder.

    Documents are in ascending order of id, null ids first, equal ids by text; a key is an id and the
    place among the rows of that id. Null texts are empty and have the end id only. An empty table
    gives a manifest without files. Ids must be whole numbers; other columns are not read. Ids are
    cut into shards of about equal text; the driver holds file names and counts, not documents. The
    folder needs a scheme that pyarrow can write (file, hdfs, s3, gs).
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/token_files/{uuid.uuid4().hex}"
    file = tokenizer_file(tokenizer)
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    size = worker_store(file, with_ids=True).model.vocabulary_size()
    kind = "<u2" if size <= 1 << 16 else "<u4"
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    parts = parts_for(text_bytes(rows, "text"), most=10_000)
    splits = id_splits(rows, "doc_id", parts)
    ordered = rows.select(id_part(F.col("doc_id"), splits).alias("part"), "doc_id", "text")
    ordered = ordered.repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "text")
    entries = stored(ordered.mapInArrow(_shard_writer(folder, file, end_id, kind), _ENTRY_DDL))
    totals = entries.groupBy("part", "file").agg(
        F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs")
    ).orderBy("part").collect()
    shards, before = {}, 0
    for row in totals:
        shards[row.part] = row.file, before, row.n
        before += row.n
    buckets = max(1, -(-sum(r.docs for r in totals) // INDEX_KEYS))
    key, place = _key(F.col("doc_id"), F.col("copy"))
    keyed = entries.select(key, place, "part", "n_tokens", "offset").withColumn("bucket", _bucket(buckets))
    placed = keyed.repartition("bucket").sortWithinPartitions("bucket")
    written = stored(placed.mapInArrow(_index_writer(folder), "bucket int, file string, n_keys long"))
    indexes = {row.bucket: row.file for row in written.collect()}
    with system.open_output_stream(f"{path}/manifest.json") as out:
        told = {"kind": kind, "end_id": end_id, "shards": shards, "indexes": indexes, "buckets": buckets}
        out.write(json.dumps(told).encode())
    return TokenFiles(folder, kind, end_id, shards, indexes, buckets)


def document_keys(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id and copy of every row: ids counted first, so a repeated id is one row in the shuffle."""
    counts = docs.groupBy(F.col(id_column).cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))


_CHECKS = pa.schema([("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _checks(each: list[np.ndarray]) -> dict:
    return {
        "n_tokens": [len(ids) for ids in each],
        "ids_crc32": [zlib.crc32(ids.astype("<u4").tobytes()) for ids in each],
    }


def read_checks(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (ids as little-endian 32-bit numbers) from the files."""
    return files.read(keys, _checks, _CHECKS, "n_tokens long, ids_crc32 long")
