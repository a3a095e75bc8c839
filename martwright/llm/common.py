"""What the corpus operators share: stored intermediates, slices of text, ids in buckets."""

from __future__ import annotations

import math
import tempfile
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.sources.tables import shared_dir

#: Bytes of text that a Python task works on at a time.
SLICE_BYTES = 4 << 20
#: Bytes of text that a partition is made for.
PART_BYTES = 16 << 20
#: Bytes of a batch of rows that Spark hands to a Python task, where the session leaves its default.
BATCH_BYTES = 4 << 20
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)


_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Executors need not have this package installed: Spark sends it to them, once per application.

    Batches for Python tasks are bounded by bytes in this session, as rows may hold long texts.
    """
    if spark.conf.get(_BATCH_KEY).rstrip("b") == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    _sent.add(context.applicationId)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    send_package(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """The rows, written once to the shared checkpoint folder; lineage ends there.

    The checkpoint folder is the one the cluster names. Spark removes the files with the frame when
    spark.cleaner.referenceTracking.cleanCheckpoints is set. With drop_shuffles what was shuffled for
    the rows leaves the disks when they are written, not whenever the driver next collects garbage.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_dir(spark)}/checkpoints")
    if not drop_shuffles:
        return df.checkpoint(eager=True)
    before = spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        own = df.select("*")  # planned under the setting, with shuffles that no other frame reads
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return own.checkpoint(eager=True)


def parts_for(n_bytes: float, part_bytes: int = PART_BYTES, most: int = 100_000) -> int:
    """Partitions that hold part_bytes each."""
    return int(min(most, max(1, math.ceil(n_bytes / part_bytes))))


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.select(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def slices(texts: Sequence[Any], most: int = SLICE_BYTES) -> Iterator[slice]:
    """Runs of rows whose texts come to about so many characters; a longer text stands alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text) if text is not None else 0
        if i > start and held + size > most:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(texts):
        yield slice(start, len(texts))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit integers over 64 bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... lengths[0] of them, then those of starts[1], and so on."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def id_splits(docs: DataFrame, id_column: str, parts: int) -> list[int]:
    """Ids that cut the documents into about equal parts, ascending; at most parts - 1 of them."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    found = docs.select(F.col(id_column).cast("double").alias("id"))
    found = found.where("id is not null").approxQuantile("id", at, 0.2 / parts)
    return sorted({int(x) for x in found})


def id_part(id_column: F.Column, splits: list[int]) -> F.Column:
    """The part of an id: the number of splits at or below it. Null ids are in a part before all."""
    if not splits:
        return F.when(id_column.isNull(), F.lit(-1)).otherwise(F.lit(0))

    @F.pandas_udf("int")
    def part(ids):
        known = ids.notna().to_numpy()
        out = np.full(len(ids), -1, np.int32)
        values = ids[known].astype("int64").to_numpy()
        out[known] = np.searchsorted(np.array(splits, np.int64), values, side="right")
        return type(ids)(out)

    return part(id_column.cast("long"))


def record_batch(schema: pa.Schema, **columns: Any) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
    )
