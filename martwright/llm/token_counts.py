"""Token counts: distinct pre-tokens counted once, joined to the pre-token frequencies of documents.

A pre-token is a word between spaces, as both kinds of tokenizer cut there before any merge. Distinct
pre-tokens are merged over all tasks and each goes to the library once. A second pass takes the
frequencies of each document. Those of frequent pre-tokens meet their piece counts within the task,
from a table of bounded size; the others are joined by pre-token and summed by document. No ids of a
text are made. Texts that a tokenizer does not cut at every space (runs of white space, its own
marks) are counted whole in the second pass.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import record_batch, slices
from martwright.llm.word_pieces import ByteModel, PieceModel, load_model, tokenizer_file
from martwright.sources.tables import shared_dir, write_table

#: Frequent pre-tokens are those with most occurrences for each WORD_BYTES begun, FREQUENT such units
#: at most: 25.6 MB whatever the corpus. No other is hot in the join.
FREQUENT = 400_000
WORD_BYTES = 64
#: Occurrences are told apart by this many steps for each doubling.
_STEPS = 8

_WORDS = pa.schema([("word", pa.large_string()), ("n", pa.int64())])
_PIECES = pa.schema([("word", pa.large_string()), ("n", pa.int64()), ("pieces", pa.int64())])
_FREQUENCIES = [
    ("part", pa.int32()), ("digest", pa.int64()), ("word", pa.large_string()),
    ("freq", pa.int64()), ("base", pa.int64()), ("copies", pa.int64()), ("n_bytes", pa.int64()),
]

_models: dict[str, PieceModel | ByteModel] = {}


def _model(file: str) -> PieceModel | ByteModel:
    if file not in _models:
        _models[file] = load_model(file)
    return _models[file]


def _pretokens(model: PieceModel | ByteModel, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of all texts in a row, and the place of each text's first.

    With a model to which a text's first word is not like the others, those begin with their space.
    """
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    offsets, words = lists.offsets.to_numpy(), lists.flatten()
    if isinstance(model, ByteModel):
        spaces = np.full(len(words), " ", object)
        spaces[offsets[:-1]] = ""
        none = pa.scalar("", pa.large_string())
        words = pc.binary_join_element_wise(pa.array(spaces, pa.large_string()), words, none)
    return words, offsets[:-1]


def _piece_counts(model: PieceModel | ByteModel, words: list[str]) -> np.ndarray:
    """Pieces of each pre-token."""
    if isinstance(model, PieceModel):
        return model.encode_words(words)[1] if words else np.zeros(0, np.int64)
    out = np.zeros(len(words), np.int64)
    later = np.fromiter((w.startswith(" ") for w in words), bool, len(words))
    if later.any():
        out[later] = model.encode_words([w[1:] for w in words if w.startswith(" ")])[1]
    if not later.all():
        out[~later] = model.encode_first([w for w in words if not w.startswith(" ")])[1]
    return out


def distinct_pretokens(docs: DataFrame, file: str, text_column: str = "text") -> DataFrame:
    """word, n (its occurrences) and pieces of every distinct pre-token of the texts that split."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(file)
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for part in slices(rows):
                texts = [t for t in rows[part] if model.splits(t)]
                if texts:
                    found = pc.value_counts(_pretokens(model, texts)[0])
                    yield record_batch(_WORDS, word=found.field("values"), n=found.field("counts"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(file)
        for batch in batches:
            counts = _piece_counts(model, batch.column(0).to_pylist())
            yield record_batch(_PIECES, word=batch.column(0), n=batch.column(1), pieces=counts)

    texts = docs.select(F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    merged = texts.mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return merged.mapInArrow(pieces, "word string, n long, pieces long")


def _units() -> Column:
    return F.greatest(F.ceil(F.octet_length("word") / WORD_BYTES), F.lit(1))


def _step() -> Column:
    """Where a pre-token stands by its occurrences for each unit."""
    return F.floor(_STEPS * F.log2(F.col("n") / _units())).cast("int")


def _least_step(words: DataFrame) -> int:
    """The least step from which on pre-tokens are frequent. Steps are a few hundred at most."""
    steps = words.groupBy(_step().alias("step")).agg(F.sum(_units()).alias("units")).collect()
    held, least = 0, 1 << 30
    for row in sorted(steps, key=lambda r: -r.step):
        held += row.units
        if held > FREQUENT:
            break
        least = row.step
    return least


def _frequent(words: DataFrame, least: int) -> dict[str, int]:
    """Pieces of the frequent pre-tokens, see FREQUENT."""
    table = words.where(_step() >= least).select("word", "pieces").toArrow()
    return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))


def _frequencies(rows: DataFrame, file: str, frequent: dict[str, int]) -> DataFrame:
    """Pre-token frequencies of each row beyond the frequent ones.

    base, on one row of each document, is what the frequent pre-tokens come to, or a whole text's
    count; copies is one and n_bytes is filled there, both are zero elsewhere. A document without other pre-tokens has one row,
    with freq zero and a word that spreads such rows.
    """
    known = rows.sparkSession.sparkContext.broadcast(frequent)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pieces = _model(file), known.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in slices(texts):
                yield _of_slice(model, pieces, batch.slice(part.start, part.stop - part.start))

    names = f"doc_id {id_type}, part int, digest long, word string"
    return rows.mapInArrow(count, f"{names}, freq long, base long, copies long, n_bytes long")


def _of_slice(
    model: PieceModel | ByteModel, pieces: dict[str, int], batch: pa.RecordBatch
) -> pa.RecordBatch:
    texts = batch.column("text").to_pylist()
    split = np.fromiter(map(model.splits, texts), bool, len(texts))
    base = np.zeros(len(texts), np.int64)
    for i in np.flatnonzero(~split):
        base[i] = len(model.encode(texts[i])) if texts[i] else 0
    at = np.flatnonzero(split)
    rows, words, freq = np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(0, np.int64)
    if len(at):
        flat, starts = _pretokens(model, [texts[i] for i in at])
        coded = flat.dictionary_encode()
        distinct = coded.dictionary
        each = np.fromiter(
            (pieces.get(w, -1) for w in distinct.to_pylist()), np.int64, len(distinct)
        )
        codes = coded.indices.to_numpy()
        counts = each[codes]
        base[at] = np.add.reduceat(np.maximum(counts, 0), starts)
        rest = np.flatnonzero(counts < 0)
        text_of = np.searchsorted(starts, rest, side="right") - 1
        pairs, freq = np.unique(text_of * len(distinct) + codes[rest], return_counts=True)
        rows, words = at[pairs // len(distinct)], distinct.take(pa.array(pairs % len(distinct)))
    alone = np.setdiff1d(np.arange(len(texts)), rows)
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    everything = np.concatenate([rows, alone])
    leads = np.concatenate([first, np.ones(len(alone), bool)])
    digests = batch.column("digest").take(pa.array(alone)).cast(pa.string()).cast(pa.large_string())
    head = batch.select(["doc_id", "part", "digest"]).take(pa.array(everything))
    n_bytes = batch.column("n_bytes").to_numpy()
    schema = pa.schema([head.schema.field("doc_id"), *_FREQUENCIES])
    return record_batch(
        schema,
        **{name: head.column(name) for name in head.schema.names},
        word=pa.concat_arrays([words, digests]),
        freq=np.concatenate([freq, np.zeros(len(alone), np.int64)]),
        base=np.where(leads, base[everything], 0),
        copies=leads.astype(np.int64),
        n_bytes=np.where(leads, n_bytes[everything], 0),
    )


def _stored_words(words: DataFrame) -> DataFrame:
    """The table, written as Parquet to the shared folder: less than half of a checkpoint's bytes."""
    path = f"{shared_dir(words.sparkSession)}/pretokens/{uuid.uuid4().hex}"
    write_table(words, path)
    return words.sparkSession.read.schema(words.schema).parquet(path)


def count_tokens(
    docs: DataFrame,
    tokenizer: str = "piece_bpe_32k.model",
    limit: int = 4096,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens above limit) of every row.

    Counts are those of the library for the file, sentencepiece for .model and tokenizers for
    .json, over the whole text, without begin, end or added special tokens. A null text is empty and
    has no tokens. Every row is counted: repeated rows and null ids stay. An empty table gives no
    rows. Other columns are not read. The table of distinct pre-tokens is written to the shared folder
    when this is called, and stays there. Repeated rows are summed together within a partition of the input,
    which also bounds how often one is repeated again.
    """
    file = tokenizer_file(tokenizer)
    words = _stored_words(distinct_pretokens(docs, file, text_column))
    whole = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.spark_partition_id().alias("part"),
        F.octet_length(whole).cast("long").alias("n_bytes"),
        F.xxhash64(whole).alias("digest"),
        whole.alias("text"),
    )
    least = _least_step(words)
    rare = words.where(_step() < least).select("word", "pieces")
    counted = _frequencies(rows, file, _frequent(words, least)).join(rare, "word", "left")
    lost = F.raise_error(F.lit("a pre-token has no count"))
    pieces = F.when(F.col("freq") == 0, F.lit(0)).otherwise(
        F.col("freq") * F.coalesce(F.col("pieces"), lost.cast("long"))
    )
    summed = counted.groupBy("doc_id", "part", "digest").agg(
        F.sum(F.col("base") + pieces).alias("total"), F.sum("copies").alias("copies"),
        F.max("n_bytes").alias("n_bytes"),
    )
    each = summed.select(
        "doc_id", "n_bytes",
        F.expr("total div copies").alias("n_tokens"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
    return each.withColumn("over_limit", F.col("n_tokens") > limit)
