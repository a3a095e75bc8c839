"""Language identification by partial matching: byte contexts of up to three bytes per language.

Each language has counts of bytes after contexts of 0 to 3 bytes. A byte unseen after a context
costs that context's escape (distinct bytes over bytes and distinct bytes) and is coded by the
next shorter one, at last as one of 256. The counts are frozen after training, so every code length
follows from table entries; a text's length in bits under each language decides.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from martwright.llm.common import record_batch, slices

ORDER = 3
#: Bytes of text that are coded at a time.
SLICE_BYTES = 1 << 19
#: Bits beyond eight a byte from which a text is of no learned language.
SLACK_BITS = 256
#: Every text is read after these bytes, so that its first byte has a context too.
_BEFORE = b"\n" * ORDER
#: Bytes of whole sample texts per language, at most.
SAMPLE_BYTES = 1 << 20
#: Bytes of sample texts of all languages: with more than 64 languages each has an equal share.
ALL_SAMPLE_BYTES = 64 << 20
UNKNOWN = "und"

_COUNTS = pa.schema([
    ("lang", pa.string()), ("length", pa.int32()), ("code", pa.int64()), ("n", pa.int64()),
])


def _mask(length: int) -> np.uint32:
    """The last bytes of a code."""
    return np.uint32((1 << 8 * length) - 1)


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts the code of it and the three before it; each text's length."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(_BEFORE + _BEFORE.join(texts), np.uint8).astype(np.uint32)
    codes = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    if len(texts) > 1:
        wanted = np.ones(len(codes), bool)
        ends = np.cumsum(lengths + ORDER)[:-1] - ORDER
        wanted[(ends[:, None] + np.arange(ORDER)).ravel()] = False
        codes = codes[wanted]
    return codes, lengths


def _runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, codes and lengths of some texts at a time; a longer text comes in several runs."""
    for part in slices(texts, SLICE_BYTES):
        rows = np.arange(part.start, part.stop)
        if len(rows) > 1 or len(texts[part.start]) <= SLICE_BYTES:
            yield rows, *_codes(texts[part])
            continue
        text = texts[part.start]
        for start in range(0, len(text), SLICE_BYTES):
            before = min(start, ORDER)
            codes, _ = _codes([text[start - before : start + SLICE_BYTES]])
            yield rows, codes[before:], np.array([len(codes) - before])


@dataclass(frozen=True)
class Contexts:
    """Code lengths in bits of a language's bytes after contexts of one length, sorted by code.

    codes/bits: bytes seen after their context. contexts/escape: contexts seen before some byte.
    """

    codes: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escape: np.ndarray


def _bits(tables: list[Contexts], codes: np.ndarray) -> np.ndarray:
    """Bits of bytes under one language, its longest contexts first."""
    bits = np.zeros(len(codes))
    rest = np.arange(len(codes))
    for length in range(ORDER + 1, 0, -1):
        table, own = tables[length - 1], codes[rest] & _mask(length)
        at, hit = _find(table.codes, own)
        bits[rest[hit]] += table.bits[at[hit]]
        rest, own = rest[~hit], own[~hit]
        at, hit = _find(table.contexts, own >> 8)
        bits[rest[hit]] += table.escape[at[hit]]
    bits[rest] += 8.0
    return bits


@dataclass(frozen=True)
class ContextModel:
    """Each language with its own tables of contexts of 0 to ORDER bytes, so size follows the sample."""

    languages: list[str]
    tables: list[list[Contexts]]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        for rows, codes, lengths in _runs(texts):
            places, found = pd.factorize(codes, sort=True)
            full = np.flatnonzero(lengths)
            if not len(full):
                continue
            starts = (np.cumsum(lengths) - lengths)[full]
            for column, tables in enumerate(self.tables):
                bits = _bits(tables, found)[places]
                out[rows[full], column] += np.add.reduceat(bits, starts)
        return out

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """Language, its posterior, every language being as likely beforehand, and whether it fits:
        the text takes at most SLACK_BITS more than eight bits a byte, which any bytes take without
        a model."""
        names = np.full(len(texts), UNKNOWN, object)
        scores = np.zeros(len(texts))
        fits = np.zeros(len(texts), bool)
        if self.languages:
            for part in slices(texts, SLICE_BYTES):
                told = [i for i in range(part.start, part.stop)
                        if texts[i] and any(map(str.isalpha, texts[i]))]
                if not told:
                    continue
                known = [texts[i].encode() for i in told]
                bits = self.code_lengths(known)
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(bits)), best]
                names[told] = np.array(self.languages, object)[best]
                scores[told] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                fits[told] = least <= 8 * np.fromiter(map(len, known), float, len(known)) + SLACK_BITS
        return pd.DataFrame({"lang_pred": names, "score": scores, "fits": fits})


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted table, and whether the entry there is the wanted one."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def language_tables(counts: pd.DataFrame) -> list[Contexts]:
    """From one language's (length, code, n): n times the length bytes of code stood together."""
    tables = []
    for length in range(1, ORDER + 2):
        part = counts[counts["length"] == length].sort_values("code")
        codes, n = part["code"].to_numpy(np.uint32), part["n"].to_numpy(float)
        contexts, place = np.unique(codes >> 8, return_inverse=True)
        kinds = np.bincount(place, minlength=len(contexts))
        whole = np.bincount(place, n, len(contexts)) + kinds
        tables.append(Contexts(codes, -np.log2(n / whole[place]), contexts, -np.log2(kinds / whole)))
    return tables


def build_model(counts: pd.DataFrame) -> ContextModel:
    """From (lang, length, code, n) of all languages."""
    groups = sorted(counts.groupby("lang"))
    return ContextModel([name for name, _ in groups], [language_tables(own) for _, own in groups])


def _count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch["lang"].to_pylist(), object)
        texts = batch["text"].to_pylist()
        for lang in np.unique(langs):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            for _, codes, _ in _runs(own):
                for length in range(1, ORDER + 2):
                    found, n = np.unique(codes & _mask(length), return_counts=True)
                    yield record_batch(
                        _COUNTS, lang=[lang] * len(found), length=[length] * len(found),
                        code=found.astype(np.int64), n=n,
                    )


def is_held_out(id_column: F.Column) -> F.Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    rest = F.crc32(id_column.cast("string").cast("binary")) % 4
    return F.coalesce(rest == 2, F.lit(False))


def _totals(rows: DataFrame, sample_bytes: int) -> list[Row]:
    """Each language's bytes in texts of up to sample_bytes, and its first text's key by hash.

    Texts above sample_bytes come after all others.
    """
    size, key = F.octet_length("text"), F.xxhash64("text")
    fits = size <= sample_bytes
    return rows.where(size > 0).groupBy("lang").agg(
        F.sum(F.when(fits, size)).alias("total"),
        F.coalesce(F.min(F.when(fits, key)), F.min(key)).alias("first"),
    ).collect()


def fit_languages(
    labelled: DataFrame,
    sample_bytes: int = SAMPLE_BYTES,
    all_sample_bytes: int = ALL_SAMPLE_BYTES,
    lang_column: str = "lang",
    text_column: str = "text",
) -> ContextModel:
    """Statistics from whole texts of each language, in the order of their hash, up to sample_bytes.

    Every language with a text that is not empty is learned; if there are so many that their samples
    pass all_sample_bytes, each has an equal share of these. Rows with a null language or text teach
    nothing. Texts above a language's bytes stand back: only a language that has no other is learned
    from one of them, the first by hash, in whole. The model has at most four entries for each
    sampled byte, which bounds what comes to the driver and what is broadcast.
    """
    rows = labelled.select(
        F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text")
    ).dropna()
    totals = _totals(rows, sample_bytes)
    if len(totals) * sample_bytes > all_sample_bytes:
        sample_bytes = max(1, all_sample_bytes // len(totals))
        totals = _totals(rows, sample_bytes)
    # three times the bytes wanted are drawn before any order, so that the windows stay small
    drawn_of = [
        (t.lang, min(1.0, 3 * sample_bytes / t.total) if t.total else 0.0, t.first) for t in totals
    ]
    shares = labelled.sparkSession.createDataFrame(drawn_of, "lang string, share double, first long")
    size, key = F.octet_length("text"), F.xxhash64("text")
    drawn = rows.join(F.broadcast(shares), "lang").where(
        ((size <= sample_bytes) & (F.pmod(key, F.lit(1 << 20)) < F.col("share") * (1 << 20)))
        | (key == F.col("first"))
    )
    drawn = drawn.select("lang", "text", key.alias("order"), size.alias("size")).distinct()
    so_far = F.sum("size").over(
        Window.partitionBy("lang").orderBy("order", "text").rowsBetween(Window.unboundedPreceding, 0)
    )
    sample = drawn.withColumn("so_far", so_far)
    sample = sample.where((F.col("so_far") <= sample_bytes) | (F.col("so_far") == F.col("size")))
    texts = sample.select("lang", F.col("text").cast("binary").alias("text"))
    counts = texts.mapInArrow(_count_contexts, "lang string, length int, code long, n long")
    counts = counts.groupBy("lang", "length", "code").agg(F.sum("n").alias("n"))
    # tables are made beside the counts, so that the driver gets arrays and not rows
    made = counts.groupBy("lang").applyInPandas(_pickled_tables, "lang string, tables binary")
    learned = sorted((r.lang, r.tables) for r in made.collect())
    return ContextModel([lang for lang, _ in learned], [pickle.loads(t) for _, t in learned])


def _pickled_tables(counts: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({
        "lang": counts["lang"].iloc[:1], "tables": [pickle.dumps(language_tables(counts))],
    })


def predict_languages(
    docs: DataFrame, model: ContextModel, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, lang_pred and score of every row.

    lang_pred is the learned language with the least bits, und if the text is null or has no letter
    or nothing was learned; equal bits go to the first name. score is that language's posterior
    (0 to 1), 0 for und. Only the text is read. Repeated rows and null ids stay; an empty table
    gives no rows.
    """
    predicted = docs.select(
        F.col(id_column).alias("doc_id"), predictor(docs, model)(F.col(text_column)).alias("p")
    )
    return predicted.select("doc_id", "p.lang_pred", "p.score")


def predictor(docs: DataFrame, model: ContextModel):
    """The model as a function of a text column: struct of lang_pred and score; und and 0 for texts
    that are null or have no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return shared.value.predict(texts.tolist())[["lang_pred", "score"]]

    return predict


def keep_languages(
    docs: DataFrame,
    model: ContextModel,
    wanted: Sequence[str] | None = None,
    least_score: float = 0.0,
    lang_column: str = "lang",
    text_column: str = "text",
) -> DataFrame:
    """The documents in a wanted language (all learned ones, if none are named), with all their columns.

    A document goes if its text is null or has no letter, if no learned language fits it (more than
    SLACK_BITS above eight bits a byte under each), if the predicted language is not wanted or if that
    language's posterior is below least_score. The predicted language is written to lang_column where
    that is null, if there is such a column; other labels stay and are never read. Repeated rows share their fate; null ids are
    like others. If nothing was learned, all documents go. An empty table gives no rows. Rows pass by
    in slices, in their order, and nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wanted = None if wanted is None else frozenset(wanted)
    names = docs.columns
    text_at = names.index(text_column)
    lang_at = names.index(lang_column) if lang_column in names else None

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.column(text_at).nbytes))
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                found = shared.value.predict(part.column(text_at).to_pylist())
                kept = found["fits"] & (found["score"] >= least_score)
                if wanted is not None:
                    kept &= found["lang_pred"].isin(wanted)
                columns = list(part.columns)
                if lang_at is not None:
                    told = pa.array(found["lang_pred"], pa.string()).cast(columns[lang_at].type)
                    columns[lang_at] = pc.coalesce(columns[lang_at], told)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(
                    pa.array(kept.to_numpy(bool))
                )

    return docs.mapInArrow(keep, docs.schema)
