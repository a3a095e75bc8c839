"""Quality rules: document statistics, two fixed rules, and boosted trees learned from labels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.llm.boosted_trees import Forest, fit
from martwright.llm.common import slices

SPACES = b"\t\n\x0b\x0c\r "
SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = b"!?.,;:"
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of a code point after its first
WINDOW = 8
#: Labelled rows that a model is fitted on at most.
SAMPLE_ROWS = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_capitals", "n_digits", "n_marks", "n_other")
_COUNT_TYPE = ", ".join(f"{name} long" for name in COUNTS)

FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "digits",
            "marks", "line_words", "other")
#: The score may only fall as these shares rise, all else equal.
MONOTONE = {2: -1, 3: -1, 4: -1, 5: -1}

with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(WINDOW, 0x9E3779B97F4A7C15, np.uint64))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of eight words that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        windows = sum(hashes[j : j + n] * _POWERS[j] for j in range(WINDOW))
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    edges[at] += 1
    edges[at + WINDOW] -= 1
    return int((np.cumsum(edges) > 0).sum())


def statistics(text: bytes) -> tuple[int, ...]:
    """The COUNTS of a text."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    size = len(text)

    def count(kind: bytes) -> int:
        return size - len(text.translate(None, kind))

    following = count(_FOLLOWING)
    return (
        len(words), size - following - count(SPACES), count(SYMBOLS),
        len(lines) - len(set(lines)), repeated_words(words),
        len(lines), count(_CAPITALS), count(_DIGITS), count(_MARKS), following,
    )


def features(counts: np.ndarray) -> np.ndarray:
    """Shares per word or character from the COUNTS, one row each."""
    named = dict(zip(COUNTS, counts.T.astype(float), strict=True))
    words, chars = np.maximum(named["n_words"], 1), np.maximum(named["word_chars"], 1)
    lines = np.maximum(named["n_lines"], 1)
    return np.column_stack([
        np.log1p(named["n_words"]), named["word_chars"] / words, named["n_symbols"] / words,
        named["n_dup_lines"] / lines, named["n_repeat_words"] / words,
        named["n_capitals"] / chars, named["n_digits"] / chars, named["n_marks"] / words,
        words / lines, named["n_other"] / chars,
    ])


def count_frame(texts: list[bytes]) -> pd.DataFrame:
    rows = [statistics(t) for part in slices(texts) for t in texts[part]]
    return pd.DataFrame(np.array(rows, np.int64).reshape(-1, len(COUNTS)), columns=list(COUNTS))


def _text_counts(text: str) -> Column:
    @F.pandas_udf(_COUNT_TYPE)
    def counts(texts: pd.Series) -> pd.DataFrame:
        return count_frame(texts.tolist())

    return counts(text)


def _bytes(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


@dataclass(frozen=True)
class QualityModel:
    forest: Forest
    least_score: float = 0.5
    least_words: int = 20
    most_repeats_pct: int = 30

    def judge(self, counts: pd.DataFrame) -> pd.DataFrame:
        words, repeats = counts["n_words"], counts["n_repeat_words"]
        failed = (words < self.least_words) | (100 * repeats > self.most_repeats_pct * words)
        score = self.forest.score(features(counts[list(COUNTS)].to_numpy()))
        return pd.DataFrame({
            "base_failed": failed, "score": score, "kept": ~failed & (score >= self.least_score),
        })


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    id_column: str = "doc_id",
    text_column: str = "text",
    **options,
) -> QualityModel:
    """Trees fitted on at most sample_rows labelled documents, chosen by the hash of their id.

    labels: doc_id and quality (1 good, 0 not). Null ids and qualities are not used, nor are labels
    of ids that docs does not hold; of several labels the majority counts, a tie is good. Each id
    counts once, by the first of its texts by hash. Without labels, or with one class, the score is
    the same for all. The sample's size is a parameter, so both its broadcast and its collect are
    bounded.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("double"))
    known = known.dropna().groupBy("label_id").agg(F.avg("quality").alias("quality"))
    order = [F.xxhash64("label_id"), F.col("label_id")]
    present = docs.select(F.col(id_column).alias("doc_id")).distinct()
    known = known.join(present, F.col("label_id") == F.col("doc_id"), "left_semi")
    sample = known.orderBy(*order).limit(sample_rows)
    texts = docs.select(F.col(id_column).alias("doc_id"), _bytes(text_column).alias("text"))
    counted = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select(
        "label_id", "quality", F.xxhash64("text").alias("text_hash"), _text_counts("text").alias("counts")
    ).select("label_id", "quality", "text_hash", "counts.*")
    # copies of an id are merged before they are moved
    single = counted.groupBy("label_id", "quality").agg(
        F.min(F.struct("text_hash", *COUNTS)).alias("first")
    ).select("label_id", "quality", "first.*")
    rows = single.orderBy(*order).toPandas()
    x = features(rows[list(COUNTS)].to_numpy(np.int64).reshape(-1, len(COUNTS)))
    y = (rows["quality"].to_numpy(float) >= 0.5).astype(float)
    return QualityModel(fit(x, y, MONOTONE), **options)


def quality_verdicts(
    docs: DataFrame,
    model: QualityModel,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, the COUNTS, base_failed, score and kept of every row.

    base_failed: under 20 words, or over 30 % of the words in repeated windows of eight words. kept:
    not base_failed, and the trees' score is 0.5 or more. A null or empty text has no words and
    fails. Rows are judged one by one: repeated rows and null ids stay; an empty table gives none.
    Other columns are not read.
    """

    @F.pandas_udf(f"{_COUNT_TYPE}, base_failed boolean, score double, kept boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        counts = count_frame(texts.tolist())
        return pd.concat([counts, model.judge(counts)], axis=1)

    judged = docs.select(
        F.col(id_column).alias("doc_id"), judge(_bytes(text_column)).alias("judged")
    )
    return judged.select("doc_id", "judged.*")


def keep_quality(docs: DataFrame, model: QualityModel, text_column: str = "text") -> DataFrame:
    """The documents that quality_verdicts keeps, with all their columns."""

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return model.judge(count_frame(texts.tolist()))["kept"]

    return docs.where(kept(_bytes(text_column)))
