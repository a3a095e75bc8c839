"""Public tokenizers applied once per distinct word of a slice of texts.

Both kinds of tokenizer cut a text at spaces before any merge, so the ids of a text are those of
its words in order. Words that a worker has met stay in a store of bounded size. A text where
that does not hold (runs of white space, marks of the tokenizer itself) goes to the library whole.
"""

from __future__ import annotations

import re
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from martwright.llm.common import ranges

#: Words that a Python worker keeps; words beyond are encoded again in the next slice.
KEPT_WORDS = 1_000_000
#: Characters given to the library at a time. Sentencepiece keeps all pairs of a text in one queue, so
#: it takes longer over each word of a longer text.
_BLOCK, _PIECE_BLOCK = 200_000, 10_000
_SPACE_FIRST = re.compile(r"\s ")
_ENDS = re.compile(r"^\s|\s$")


def tokenizer_file(name: str) -> str:
    """A full path as it is; else the place of a public tokenizer's file."""
    if Path(name).is_absolute():
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _blocks(words: list[str], size: int):
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    cuts = np.flatnonzero(np.diff(ends // size, prepend=0)) + 1
    at = 0
    for stop in [*cuts.tolist(), len(words)]:
        if stop > at:
            yield words[at:stop]
        at = stop


class PieceModel:
    """A sentencepiece model: ids and counts as the library gives them, without added tokens."""

    space = "▁"

    def __init__(self, file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = pieces
        self.starts = np.array([p.startswith(self.space) for p in pieces])
        inside = any(self.space in p.lstrip(self.space) for p in pieces)
        probe = "aÅﬁ ① b"
        same = self.model.normalize(probe) == self.space + probe.replace(" ", self.space)
        # merges stay within words only if no piece goes on over a space and no text is rewritten
        self.by_words = same and not inside

    def vocabulary_size(self) -> int:
        return len(self.pieces)

    def splits(self, text: str) -> bool:
        return (
            self.by_words
            and bool(text)
            and "  " not in text
            and text[0] != " "
            and text[-1] != " "
            and self.space not in text
        )

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each word's number of ids. Each word begins at a space's piece."""
        ids, counts = [], []
        for block in _blocks(words, _PIECE_BLOCK):
            got = np.array(self.model.encode(" ".join(block), num_threads=1), np.int32)
            at = np.flatnonzero(self.starts[got])
            if len(at) != len(block):
                raise ValueError("words and pieces do not belong together")
            ids.append(got)
            counts.append(np.diff(np.append(at, len(got))))
        return np.concatenate(ids), np.concatenate(counts)

    def encode_first(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library puts a space before a text, so a first word is like any other."""
        return self.encode_words(words)


class ByteModel:
    """A byte-level BPE of the tokenizers library, without added tokens."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(file)
        added = self.model.get_added_tokens_decoder()
        self.marks = [t.content for t in added.values()]
        size = self.model.get_vocab_size(with_added_tokens=True)
        self.lengths = np.zeros(size, np.int64)  # bytes of each id; a character of a piece is a byte
        for piece, i in self.model.get_vocab(with_added_tokens=False).items():
            self.lengths[i] = len(piece)

    def vocabulary_size(self) -> int:
        return len(self.lengths)

    def splits(self, text: str) -> bool:
        return (
            bool(text)
            and not _ENDS.search(text[0] + "." + text[-1])
            and not any(m in text for m in self.marks)
            and not (self._maybe_run(text) and _SPACE_FIRST.search(text))
        )

    @staticmethod
    def _maybe_run(text: str) -> bool:
        """Cheap: false if no white space stands before a space."""
        return not text.isascii() or any(f"{c} " in text for c in " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f")

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word with a space before it. An id stands for a fixed number of bytes."""
        ids, counts = [], []
        for block in _blocks(words, _BLOCK):
            text = [" " + " ".join(block)]
            got = self.model.encode_batch_fast(text, add_special_tokens=False)[0].ids
            got = np.array(got, np.int32)
            sizes = pc.binary_length(pa.array(block, pa.string())).to_numpy() + 1
            ends = np.cumsum(self.lengths[got])
            at = np.searchsorted(ends, np.cumsum(sizes), side="left") + 1
            if at[-1] != len(got) or ends[-1] != sizes.sum():
                raise ValueError("words and ids do not belong together")
            ids.append(got)
            counts.append(np.diff(at, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def encode_first(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.model.encode_batch_fast(words, add_special_tokens=False)
        each = [e.ids for e in got]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), np.int32, int(counts.sum())), counts


def load_model(file: str) -> PieceModel | ByteModel:
    return PieceModel(file) if file.endswith(".model") else ByteModel(file)


class WordStore:
    """What a tokenizer makes of each word met so far: number of ids and, if wanted, the ids."""

    def __init__(self, file: str, with_ids: bool):
        self.model = load_model(file)
        self.with_ids = with_ids
        self.first: dict[str, int] = {}  # a text's first word, without a space before it
        self.rest: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def _learn(self, at: dict[str, int], words: list[str], encode) -> list[str]:
        new = [w for w in words if w not in at]
        if new:
            ids, counts = encode(new)
            row = len(self.counts)
            at.update(zip(new, range(row, row + len(new)), strict=True))
            self.counts = np.concatenate([self.counts, counts])
            if self.with_ids:
                start = len(self.ids) + np.cumsum(counts) - counts
                self.starts = np.concatenate([self.starts, start])
                self.ids = np.concatenate([self.ids, ids])
        return new

    def _forget(self, at: dict[str, int], words: list[str]) -> None:
        for word in words:
            del at[word]

    def apply(self, texts: list[str], use) -> None:
        """Calls use(rows, offsets): the store's row of each word of all texts, and each text's first.

        Texts must split at spaces. Words beyond the store's size are forgotten afterwards.
        """
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = lists.offsets.to_numpy()
        words = lists.flatten().dictionary_encode()
        known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        firsts = [t.partition(" ")[0] for t in texts]
        size = len(self.counts), len(self.ids)
        new = self._learn(self.rest, known, self.model.encode_words)
        new_firsts = self._learn(
            self.first, list(dict.fromkeys(firsts)), self.model.encode_first
        )
        row_of = np.fromiter(map(self.rest.__getitem__, known), np.int64, len(known))
        rows = row_of[words.indices.to_numpy()]
        rows[offsets[:-1]] = [self.first[w] for w in firsts]
        use(rows, offsets[:-1])
        if size[0] + len(new) + len(new_firsts) > KEPT_WORDS:
            self._forget(self.rest, new)
            self._forget(self.first, new_firsts)
            self.counts, self.starts = self.counts[: size[0]], self.starts[: size[0]]
            self.ids = self.ids[: size[1]]

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text: its words' frequencies times their pieces."""
        out = np.zeros(len(texts), np.int64)
        split = np.fromiter(map(self.model.splits, texts), bool, len(texts))
        for i in np.flatnonzero(~split):
            out[i] = len(self.model.encode(texts[i])) if texts[i] else 0

        def use(rows, offsets):
            out[split] = np.add.reduceat(self.counts[rows], offsets)

        if split.any():
            self.apply([t for t, s in zip(texts, split, strict=True) if s], use)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        split = np.fromiter(map(self.model.splits, texts), bool, len(texts))
        lengths = np.zeros(len(texts), np.int64)
        whole = {i: np.array(self.model.encode(texts[i]), np.int32) for i in np.flatnonzero(~split)}
        for i, ids in whole.items():
            lengths[i] = len(ids)
        flat = np.zeros(0, np.int32)

        def use(rows, offsets):
            nonlocal flat
            counts = self.counts[rows]
            lengths[split] = np.add.reduceat(counts, offsets)
            flat = self.ids[ranges(self.starts[rows], counts)]

        if split.any():
            self.apply([t for t, s in zip(texts, split, strict=True) if s], use)
        if not whole:
            return flat, lengths
        parts = iter(np.split(flat, np.cumsum(lengths[split])[:-1]))
        each = [whole[i] if i in whole else next(parts) for i in range(len(texts))]
        return np.concatenate(each), lengths


_stores: dict[tuple[str, bool], WordStore] = {}


def worker_store(file: str, with_ids: bool) -> WordStore:
    """One per Python worker, so that tasks that follow each other share the words."""
    key = file, with_ids
    if key not in _stores:
        _stores[key] = WordStore(file, with_ids)
    return _stores[key]
