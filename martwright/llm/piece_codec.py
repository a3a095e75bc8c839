"""SentencePiece BPE with seeded merge dropout, and its lossless decoding.

Words (a run of spaces and what follows) are segmented apart from each other. For each word an agenda
holds the pairs of neighbouring symbols that the model can merge, best score first and leftmost among
equals. A candidate taken from the agenda is skipped if a hash keyed by seed, document, place in the
document and candidate falls below the dropout; it comes back only if a neighbour changes. So each
occurrence of a word draws by itself. All words of a slice of texts go through their agendas in step,
as rows of one array; occurrences of a word share a row until their draws differ. Without dropout the
result is the library's own segmentation.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from martwright.llm.common import mix, ranges, slices
from martwright.llm.word_pieces import tokenizer_file

SPACE = "▁"
#: Stands for the model's own space mark inside texts; doubled with a digit so that it is unique.
HIDDEN = "\U0010fffd"
DROPOUT, SEED = 0.1, 17
_CUT = "\0"
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Characters of texts whose distinct words are segmented together.
_SLICE = 1 << 20
#: Ids that are decoded together.
_DECODED = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Symbols that words are given room for at a time; longer words stand alone.
_WIDTHS = (8, 16, 32, 64)
#: Symbols that the occurrences of words in step would have, were no two of them alike.
_IN_STEP = 1 << 20


class PieceCodec:
    """A BPE model with byte fallback, as tables."""

    def __init__(self, file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [
            not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
            for i in range(n)
        ]
        scores = np.array([model.get_score(i) for i in range(n)])
        self.size = n
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if len(set(self.byte_ids.tolist())) < 256:
            raise ValueError("the model has no byte pieces, so it cannot hold every text")
        ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        # a character without a piece is kept as -2 minus its code point
        self.char_ids = -2 - np.arange(sys.maxunicode + 1, dtype=np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = i
        pairs = [
            (ids[p[:k]] * n + ids[p[k:]], i)
            for p, i in ids.items()
            for k in range(1, len(p))
            if p[:k] in ids and p[k:] in ids
        ]
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_ids = np.array([i for _, i in pairs], np.int32)
        order = np.lexsort([np.arange(n), -scores])
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        # equal scores rank alike: the leftmost goes first
        ranked = scores[order]
        rank[order] = np.cumsum(np.append(0, ranked[1:] != ranked[:-1]))
        self.pair_ranks = rank[self.pair_ids].astype(np.int32)
        bodies = [
            bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode()
            if plain[i] else b"" for i, p in enumerate(pieces)
        ]
        self.body_lengths = np.array([len(b) for b in bodies], np.int64)
        self.body_starts = np.cumsum(self.body_lengths) - self.body_lengths
        self.bodies = np.frombuffer(b"".join(bodies), np.uint8)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of the merge table of each pair, -1 if the model has none."""
        known = (left >= 0) & (right >= 0)
        keys = np.where(known, left.astype(np.int64) * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, at, -1).astype(np.int32)

    def _agendas(
        self, symbols: np.ndarray, owner: np.ndarray, keys: np.ndarray, dropout: float
    ) -> tuple[np.ndarray, np.ndarray]:
        """Merges the symbols of all rows in step; -1 closes a row, below that are foreign characters.

        owner: row of each occurrence, every row having some; keys: of each occurrence, seed included.
        A row whose occurrences draw differently goes on as two. Gives the final rows, and the row of
        each occurrence.
        """
        n, width = symbols.shape
        state = owner.astype(np.int64)
        if width < 2:
            return symbols, state
        never = np.iinfo(np.int32).max
        limit = np.uint64(min(int(dropout * 2.0**64), (1 << 64) - 1))
        merges = self._pairs(symbols[:, :-1], symbols[:, 1:])
        agenda = np.where(merges >= 0, self.pair_ranks[merges], np.int32(never))
        rows, total, step = np.arange(n), n, np.uint64(0)
        # open occurrences and where their rows stand
        open_ones, local = np.arange(len(state)), state.copy()
        closed, closed_rows = [], []
        while len(rows):
            at = agenda.argmin(axis=1)
            live = agenda[np.arange(len(rows)), at] != never
            if not live.all():
                closed_rows.append(rows[~live])
                closed.append(symbols[~live])
                stay = live[local]
                open_ones, keys, local = open_ones[stay], keys[stay], (np.cumsum(live) - 1)[local[stay]]
                rows, symbols, agenda, merges, at = (
                    a[live] for a in (rows, symbols, agenda, merges, at)
                )
                if not len(rows):
                    break
            step += np.uint64(1)
            merged = merges[np.arange(len(rows)), at]
            skipped = np.zeros(len(rows), bool)
            if limit:
                with np.errstate(over="ignore"):
                    drawn = mix(keys + (step * _STEP + mix(merged.astype(np.uint64)))[local]) < limit
                skips = np.bincount(local[drawn], minlength=len(rows))
                whole = np.bincount(local, minlength=len(rows))
                skipped = skips == whole
                split = np.flatnonzero((skips > 0) & ~skipped)
                if len(split):  # those that skip go on in a row of their own
                    copies = np.full(len(rows), -1)
                    copies[split] = np.arange(len(split))
                    own = np.flatnonzero(drawn & (copies[local] >= 0))
                    copy = copies[local[own]]
                    local[own] = len(rows) + copy
                    state[open_ones[own]] = total + copy
                    rows = np.concatenate([rows, total + np.arange(len(split))])
                    total += len(split)
                    symbols, agenda, merges, at, merged = (
                        np.concatenate([a, a[split]]) for a in (symbols, agenda, merges, at, merged)
                    )
                    skipped = np.concatenate([skipped, np.ones(len(split), bool)])
            agenda[np.flatnonzero(skipped), at[skipped]] = never
            on = np.flatnonzero(~skipped)
            if not len(on):
                continue
            # the merged pair becomes one symbol; all to its right move up by one
            spot, new = at[~skipped], self.pair_ids[merged[~skipped]]
            columns = np.arange(width)
            moved = columns[None, :] + (columns[None, :] > spot[:, None])
            own = np.concatenate([symbols[on], np.full((len(on), 1), -1, np.int32)], axis=1)
            own = np.take_along_axis(own, moved, axis=1)
            own[np.arange(len(on)), spot] = new
            symbols[on] = own
            for table, fill in ((agenda, never), (merges, -1)):
                part = np.concatenate([table[on], np.full((len(on), 1), fill, np.int32)], axis=1)
                table[on] = np.take_along_axis(part, moved[:, :-1], axis=1)
            for shift in (-1, 0):  # the two pairs of the new symbol are new candidates
                pair = spot + shift
                ok = (pair >= 0) & (pair < width - 1)
                r, c = on[ok], pair[ok]
                found = self._pairs(symbols[r, c], symbols[r, c + 1])
                merges[r, c] = found
                agenda[r, c] = np.where(found >= 0, self.pair_ranks[found], never)
        out = np.empty((total, width), np.int32)
        out[np.concatenate(closed_rows)] = np.concatenate(closed)
        return out, state

    def segment(
        self, words: list[str], index: np.ndarray, keys: np.ndarray, dropout: float
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all segmentations in a row, how many each has, and that of each occurrence.

        index: word of each occurrence, every word having some; keys: of each occurrence.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        flat = self.char_ids[points]
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(index, kind="stable")  # occurrences by word
        often = np.bincount(index, minlength=len(words))
        begin = np.cumsum(often) - often
        which = np.zeros(len(index), np.int64)
        found, counts, held = [], [], 0
        widest = int(sizes.max(initial=1))
        low = 0
        for width in [w for w in _WIDTHS if w < widest] + [widest]:
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            full = (np.cumsum(often[rows]) - often[rows]) * width // _IN_STEP
            for part in np.split(rows, np.flatnonzero(np.diff(full)) + 1):
                if not len(part):
                    continue
                symbols = np.full((len(part), width), -1, np.int32)
                symbols[np.arange(width) < sizes[part][:, None]] = flat[ranges(starts[part], sizes[part])]
                own = order[ranges(begin[part], often[part])]
                owner = np.repeat(np.arange(len(part)), often[part])
                done, state = self._agendas(symbols, owner, keys[own], dropout)
                kept = done != -1
                which[own] = held + state
                held += len(done)
                counts.append(kept.sum(axis=1))
                found.append(done[kept])
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), which
        return *self._with_bytes(np.concatenate(found), np.concatenate(counts)), which

    def _with_bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Foreign characters as their bytes."""
        foreign = np.flatnonzero(ids < -1)
        if not len(foreign):
            return ids.astype(np.int32), counts
        bodies = [chr(-2 - int(i)).encode() for i in ids[foreign]]
        widths = np.ones(len(ids), np.int64)
        widths[foreign] = [len(b) for b in bodies]
        out = np.repeat(ids, widths)
        begin = (np.cumsum(widths) - widths)[foreign]
        raw = np.frombuffer(b"".join(bodies), np.uint8)
        out[ranges(begin, widths[foreign])] = self.byte_ids[raw]
        owner = np.repeat(np.arange(len(counts)), counts)
        return out.astype(np.int32), np.bincount(owner, widths, len(counts)).astype(np.int64)

    def encode(
        self, texts: list[str], rows: np.ndarray, seed: int, dropout: float, variants: int | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has. rows: a key for each text.

        Each place of a word draws by itself; with variants it draws one of so many keys of the word.
        """
        words, owner = _split(texts)
        known = words.dictionary_encode()
        index = known.indices.to_numpy().astype(np.int64)
        lists = known.dictionary.to_numpy(zero_copy_only=False).tolist()
        first = np.searchsorted(owner, np.arange(len(texts)))
        with np.errstate(over="ignore"):
            base = rows.astype(np.int64).view(np.uint64) + np.uint64(seed) * _STEP
            place = (np.arange(len(owner)) - first[owner]).astype(np.uint64)
            keys = mix(mix(base)[owner] + place)
            if variants is not None:
                variant = keys % np.uint64(variants)
                keys = mix(_word_hashes(lists)[index] + variant * _STEP + np.uint64(seed))
        ids, counts, which = self.segment(lists, index, keys, dropout)
        starts = np.cumsum(counts) - counts
        flat = ids[ranges(starts[which], counts[which])]
        return flat, np.bincount(owner, counts[which], len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of rows of ids; the space that encoding put first is taken off."""
        body = self.bodies[ranges(self.body_starts[ids], self.body_lengths[ids])].tobytes()
        each = np.cumsum(self.body_lengths[ids])
        ends = np.concatenate([[0], each])[np.cumsum(counts)]
        begins = np.concatenate([[0], ends[:-1]])
        return [body[a + 1 : b].decode() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]


def _word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))


def _split(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All words, spaces as the model's mark and one before each text, and the text of each word.

    A mark that a text itself holds is no space: it is hidden in a private code point, which goes into
    bytes. Texts that hold it, or the cut, are split one by one.
    """
    plain = [bool(t) and not any(c in t for c in (_CUT, SPACE, HIDDEN)) for t in texts]
    marked = [SPACE + t.replace(" ", SPACE) for t, p in zip(texts, plain, strict=True) if p]
    cut = pc.replace_substring_regex(
        pa.array(marked, pa.large_string()), f"([^{SPACE}]){SPACE}", f"\\1{_CUT}{SPACE}"
    )
    lists = pc.split_pattern(cut, _CUT)
    words = lists.flatten()
    rows = np.flatnonzero(plain)
    owner = np.repeat(rows, np.diff(lists.offsets.to_numpy()))
    if all(plain):
        return words, owner
    more, owners = [], []
    for i in np.flatnonzero(~np.array(plain, bool)).tolist():
        if texts[i]:
            found = _WORDS.findall(SPACE + _hide(texts[i]).replace(" ", SPACE))
            more += found
            owners += [i] * len(found)
    words = pa.concat_arrays([words, pa.array(more, pa.large_string())])
    owner = np.concatenate([owner, np.array(owners, np.int64)])
    order = np.argsort(owner, kind="stable")
    return words.take(pa.array(order)), owner[order]


def _hide(text: str) -> str:
    return text.replace(HIDDEN, HIDDEN + "1").replace(SPACE, HIDDEN + "0")


def _show(text: str) -> str:
    return text.replace(HIDDEN + "0", SPACE).replace(HIDDEN + "1", HIDDEN) if HIDDEN in text else text


_codecs: dict[str, PieceCodec] = {}


def worker_codec(file: str) -> PieceCodec:
    if file not in _codecs:
        _codecs[file] = PieceCodec(file)
    return _codecs[file]


def encode_pieces(
    docs: DataFrame,
    tokenizer: str = "piece_bpe_32k.model",
    seed: int = SEED,
    dropout: float = DROPOUT,
    variants: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, text and ids (array of int) of every row, without begin and end ids.

    The same seed, id and text give the same ids wherever they are encoded; another seed gives others.
    Each occurrence of a word draws by itself, unless variants bounds the segmentations of a word.
    dropout 0 gives the library's ids, 1 single characters. Null and empty texts have no ids; null
    ids count as 0 in the key. Rows are encoded one by one, repeated rows alike; an empty table
    gives none. Other columns are not read.
    """
    file = tokenizer_file(tokenizer)
    if not 0 <= dropout <= 1 or (variants is not None and variants < 1):
        raise ValueError("dropout lies between 0 and 1, and there is a variant at least")
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(F.col(id_column).cast("string")).alias("key"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    out = T.StructType([
        rows.schema["doc_id"], T.StructField("text", T.StringType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ])
    schema = to_arrow_schema(out)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(file)
        for batch in batches:
            texts, keys = batch["text"].to_pylist(), batch["key"].to_numpy()
            for part in slices(texts, _SLICE):
                ids, counts = codec.encode(texts[part], keys[part], seed, dropout, variants)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                own = batch.slice(part.start, part.stop - part.start)
                arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), schema.field("ids").type)
                yield pa.record_batch([own["doc_id"], own["text"], arrays], schema=schema)

    return rows.mapInArrow(encode, out)


def decode_pieces(
    encoded: DataFrame, tokenizer: str = "piece_bpe_32k.model", ids_column: str = "ids"
) -> DataFrame:
    """The rows with a column decoded: the text that the ids spell, whatever way it was segmented.

    Null and empty ids give an empty text.
    """
    file = tokenizer_file(tokenizer)
    rows = encoded.drop("decoded")
    out = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    schema = to_arrow_schema(out)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(file)
        for batch in batches:
            lists = pc.fill_null(pc.list_value_length(batch[ids_column]), 0).to_numpy()
            ids = pc.list_flatten(batch[ids_column]).to_numpy()
            ends, texts = np.cumsum(lists), []
            for part in slices([range(n) for n in lists.tolist()], _DECODED):
                first, last = ends[part.start] - lists[part.start], ends[part.stop - 1]
                texts += map(_show, codec.decode(ids[first:last], lists[part]))
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], schema=schema)

    return rows.mapInArrow(decode, out)
