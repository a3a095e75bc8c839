"""Two tokenizers aligned over a corpus: groups of tokens, links, and how often ids are linked.

Tokens of both vocabularies are laid over the bytes of a space and the text. Where tokens of both end
together a group ends, and the two tokens that end there are linked. Distinct pairs of linked ids get
minimal perfect hashes, in buckets of the second id; counts are added in dense vectors that the hashes
index, vectors are summed in a tree, and keys stored with the slots verify each lookup. A second pass
aligns the documents again and looks the counts up.

Both tokenizers cut at spaces, so words are aligned once and kept in a store of bounded size; texts
where that does not hold are aligned whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from martwright.llm.common import (
    parts_for,
    ranges,
    record_batch,
    send_package,
    slices,
    stored,
    text_bytes,
)
from martwright.llm.perfect_hash import KeySlots
from martwright.llm.word_pieces import ByteModel, PieceModel, tokenizer_file

#: Words that a worker keeps, and characters of what they are aligned to; others are aligned again.
KEPT_WORDS, KEPT_CHARS = 300_000, 32 << 20
#: Characters of texts that are aligned at a time.
_SLICE = 1 << 20
#: Bytes of text whose pairs one task holds.
_BLOCK_BYTES = 16 << 20
#: Links whose pairs a task holds before it merges equal ones.
_HELD = 1 << 20
#: Blocks whose counts one vector takes up, and vectors that are summed at a time.
_FAN = 64


def byte_table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all ids in a row, each id's place there and length."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(lengths) - lengths, lengths


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: the byte itself if it is
    printable in Latin-1, else the next letter from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in set(printable)]
    letters = {chr(b): b for b in printable}
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


class _Side:
    """A tokenizer's ids of units (words, or texts as a whole), and the bytes of its ids."""

    def __init__(self, model, pieces: list[bytes], ends: str):
        self.model = model
        self.flat, self.starts, self.lengths = byte_table(pieces)
        names = [str(i) for i in range(len(pieces))]
        # an id as it is written inside and at the end of a group
        self.names = np.array([n + "," for n in names] + [n + ends for n in names], object)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return self.flat[ranges(self.starts[ids], self.lengths[ids])].tobytes()


def _byte_side(file: str) -> _Side:
    model = ByteModel(file)
    model.model.encode_special_tokens = True
    model.marks = []  # their strings are ordinary text then
    letters = _byte_letters()
    pieces = [b""] * model.vocabulary_size()
    for piece, i in model.model.get_vocab(with_added_tokens=False).items():
        if all(c in letters for c in piece):
            pieces[i] = bytes(letters[c] for c in piece)
    return _Side(model, pieces, "|")


def _piece_side(file: str) -> _Side:
    model = PieceModel(file)
    pieces = [
        bytes([int(p[3:5], 16)]) if model.model.is_byte(i) else p.replace(model.space, " ").encode()
        for i, p in enumerate(model.pieces)
    ]
    return _Side(model, pieces, ";")


class Aligner:
    """Aligns texts word by word and keeps what words are aligned to.

    Rows of the store: tokens of either side, links (pairs of ids as one number, the second side's
    above), the groups as text if wanted, and whether the tokens hold the bytes of the word.
    """

    def __init__(self, byte_file: str, piece_file: str, with_groups: bool = True):
        self.with_groups = with_groups
        self.a, self.b = _byte_side(byte_file), _piece_side(piece_file)
        self.at: dict[str, int] = {}
        self.chars = 0
        self.n_a = self.n_b = self.n_links = self.starts = self.links = np.zeros(0, np.int64)
        self.good = np.zeros(0, bool)
        self.groups = np.zeros(0, object)

    def _splits(self, text: str) -> bool:
        return self.a.model.splits(text) and self.b.model.splits(text)

    def _whole(self, text: str) -> tuple[list[int], list[int]]:
        first = self.a.model.model.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        return first, self.b.model.encode(text)

    def _learn(self, units: list[str], words: bool) -> None:
        """Adds rows for the units."""
        if words:
            ids_a, n_a = self.a.model.encode_words(units)
            ids_b, n_b = self.b.model.encode_words(units)
        else:
            both = [self._whole(u) for u in units]
            n_a, n_b = (np.array([len(x[i]) for x in both], np.int64) for i in (0, 1))
            ids_a, ids_b = (np.concatenate([np.array(x[i], np.int64) for x in both]) for i in (0, 1))
        good = np.ones(len(units), bool)
        wanted = (" " + " ".join(units)).encode() if words else "".join(" " + u for u in units).encode()
        if not self.a.bytes_of(ids_a) == self.b.bytes_of(ids_b) == wanted:
            cut_a, cut_b = np.split(ids_a, np.cumsum(n_a)[:-1]), np.split(ids_b, np.cumsum(n_b)[:-1])
            good = np.array([
                self.a.bytes_of(x) == self.b.bytes_of(y) == (" " + u).encode()
                for x, y, u in zip(cut_a, cut_b, units, strict=True)
            ])
            ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        links, n_links, groups = self._aligned(ids_a.astype(np.int64), n_a, ids_b.astype(np.int64), n_b)
        self.starts = np.append(self.starts, len(self.links) + np.cumsum(n_links) - n_links)
        self.links = np.append(self.links, links)
        self.n_a, self.n_b = np.append(self.n_a, n_a), np.append(self.n_b, n_b)
        self.n_links, self.good = np.append(self.n_links, n_links), np.append(self.good, good)
        self.groups = np.append(self.groups, groups)
        self.chars += sum(map(len, groups)) + sum(map(len, units))

    def _aligned(self, ids_a, n_a, ids_b, n_b):
        """Links, their number and the groups' text for each unit; both sides have the same bytes."""
        ends_a, ends_b = np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b])
        _, last_a, last_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        links = ids_b[last_b] << 32 | ids_a[last_a]
        unit_ends = np.searchsorted(last_a, np.cumsum(n_a))
        n_links = np.diff(unit_ends, prepend=0)
        groups = np.full(len(n_a), "", object)
        if not self.with_groups:
            return links, n_links, groups
        closes_a, closes_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        closes_a[last_a] = closes_b[last_b] = 1
        # a group's tokens of the first side stand before those of the second
        before_a, before_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        text = np.empty(len(ids_a) + len(ids_b), object)
        to_a, to_b = np.append(0, last_a + 1), np.append(0, last_b + 1)
        text[np.arange(len(ids_a)) + to_b[before_a]] = self.a.names[ids_a + closes_a * len(self.a.lengths)]
        text[np.arange(len(ids_b)) + to_a[before_b + 1]] = self.b.names[
            ids_b + closes_b * len(self.b.lengths)
        ]
        cuts = np.cumsum(n_a + n_b)
        parts = text.tolist()
        groups[:] = [
            "".join(parts[stop - n : stop])
            for stop, n in zip(cuts.tolist(), (n_a + n_b).tolist(), strict=True)
        ]
        return links, n_links, groups

    def apply(self, texts: list[str], use) -> None:
        """Calls use(rows, counts): the store's rows of each text's units in order, how many each has.

        Empty texts have none. Texts aligned whole, and words beyond the store's size, are forgotten
        afterwards.
        """
        kept = len(self.n_a), len(self.links), self.chars
        counts = np.zeros(len(texts), np.int64)
        split = [i for i, t in enumerate(texts) if self._splits(t)]
        whole = sorted(set(range(len(texts))) - set(split) - {i for i, t in enumerate(texts) if not t})
        counts[whole] = 1
        lists = pc.split_pattern(pa.array([texts[i] for i in split], pa.large_string()), " ")
        counts[split] = np.diff(lists.offsets.to_numpy())
        words = lists.flatten().dictionary_encode()
        known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        row_of = np.fromiter(map(self.at.get, known, repeat(-1)), np.int64, len(known))
        missing = np.flatnonzero(row_of < 0)
        if len(missing):
            row_of[missing] = len(self.n_a) + np.arange(len(missing))
            new = list(map(known.__getitem__, missing.tolist()))
            self._learn(new, words=True)
            if len(self.at) + len(new) <= KEPT_WORDS and self.chars <= KEPT_CHARS:
                self.at.update(zip(new, row_of[missing].tolist(), strict=True))
                kept = len(self.n_a), len(self.links), self.chars
        rows = np.empty(int(counts.sum()), np.int64)
        is_word = np.ones(len(texts), bool)
        is_word[whole] = False
        from_words = np.repeat(is_word, counts)
        rows[from_words] = row_of[words.indices.to_numpy()]
        if whole:
            rows[~from_words] = len(self.n_a) + np.arange(len(whole))
            self._learn([texts[i] for i in whole], words=False)
        use(rows, counts)
        if len(self.n_a) > kept[0]:
            for name in ("n_a", "n_b", "n_links", "starts", "good", "groups"):
                setattr(self, name, getattr(self, name)[: kept[0]])
            self.links, self.chars = self.links[: kept[1]], kept[2]


_aligners: dict[tuple, Aligner] = {}


def _aligner(files: tuple[str, str], with_groups: bool) -> Aligner:
    """One for each Python worker; that of the other pass goes."""
    if (files, with_groups) not in _aligners:
        _aligners.clear()
        _aligners[files, with_groups] = Aligner(*files, with_groups)
    return _aligners[files, with_groups]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of so many values in a row each."""
    total = np.append(0, np.cumsum(values))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _of_good_texts(aligner: Aligner, rows: np.ndarray, counts: np.ndarray):
    """Rows and counts without those of texts in which some unit's bytes are not the tokens'."""
    bad = _sums(~aligner.good[rows], counts) > 0
    return rows[~np.repeat(bad, counts)], np.where(bad, 0, counts)


def _packed(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending keys as steps, and columns, compressed."""
    body = [np.diff(keys, prepend=0), *columns]
    return zstandard.ZstdCompressor(level=1).compress(
        b"".join(np.ascontiguousarray(c, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in body)
    )


def _unpacked(body: bytes, columns: int) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    found = [
        np.ascontiguousarray(c.reshape(8, -1).T).view("<i8").ravel() for c in flat.reshape(columns, -1)
    ]
    return [np.cumsum(found[0]), *found[1:]]


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


_PAIRS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("body", pa.binary())])
_PAIRS_DDL = "bucket int, block int, body binary"


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Pairs of one id of the second side lie in one bucket."""
    return ((keys >> 32) * 0x9E3779B1 & 0xFFFFFFFF) % buckets


def _places(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows, a few at a time as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            yield from zip(*[part[n].to_pylist() for n in names], strict=True)


def _grouped(rows: Iterator[tuple]) -> Iterator[tuple]:
    """First value and the others, as an iterator, of rows that are sorted by the first."""
    ahead = next(rows, None)
    while ahead is not None:
        place = ahead[0]

        def own(place=place):
            nonlocal ahead
            while ahead is not None and ahead[0] == place:
                now, ahead = ahead, next(rows, None)
                yield now[1:]

        members = own()
        yield place, members
        for _ in members:
            pass


def _text_slices(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows (.., text) up to about a slice of characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= _SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _count_pairs(files: tuple[str, str], buckets: int):
    """Rows of a block; gives the block's pairs with their counts by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(files, with_groups=False)
        for block, rows in _grouped(_places(batches, "place", "text")):
            held, size = [], 0

            def use(units, counts):
                nonlocal held, size
                units, _ = _of_good_texts(aligner, units, counts)
                own, times = np.unique(units, return_counts=True)
                n = aligner.n_links[own]
                keys = aligner.links[ranges(aligner.starts[own], n)]
                held.append(_merged(keys, np.repeat(times, n)))
                size += len(held[-1][0])
                if size > _HELD:
                    held = [_merged(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][0]) // 2

            for part in _text_slices(rows):
                aligner.apply([text for (text,) in part], use)
            keys, counts = _merged(*map(np.concatenate, zip(*held, strict=True)))
            bucket = _bucket_of(keys, buckets)
            filled = np.unique(bucket).tolist()
            yield record_batch(
                _PAIRS, bucket=filled, block=[block] * len(filled),
                body=[_packed(keys[bucket == b], counts[bucket == b]) for b in filled],
            )

    return count


_BODY = pa.schema([("place", pa.int32()), ("body", pa.binary())])
_BODY_DDL = "place int, body binary"


def _distinct_keys(columns: int):
    """All keys of a place's rows once; merged as they come."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, bodies in _grouped(_places(batches, "place", "body")):
            keys, held, size = np.zeros(0, np.int64), [], 0
            for (body,) in bodies:
                held.append(_unpacked(body, columns)[0])
                size += len(held[-1])
                if size > max(_HELD, len(keys)):
                    keys, held, size = np.unique(np.concatenate([keys, *held])), [], 0
            keys = np.unique(np.concatenate([keys, *held]))
            yield record_batch(_BODY, place=[place], body=[_packed(keys)])

    return distinct


def _build_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's minimal perfect hash, and the key of each slot after it."""
    for bucket, bodies in _grouped(_places(batches, "place", "body")):
        (keys,) = _unpacked(next(bodies)[0], 1)
        found, slots = KeySlots.build(keys, np.zeros(len(keys), np.int64))
        by_slot = np.empty(len(keys), "<i8")
        by_slot[slots] = keys
        yield record_batch(_BODY, place=[bucket], body=[found.to_bytes() + by_slot.tobytes()])


class _Slots:
    """A bucket's hash with the keys that verify it, and columns by slot."""

    def __init__(self, body: bytes, columns: int = 0):
        self.found, at = KeySlots.from_bytes(body)
        rest = np.frombuffer(body, "<i8", -1, at).reshape(1 + columns, -1)
        self.keys, self.columns = rest[0], rest[1:]

    def of(self, keys: np.ndarray) -> np.ndarray:
        slots = self.found.find(keys, np.zeros(len(keys), np.int64))
        if (slots < 0).any() or (self.keys[slots] != keys).any():
            raise ValueError("a pair is not in the index")
        return slots


_VECTOR = pa.schema([("place", pa.int32()), ("body", pa.binary())])


def _vector(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<i8").tobytes())


def _counts(body: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), "<i8")


def _dense_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a place: the bucket's hash first, then pairs of blocks; gives one vector."""
    for place, rows in _grouped(_places(batches, "place", "body")):
        slots = _Slots(next(rows)[0])
        dense = np.zeros(len(slots.keys), np.int64)
        for (body,) in rows:
            keys, counts = _unpacked(body, 2)
            dense[slots.of(keys)] += counts
        yield record_batch(_VECTOR, place=[place], body=[_vector(dense)])


def _sum_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for place, rows in _grouped(_places(batches, "place", "body")):
        total = None
        for (body,) in rows:
            total = _counts(body) if total is None else total + _counts(body)
        yield record_batch(_VECTOR, place=[place], body=[_vector(total)])


def _with_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket: hash, then counts. Adds counts, and whether they are their second id's best."""
    for bucket, rows in _grouped(_places(batches, "place", "body")):
        body, counts = next(rows)[0], _counts(next(rows)[0])
        second = _Slots(body).keys >> 32
        kinds, which = np.unique(second, return_inverse=True)
        best = np.zeros(len(kinds), np.int64)
        np.maximum.at(best, which, counts)
        flags = (counts == best[which]).astype("<i8")
        yield record_batch(
            _BODY, place=[bucket], body=[body + counts.astype("<i8").tobytes() + flags.tobytes()]
        )


_TOLD = pa.schema([("place", pa.int32()), ("body", pa.binary())])


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a place: the bucket's hash and counts, then pairs of blocks; tells each block of its."""
    for _, rows in _grouped(_places(batches, "place", "block", "body")):
        index = _Slots(next(rows)[1], 2)
        for block, body in rows:
            keys, _ = _unpacked(body, 2)
            counts, best = (column[index.of(keys)] for column in index.columns)
            yield record_batch(_TOLD, place=[block], body=[_packed(keys, counts, best)])


def _report(files: tuple[str, str], schema: pa.Schema):
    """Rows of a block: what it is told of its pairs, then its documents."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(files, with_groups=True)
        names = ("place", "body", "doc_id", "text")
        for _, rows in _grouped(_places(batches, *names)):
            told, docs = [np.zeros((3, 0), np.int64)], []
            first = None
            for row in rows:
                if row[0] is None:
                    first = row
                    break
                told.append(np.array(_unpacked(row[0], 3)))
            table = np.concatenate(told, axis=1)
            keys, counts, best = table[:, np.argsort(table[0], kind="stable")]

            def documents(first=first, rows=rows):
                if first is not None:
                    yield first[1:]
                    yield from (row[1:] for row in rows)

            def use(units, n_units, keys=keys, counts=counts, best=best):
                units, n_units = _of_good_texts(aligner, units, n_units)
                own, which = np.unique(units, return_inverse=True)
                n = aligner.n_links[own]
                wanted = aligner.links[ranges(aligner.starts[own], n)]
                at = np.searchsorted(keys, wanted)
                if len(wanted) and not (keys[np.minimum(at, len(keys) - 1)] == wanted).all():
                    raise ValueError("a block was not told of one of its pairs")
                values = {
                    "n_a": aligner.n_a[own], "n_b": aligner.n_b[own], "n_groups": n, "n_links": n,
                    "n_best": _sums(best[at], n), "count_sum": _sums(counts[at], n),
                }
                ends = np.cumsum(n_units).tolist()
                text = aligner.groups[units].tolist()
                groups = [
                    "".join(text[end - n : end])[:-1] for end, n in zip(ends, n_units.tolist(), strict=True)
                ]
                docs.append(record_batch(
                    schema, doc_id=[row[0] for row in part], groups=groups,
                    **{name: _sums(v[which], n_units) for name, v in values.items()},
                ))

            for part in _text_slices(documents()):
                aligner.apply([text for *_, text in part], use)
                yield from docs
                docs.clear()

    return report


def _meet(first: DataFrame, second: DataFrame, parts: int) -> DataFrame:
    """Rows of both by place, those of the first before those of the second."""
    both = first.withColumn("late", F.lit(0)).unionByName(
        second.withColumn("late", F.lit(1)), allowMissingColumns=True
    )
    return both.repartitionById(parts, "place").sortWithinPartitions("place", "late")


def _by_place(frame: DataFrame, place: Column, parts: int, *columns: str) -> DataFrame:
    placed = frame.select(place.cast("int").alias("place"), *columns)
    return placed.repartitionById(parts, "place").sortWithinPartitions("place")


def link_index(pairs: DataFrame, buckets: int, blocks: int) -> DataFrame:
    """place (the bucket) and body: hash, keys, counts and best flags of all pairs of the bucket.

    pairs has bucket, block and body as _count_pairs gives them. Distinct keys and count vectors of a
    bucket are merged over groups of blocks first.
    """
    groups = -(-blocks // _FAN)
    group = F.floor(F.col("block") / _FAN).cast("int")
    place = F.col("bucket") * groups + group
    keys = _by_place(pairs, place, buckets * groups, "body").mapInArrow(_distinct_keys(2), _BODY_DDL)
    keys = _by_place(keys, F.floor(F.col("place") / groups), buckets, "body")
    hashes = stored(keys.mapInArrow(_distinct_keys(1), _BODY_DDL).mapInArrow(_build_hash, _BODY_DDL))
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    spread = hashes.select("place", every_group.alias("group"), "body").select(
        (F.col("place") * groups + F.col("group")).cast("int").alias("place"), "body"
    )
    placed = pairs.select(place.cast("int").alias("place"), "body")
    vectors = _meet(spread, placed, buckets * groups).mapInArrow(_dense_counts, _BODY_DDL)
    while groups > 1:
        fewer = -(-groups // _FAN)
        bucket, own = F.floor(F.col("place") / groups), F.col("place") % groups
        vectors = _by_place(
            vectors, bucket * fewer + F.floor(own / _FAN), buckets * fewer, "body"
        ).mapInArrow(_sum_vectors, _BODY_DDL)
        groups = fewer
    return stored(_meet(hashes, vectors, buckets).mapInArrow(_with_best, _BODY_DDL))


def align_tokenizers(
    docs: DataFrame,
    byte_tokenizer: str = "byte_bpe_50k.json",
    piece_tokenizer: str = "piece_bpe_32k.model",
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every row.

    A space and the text are encoded by the byte-level tokenizer (side A), the text by the piece
    tokenizer (side B, which adds the space), both without special tokens. groups lists the ids of
    each group as A ids|B ids;... A link's count is how often its ids are linked in all rows; n_best
    counts links whose count is the highest of their B id, ties included, count_sum adds the counts.
    Texts that are null or empty, or whose tokens of either side do not hold exactly the bytes of a
    space and the text, have no tokens: zeros and an empty groups; they add nothing to counts. Each row
    counts, repeated ones too; null ids stay. An empty table gives no rows. Other columns are not read.

    Documents are dealt to blocks by id and text, so neither a hot id nor copies under several ids
    fill one; rows that agree in both are in one block, which streams them. Buckets follow the square
    root of the input, as distinct pairs do (at most the product of both vocabularies).
    """
    send_package(docs.sparkSession)
    files = tokenizer_file(byte_tokenizer), tokenizer_file(piece_tokenizer)
    volume = text_bytes(docs, text_column)
    blocks = parts_for(volume, _BLOCK_BYTES)
    buckets = max(1, round((volume / _BLOCK_BYTES) ** 0.5))
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(id_column), text), F.lit(blocks)).cast("int").alias("place"),
        F.col(id_column).alias("doc_id"), text.alias("text"),
    )
    placed = _by_place(rows, F.col("place"), blocks, "text")
    pairs = stored(placed.mapInArrow(_count_pairs(files, buckets), _PAIRS_DDL))
    index = link_index(pairs, buckets, blocks)
    groups = -(-blocks // _FAN)
    group = F.floor(F.col("block") / _FAN).cast("int")
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    spread = index.select("place", every_group.alias("group"), "body").select(
        (F.col("place") * groups + F.col("group")).cast("int").alias("place"), "body"
    )
    asked = pairs.select((F.col("bucket") * groups + group).cast("int").alias("place"), "block", "body")
    met = _meet(spread, asked, buckets * groups).select("place", "block", "body")
    told = met.mapInArrow(_look_up, _BODY_DDL)
    schema = T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType),
        *[T.StructField(n, T.LongType()) for n in
          ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
        T.StructField("groups", T.StringType()),
    ])
    met = _meet(told, rows, blocks).select("place", "body", "doc_id", "text")
    return met.mapInArrow(_report(files, to_arrow_schema(schema)), schema)
