"""Repeated passages removed through suffix arrays of shards.

A byte goes if it lies in a string of 100 bytes that starts earlier in the corpus as well. Every such
string is known by its least hash of 50 bytes (its anchor), so all its occurrences meet in the shard
of that hash, with the run of strings around them that have the same anchor (a snippet). Equal
snippets are merged before, and only anchors with several different snippets need a shard's suffix
array: it is induced over the snippets, and neighbours with a common prefix of 100 bytes are
occurrences of one string, of which the earliest stays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from martwright.llm.common import mix, parts_for, record_batch, stored, text_bytes
from martwright.llm.induced_sort import permuted_prefixes, suffix_array

LENGTH = 100
#: Long enough that texts which share nothing longer hardly share an anchor.
_GRAM = 50
#: Strings that a text is scanned by at a time; snippets end there, what is removed does not change.
_SCAN = 1 << 20
#: Bytes of short texts that are scanned together.
_CHUNK = 1 << 15
#: Anchors of a bucket in the search for repeated ones, and bytes of snippets of a shard.
_BUCKET_BYTES = 16 << 20
_BLOCK_BYTES = 8 << 20
_SHARD_BYTES = 1 << 19
#: Texts of so many bytes move compressed one by one; shorter ones are left to Spark's blocks of rows.
_LONG_TEXT = 1 << 9
#: Snippets of one anchor that a suffix array takes; strings of larger anchors are grouped singly.
LARGE_ANCHOR = 30_000
_BASE = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the hash's base and of its inverse, as long as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.full(n, _BASE, np.uint64))
                self.down = np.cumprod(np.full(n, _INVERSE, np.uint64))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _sliding(pick: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum of each run of width values, by runs of doubled length."""
    n, out = 1, values
    while 2 * n <= width:
        out = pick(out[:-n], out[n:])
        n *= 2
    return pick(out[: len(out) - (width - n)], out[width - n :]) if width > n else out


def _several_places(grams, anchors, first, last, width: int) -> np.ndarray:
    """Whether a run's anchor stands at more than one place in its snippet."""
    around = np.zeros(width - 1, np.uint64)
    places = np.flatnonzero(
        _sliding(np.maximum, np.concatenate([around, anchors, around]), width) == grams
    )
    several = np.zeros(len(first), bool)
    kinds = np.sort(grams[places])
    kinds = np.unique(kinds[1:][kinds[1:] == kinds[:-1]])
    if not len(kinds):
        return several
    # only hashes that stand twice in the text
    own, known = _among(kinds, anchors[first])
    runs = np.flatnonzero(known)
    of_place, known = _among(kinds, grams[places])
    span = len(grams) + 1
    keys = np.sort(of_place[known] * span + places[known])
    low = np.searchsorted(keys, own[runs] * span + first[runs])
    high = np.searchsorted(keys, own[runs] * span + last[runs] + width - 1, side="right")
    several[runs] = high - low > 1
    return several


def _among(kinds: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in sorted kinds, and whether they are there."""
    at = np.minimum(np.searchsorted(kinds, values), len(kinds) - 1)
    return at, kinds[at] == values


def _runs_of_anchors(
    part: np.ndarray, length: int, ends: np.ndarray, with_inner: bool
) -> tuple[np.ndarray, ...]:
    """Anchors of the strings of some texts, which end at ends: hash, first and last start of each run
    with one anchor, and, if asked, whether the anchor stands at several places in the run's snippet."""
    gram = min(_GRAM, length)
    width = length - gram + 1
    up, down = _powers.get(len(part))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        grams = mix((sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1])
    anchors = _sliding(np.minimum, grams, width)
    own = np.ones(len(part) + 1, bool)  # false where a string would go on into the next text
    inner = ends[:-1]
    own[(inner[:, None] - np.arange(1, length)).ravel()] = False
    own = own[: len(anchors)]
    new = np.ones(len(anchors), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | ~own[:-1]
    first = np.flatnonzero(new & own)
    closes = np.ones(len(anchors), bool)
    closes[:-1] = new[1:] | ~own[1:]
    last = np.flatnonzero(closes & own)
    if not with_inner:
        return anchors[first], first, last, np.zeros(len(first), bool)
    told = np.where(own, anchors, np.uint64(0))
    return anchors[first], first, last, _several_places(grams, told, first, last, width)


def snippets(
    texts: Sequence[bytes], length: int = LENGTH, with_inner: bool = True
) -> Iterator[tuple[np.ndarray, ...]]:
    """For each text the runs of its strings with one anchor: hash, first and last start, and whether
    the anchor stands at several places in the run's snippet (false without with_inner). Short texts
    are read together."""
    sizes = [len(t) for t in texts]
    at = 0
    while at < len(texts):
        stop, size = at + 1, sizes[at]
        while stop < len(texts) and size + sizes[stop] <= _CHUNK:
            size += sizes[stop]
            stop += 1
        if size > _CHUNK and size >= length:
            yield _long_snippets(texts[at], length, with_inner)
        else:
            yield from _short_snippets(texts[at:stop], length, with_inner)
        at = stop


def _short_snippets(
    texts: Sequence[bytes], length: int, with_inner: bool
) -> Iterator[tuple[np.ndarray, ...]]:
    whole = [t for t in texts if len(t) >= length]
    none = np.zeros(0, np.int64)
    empty = none.view(np.uint64), none, none, none.astype(bool)
    if not whole:
        yield from (empty for _ in texts)
        return
    ends = np.cumsum(np.fromiter(map(len, whole), np.int64, len(whole)))
    hashes, first, last, inner = _runs_of_anchors(
        np.frombuffer(b"".join(whole), np.uint8), length, ends, with_inner
    )
    cuts = np.append(0, np.searchsorted(first, ends)).tolist()
    begins = np.append(0, ends).tolist()
    n = 0
    for text in texts:
        if len(text) < length:
            yield empty
            continue
        rows, begin = slice(cuts[n], cuts[n + 1]), begins[n]
        yield hashes[rows], first[rows] - begin, last[rows] - begin, inner[rows]
        n += 1


def _long_snippets(text: bytes, length: int, with_inner: bool = True) -> tuple[np.ndarray, ...]:
    """Those of a text that is scanned a part at a time."""
    found = []
    for begin in range(0, len(text) - length + 1, _SCAN):
        part = np.frombuffer(text, np.uint8)[begin : begin + _SCAN + length - 1]
        hashes, first, last, inner = _runs_of_anchors(part, length, np.array([len(part)]), with_inner)
        found.append((hashes, first + begin, last + begin, inner))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _keys(text: bytes, firsts: np.ndarray, lasts: np.ndarray, length: int) -> np.ndarray:
    """A hash of each snippet."""
    cuts = map(slice, firsts.tolist(), (lasts + length).tolist())
    found = map(xxhash.xxh3_64_intdigest, map(text.__getitem__, cuts))
    return np.fromiter(found, np.uint64, len(firsts))


# Columns of a record of a snippet: short anchor, snippet's key, id of its document and its start there.
_SNIPPET = ("<u4", "<u8", "<i8", "<i8")
# What a document's block is told of a key: the key, the document and start where it stands first, and
# whether its anchor has others.
_FOUND = ("<u8", "<i8", "<i8", "?")
#: A prime, and a factor that spreads ids; their products are below 2 ** 63.
_PRIME, _FACTOR = (1 << 31) - 1, 1_583_458_089


def _block(doc: np.ndarray, blocks: int) -> np.ndarray:
    """The block of a document; _block_of is the same for a column."""
    return (doc % _PRIME * _FACTOR % _PRIME % blocks).astype(np.int32)


def _packed(columns: Sequence[np.ndarray]) -> bytes:
    """Columns one after the other, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def _unpacked(blob: bytes, kinds: Sequence[str]) -> list[np.ndarray]:
    import zstandard

    body = zstandard.ZstdDecompressor().decompress(blob)
    sizes = [np.dtype(kind).itemsize for kind in kinds]
    n, at, columns = len(body) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        columns.append(np.frombuffer(body, kind, n, at))
        at += n * size
    return columns


def _joined(tables: Sequence[Sequence[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(columns) for columns in zip(*tables, strict=True)]


def _by_value(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in ascending order of values, and how many have each value."""
    order = np.argsort(values)
    values = values[order]
    edges = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, len(values))
    return order, np.diff(edges, prepend=0)


def _at_most_two(key: np.ndarray, doc: np.ndarray, start: np.ndarray, blocks: int) -> np.ndarray:
    """Which records are among the first two, by document and start, of their key and block."""
    kept = np.ones(len(key), bool)
    order, counts = _by_value(key)
    rows = order[np.repeat(counts > 2, counts)]
    block = _block(doc[rows], blocks)
    order = np.lexsort([start[rows], doc[rows], block, key[rows]])
    rows, block = rows[order], block[order]
    same = (key[rows[1:]] == key[rows[:-1]]) & (block[1:] == block[:-1])
    kept[rows[2:][same[1:] & same[:-1]]] = False
    return kept


def _few(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[tuple]]:
    """Rows of batches, a few at a time as Python values: a batch may hold long texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            yield list(zip(*[part[n].to_pylist() for n in names], strict=True))


def _cells(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    for rows in _few(iter([batch]), *names):
        yield from rows


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a column packed: their text compressed, if it is long, and then no text."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = batch["text"]
        long = pc.greater_equal(pc.binary_length(texts), _LONG_TEXT)
        packed = [compress(t.as_buffer()) if big else None
                  for t, big in zip(texts, long.to_pylist(), strict=True)]
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        columns["text"] = pc.if_else(long, pa.scalar(None, texts.type), texts)
        columns["packed"] = pa.array(packed, pa.binary())
        yield pa.RecordBatch.from_pydict(columns)


def _whole_texts(parts: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
    """Rows that end with text and packed, with the text alone in place of both."""
    import zstandard

    whole = zstandard.ZstdDecompressor().decompress
    for rows in parts:
        yield [(*row, text if packed is None else whole(packed)) for *row, text, packed in rows]


_BLOB = pa.schema([("place", pa.int32()), ("blob", pa.binary())])
#: Bytes of records that a task holds before it merges equal ones.
_HELD = 16 << 20
_SNIPPET_BYTES = 28


def _find_snippets(buckets: int, blocks: int, length: int):
    """Records of all snippets by bucket of the anchor; equal ones of a block once per task's share."""

    few = np.min_scalar_type(buckets)  # small whole numbers are sorted by digits

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        hashes, key, doc, start = _joined(held)
        # equal snippets of one block are told the same later: the first one stands for them, with
        # a second record where there are more, so that a repeat is still seen as one
        kept = np.flatnonzero(_at_most_two(key, doc, start, blocks))
        # upper bits tell anchors of a bucket apart, lower ones choose the bucket
        bucket = ((hashes[kept] & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(few)
        order = np.argsort(bucket, kind="stable")
        kept = kept[order]
        table = (hashes >> np.uint64(32)).astype("<u4")[kept], key[kept], doc[kept], start[kept]
        cuts = np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))
        filled = np.flatnonzero(np.diff(cuts))
        blobs = [_packed([c[cuts[b] : cuts[b + 1]] for c in table]) for b in filled]
        yield record_batch(_BLOB, place=filled.astype(np.int32), blob=blobs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows in _few(batches, "doc", "text"):
            found = snippets([text for _, text in rows], length, with_inner=False)
            for (doc, text), (hashes, firsts, lasts, _) in zip(rows, found, strict=True):
                if not len(hashes):
                    continue
                keys = _keys(text, firsts, lasts, length)
                held.append((hashes, keys, np.full(len(keys), doc, np.int64), firsts))
                size += len(keys) * _SNIPPET_BYTES
                if size > _HELD:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return find


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[bytes]]]:
    """Place and blobs, as they come, of rows that are sorted by place."""
    rows = (row for part in _few(batches, "place", "blob") for row in part)
    return ((place, (blob for _, blob in own)) for place, own in groupby(rows, itemgetter(0)))


def _tell_repeats(blocks: int):
    """For each bucket the keys that stand several times or share their anchor, told to each block
    that holds them."""

    def merged(tables: list[list[np.ndarray]]) -> list[np.ndarray]:
        """Two records at most of a key and block: more say nothing new."""
        table = _joined(tables)
        kept = _at_most_two(*table[1:], blocks)
        return [column[kept] for column in table]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _groups(batches):
            tables, size = [], 0
            for blob in blobs:
                tables.append(_unpacked(blob, _SNIPPET))
                size += len(tables[-1][0]) * _SNIPPET_BYTES
                if size > 4 * _HELD:
                    tables = [merged(tables)]
                    size = len(tables[0][0]) * _SNIPPET_BYTES // 2
            anchor, key, doc, start = merged(tables)
            rows, counts = _by_value(key)
            repeated = counts > 1
            firsts = rows[np.cumsum(counts) - counts]
            again = rows[np.repeat(repeated, counts)]
            again = again[np.lexsort([start[again], doc[again], key[again]])]
            firsts[repeated] = again[np.cumsum(counts[repeated]) - counts[repeated]]
            order, sharing = _by_value(anchor[firsts])
            several = np.empty(len(firsts), bool)
            several[order] = np.repeat(sharing > 1, sharing)
            wanted = np.flatnonzero(repeated | several)
            if not len(wanted):
                continue
            which = np.full(len(firsts), -1)
            which[wanted] = np.arange(len(wanted))
            which = np.repeat(which, counts)
            rows, which = rows[which >= 0], which[which >= 0]
            pairs = np.unique(_block(doc[rows], blocks) * np.int64(len(wanted)) + which)
            block, which = np.divmod(pairs, len(wanted))
            own = wanted[which]
            found = [column[firsts[own]] for column in (key, doc, start)] + [several[own]]
            cuts = np.searchsorted(block, np.arange(blocks + 1))
            filled = np.flatnonzero(np.diff(cuts))
            yield record_batch(
                _BLOB, place=filled.astype(np.int32),
                blob=[_packed([c[cuts[b] : cuts[b + 1]] for c in found]) for b in filled],
            )

    return tell


def _standing(
    known: Sequence[np.ndarray], keys: np.ndarray, doc: int, starts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Which snippets of a document are copies of an earlier one, and which are the first of theirs
    while their anchor has several."""
    key, docs, firsts, several = known
    if not len(key):
        return np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    at, hit = _among(key, keys)
    first = (docs[at] == doc) & (firsts[at] == starts)
    return hit & ~first, hit & first & several[at]


_RUN = np.dtype([("first", "<i8"), ("last", "<i8")])
_MARKED = pa.schema([
    ("shard", pa.int32()), ("doc", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()),
    ("anchor", pa.int64()), ("body", pa.binary()),
])
_MARKED_DDL = "shard int, doc long, text_hash long, start long, anchor long, body binary"


def _mark_copies(shards: int, length: int):
    """Rows of a block: first what it is told (doc null), then its documents.

    Gives runs of string starts that are copies of an earlier snippet (shard null), and the first of
    each snippet whose anchor has several (shard set, body the snippet).
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, told, known = None, [], None
        names = ("place", "blob", "doc", "text_hash", "text", "packed")
        for part in _whole_texts(_few(batches, *names)):
            rows = {f.name: [] for f in _MARKED}

            def add(*values, rows=rows):
                for name, value in zip(rows, values, strict=True):
                    rows[name].append(value)

            found = snippets([text or b"" for *_, text in part], length)
            for (place, blob, doc, text_hash, text), snippets_ in zip(part, found, strict=True):
                if place != block:
                    block, told, known = place, [], None
                if blob is not None:
                    told.append(_unpacked(blob, _FOUND))
                    continue
                if known is None:
                    known = _joined([[np.zeros(0, kind) for kind in _FOUND], *told])
                    order = np.argsort(known[0])
                    known = [column[order] for column in known]
                hashes, firsts, lasts, inner = snippets_
                if not len(hashes):
                    continue
                keys = _keys(text, firsts, lasts, length)
                copies, several = _standing(known, keys, doc, firsts)
                several |= inner & ~copies  # a string may stand twice within the snippet
                if copies.any():
                    runs = np.zeros(int(copies.sum()), _RUN)
                    runs["first"], runs["last"] = firsts[copies], lasts[copies]
                    add(None, doc, text_hash, None, None, runs.tobytes())
                for i in np.flatnonzero(several).tolist():
                    a, b = int(firsts[i]), int(lasts[i]) + length
                    anchor = int(hashes[i])
                    add(anchor % shards, doc, text_hash, a,
                        anchor - (1 << 64) if anchor >> 63 else anchor, text[a:b])
            if rows["doc"]:
                yield record_batch(_MARKED, **rows)

    return mark


_RUNS = pa.schema([("doc", pa.int64()), ("text_hash", pa.int64()), ("body", pa.binary())])


def repeated_starts(
    bodies: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int = LENGTH
) -> list[np.ndarray]:
    """For each snippet the offsets of its strings that start earlier in another place.

    bodies are distinct. The suffix array of all of them is induced; suffixes that share length bytes
    with the one before form a group, of which the one least by document and start stays.
    """
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    joined = np.frombuffer(b"\0".join(bodies), np.uint8).astype(np.int32) + 1
    begins = np.cumsum(sizes + 1) - sizes - 1
    joined[begins[1:] - 1] = 0
    array = suffix_array(joined)
    shared = permuted_prefixes(joined, array)
    heads = shared[array] < length
    heads[0] = True
    group = np.cumsum(heads)
    owner = np.repeat(np.arange(len(bodies)), sizes + 1)[:-1]
    offset = np.arange(len(joined)) - begins[owner]
    whole = (offset[array] + length <= sizes[owner[array]])
    array, group = array[whole], group[whole]
    twice = np.zeros(len(array), bool)
    twice[1:] = group[1:] == group[:-1]
    twice[:-1] |= twice[1:]
    array, group = array[twice], group[twice]
    own, at = owner[array], offset[array]
    position = starts[own] + at
    order = np.lexsort([position, docs[own], group])
    group, own, at, position = group[order], own[order], at[order], position[order]
    lead = np.ones(len(group), bool)
    lead[1:] = group[1:] != group[:-1]
    leader = np.maximum.accumulate(np.where(lead, np.arange(len(group)), 0))
    later = (docs[own] != docs[own[leader]]) | (position != position[leader])
    own, at = own[later], at[later]
    order = np.lexsort([at, own])
    cuts = np.searchsorted(own[order], np.arange(1, len(bodies)))
    return np.split(at[order], cuts)


def _sort_shards(length: int):
    """Rows sorted by shard and anchor; gives the starts of strings that stand earlier."""

    def solve(rows: dict) -> pa.RecordBatch | None:
        docs, starts = np.array(rows["doc"], np.int64), np.array(rows["start"], np.int64)
        found = repeated_starts(rows["body"], docs, starts, length)
        out = {f.name: [] for f in _RUNS}
        for i, at in enumerate(found):
            if len(at):
                cuts = np.flatnonzero(np.diff(at) > 1) + 1
                runs = np.zeros(len(cuts) + 1, _RUN)
                runs["first"] = starts[i] + at[np.concatenate([[0], cuts])]
                runs["last"] = starts[i] + at[np.append(cuts - 1, len(at) - 1)]
                out["doc"].append(rows["doc"][i])
                out["text_hash"].append(rows["text_hash"][i])
                out["body"].append(runs.tobytes())
        return record_batch(_RUNS, **out) if out["doc"] else None

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An array takes whole groups of anchors, as many as come to a shard's size."""
        names = ("doc", "text_hash", "start", "anchor", "body")
        held, size = {n: [] for n in names}, 0
        for batch in batches:
            for row in _cells(batch, *names):
                if size > _SHARD_BYTES and row[3] != held["anchor"][-1]:
                    found = solve(held)
                    if found is not None:
                        yield found
                    held, size = {n: [] for n in names}, 0
                for name, value in zip(names, row, strict=True):
                    held[name].append(value)
                size += len(row[4])
        if size:
            found = solve(held)
            if found is not None:
                yield found

    return sort


def _covered(size: int, runs: list[bytes], length: int) -> np.ndarray:
    """Whether each byte lies in a string that starts in one of the runs."""
    edges = np.zeros(size + 1, np.int64)
    for blob in runs:
        table = np.frombuffer(blob, _RUN)
        np.add.at(edges, table["first"], 1)
        np.add.at(edges, table["last"] + length, -1)
    return np.cumsum(edges[:-1]) > 0


def _rows(docs: DataFrame, id_column: str, text_column: str, *more: str) -> DataFrame:
    """doc orders documents: null ids last. text_hash tells texts of one id apart."""
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    known = F.col(id_column).cast("long")
    return docs.select(
        *more,
        F.coalesce(known, F.lit((1 << 63) - 1)).alias("doc"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
    )


def _split_strings(length: int):
    """Every string of the snippets, with its place."""
    schema = pa.schema([("string", pa.binary()), ("doc", pa.int64()), ("text_hash", pa.int64()),
                        ("start", pa.int64())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text_hash, start, body in _cells(batch, "doc", "text_hash", "start", "body"):
                n = len(body) - length + 1
                yield record_batch(
                    schema, string=[body[i : i + length] for i in range(n)], doc=[doc] * n,
                    text_hash=[text_hash] * n, start=list(range(start, start + n)),
                )

    return split


def _large_anchors(snippets_: DataFrame, length: int) -> DataFrame:
    """doc, text_hash and body for anchors with more snippets than an array should hold.

    Their strings are grouped one by one: the earliest place is aggregated before the shuffle, and
    the places join it again, so no task needs all strings of an anchor.
    """
    strings = snippets_.mapInArrow(
        _split_strings(length), "string binary, doc long, text_hash long, start long"
    )
    place = F.struct("doc", "start")
    first = strings.groupBy("string").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    later = strings.join(first.where("first != last"), "string").where(place != F.col("first"))
    packed = _run_body(F.col("start"), F.col("start"))
    return later.select("doc", "text_hash", packed.alias("body"))


def _run_body(first: Column, last: Column) -> Column:
    @F.pandas_udf("binary")
    def body(firsts, lasts):
        table = np.zeros(len(firsts), _RUN)
        table["first"], table["last"] = firsts.to_numpy(), lasts.to_numpy()
        return type(firsts)([row.tobytes() for row in table])

    return body(first, last)


def repeated_runs(
    docs: DataFrame,
    length: int = LENGTH,
    id_column: str = "doc_id",
    text_column: str = "text",
    large: int = LARGE_ANCHOR,
) -> DataFrame:
    """doc, text_hash and body: packed runs of starts of strings that start earlier as well."""
    rows = _rows(docs, id_column, text_column)
    volume = text_bytes(docs, text_column)
    blocks = parts_for(volume, _BLOCK_BYTES)
    buckets = parts_for(volume, _BUCKET_BYTES)
    shards = parts_for(volume, 8 * _SHARD_BYTES)
    found = rows.select("doc", "text").mapInArrow(
        _find_snippets(buckets, blocks, length), "place int, blob binary"
    )
    told = found.repartitionById(buckets, "place").sortWithinPartitions("place").mapInArrow(
        _tell_repeats(blocks), "place int, blob binary"
    )
    meeting = _meet(told.select("place", "blob"), rows, blocks)
    marked = stored(
        meeting.mapInArrow(_mark_copies(shards, length), _MARKED_DDL), drop_shuffles=True
    )
    copies = marked.where("shard is null").select("doc", "text_hash", "body")
    several = marked.where("shard is not null")
    runs = copies
    sizes = several.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large)
    sizes = stored(sizes, drop_shuffles=True)
    if not sizes.isEmpty():
        over = several.join(sizes, "anchor", "left_semi").select("doc", "text_hash", "start", "body")
        runs = runs.unionByName(_large_anchors(over, length))
        several = several.join(sizes, "anchor", "left_anti")
    ordered = several.repartitionById(shards, "shard").sortWithinPartitions(
        "shard", "anchor", "doc", "start"
    )
    arrays = ordered.select("doc", "text_hash", "start", "anchor", "body").mapInArrow(
        _sort_shards(length), "doc long, text_hash long, body binary"
    )
    return stored(runs.unionByName(arrays), drop_shuffles=True)


def _block_of(doc: Column, blocks: int) -> Column:
    spread = F.pmod(doc, F.lit(_PRIME)) * F.lit(_FACTOR)
    return F.pmod(F.pmod(spread, F.lit(_PRIME)), F.lit(blocks)).cast("int")


def _meet(notes: DataFrame, rows: DataFrame, blocks: int) -> DataFrame:
    """Notes (by place, the block) and documents in one partition for each block, notes first.

    The texts are most of what moves; long ones come as packed, see _pack_texts.
    """
    placed = rows.withColumn("place", _block_of(F.col("doc"), blocks))
    kinds = [T.StructField(f.name, f.dataType) for f in placed.schema]
    placed = placed.mapInArrow(
        _pack_texts, T.StructType([*kinds, T.StructField("packed", T.BinaryType())])
    )
    both = notes.unionByName(placed, allowMissingColumns=True).repartitionById(blocks, "place")
    return both.sortWithinPartitions("place", F.col("blob").isNull())


def _cut(length: int, schema: pa.Schema):
    """Documents without the bytes that the notes of their block cover."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, notes = None, {}
        for batch in batches:
            taken, out = [], {f.name: [] for f in schema if f.name != "row"}
            names = ("place", "blob", "doc", "text_hash", "text", "packed")
            rows = (row for part in _whole_texts(_few(iter([batch]), *names)) for row in part)
            for i, (place, blob, doc, text_hash, text) in enumerate(rows):
                if place != block:
                    block, notes = place, {}
                if blob is not None:
                    notes.setdefault((doc, text_hash), []).append(blob)
                    continue
                size, removed, spans = len(text), 0, 0
                runs = notes.get((doc, text_hash))
                if runs:
                    gone = _covered(size, runs, length)
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    text = np.frombuffer(text, np.uint8)[~gone].tobytes()
                taken.append(i)
                for name, value in zip(out, (size, removed, spans, text), strict=True):
                    out[name].append(value)
            if taken:
                yield record_batch(schema, row=batch["row"].take(pa.array(taken)), **out)

    return cut


def remove_repeats(
    docs: DataFrame,
    keep: Sequence[str] = (),
    length: int = LENGTH,
    id_column: str = "doc_id",
    text_column: str = "text",
    large: int = LARGE_ANCHOR,
) -> DataFrame:
    """row (a struct of the columns in keep), n_bytes, n_removed, n_spans and kept, the bytes left,
    of every row.

    A byte is removed if a string of length bytes covers it that also starts earlier: in a document
    with a smaller id, or in the same one. Strings are those of the input and lie within one text,
    whatever else is removed; spans are the maximal runs of removed bytes. Null texts are empty. Null
    ids come after all others. Rows of one id are one document here: of two places in them the one
    further from the start of its text is later, and equal places remove nothing, so a repeated row
    has the same result each time. Texts shorter than length lose nothing. An empty table gives no
    rows.
    """
    runs = repeated_runs(docs, length, id_column, text_column, large)
    blocks = parts_for(text_bytes(docs, text_column), _BLOCK_BYTES)
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    rows = _rows(docs.select(row.alias("row"), F.col(id_column), F.col(text_column)),
                 id_column, text_column, "row")
    notes = runs.select(
        _block_of(F.col("doc"), blocks).alias("place"), F.col("body").alias("blob"), "doc", "text_hash"
    )
    kind = rows.schema["row"].dataType
    out = T.StructType([
        T.StructField("row", kind), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("kept", T.BinaryType()),
    ])
    return _meet(notes, rows, blocks).mapInArrow(_cut(length, to_arrow_schema(out)), out)


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; see remove_repeats."""
    return remove_repeats(docs, ["doc_id"], length).select(
        "row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def drop_repeats(
    docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The documents with repeats removed from their texts, with all their columns.

    Documents that lose every byte go; empty ones stay. Bytes of a character that a cut has split go
    too. A column n_chars follows the new text.
    """
    # the text itself comes back as kept, so beside it only whether it is null has to move
    null = max(docs.columns, key=len) + "_"
    others = [c for c in docs.columns if c != text_column]
    flagged = docs.withColumn(null, F.col(f"`{text_column}`").isNull())
    cut = remove_repeats(flagged, [*others, null], length, id_column, text_column)
    kept = cut.where((F.col("n_removed") == 0) | (F.length("kept") > 0))
    same = F.col("kept").cast(docs.schema[text_column].dataType)
    changed = F.when(F.col("n_removed") > 0, _whole_characters(F.col("kept"))).otherwise(
        F.when(~F.col(f"row.`{null}`"), same)
    )
    columns = {c: changed if c == text_column else F.col(f"row.`{c}`") for c in docs.columns}
    if "n_chars" in columns:
        length_of = F.length(changed).cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_removed") > 0, length_of).otherwise(columns["n_chars"])
    return kept.select(*[value.alias(name) for name, value in columns.items()])


def _whole_characters(body: Column) -> Column:
    @F.pandas_udf("string")
    def decode(bodies):
        return bodies.map(lambda b: b.decode("utf-8", "ignore"), na_action="ignore")

    return decode(body)
