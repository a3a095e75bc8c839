"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than the next one. Leftmost S suffixes (LMS)
cut the text; their substrings are sorted by one round of induction and named, the text of names is
sorted where names repeat, by induction again or, with many names, by doubled prefixes, and a last
round induces the order of all suffixes.
"""

from __future__ import annotations

import numpy as np

from martwright.llm.common import ranges

#: Symbols that are compared at a time.
_COMPARED = 1 << 16
#: Up to this many symbols buckets are induced in array steps; above, a text (of names, as a rule) has
#: so many small buckets that doubled prefixes sort it in less time.
_ARRAY_SYMBOLS = 1024


def _classes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the next, and where leftmost smaller ones start.

    A run of equal symbols is of the class of its end; the last suffix is larger than the empty one.
    """
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    ends = np.append(differs, n - 1)  # last place of each run
    rising = np.append(text[differs] < text[differs + 1], False)
    smaller = np.repeat(rising, np.diff(ends, prepend=-1))
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    return smaller, leftmost


def _with_runs(block: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places of a bucket, then those before them in their runs of its symbol, nearest ones first."""
    steps = left[block]
    if not steps.any():
        return block
    own = np.repeat(np.arange(len(block)), steps + 1)
    back = ranges(np.zeros(len(block), np.int64), steps + 1)
    order = np.argsort(back, kind="stable")
    return (block[own] - back)[order]


def _induce(text, smaller, starts, first, size):
    """All suffixes sorted, given the leftmost smaller ones in order; starts: of each bucket."""
    n = len(text)
    place = np.arange(n)
    changes = np.append(True, text[1:] != text[:-1])
    left = place - np.maximum.accumulate(np.where(changes, place, 0))  # equal symbols before a place
    text = text.astype(np.uint16)  # sorted by digits
    larger = ~smaller
    kinds = np.bincount(text[larger], minlength=size)  # a bucket holds its larger suffixes first
    array = np.full(n, -1, np.int32)
    heads = starts[:-1].copy()

    def put(places: np.ndarray, at: np.ndarray, step: int) -> None:
        """Places into their buckets in this order, from at on, upwards or downwards."""
        symbols = text[places]
        order = np.argsort(symbols, kind="stable")
        ordered = symbols[order]
        counts = np.bincount(ordered, minlength=size)
        nth = np.arange(len(ordered)) - np.repeat(np.cumsum(counts) - counts, counts)
        array[at[ordered] + step * nth] = places[order]
        at += step * counts

    seeds = np.split(first, np.searchsorted(text[first], np.arange(1, size)))
    put(np.array([n - 1]), heads, 1)
    for symbol in np.flatnonzero(np.diff(starts)):
        block = array[starts[symbol] : heads[symbol]]  # larger suffixes of the bucket
        if len(block):
            block = _with_runs(block, left)
            array[starts[symbol] : starts[symbol] + len(block)] = block
            before = block[left[block] == 0] - 1  # of another symbol, or before the text
            before = before[before >= 0]
            put(before[larger[before]], heads, 1)
        before = seeds[symbol] - 1
        put(before[larger[before]], heads, 1)
    tails = starts[1:] - 1
    tails = tails.copy()
    for symbol in np.flatnonzero(np.diff(starts))[::-1]:
        block = array[tails[symbol] + 1 : starts[symbol + 1]][::-1]
        if len(block):
            block = _with_runs(block, left)
            array[starts[symbol + 1] - len(block) : starts[symbol + 1]] = block[::-1]
            before = block[left[block] == 0] - 1
            before = before[before >= 0]
            put(before[smaller[before]], tails, -1)
        block = array[starts[symbol] : starts[symbol] + kinds[symbol]][::-1]
        before = block[block > 0] - 1
        put(before[smaller[before]], tails, -1)
    return array


def _by_doubling(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefixes of doubled length.

    A suffix's rank is the first row of those that share its prefix. Only rows that share one are
    sorted again, each by its rank and that of the suffix a prefix further on.
    """
    n = len(text)
    array = np.argsort(text, kind="stable")
    keys, rows, step = text[array].astype(np.int64), np.arange(n), 0
    rank = np.empty(n, np.int64)
    while True:
        heads = np.append(True, keys[1:] != keys[:-1])
        rank[array[rows]] = rows[np.maximum.accumulate(np.where(heads, np.arange(len(rows)), 0))]
        alone = heads & np.append(heads[1:], True)
        rows = rows[~alone]
        if not len(rows):
            return array
        step = 2 * step or 1
        own = array[rows]
        further = np.where(own + step < n, rank[np.minimum(own + step, n - 1)] + 1, 0)
        keys = rank[own] * (n + 1) + further
        order = np.argsort(keys)
        array[rows], keys = own[order], keys[order]


def _names(text, leftmost, ordered):
    """A number for each leftmost substring, in order, equal ones alike; and how many there are."""
    n, m = len(text), len(leftmost)
    ends = np.append(leftmost[1:], n - 1)  # a substring goes to the next one's first symbol
    lengths = ends - leftmost + 1
    which = np.empty(n, np.int64)
    which[leftmost] = np.arange(m)
    order = which[ordered]
    a, b = order[:-1], order[1:]
    same = lengths[a] == lengths[b]
    same &= (a != m - 1) & (b != m - 1)  # the last one ends with the text
    rows = np.flatnonzero(same)
    step = 0
    while len(rows):
        rows = rows[lengths[a[rows]] > step]
        width = max(1, _COMPARED // max(1, len(rows)))
        reach = np.arange(step, step + width)
        inside = reach < lengths[a[rows], None]
        first, second = (np.where(inside, leftmost[x[rows], None] + reach, 0) for x in (a, b))
        equal = (text[first] == text[second]).all(axis=1)
        same[rows[~equal]] = False
        rows = rows[equal]
        step += width
    names = np.empty(m, np.int64)
    names[order] = np.cumsum(np.append(0, ~same))
    return names, int(m - same.sum())


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a text of whole numbers from 0, in order."""
    text = np.asarray(text)
    n = len(text)
    if n < 2:
        return np.arange(n)
    size = int(text.max()) + 1
    if size > _ARRAY_SYMBOLS:
        return _by_doubling(text)
    smaller, leftmost = _classes(text)
    starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
    if len(leftmost) < 2:
        return _induce(text, smaller, starts, leftmost, size)
    by_symbol = leftmost[np.argsort(text[leftmost], kind="stable")]
    rough = _induce(text, smaller, starts, by_symbol, size)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    ordered = rough[is_leftmost[rough]]
    names, kinds = _names(text, leftmost, ordered)
    if kinds < len(leftmost):
        ordered = leftmost[suffix_array(names)]
    return _induce(text, smaller, starts, ordered, size)


def permuted_prefixes(text: np.ndarray, array: np.ndarray, separator: int = 0) -> np.ndarray:
    """For each place the symbols that its suffix shares with the one before it in the array.

    Separators end a suffix: they equal nothing. Where the neighbours of two places in a row stand in
    a row too, the shared length falls by exactly one. Only the other places are compared, symbol by
    symbol for all of them at once; their lengths come to n log n at most.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (before[:-1] >= 0) & (before[1:] == before[:-1] + 1)
    follows[1:] &= text[:-1] != separator
    at = np.flatnonzero(follows)
    follows[at] = text[at - 1] == text[before[at] - 1]
    shared = np.zeros(n, np.int64)
    rows, step = np.flatnonzero(~follows & (before >= 0)), 0
    while len(rows):
        width = max(1, _COMPARED // len(rows))
        reach = np.arange(step, step + width)
        one, other = rows[:, None] + reach, before[rows, None] + reach
        inside = np.maximum(one, other) < n
        one, other = np.where(inside, one, 0), np.where(inside, other, 0)
        symbols = text[one]
        equal = inside & (symbols == text[other]) & (symbols != separator)
        whole = equal.all(axis=1)
        shared[rows] = step + np.where(whole, width, equal.argmin(axis=1))
        rows = rows[whole]
        step += width
    place = np.arange(n)
    root = np.maximum.accumulate(np.where(follows, 0, place))
    return shared[root] - (place - root)
