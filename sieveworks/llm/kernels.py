"""Vectorised word hashing over Arrow text columns.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII bytes of the lower-cased text. Words are
hashed where they lie, in slices of bounded size that end between words, so that memory follows the number of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once.
SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def buffers(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.utf8_lower(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _hash_slice(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of data; breaks: positions at which a word ends in any case."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _WORD[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = breaks[(breaks > 0) & (breaks < len(data))]
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    if len(cuts):
        cuts = np.unique(cuts)
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    up, down = _power_tables(max(SLICE, len(data) + 1))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: pa.Array, spans: bool = False):
    """(hashes, offsets): the word hashes of all texts in a row, and where each text's begin; with spans also the words' byte positions in their own text."""
    data, offsets = buffers(texts)
    starts, hashes, ends, at = [], [], [], 0
    while at < len(data):
        to = min(len(data), at + SLICE)
        if to < len(data):  # back to the last byte outside words, else on to the next
            gaps = np.flatnonzero(~_WORD[data[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:
                more = to
                while more < len(data) and _WORD[data[more]]:
                    more += 1
                to = more
        own = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, side="right")] - at
        s, e, h = _hash_slice(data[at:to], own)
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(h)
        at = to
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    bounds = np.searchsorted(starts, offsets)
    if not spans:
        return hashes, bounds
    ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    base = np.repeat(offsets[:-1], np.diff(bounds))
    return hashes, bounds, starts - base, ends - base


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each position on; the last n-1 positions are left out."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + m]
    return mix(out)


def text_ngrams(hashes: np.ndarray, bounds: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram hashes, number of their text, word position in it) of all texts; short: a text of 1 to n-1 words counts as one n-gram."""
    grams = ngrams(hashes, n)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    where = np.arange(len(hashes)) - np.repeat(bounds[:-1], sizes)
    fits = where[: len(grams)] + n <= sizes[owner[: len(grams)]]
    grams, own, pos = grams[fits], owner[: len(fits)][fits], where[: len(fits)][fits]
    if short and (few := np.flatnonzero((sizes > 0) & (sizes < n))).size:
        extra = np.array([mix(np.array([int(sum((int(h) * (0x9E37 + 2 * i) for i, h in enumerate(hashes[bounds[d] : bounds[d + 1]])), 77) & (2**64 - 1))], np.uint64))[0] for d in few], np.uint64)
        grams, own, pos = np.concatenate([grams, extra]), np.concatenate([own, few]), np.concatenate([pos, np.zeros(len(few), np.int64)])
        order = np.argsort(own, kind="stable")
        grams, own, pos = grams[order], own[order], pos[order]
    return grams, own, pos
