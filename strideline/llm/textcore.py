"""Vectorised text primitives over Arrow string buffers.

Everything here works on the raw UTF-8 bytes of a whole record batch at once, so
the cost is a few numpy passes per byte and no Python object is made per word.
Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z count as a-z.

Temporary arrays are about 100 bytes for each byte of text, so bytes are hashed in
pieces of ``SLICE_BYTES`` that end between words, however long a text is; what is kept
of a text after that is a few dozen bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text handled at a time; bounds the temporary arrays to a few dozen MB.
SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _byte_table(seed: int) -> np.ndarray:
    """Random 64-bit value of each byte, the same for A-Z and a-z."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN + np.uint64(seed))[_FOLD]


@lru_cache(maxsize=1)
def _kept_powers() -> np.ndarray:
    return _make_powers(SLICE_BYTES + 1)


def _make_powers(n: int) -> np.ndarray:
    base = 0x5851F42D4C957F2D
    out = np.ones((2, n), np.uint64)
    for row, b in zip(out, (base, pow(base, -1, 2**64)), strict=True):
        row[1:] = b
        np.multiply.accumulate(row, out=row)
    return out


def _powers(n: int) -> np.ndarray:
    """Rows: powers of the hash base and of its inverse modulo 2**64. Only those of one slice are kept; a word longer than that has its own."""
    return _kept_powers() if n <= SLICE_BYTES else _make_powers(n + 1)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null reads as an empty text."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes together, one at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _cuts(buf: np.ndarray, limit: int) -> list[int]:
    """Ends of pieces of about ``limit`` bytes, each before a blank or at the end."""
    out, at = [], 0
    while len(buf) - at > limit:
        at += limit
        while at < len(buf):
            blank = np.flatnonzero(_SPACE[buf[at : at + limit]])
            if len(blank):
                at += int(blank[0])
                break
            at = min(at + limit, len(buf))
        out.append(at)
    return [c for c in out if c < len(buf)] + [len(buf)]


def word_hashes(buf: np.ndarray, offsets: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word in text order and the words' n + 1 offsets by document."""
    if len(buf) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    heads = offsets[1:-1]
    heads = heads[(heads > 0) & (heads < len(buf))]
    words, starts, at = [], [], 0
    for end in _cuts(buf, SLICE_BYTES):
        inside = heads[(heads > at) & (heads < end)] - at
        found, begin = _piece_hashes(buf[at:end], inside, seed)
        words.append(found)
        starts.append(begin + at)
        at = end
    return np.concatenate(words), np.searchsorted(np.concatenate(starts), offsets)


def _piece_hashes(buf: np.ndarray, heads: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of some bytes; a word also ends before each of ``heads``.

    A word's hash is a difference of two prefix sums of ``table[byte] * base**index``
    shifted back by the inverse power, so no per-word work is needed.
    """
    inside = np.zeros(len(buf) + 1, dtype=bool)
    inside[:-1] = ~_SPACE[buf]
    start = inside[:-1].copy()
    start[1:] &= ~inside[:-2]
    stop = ~inside[1:]
    start[heads] = inside[heads]
    stop[heads - 1] = True
    stop &= inside[:-1]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    power, inverse = _powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_byte_table(seed)[buf] * power[: len(buf)], out=total[1:])
    return mix64((total[stops] - total[starts]) * inverse[starts] + (stops - starts).astype(np.uint64) * GOLDEN), starts


def content_keys(words: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes (n, 2) of each document's word sequence; 0, 0 if it has no word."""
    n = len(word_at) - 1
    out = np.zeros((n, 2), np.uint64)
    some = np.flatnonzero(np.diff(word_at) > 0)
    if len(some) == 0:
        return out
    starts = word_at[:-1][some]
    place = (np.arange(len(words)) - np.repeat(starts, np.diff(word_at)[some])).astype(np.uint64)
    for k, salt in enumerate((0x2545F4914F6CDD1D, 0x27D4EB2F165667C5)):
        salted = mix64(words + place * GOLDEN + np.uint64(salt)) * (place * np.uint64(2) + np.uint64(1))
        out[some, k] = mix64(np.add.reduceat(salted, starts) + np.diff(word_at)[some].astype(np.uint64))
    return out


def shingles(words: np.ndarray, word_at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words in text order, and offsets by document. A document of fewer words has one shingle of all its words, one without words has none."""
    sizes = np.diff(word_at)
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(sizes)), counts)
    start = word_at[:-1][doc] + (np.arange(at[-1]) - at[:-1][doc])
    room = (word_at[1:][doc] - start) if len(doc) else np.zeros(0, np.int64)
    out = np.zeros(at[-1], np.uint64)
    salts = np.arange(1, k + 1, dtype=np.uint64) * GOLDEN
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        part = mix64(padded[start + j] + salts[j])
        part[room <= j] = 0
        out = (out ^ part) * MIX_B + np.uint64(j)
    return mix64(out), at


def occurrence_labels(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each value mixed with how often it came before in its document, so that labels of a document are distinct."""
    if len(values) == 0:
        return values
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    key = values ^ mix64(doc + GOLDEN)
    order = np.argsort(key, kind="stable")
    run = key[order]
    new = np.ones(len(run), dtype=bool)
    new[1:] = run[1:] != run[:-1]
    begin = np.flatnonzero(new)
    nth = np.arange(len(run)) - begin[np.cumsum(new) - 1]
    seen = np.zeros(len(values), np.uint64)
    seen[order] = nth.astype(np.uint64)
    return mix64(values + seen * GOLDEN)
