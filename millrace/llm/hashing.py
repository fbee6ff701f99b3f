"""Vectorised word and shingle hashes over whole Arrow string columns.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text with A-Z lower-cased. Its hash is a polynomial over a random table of
bytes modulo 2**64, taken as the difference of two prefix sums, then mixed; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

K = 5
PIECE = 1 << 18
_U = np.uint64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    table = np.random.default_rng(20240501).integers(0, 2**64, 256, dtype=np.uint64)
    table[65:91] = table[97:123]
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return table, space


TABLE, SPACE = _tables()
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def __reduce__(self):
        return type(self), ()  # travels empty

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = powers(BASE, n), powers(BASE_INVERSE, n)
        return self.up, self.down


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _bounds(data: np.ndarray, breaks: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; breaks are positions at which a word ends whatever stands there."""
    word = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    if len(data):
        edge[0], edge[-1] = word[0], word[-1]
    inner = np.unique(breaks[(breaks > 0) & (breaks < len(data))])
    inner = inner[word[inner] & word[inner - 1]]  # a word would go over the break
    at = np.flatnonzero(edge)
    if len(inner):
        at = np.sort(np.concatenate([at, inner, inner]), kind="stable")
    return at[0::2], at[1::2]


def word_hashes(text: pa.Array, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column in order, and where each row's words begin (one more than rows). Null is empty.
    ``space`` marks the bytes between words; ASCII space must be one."""
    text = pc.fill_null(text.cast(pa.large_binary()), b"")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):  # cut at a space, or at the start of a row
            gap = np.flatnonzero(space[data[at:end]])
            row = offsets[np.searchsorted(offsets, end, "right") - 1]
            cut = max(at + int(gap[-1]) + 1 if len(gap) else at, int(row))
            if cut <= at:  # one word longer than a piece
                rest = np.flatnonzero(space[data[end:]])
                nxt = np.searchsorted(offsets, end, "right")
                cut = min(end + int(rest[0]) if len(rest) else len(data), int(offsets[nxt]) if nxt < len(offsets) else len(data))
            end = cut
        piece = data[at:end]
        lo, hi = np.searchsorted(offsets, [at, end])
        s, e = _bounds(piece, offsets[lo : hi + 1] - at, space)
        up, down = _POWERS.upto(len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(TABLE[piece] * up[: len(piece)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        at = end
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    begin = np.searchsorted(np.concatenate(starts), offsets) if starts else np.zeros(len(offsets), np.int64)
    return words, begin


_MULT = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(words: np.ndarray, k: int = K) -> np.ndarray:
    """Distinct shingle hashes of one document in ascending order; with fewer than k words, the whole sequence is one."""
    n = len(words)
    if not n:
        return words
    if n < k:
        one = np.full(1, n, np.uint64)
        for j in range(n):
            one = mix(one + words[j : j + 1] * _MULT[j % len(_MULT)])
        return one
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = mix(out + words[j : n - k + 1 + j] * _MULT[j % len(_MULT)]) if j % len(_MULT) == 4 else out + words[j : n - k + 1 + j] * _MULT[j % len(_MULT)]
    return np.unique(mix(out))


def slices(batch: pa.RecordBatch, column: str | int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about so many bytes of text each (one row at least)."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
