"""Vectorised work on the UTF-8 bytes of Arrow string columns, inside tasks.

A batch is cut into pieces of about a quarter of a megabyte, so that temporaries stay small whatever the batch holds; a text
longer than that is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18


def class_table(excluded: bytes) -> np.ndarray:
    """Table over byte values: True for bytes that belong to a word."""
    out = np.ones(256, bool)
    out[list(excluded)] = False
    return out


#: [^\x20\x09-\x0D]+
NON_SPACE = class_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after A-Z are lower-cased
ALNUM_LOWER = class_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Piece:
    """Rows start:stop of a batch; their texts' bytes end to end in buf, row i at offs[i]:offs[i + 1]."""

    def __init__(self, start: int, buf: np.ndarray, offs: np.ndarray):
        self.start, self.buf, self.offs = start, buf, offs
        self.rows = len(offs) - 1

    def spans(self, word: np.ndarray, buf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of the maximal runs of bytes for which word[] is True; no run crosses a row."""
        buf = self.buf if buf is None else buf
        n = len(buf)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        w = np.zeros(n + 2, bool)
        w[1:-1] = word[buf]
        first = np.zeros(n + 1, bool)
        first[self.offs] = True
        s = np.flatnonzero(w[1:-1] & (~w[:-2] | first[:n]))
        e = np.flatnonzero(w[1:-1] & (~w[2:] | first[1:])) + 1
        return s, e, np.searchsorted(self.offs, s, "right") - 1


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[Piece]:
    """Cut a string or binary column into pieces; null counts as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield Piece(at, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        at = to


def strings(texts: pa.Array) -> list[str]:
    return ["" if x is None else x for x in texts.to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers = np.ones((2, 1), np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if _powers.shape[1] < n:
        m = max(n, 2 * PIECE)
        _powers = np.ones((2, m), np.uint64)
        _powers[0, 1:], _powers[1, 1:] = _BASE, _INVERSE
        np.cumprod(_powers, axis=1, out=_powers)
    return _powers


class Hashes:
    """64-bit polynomial hashes of any byte ranges of one buffer, each in constant time."""

    def __init__(self, buf: np.ndarray):
        self.pow = _power_table(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * self.pow[0, : len(buf)], out=self.sums[1:])

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.sums[e] - self.sums[s]) * self.pow[1, s] + (e - s).astype(np.uint64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of every k consecutive words, from the words' hashes."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    power = _power_table(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[0, :n])))
    return mix((sums[k:] - sums[: n - k + 1]) * power[1, : n - k + 1])


def counts(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights, n).astype(np.int64)
