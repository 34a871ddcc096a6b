"""Words of many texts at once, as NumPy arrays over an Arrow string column.

A word is a maximal run of bytes of one class inside one text.  All classes used
here are decided by ASCII bytes (bytes from 0x80 on belong to a class as a whole),
so cutting UTF-8 by bytes equals cutting by characters.  Every word gets a 64-bit
hash of its bytes, A-Z folded to a-z if asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text looked at in one go; bounds the memory of one step (about 40 bytes per byte of text).
WINDOW = 1 << 17

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (xor-shift-multiply)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out, x = np.empty(n, _U), 1
    for i in range(n):
        out[i] = x
        x = x * base & 0xFFFFFFFFFFFFFFFF
    return out


_POW_BITS = 12
_POW = _powers(0x9E3779B97F4A7C15, 1 << _POW_BITS)
_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Everything but white space: not 0x20 and not 0x09-0x0D.
NOT_SPACE = ~_class((0x20, 0x20), (0x09, 0x0D))
#: Letters, digits and all bytes beyond ASCII: not 0x00-0x2F, 0x3A-0x60, 0x7B-0x7F once A-Z is folded.
ALNUM = _class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

#: Bytes of this kind are words of their own where kinds cut words.
SINGLE = 4

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


@dataclass
class Words:
    """``start``/``end``: byte places in the buffer; ``doc``: row of the text; ``first``: index of
    each text's first word (one more entry than texts); ``hash``: 64-bit hash of the word."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def parts(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each (a longer text is a range of its own)."""
    _, at = buffer_of(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        j = min(j, i + 20_000, n)
        yield i, j
        i = j


def _window(data: np.ndarray, at: np.ndarray, a: int, b: int, member: np.ndarray, kinds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = member[data[a:b]]
    cut = at[np.searchsorted(at, a) : np.searchsorted(at, b)] - a
    before = np.zeros_like(mask)
    before[1:] = mask[:-1]
    before[cut] = False
    after = np.zeros_like(mask)
    after[:-1] = mask[1:]
    after[cut[cut > 0] - 1] = False
    if kinds is not None:
        kind = kinds[data[a:b]]
        apart = np.flatnonzero((kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == SINGLE)))
        before[apart + 1] = False
        after[apart] = False
    start, end = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return mask, start, end


def _hashes(byte: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of each run; ``byte`` holds the runs one after another."""
    if not len(length):
        return np.zeros(0, _U)
    first = np.cumsum(length) - length
    rel = np.arange(len(byte)) - np.repeat(first, length)
    v = _BYTE[byte] * _POW[rel & ((1 << _POW_BITS) - 1)]
    far = rel >= 1 << _POW_BITS
    if far.any():
        v[far] = mix64(v[far] + (rel[far] >> _POW_BITS).astype(_U))
    return mix64(np.add.reduceat(v, first) + length.astype(_U))


def find_words(data: np.ndarray, at: np.ndarray, member: np.ndarray, fold: bool = True, hashed: bool = True, kinds: np.ndarray | None = None) -> Words:
    """The words of all texts, in text order.  Long buffers are walked in windows that end between words.

    ``kinds`` (a number per byte) also cuts words between bytes of two different kinds above 0, and
    between any two of kind ``SINGLE``."""
    starts, ends, hashes = [], [], []
    a, n = 0, len(data)
    while a < n:
        b = min(a + WINDOW, n)
        while b < n and member[data[b]] and member[data[b - 1]]:  # go on to the end of the word
            gap = np.flatnonzero(~member[data[b : b + WINDOW]])
            b = b + int(gap[0]) if len(gap) else min(b + WINDOW, n)
        mask, start, end = _window(data, at, a, b, member, kinds)
        starts.append(start + a)
        ends.append(end + a)
        if hashed:
            byte = data[a:b][mask]
            hashes.append(_hashes(FOLD[byte] if fold else byte, end - start))
        a = b
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    start, end = cat(starts, np.int64), cat(ends, np.int64)
    first = np.searchsorted(start, at)
    return Words(start, end, np.repeat(np.arange(len(at) - 1), np.diff(first)), first, cat(hashes, _U))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k consecutive words of one text, and the index of its first word."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    index = np.flatnonzero(words.doc[:n] == words.doc[k - 1 :])
    h = np.zeros(len(index), _U)
    for j in range(k):
        h = (h + words.hash[index + j]) * _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
    return mix64(h), index
