"""Vectorised word hashing over Arrow text buffers, shared by the document operators.

A word is a maximal run of bytes outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing
A-Z: ASCII letters and digits and every byte of a non-ASCII character. Words never cross documents.
A word's hash is the sum over its bytes of an avalanche mix of byte and place, mixed again with the
length: no structure of words makes sums meet, as it does for polynomials modulo 2**64.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
#: Bytes hashed at once; a longer document is cut at a byte that belongs to no word.
SEGMENT = 1 << 18

#: Places in a word whose mixes are held in a table.
NEAR = 32

#: Bits of one of an exponent's three digits.
DIGIT = 11
#: The greatest exponent, beyond any text's length.
TOP = (1 << 3 * DIGIT) - 1


@functools.cache
def _digits(base: int) -> list[np.ndarray]:
    """base**(i * 2**(DIGIT*k)) modulo 2**64 for i below 2**DIGIT and k = 0, 1, 2."""
    tables = []
    for k in range(3):
        out = np.full(1 << DIGIT, pow(base, 1 << DIGIT * k, 1 << 64), dtype=np.uint64)
        out[0] = 1
        tables.append(np.multiply.accumulate(out))
    return tables


def power(exponent: np.ndarray, base: int = BASE) -> np.ndarray:
    """base**exponent modulo 2**64, digit by digit: no table of all powers is held."""
    low, middle, high = _digits(base)
    below = (1 << DIGIT) - 1
    return high[exponent >> 2 * DIGIT] * middle[exponent >> DIGIT & below] * low[exponent & below]


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**i modulo 2**64 for i in 0..n-1, n at most 2**(2*DIGIT)."""
    low, middle, _ = _digits(base)
    return np.multiply.outer(middle[: (n >> DIGIT) + 1], low).ravel()[:n]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes of bytes: [e] - [s], times power(TOP - s), is the hash of raw[s:e]."""
    out = np.empty(len(raw) + 1, dtype=np.uint64)
    out[0] = 0
    step = 1 << 18
    for a in range(0, len(raw), step):
        part = raw[a : a + step].astype(np.uint64)
        part += np.uint64(1)
        part *= powers(len(part))
        if a:
            part *= power(np.array(a))
        np.cumsum(part, out=out[a + 1 : a + 1 + len(part)])
        out[a + 1 : a + 1 + len(part)] += out[a]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def _placed() -> np.ndarray:
    """The mix of every byte at each of the first NEAR places."""
    return mix(np.arange(NEAR << 8, dtype=np.uint64) + np.uint64(BASE))


def placed(b: np.ndarray, place: np.ndarray) -> np.ndarray:
    """An avalanche mix of each byte and its place in its word."""
    key = place << 8 | b
    out = _placed()[np.minimum(key, (NEAR << 8) - 1)]
    far = np.flatnonzero(place >= NEAR)
    out[far] = mix(key[far].astype(np.uint64) + np.uint64(BASE))
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def segments(raw: np.ndarray, offs: np.ndarray, size: int = SEGMENT):
    """Byte ranges (lo, hi) of about ``size`` that start and end at document or word ends."""
    lo, end = 0, len(raw)
    while lo < end:
        hi = min(lo + size, end)
        if hi < end:
            k = offs[np.searchsorted(offs, hi, "right") - 1]
            if k > lo:
                hi = int(k)
            else:  # one document fills the segment: cut after a byte outside words
                doc_end = int(offs[np.searchsorted(offs, lo, "right")])
                while True:
                    gaps = np.flatnonzero(~WORD[LOWER[raw[lo:hi]]])
                    if len(gaps) or hi >= doc_end:
                        break
                    hi = min(hi + size, doc_end)
                if hi < doc_end:
                    hi = lo + int(gaps[-1]) + 1
        yield lo, hi
        lo = hi


def word_hashes(raw: np.ndarray, offs: np.ndarray, spans: bool = False):
    """(hashes, counts per document) and, with ``spans``, each word's first byte and end."""
    hashes, firsts, lasts = [], [], []
    for lo, hi in segments(raw, offs):
        b = LOWER[raw[lo:hi]]
        m = WORD[b]
        cut = offs[np.searchsorted(offs, lo) : np.searchsorted(offs, hi, "right")] - lo
        before = np.empty_like(m)
        before[0], before[1:] = False, m[:-1]
        before[cut[cut < len(m)]] = False
        after = np.empty_like(m)
        after[-1], after[:-1] = False, m[1:]
        after[cut[cut > 0] - 1] = False
        first = np.flatnonzero(m & ~before)
        last = np.flatnonzero(m & ~after) + 1
        size = last - first
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(placed(b[m], place))))
        ends = np.cumsum(size)
        hashes.append(mix(total[ends] - total[ends - size] + size.astype(np.uint64)))
        firsts.append(first + lo)
        lasts.append(last + lo)
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    firsts = cat(firsts, np.int64)
    counts = np.diff(np.searchsorted(firsts, offs))
    return (cat(hashes, np.uint64), counts, firsts, cat(lasts, np.int64)) if spans else (cat(hashes, np.uint64), counts)


def hash_word(word: str) -> int:
    """The hash of one word, as word_hashes gives it."""
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(word_hashes(raw, np.array([0, len(raw)]))[0][0])


def slices(batch: pa.RecordBatch, text: int, size: int = 1 << 20):
    """Zero-copy slices of a batch holding about ``size`` bytes of text or one row."""
    column = batch.column(text)
    if not len(column):
        return
    length = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(length) // size
    starts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(column)]))
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


@functools.cache
def _trim():
    """The C library's call that gives freed memory back, where there is one."""
    with contextlib.suppress(OSError, AttributeError):
        return ctypes.CDLL(None).malloc_trim
    return lambda _: None


#: What operators keep in a worker from task to task, by the operator's name.
HELD: dict[str, dict] = {}


def give_back(made, keep: str = ""):
    """What a task makes. The worker, which waits for further tasks, keeps no freed memory after it,
    and nothing that other operators' tasks have left there."""
    others = [held for name, held in HELD.items() if held and name != keep]
    for held in others:
        held.clear()
    if others:
        gc.collect()
    yield from made
    _trim()(0)
