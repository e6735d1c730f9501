"""Arrow text columns as numpy arrays of word hashes.

A word's identity is a 64-bit polynomial hash of its bytes (a random value per byte, an odd base), mixed at the end.
Two different words share one with probability about 2**-64; no dictionary of words is held, so memory does not
grow with the vocabulary. Texts are worked on in blocks of whole documents; only the hashes of one block are in memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 2 << 20
_SLICE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Everything but 0x20 and 0x09-0x0D belongs to a word.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

#: Digits, a-z and bytes beyond ASCII belong to a word.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[0x00:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
    power = np.full(_SLICE + 1, _BASE, np.uint64)
    inverse = np.full(_SLICE + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    return values, np.multiply.accumulate(power), np.multiply.accumulate(inverse)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, document offsets (one more than documents) and which documents are not null (null reads as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = pc.is_valid(column).to_numpy(zero_copy_only=False)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data if data is not None else b"", np.uint8), offsets, valid


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most ``size`` bytes together, or one longer document."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, min(high, n)
        low = high


def hash_words(data: np.ndarray, fresh: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word; A-Z count as a-z. ``fresh``: sorted bytes where a document begins."""
    values, power, inverse = _tables()
    hashes, starts, ends = [], [], []
    for low in range(0, len(data), _SLICE):
        part = _LOWER[data[low : low + _SLICE]]
        n = len(part)
        word = ~separators[part]
        new = np.zeros(n, bool)
        new[fresh[np.searchsorted(fresh, low) : np.searchsorted(fresh, low + n)] - low] = True
        begin, stop = word.copy(), word.copy()
        begin[1:] &= ~word[:-1] | new[1:]
        stop[:-1] &= ~word[1:] | new[1:]
        first, last = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values[part] * power[:n], out=total[1:])
        raw = (total[last] - total[first]) * inverse[first]
        if low and n and word[0] and not new[0] and ends and len(ends[-1]) and ends[-1][-1] == low:
            # The word began in an earlier slice.
            shift = pow(_BASE, int(low - starts[-1][-1]), 1 << 64)
            hashes[-1][-1] = (int(hashes[-1][-1]) + shift * int(raw[0])) & _MASK
            ends[-1][-1] = low + last[0]
            raw, first, last = raw[1:], first[1:], last[1:]
            if not len(raw):
                continue
        if len(raw):
            hashes.append(raw), starts.append(first + low), ends.append(last + low)
    if not hashes:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty
    return mix(np.concatenate(hashes)), np.concatenate(starts), np.concatenate(ends)


def hash_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the bytes ``data[first[i]:last[i]]``, as they are; the spans are in order and do not overlap."""
    values, power, inverse = _tables()
    out = np.zeros(len(first), np.uint64)
    at = 0
    while at < len(first):
        low = first[at]
        high = int(np.searchsorted(last, low + _SLICE, "right"))
        if high > at:
            part = data[low : last[high - 1]]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values[part] * power[: len(part)], out=total[1:])
            a, b = first[at:high] - low, last[at:high] - low
            out[at:high] = mix((total[b] - total[a]) * inverse[a])
            at = high
            continue
        # One long span, slice by slice.
        whole = 0
        for start in range(low, last[at], _SLICE):
            part = data[start : min(start + _SLICE, last[at])]
            whole += pow(_BASE, int(start - low), 1 << 64) * int((values[part] * power[: len(part)]).sum(dtype=np.uint64))
        out[at] = mix(np.array([whole & _MASK], np.uint64))[0]
        at += 1
    return out


def word_blocks(
    column: pa.Array, separators: np.ndarray, size: int = BLOCK
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(low, high, hashes, starts, ends, first) for blocks of documents ``low:high``.

    Words ``first[i]:first[i + 1]`` are those of document ``low + i``; starts and ends are bytes from ``offsets[low]``.
    """
    data, offsets, _ = utf8(column)
    for low, high in blocks(offsets, size):
        base = offsets[low]
        own = offsets[low : high + 1] - base
        hashes, starts, ends = hash_words(data[base : offsets[high]], own[:-1][own[:-1] < own[-1]], separators)
        yield low, high, hashes, starts, ends, np.searchsorted(starts, own)


def hash_word(word: bytes) -> int:
    """The hash of one word, as :func:`hash_words` gives it."""
    return int(hash_words(np.frombuffer(word, np.uint8), np.zeros(1, np.int64), np.zeros(256, bool))[0][0])


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for every run of ``n`` consecutive words; the last ``n - 1`` places have none."""
    total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        total = mix(total * np.uint64(3) + hashes[k : k + len(total)])
    return total


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, across batches; the input is sorted by ``keys``.

    Several whole groups come as one table: a table ends where its batch's last group begins.
    """
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for key in keys:
            column = batch.column(key)
            changed[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        same = bool(kept) and all(kept[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
        if kept and not same:
            yield pa.Table.from_batches(kept)
            kept = []
        cuts = np.flatnonzero(changed)
        if len(cuts):
            yield pa.Table.from_batches([*kept, batch.slice(0, cuts[-1])])
            kept = [batch.slice(cuts[-1])]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of the groups of a sorted table, and its length."""
    changed = np.zeros(table.num_rows, bool)
    for key in keys:
        column = table.column(key)
        changed[1:] |= pc.not_equal(column[1:], column[:-1]).combine_chunks().to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(changed), [table.num_rows]))
