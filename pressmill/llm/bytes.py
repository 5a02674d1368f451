"""Bulk features of the bytes of whole texts, for the text models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
PIECE = 2_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_rows(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(data, starts, rows)``: bytes of several rows joined, where each begins (and the end), which rows.

    Every byte of every row comes once. Rows that are null or empty are left out; a text
    larger than ``PIECE`` comes in several pieces of the same row.
    """
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    size = np.diff(offsets)
    if texts.null_count:
        size = np.where(texts.is_valid().to_numpy(zero_copy_only=False), size, 0)
    at = 0
    while at < len(size):
        if size[at] > PIECE:
            for lo in range(0, int(size[at]), PIECE):
                begin, end = int(offsets[at]) + lo, int(offsets[at]) + min(int(size[at]), lo + PIECE)
                yield data[begin:end], np.array([0, end - begin]), np.array([at])
            at += 1
            continue
        to = at + 1
        total = int(size[at])
        while to < len(size) and total + size[to] <= PIECE:
            total += int(size[to])
            to += 1
        rows = at + np.nonzero(size[at:to])[0]
        if len(rows):
            # null rows may cover bytes; of the others each begins where the one before ends
            if int(size[rows].sum()) == int(offsets[rows[-1] + 1] - offsets[rows[0]]):
                joined = data[offsets[rows[0]] : offsets[rows[-1] + 1]]
            else:
                joined = np.concatenate([data[offsets[r] : offsets[r + 1]] for r in rows])
            yield joined, np.concatenate(([0], np.cumsum(size[rows]))), rows
        at = to


def gram_codes(data: np.ndarray, bits: int, starts: np.ndarray) -> np.ndarray:
    """For each byte the hash of it and the three after it, A-Z as a-z, zeros after its row's end."""
    n = len(data)
    low = np.zeros(n + 3, np.uint32)
    low[:n] = _LOWER[data]
    word = low[:n] | low[1 : n + 1] << 8 | low[2 : n + 2] << 16 | low[3 : n + 3] << 24
    ends, size = starts[1:], np.diff(starts)
    for back, mask in ((1, 0xFF), (2, 0xFFFF), (3, 0xFFFFFF)):
        word[ends[size >= back] - back] &= np.uint32(mask)
    return (word * np.uint32(2654435761)) >> np.uint32(32 - bits)


def echoes(codes: np.ndarray, starts: np.ndarray, lags: range) -> np.ndarray:
    """For each row how many of its codes come again after each of the lags, in all."""
    own = codes.astype(np.uint64) + (np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts)) << np.uint64(32))
    again = np.zeros(len(own), np.uint8)
    for lag in lags:
        again[lag:] += own[lag:] == own[:-lag]
    return sums(again, starts)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive non-empty runs."""
    return np.add.reduceat(values, starts[:-1], dtype=np.float64)
