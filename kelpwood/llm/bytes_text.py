"""Whole texts as arrays of bytes: word spans, word hashes and n-gram hashes.

The functions work on the value buffer of an Arrow string column, a block of
rows at a time, so that no Python object is made for a word. A block needs
about 60 bytes of memory for each byte of text, and is one row at least; a long
row is worked on in segments, which end between words (a single word is whole).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text in a block, unless a single text is longer.
BLOCK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_MIX = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII letters and digits, and all bytes of longer UTF-8 characters.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
SPACE_BYTE = np.zeros(256, bool)
SPACE_BYTE[[9, 10, 11, 12, 13, 32]] = True


def blocks(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of rows in them) for a string column without nulls."""
    wide = np.int64 if str(column.type).startswith("large") else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def segments(data: np.ndarray, member: np.ndarray, size: int = BLOCK_BYTES) -> list[tuple[int, int, int]]:
    """(start, end, next_end) of the segments of one long text: each but the first
    starts with a word (a run of ``member``) and each but the last ends before one,
    which ends at next_end. Segments have ``size`` bytes, and up to two words more."""
    out, start, n = [], 0, len(data)

    def first(at: int, inside: bool) -> int:
        """The first byte from ``at`` on for which member is ``inside``, or the end."""
        while at < n:
            found = np.flatnonzero(member[data[at : at + 4096]] == inside)
            if len(found):
                return at + int(found[0])
            at += 4096
        return n

    while start < n:
        end = first(first(min(n, start + size), False), True)
        out.append((start, end, first(end, False)))
        start = end
    return out or [(0, 0, 0)]


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of each run of bytes for which member holds, within rows."""
    inside = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each range, by one prefix sum modulo 2^64."""
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
