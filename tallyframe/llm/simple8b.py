"""Simple-8b: unsigned integers in 64-bit words, a 4-bit selector and 60 bits of values.

Selectors 1 to 14 pack 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1 values of equal width.
Selector 0 is an escape: its word points into a table of values that need over 60 bits.
A stream is cut into blocks that are coded each by itself; the header has the word at which
each block starts, so that any block can be decoded alone, and all of them at once.

    bytes 0-3   b"TFS8"
    bytes 4-7   ids a block, unsigned 32-bit
    bytes 8-15  ids in all, unsigned 64-bit
    then        blocks and escapes, unsigned 32-bit each
    then        first word of each block and the number of words, unsigned 64-bit each
    then        words, then escaped values, unsigned 64-bit each

All numbers are little-endian.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"TFS8"
BLOCK_IDS = 16_384
_COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0])
_WIDTHS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0])
_HEAD = struct.Struct("<4sIQII")


def _steps(values: np.ndarray) -> np.ndarray:
    """For each position the selector that packs most of the values from there on.

    Values that fit a selector fit the next one, of fewer and wider values, so the number of
    selectors that fit says which is the first. The largest of each run of values comes from
    two shorter runs; selectors too narrow for every run are passed over.
    """
    n = len(values)
    fitting = np.zeros(n, np.uint8)
    if n and int(values.max()) < 1 << 32:
        values = values.astype(np.uint32)
    runs = {1: values}  # the largest of so many values from each position on
    for s in range(14, 0, -1):
        count, limit = int(_COUNTS[s]), 1 << int(_WIDTHS[s])
        if count > n:
            break
        if count not in runs:
            half = next(k for k in sorted(runs, reverse=True) if k < count)
            while 2 * half < count:
                runs[2 * half] = np.maximum(runs[half][: n - 2 * half + 1], runs[half][half:])
                half *= 2
            runs[count] = np.maximum(runs[half][: n - count + 1], runs[half][count - half : n - half + 1])
        fits = runs[count] < limit if limit < 1 << 32 or values.dtype == np.uint64 else np.ones(n - count + 1, bool)
        if not fits.any():
            break
        fitting[: n - count + 1] += fits
    return np.where(fitting > 0, 15 - fitting, 0).astype(np.uint8)


def _block(values: np.ndarray, escapes: list[int]) -> np.ndarray:
    best = _steps(values)
    jump, at, starts, n = _COUNTS[best].tolist(), 0, [], len(values)
    while at < n:
        starts.append(at)
        at += jump[at]
    starts = np.array(starts, np.int64)
    chosen = best[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if s == 0:
            words[rows] |= np.arange(len(escapes), len(escapes) + len(rows)).astype(np.uint64)
            escapes += values[starts[rows]].tolist()
            continue
        count, width = int(_COUNTS[s]), int(_WIDTHS[s])
        for k in range(count):
            words[rows] |= values[starts[rows] + k] << np.uint64(k * width)
    return words


def pack(values: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    values = np.ascontiguousarray(values, np.uint64)
    escapes: list[int] = []
    blocks = [_block(values[k : k + block_ids], escapes) for k in range(0, len(values), block_ids)]
    starts = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    head = _HEAD.pack(MAGIC, block_ids, len(values), len(blocks), len(escapes))
    return b"".join([head, starts.tobytes(), *(b.astype("<u8").tobytes() for b in blocks), np.array(escapes, "<u8").tobytes()])


def _expand(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[selector]
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        at = ends[rows] - counts[rows]
        if s == 0:
            out[at] = escapes[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        count, width = int(_COUNTS[s]), int(_WIDTHS[s])
        mask = np.uint64((1 << width) - 1)
        for k in range(count):
            out[at + k] = (words[rows] >> np.uint64(k * width)) & mask
    return out


def _parts(raw: bytes):
    magic, block_ids, n, blocks, escaped = _HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b stream")
    starts = np.frombuffer(raw, "<u8", blocks + 1, _HEAD.size)
    at = _HEAD.size + starts.nbytes
    words = np.frombuffer(raw, "<u8", int(starts[-1]), at)
    return block_ids, n, starts, words, np.frombuffer(raw, "<u8", escaped, at + words.nbytes)


def unpack(raw: bytes) -> np.ndarray:
    """All values, as unsigned 64-bit integers."""
    _, n, _, words, escapes = _parts(raw)
    out = _expand(words, escapes)
    if len(out) != n:
        raise ValueError(f"{len(out)} values where the header says {n}")
    return out


def unpack_block(raw: bytes, block: int) -> np.ndarray:
    """The values of one block, found by its offset."""
    _, _, starts, words, escapes = _parts(raw)
    return _expand(words[int(starts[block]) : int(starts[block + 1])], escapes)
