"""Vectorised text kernels used inside tasks, on flat UTF-8 buffers of many documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(seed))


BYTE = seeds(256, 11) | np.uint64(1)
BYTE_LOWER = BYTE[LOWER]
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash base and its inverse to the powers 0..n-1, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        _powers = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)])) for b in (_BASE, _INVERSE))
    return _powers


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows that hold about ``limit`` bytes of ``column`` at most."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column end to end, and the rows' bounds; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    _, bounds, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(bounds, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words ``[^\\x20\\x09-\\x0D]+``."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of disjoint, ordered, non-empty spans."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    value = np.zeros(len(data) + 1, np.uint64)
    np.multiply((BYTE_LOWER if lower else BYTE)[data], up[: len(data)], out=value[:-1])
    at = np.empty(2 * len(starts), np.int64)
    at[::2], at[1::2] = starts, ends
    return mix(np.add.reduceat(value, at)[::2] * down[starts] + (ends - starts).astype(np.uint64))


_TURN = seeds(64, 77) | np.uint64(1)


def gram_hash(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows within each row, and the index of each window's first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = len(hashes) - n + 1
    whole = np.zeros(last, np.uint64)
    for i in range(n):
        whole += hashes[i : i + last] * _TURN[i]
    first = np.flatnonzero(row[:last] == row[n - 1 :])
    return mix(whole[first]), first


def shingles(column: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingle hashes of each row, in ascending order within a row, and the rows' bounds.

    A-Z is lower-cased.  A row with fewer than n words has one shingle, the whole
    sequence; a row without words has none.
    """
    data, offs = flat(column)
    starts, ends, row = words(data, offs)
    hashes = span_hash(data, starts, ends, lower=True)
    gram, first = gram_hash(hashes, row, n)
    of = row[first]
    count = np.bincount(row, minlength=len(column))
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        begin = np.searchsorted(row, short)
        whole = np.array([int(mix(np.array([(hashes[b : b + count[r]] * _TURN[20 : 20 + count[r]]).sum(dtype=np.uint64) + np.uint64(count[r])]))[0]) for r, b in zip(short, begin, strict=True)], np.uint64)
        gram, of = np.concatenate([gram, whole]), np.concatenate([of, short])
    order = np.lexsort((gram, of))
    gram, of = gram[order], of[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])
    gram, of = gram[new], of[new]
    return gram, np.searchsorted(of, np.arange(len(column) + 1))


def bit_set(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which positions are set in a bitmap made by ``numpy.packbits``."""
    return packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & np.uint8(1) > 0


def set_bits(packed: np.ndarray, at: np.ndarray) -> None:
    """Set positions in a bitmap as made by ``numpy.packbits``, in place."""
    at = np.unique(at)
    if len(at):
        byte = at >> 3
        first = np.flatnonzero(np.diff(byte, prepend=-1))
        packed[byte[first]] |= np.bitwise_or.reduceat(np.right_shift(np.uint8(128), (at & 7).astype(np.uint8)), first)


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many of the flags are set in each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]
