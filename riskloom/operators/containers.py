"""Compressed sets of 16-bit integers: an array, runs or a bitmap, whichever is smallest, and set operations on these forms."""

from __future__ import annotations

import numpy as np

#: Integers of one container.
RANGE = 65_536

ARRAY, RUNS, BITS = 0, 1, 2

#: A container: its form and its data (sorted uint16 values; int32 rows of first and last; uint8 bytes of the bitmap).
Container = tuple[int, np.ndarray]
EMPTY: Container = (ARRAY, np.empty(0, np.uint16))


def of_values(values: np.ndarray) -> Container:
    """The smallest container of integers in any order, repeated ones counted once."""
    v = np.unique(np.asarray(values).astype(np.uint16))
    if not len(v):
        return EMPTY
    first = np.flatnonzero(np.diff(v.astype(np.int32), prepend=-2) != 1)
    if min(2 * len(v), RANGE // 8) > 4 * len(first):
        return RUNS, np.stack([v[first], v[np.append(first[1:], len(v)) - 1]], 1).astype(np.int32)
    if 2 * len(v) <= RANGE // 8:
        return ARRAY, v
    bits = np.zeros(RANGE, np.uint8)
    bits[v] = 1
    return BITS, np.packbits(bits, bitorder="little")


def _of_runs(runs: np.ndarray) -> Container:
    n = int((runs[:, 1] - runs[:, 0] + 1).sum())
    if min(2 * n, RANGE // 8) > 4 * len(runs):
        return RUNS, runs
    return of_values(values((RUNS, runs)))


def values(c: Container) -> np.ndarray:
    """The integers of a container in order."""
    kind, data = c
    if kind == ARRAY:
        return data
    if kind == BITS:
        return np.flatnonzero(np.unpackbits(data, bitorder="little")).astype(np.uint16)
    length = data[:, 1] - data[:, 0] + 1
    return (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(data[:, 0], length)).astype(np.uint16)


def _has(c: Container, v: np.ndarray) -> np.ndarray:
    kind, data = c
    if not len(data):
        return np.zeros(len(v), bool)
    if kind == BITS:
        return (data[v >> 3] >> (v & 7).astype(np.uint8) & 1).astype(bool)
    if kind == ARRAY:
        return data[np.minimum(np.searchsorted(data, v), len(data) - 1)] == v
    at = np.searchsorted(data[:, 0], v, "right") - 1
    return (at >= 0) & (v <= data[np.maximum(at, 0), 1])


def _runs(c: Container) -> np.ndarray:
    return c[1] if c[0] == RUNS else np.stack([c[1], c[1]], 1).astype(np.int32)


def _bits(c: Container) -> np.ndarray:
    if c[0] == BITS:
        return c[1]
    bits = np.zeros(RANGE, np.uint8)
    bits[values(c)] = 1
    return np.packbits(bits, bitorder="little")


def _sweep(a: Container, b: Container, keep) -> Container:
    """Runs of the places where keep(in a, in b) holds, by one sweep over the ends of both."""
    x, y = _runs(a), _runs(b)
    at = np.concatenate([x[:, 0], x[:, 1] + 1, y[:, 0], y[:, 1] + 1])
    in_a = np.concatenate([np.ones(len(x)), -np.ones(len(x)), np.zeros(2 * len(y))])
    in_b = np.concatenate([np.zeros(2 * len(x)), np.ones(len(y)), -np.ones(len(y))])
    order = np.argsort(at, kind="stable")
    at, in_a, in_b = at[order], np.cumsum(in_a[order]) > 0, np.cumsum(in_b[order]) > 0
    last = np.append(at[1:] != at[:-1], True) if len(at) else np.empty(0, bool)  # of events at one place the last holds
    at, hold = at[last], keep(in_a[last], in_b[last])
    if not hold.any():
        return EMPTY
    turn = np.flatnonzero(np.diff(hold.astype(np.int8), prepend=0))
    return _of_runs(np.stack([at[turn[::2]], at[turn[1::2]] - 1], 1).astype(np.int32))


def and_not(a: Container, b: Container) -> Container:
    """Integers of a that are not in b."""
    if a[0] == ARRAY:
        return ARRAY, a[1][~_has(b, a[1])]
    if BITS in (a[0], b[0]):
        return of_values(values((BITS, _bits(a) & ~_bits(b))))
    return _sweep(a, b, lambda x, y: x & ~y)


def both(a: Container, b: Container) -> Container:
    """Integers of a that are in b too."""
    if a[0] == ARRAY:
        return ARRAY, a[1][_has(b, a[1])]
    if b[0] == ARRAY:
        return both(b, a)
    if BITS in (a[0], b[0]):
        return of_values(values((BITS, _bits(a) & _bits(b))))
    return _sweep(a, b, lambda x, y: x & y)


def either(a: Container, b: Container) -> Container:
    """Integers of a or b."""
    if BITS in (a[0], b[0]):
        return BITS, _bits(a) | _bits(b)
    return _sweep(a, b, lambda x, y: x | y)


def to_bytes(c: Container) -> bytes:
    """A container as bytes: its form, then little-endian 16-bit values, pairs of first and last, or the bitmap."""
    kind, data = c
    return bytes([kind]) + (data.tobytes() if kind == BITS else data.astype("<u2").tobytes())


def from_bytes(raw: bytes) -> Container:
    kind = raw[0]
    if kind == BITS:
        return BITS, np.frombuffer(raw, np.uint8, offset=1)
    data = np.frombuffer(raw, "<u2", offset=1)
    return (ARRAY, data) if kind == ARRAY else (RUNS, data.reshape(-1, 2).astype(np.int32))
