"""Rabin-Karp hashes of words and of windows of words, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BLOCK = 1 << 18
_BASE = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93, "check": 0xA0761D6478BD642F}
_LETTERS = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: The separators of words, space and 9 to 13.
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
_SEPARATES = np.isin(np.arange(256), list(SEPARATORS))
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if kind not in _powers:
        base = _BASE[kind]
        found = []
        for x in (base, pow(base, -1, 1 << 64)):
            steps = np.full(_BLOCK + 64, x, np.uint64)
            steps[0] = 1
            found.append(np.multiply.accumulate(steps))
        _powers[kind] = tuple(found)
    return _powers[kind]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    """Polynomial sum of each values[start:end], modulo 2**64, whatever the start."""
    up, down = _powers_of(kind)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    return mixed(_sums(values, starts, ends, kind))


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words in ``data``, taken in blocks; a word over several blocks is one word all the same."""
    sums, starts, ends = [], [], []
    open_sum, open_at = 0, None  # of a word that the last block ended in
    for at, part in _blocks(data):
        raw = np.frombuffer(part, np.uint8)
        edges = np.diff(np.concatenate([[True], _SEPARATES[raw], [True]]).astype(np.int8))
        start, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        found = _sums(_LETTERS[raw], start, end, "byte")
        start, end = start + at, end + at
        if open_at is not None:
            if len(start) and start[0] == at:
                found[0] = (open_sum + pow(_BASE["byte"], at - open_at, 1 << 64) * int(found[0])) % (1 << 64)
                start[0] = open_at
            else:
                found, start, end = (np.concatenate([np.array([x], y.dtype), y]) for x, y in ((open_sum, found), (open_at, start), (at, end)))
            open_at = None
        if len(end) and end[-1] == at + len(part) < len(data):
            open_sum, open_at = int(found[-1]), int(start[-1])
            found, start, end = found[:-1], start[:-1], end[:-1]
        sums.append(found)
        starts.append(start)
        ends.append(end)
    if not sums:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return mixed(np.concatenate(sums)), np.concatenate(starts), np.concatenate(ends)


def _blocks(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Blocks cut at a separator where they have one; others end within a word."""
    at = 0
    while at < len(data):
        part = data[at : at + _BLOCK]
        if at + len(part) < len(data):
            cut = max(part.rfind(bytes([s])) for s in SEPARATORS)
            part = part[: cut + 1] if cut >= 0 else part
        yield at, part
        at += len(part)


def windows(hashes: np.ndarray, size: int, kind: str = "word") -> np.ndarray:
    """Hash of each ``size`` consecutive hashes, none if there are fewer; ``kind`` "check" is a second one to another base."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    step, out = _BLOCK - size, []
    for at in range(0, n, step):
        part = hashes[at : at + step + size - 1]
        starts = np.arange(len(part) - size + 1)
        out.append(_spans(part, starts, starts + size, kind))
    return np.concatenate(out)


def window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` consecutive values."""
    n = len(values) - size + 1
    if n < 1:
        return values[:0]
    low, width = values, 1
    while 2 * width <= size:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    return np.minimum(low[:n], low[size - width : size - width + n])
