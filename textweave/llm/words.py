"""Whole-array word operations on byte buffers."""

from __future__ import annotations

import functools

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_ONE = np.uint64(0x0101010101010101)


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a line feed after each text, and the start of each text (and the end)."""
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    return raw, np.concatenate([[0], np.cumsum(lens + 1)])


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the last element must be False."""
    step = np.diff(np.concatenate([[0], inside.view(np.int8)]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = pow(_P, -1, 1 << 64)
    out = []
    for base in (_P, inv):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of a buffer, from which ``hash_spans`` has the hash of any span."""
    n = 1 << max(16, int(len(buf) + 1).bit_length())
    power, inverse = _powers(n)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    x = buf.astype(np.uint64)
    x += np.uint64(1)
    x *= power[: len(buf)]
    np.cumsum(x, out=total[1:])
    return total, inverse


def hash_spans(sums: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes."""
    total, inverse = sums
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes."""
    return hash_spans(hash_sums(buf), starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)


def bit_counts(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of h[offsets[i]:offsets[i+1]] have each of the 64 bits; int64 (rows, 64)."""
    lens = np.diff(offsets)
    out = np.zeros((len(lens), 64), dtype=np.int64)
    rows = np.flatnonzero(lens)
    if not rows.size:
        return out
    blocks = -(-lens[rows] // 255)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    starts = np.repeat(offsets[:-1][rows], blocks) + 255 * (np.arange(int(blocks.sum())) - np.repeat(first, blocks))
    for k in range(8):
        lane = np.add.reduceat((h >> np.uint64(k)) & _ONE, starts)
        out[rows, k::8] = np.add.reduceat(lane.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out


def majority(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint: bit set if counted in over half of n."""
    bits = (2 * counts > n[:, None]).astype(np.uint64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)
