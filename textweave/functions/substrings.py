"""Many byte strings looked for in many texts at once.

A text is read once for each length that the strings have (lengths from 8 bytes on count as one), not once for
each string: a window of up to eight bytes at every place is looked up by its hash, and what is found is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Places looked at together; bits of a hash; bytes of texts in a slice.
PLACES, BITS, SLICE = 1 << 16, 16, 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _head(x: bytes) -> int:
    return int.from_bytes(x[:8], "little")


class Finder:
    """Places of distinct strings of at least one byte."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.sizes = strings, np.array([len(x) for x in strings], np.int64)
        self.bordered = {k for k, x in enumerate(strings) if any(x.startswith(x[i:]) for i in range(1, len(x)))}
        self.groups = []
        for size in range(1, 9):
            own = [k for k, x in enumerate(strings) if min(len(x), 8) == size]
            if own:
                heads, of = np.unique(np.array([_head(strings[k]) for k in own], np.uint64), return_inverse=True)
                seen = np.zeros(1 << BITS, bool)
                seen[self._hash(heads)] = True
                self.groups.append((np.uint64((1 << 8 * size) - 1), heads, seen, [[own[k] for k in np.flatnonzero(of == h)] for h in range(len(heads))]))

    @staticmethod
    def _hash(x: np.ndarray) -> np.ndarray:
        return (x * _FACTOR >> np.uint64(64 - BITS)).astype(np.int64)

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, string, place in the joined texts) of every occurrence inside a text, overlapping ones too."""
        n = sum(map(len, texts))
        raw = np.frombuffer(b"".join([*texts, bytes(16)]), np.uint8)
        ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
        windows = np.lib.stride_tricks.sliding_window_view(raw, 8)
        strings, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low in range(0, n, PLACES):
            here = min(PLACES, n - low)
            eight = np.empty((here + 7) // 8 * 8, np.uint64)
            for k in range(8):
                eight[k::8] = np.frombuffer(raw, "<u8", len(eight) // 8, low + k)  # zeros follow the texts
            eight = eight[:here]
            for mask, heads, seen, members in self.groups:
                x = eight & mask
                at = np.flatnonzero(seen[self._hash(x)])
                of = np.minimum(np.searchsorted(heads, x[at]), len(heads) - 1)
                real = heads[of] == x[at]
                at, of = at[real] + low, of[real]
                for h in np.unique(of).tolist() if mask == np.uint64(0xFFFFFFFFFFFFFFFF) else ():
                    for k in members[h]:
                        mine = at[of == h]
                        for i in range(8, len(self.strings[k]), 8):  # the last eight bytes may overlap the ones before
                            i = min(i, len(self.strings[k]) - 8)
                            mine = mine[mine + i + 8 <= n]
                            mine = mine[np.ascontiguousarray(windows[mine + i]).view("<u8").ravel() == _head(self.strings[k][i:])]
                        strings.append(np.full(len(mine), k, np.int64))
                        places.append(mine)
                if mask != np.uint64(0xFFFFFFFFFFFFFFFF):
                    strings.append(np.array([m[0] for m in members], np.int64)[of])
                    places.append(at)
        string, place = np.concatenate(strings), np.concatenate(places)
        text = np.searchsorted(ends, place, side="right")
        inside = place + self.sizes[string] <= ends[text] if len(place) else np.zeros(0, bool)
        return text[inside], string[inside], place[inside]

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """How often each string stands in each text, occurrences that overlap an earlier one left out."""
        text, string, place = self.find(texts)
        drop = []
        if self.bordered and len(place):
            for k in np.unique(string).tolist():
                if k in self.bordered:
                    mine = np.flatnonzero(string == k)
                    mine = mine[np.argsort(place[mine], kind="stable")]
                    if len(mine) > 1 and np.diff(place[mine]).min() < self.sizes[k]:
                        free = -1
                        for i, p in zip(mine.tolist(), place[mine].tolist()):
                            if p < free:
                                drop.append(i)
                            else:
                                free = p + int(self.sizes[k])
        if drop:
            text, string = np.delete(text, drop), np.delete(string, drop)
        return np.bincount(text * len(self.strings) + string, minlength=len(texts) * len(self.strings)).reshape(len(texts), len(self.strings))


def slices(column, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of up to most texts of about SLICE bytes of an Arrow column, with their place; a longer text stands alone."""
    texts, n, start = [], 0, 0
    for k, t in enumerate(column):
        t = t.as_buffer().to_pybytes() if t.is_valid else b""
        if texts and (n + len(t) > SLICE or len(texts) >= most):
            yield start, texts
            texts, n, start = [], 0, k
        texts.append(t)
        n += len(t)
    if texts:
        yield start, texts
