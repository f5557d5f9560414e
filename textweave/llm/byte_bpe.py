"""Exact byte-level BPE over Arrow string buffers.

The tokenizer file is a byte-level BPE in the ``tokenizers`` JSON format.  Pre-tokens are cut
with whole-array byte operations and looked up in a table of the pre-tokens met before; only a
pre-token seen for the first time goes through the merge loop.  Keys hold the complete bytes of
the pre-token, so a hit is exact.  The table has a fixed number of slots; when it is full, new
pre-tokens are simply merged again, so memory is bounded and results never change.

Nothing is truncated: texts over ``SUB_BYTES`` are cut before a space that stands between two
ASCII letters or digits, where the pre-tokenizer always cuts as well.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata

import numpy as np

SUB_BYTES = 1 << 20
SLOT_BITS = 21
LONGEST_KEY = 23
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SAFE_CUT = re.compile(rb"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


@functools.cache
def _classes() -> np.ndarray:
    """0 letter, 1 number, 2 white space, 3 other, by code point."""
    kind = {"L": 0, "N": 1}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], 3) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    out[_SPACES] = 2
    return out


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            out[chr(spare)] = b
            spare += 1
    return out


class ByteBpe:
    def __init__(self, path: str, slot_bits: int = SLOT_BITS):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model.get("dropout"):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        vocab = model["vocab"]
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError(f"{path}: merge order and ids disagree")
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: special tokens with options")
        self.special_re = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        letters = _byte_alphabet()
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in tok): i for tok, i in vocab.items() if tok not in added}
        self._merge = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.cls, n = _classes(), 1 << slot_bits
        self.slots, self.shift, self.room = n, np.uint64(64 - slot_bits), n * 7 // 10
        self.keys = np.zeros((3, n), dtype=np.uint64)
        self.entry = np.full(n, -1, dtype=np.int32)
        self.count, self.start = np.zeros(1 << 12, dtype=np.int32), np.zeros(1 << 12, dtype=np.int64)
        self.pool, self.n_entries, self.n_pool = np.zeros(1 << 14, dtype=np.uint32), 0, 0

    # -- pre-tokens ---------------------------------------------------------------------------
    def _cuts(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens; buf is padded with zeros beyond bounds[-1]."""
        n = int(bounds[-1])
        own = buf[:n]
        cls = self.cls[:256][own]
        high = np.flatnonzero(own >= 0x80)
        if high.size:
            lead = high[(own[high] & 0xC0) != 0x80]
            b = [buf[lead + k].astype(np.int32) for k in range(4)]
            two, three = b[0] < 0xE0, b[0] < 0xF0
            code = np.where(two, (b[0] & 31) << 6 | b[1] & 63, np.where(three, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63))
            c = self.cls[np.minimum(code, 0x10FFFF)]
            cls[lead] = c
            for k, which in ((1, slice(None)), (2, ~two), (3, ~three)):
                at = lead[which] + k
                ok = at < n
                cls[at[ok]] = c[which][ok]
        cut = np.empty(n + 1, dtype=bool)
        cut[0], cut[n] = True, True
        np.not_equal(cls[1:], cls[:-1], out=cut[1:n])
        edge = np.zeros(n + 1, dtype=bool)
        edge[bounds] = True
        cut |= edge
        runs = np.flatnonzero(cut)
        begin, end = runs[:-1], runs[1:]
        blank = (cls[begin] == 2) & ~edge[end]
        begin, end = begin[blank], end[blank]
        last = end - 1
        for _ in range(2):
            last = last - ((buf[last] & 0xC0) == 0x80)
        cut[last] = True
        cut[end[buf[last] == 0x20]] = False
        quote = np.flatnonzero((own == 0x27) & cut[:n])
        if quote.size:
            nxt, after = buf[quote + 1], buf[quote + 2]
            one = np.isin(nxt, np.frombuffer(b"stmd", dtype=np.uint8)) & ~edge[quote + 1]
            two = ((nxt == 0x72) & (after == 0x65) | (nxt == 0x76) & (after == 0x65) | (nxt == 0x6C) & (after == 0x6C)) & ~edge[quote + 1] & ~edge[np.minimum(quote + 2, n)]
            cut[quote[one | two] + 1] = False
            cut[quote[one] + 2] = True
            cut[quote[two] + 3] = True
        return np.flatnonzero(cut[:n])

    # -- table --------------------------------------------------------------------------------
    def _add(self, ids: list[list[int]]) -> np.ndarray:
        """Numbers of new entries with these ids."""
        first, need = self.n_entries, self.n_entries + len(ids)
        while need > len(self.count):
            self.count, self.start = np.concatenate([self.count, np.zeros_like(self.count)]), np.concatenate([self.start, np.zeros_like(self.start)])
        lens = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        total = int(lens.sum())
        while self.n_pool + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.n_pool : self.n_pool + total] = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32, count=total)
        self.count[first:need], self.start[first:need] = lens, self.n_pool + np.cumsum(lens) - lens
        self.n_entries, self.n_pool = need, self.n_pool + total
        return np.arange(first, need, dtype=np.int32)

    def _mixed(self, a, b, c):
        h = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ c * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)

    def _slot(self, a, b, c):
        return (self._mixed(a, b, c) >> self.shift).astype(np.int64)

    def _lookup(self, a, b, c) -> np.ndarray:
        out = np.full(len(a), -1, dtype=np.int32)
        todo, at = np.arange(len(a)), self._slot(a, b, c)
        while todo.size:
            e = self.entry[at]
            same = (self.keys[0][at] == a[todo]) & (self.keys[1][at] == b[todo]) & (self.keys[2][at] == c[todo]) & (e >= 0)
            out[todo[same]] = e[same]
            more = ~same & (e >= 0)
            todo, at = todo[more], (at[more] + 1) & (self.slots - 1)
        return out

    def _insert(self, a, b, c, entries) -> None:
        todo, at = np.arange(len(a)), self._slot(a, b, c)
        while todo.size:
            free = np.flatnonzero(self.entry[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            for lane, key in enumerate((a, b, c)):
                self.keys[lane][at[won]] = key[todo[won]]
            self.entry[at[won]] = entries[todo[won]]
            rest = np.ones(len(todo), dtype=bool)
            rest[won] = False
            todo, at = todo[rest], (at[rest] + 1) & (self.slots - 1)

    def _entries(self, buf: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        lens = np.append(starts[1:], n) - starts
        wide = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
        lanes = [wide[starts + 8 * k] & _MASK[np.clip(lens - 8 * k, 0, 8)] for k in range(3)]
        lanes[2] |= lens.astype(np.uint64) << np.uint64(56)
        out = self._lookup(*lanes)
        out[lens > LONGEST_KEY] = -1
        new = np.flatnonzero(out < 0)
        if new.size:
            # One merge for each different new pre-token: grouped by a hash, then held against the full key.
            key = [x[new] for x in lanes]
            _, lead, group = np.unique(self._mixed(*key), return_index=True, return_inverse=True)
            same = (lens[new] <= LONGEST_KEY) & np.logical_and.reduce([x == x[lead][group] for x in key])
            own = np.flatnonzero(~same)
            raw, merge = buf.tobytes(), self._merge
            firsts = np.concatenate([new[lead], new[own]])
            s = starts[firsts]
            entries = self._add([merge(raw[i:j]) for i, j in zip(s.tolist(), (s + lens[firsts]).tolist())])
            out[new] = entries[group]
            out[new[own]] = entries[len(lead) :]
            short = np.flatnonzero(same[lead])[: max(0, self.room)]
            self._insert(*(x[lead[short]] for x in key), entries[short])
            self.room -= len(short)
        return out

    def _pieces(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces between bounds, and how many each piece has."""
        n = int(bounds[-1])
        if not n:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(bounds) - 1, dtype=np.int64)
        marks = self.n_entries, self.n_pool, self.room
        starts = self._cuts(buf, bounds)
        entries = self._entries(buf, starts, n)
        count = self.count[entries].astype(np.int64)
        ends = np.cumsum(count)
        where = np.repeat(self.start[entries] - (ends - count), count) + np.arange(int(ends[-1]))
        ids = self.pool[where]
        total = np.concatenate([[0], ends])[np.searchsorted(starts, bounds)]
        if marks[2] <= 0:  # nothing was kept, so nothing need stay in the pool
            self.n_entries, self.n_pool = marks[:2]
        return ids, np.diff(total)

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """Yields (first text, ids, ids per text) over consecutive texts of an Arrow string array.

        A text over SUB_BYTES comes alone, so one batch is bounded by the larger of the two.
        """
        i, n = 0, len(offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SUB_BYTES, side="right")) - 1)
            lo, hi = int(offsets[i]), int(offsets[j])
            raw = data[lo:hi].tobytes()
            bounds, fixed = (offsets[i : j + 1] - lo).astype(np.int64), {}
            if self.special_re and (found := list(self.special_re.finditer(raw))):
                inside = [m for m in found if np.searchsorted(bounds, m.start(), "right") == np.searchsorted(bounds, m.end(), "left")]
                fixed = {m.start(): self.special[m.group()] for m in inside}
                bounds = np.concatenate([bounds, *([m.start(), m.end()] for m in inside)])
            if hi - lo > SUB_BYTES:
                cuts, at = [], SUB_BYTES
                while at < hi - lo and (m := _SAFE_CUT.search(raw, at)):
                    cuts.append(m.start())
                    at = m.start() + SUB_BYTES
                bounds = np.concatenate([bounds, cuts]).astype(np.int64)
            texts = (offsets[i : j + 1] - lo).astype(np.int64)
            bounds = np.unique(bounds) if len(bounds) > len(texts) else np.unique(texts)
            if len(bounds) < 2:
                yield i, np.zeros(0, dtype=np.uint32), np.zeros(j - i, dtype=np.int64)
                i = j
                continue
            parts, counts, k = [], [], 0
            while k < len(bounds) - 1:
                if int(bounds[k]) in fixed:
                    parts.append(np.array([fixed[int(bounds[k])]], dtype=np.uint32))
                    counts.append(np.ones(1, dtype=np.int64))
                    k += 1
                    continue
                e = k + 1
                while e < len(bounds) - 1 and int(bounds[e]) not in fixed and bounds[e + 1] - bounds[k] <= SUB_BYTES:
                    if not fixed:
                        e = max(e + 1, min(len(bounds) - 1, int(np.searchsorted(bounds, bounds[k] + SUB_BYTES, side="right")) - 1))
                        break
                    e += 1
                a, b = int(bounds[k]), int(bounds[e])
                buf = np.zeros(b - a + 32, dtype=np.uint8)
                buf[: b - a] = np.frombuffer(raw, dtype=np.uint8, count=b - a, offset=a)
                ids, per = self._pieces(buf, bounds[k : e + 1] - a)
                parts.append(ids)
                counts.append(per)
                k = e
            total = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            yield i, np.concatenate(parts), np.diff(total[np.searchsorted(bounds, texts)])
            i = j


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One encoder per Python worker and file."""
    return ByteBpe(path)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null reads as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), offsets
