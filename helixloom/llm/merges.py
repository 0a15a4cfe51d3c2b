"""Pair merging over padded matrices: the kernel of both BPE tokenizers here.

Words of like length form one matrix. Every round, each row merges its leftmost pair of
minimum rank; pairs are looked up in an open-addressing hash table held in numpy arrays,
rows move up over the merged place, and finished rows leave the matrix.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.iinfo(np.int32).max
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: A longer word costs too many rounds over too wide rows; it goes through a heap instead, with equal results.
WIDEST = 256
#: Cells of one matrix.
CELLS = 1 << 20


class PairTable:
    """(left, right) -> value by open addressing with linear probing, all lookups vectorised."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        bits = max(8, int(2 * len(left) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        key = self.key(left, right)
        self.keys = np.full(1 << bits, EMPTY, np.uint64)
        self.value = np.full((1 << bits) + 1, NONE, np.int32)  # the last is for slot -1: no such pair
        todo, pos = np.arange(len(key)), self.home(key)
        while todo.size:
            free = todo[self.keys[pos[todo]] == EMPTY]
            _, first = np.unique(pos[free], return_index=True)
            won = free[first]
            self.keys[pos[won]], self.value[pos[won]] = key[won], value[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            pos[todo] = (pos[todo] + 1) & self.mask

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint32).astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32)

    def home(self, key: np.ndarray) -> np.ndarray:
        return ((key * MIX) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The values of pairs, NONE where there is no such pair."""
        key = self.key(left.ravel(), right.ravel())
        pos = self.home(key)
        got = self.keys[pos]
        hit = got == key
        slot = np.where(hit, pos, -1)
        todo = np.flatnonzero(~hit & (got != EMPTY))
        while todo.size:
            pos[todo] = (pos[todo] + 1) & self.mask
            got = self.keys[pos[todo]]
            hit = got == key[todo]
            slot[todo[hit]] = pos[todo[hit]]
            todo = todo[~hit & (got != EMPTY)]
        return self.value[slot].reshape(left.shape)


class Merges:
    """BPE over initial ids. `rank` orders the merges of (left, right) to `merged`."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        order = np.argsort(rank, kind="stable")
        self.left, self.right = left[order], right[order]
        self.merged = merged[order].astype(np.int32)
        self.pairs = PairTable(self.left, self.right, np.arange(len(order), dtype=np.int32))  # place in the order serves as rank
        self.by_pair: dict[tuple[int, int], int] | None = None

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """Merges every row of a matrix padded with -1 on the right; the result is padded likewise."""
        out = np.full_like(ids, -1)
        live, width = np.arange(len(ids)), ids.shape[1]
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while live.size and width > 1:
            at = rank.argmin(1)
            best = rank[np.arange(len(live)), at]
            over = best == NONE
            if over.any():
                out[live[over], :width] = ids[over]
                live, ids, rank, at, best = live[~over], ids[~over], rank[~over], at[~over], best[~over]
                if not live.size:
                    return out
            row = np.arange(len(live))
            col = np.arange(width - 1)
            ids = np.take_along_axis(ids, col + (col > at[:, None]), 1)
            ids[row, at] = self.merged[best]
            if width > 2:
                col = col[:-1]
                rank = np.take_along_axis(rank, col + (col >= at[:, None]), 1)
                for has, k in ((at > 0, at - 1), (at < width - 2, at)):
                    r, k = row[has], k[has]
                    rank[r, k] = self.pairs.find(ids[r, k], ids[r, k + 1])
            width -= 1
        out[live, :width] = ids
        return out

    def long_word(self, ids: np.ndarray) -> list[int]:
        """One word of any length by a heap over a linked list: n log n steps."""
        if self.by_pair is None:
            self.by_pair = {p: k for k, p in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True))}
        get, word, n = self.by_pair.get, ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(k, i, a, b) for i, (a, b) in enumerate(zip(word, word[1:], strict=False)) if (k := get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            k, i, a, b = heapq.heappop(heap)
            j = after[i]
            if word[i] != a or j >= n or word[j] != b:
                continue
            word[i], word[j], after[i] = int(self.merged[k]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (k := get((word[x], word[y]))) is not None:
                    heapq.heappush(heap, (k, x, word[x], word[y]))
        return [x for x in word if x >= 0]

    def words(self, ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges words laid end to end in `ids`; returns the same for the results."""
        start = np.cumsum(length) - length
        width = np.where(length <= 16, length, np.where(length <= 64, (length + 7) // 8 * 8, (length + 63) // 64 * 64))
        size = np.zeros(len(length), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for w in np.unique(width[(length > 0) & (length <= WIDEST)]).tolist():
            of = np.flatnonzero(width == w)
            for lo in range(0, len(of), step := max(1, CELLS // w)):
                part = of[lo : lo + step]
                col = np.arange(w)
                at = start[part][:, None] + col
                there = col < length[part][:, None]
                got = self.rows(np.where(there, ids[np.where(there, at, 0)], -1).astype(np.int32))
                size[part] = (got >= 0).sum(1)
                done.append((part, got[got >= 0]))
        for k in np.flatnonzero(length > WIDEST).tolist():
            got = np.asarray(self.long_word(ids[start[k] : start[k] + length[k]]), np.int32)
            size[k] = len(got)
            done.append((np.array([k]), got))
        to, out = np.cumsum(size) - size, np.zeros(int(size.sum()), np.int32)
        for part, got in done:
            n = size[part]
            out[np.repeat(to[part] - (np.cumsum(n) - n), n) + np.arange(len(got))] = got
        return out, size


def gather(offsets: np.ndarray, data: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows `ids` of a table of byte strings, end to end; and their lengths."""
    size = (offsets[1:] - offsets[:-1])[ids]
    place = np.cumsum(size) - size
    return data[np.repeat(offsets[ids] - place, size) + np.arange(int(size.sum()))], size
