"""Substring dedup by a hash-compared suffix sort.

The sparse suffixes (see repeats) of a run are merge-sorted. Two suffixes are compared by a binary search over prefix
polynomial hashes for their common extension, in a logarithmic number of steps, and by the byte after it. All merges
of a level run at once: each suffix finds its rank in the neighbouring run by binary search. Afterwards the common
extensions of neighbours are checked byte by byte; where a hash collision led astray, the run is sorted by its bytes.

Defined cases: null and empty texts have no bytes and nothing removed; documents shorter than a window stay whole;
of exact copies and repeated rows of at least a window the first stays (one row of those with the same doc_id) and the
others go whole; a null doc_id comes before all others; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import repeats


class Suffixes:
    """Sequences i: values[begin[i]], values[begin[i] + step], ... before end[i], cut at depth."""

    def __init__(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray, depth: int, step: int):
        self.values = values if step == 1 else values[::-1]
        self.begin = begin if step == 1 else len(values) - 1 - begin
        self.size = np.minimum((end - begin) * step, depth)
        self.pre = repeats.prefix(repeats.BYTE[self.values] if len(self.values) else np.zeros(0, np.uint64))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of sequences a and b, by hashes."""
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        ba, bb = self.begin[a], self.begin[b]
        while (open_ := lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = repeats.between(self.pre, ba, ba + mid) == repeats.between(self.pre, bb, bb + mid)
            lo = np.where(open_ & same, mid, lo)
            hi = np.where(open_ & ~same, mid - 1, hi)
        return lo

    def after(self, i: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The value at a depth, -1 at the end."""
        inside = depth < self.size[i]
        return np.where(inside, self.values[np.where(inside, self.begin[i] + depth, 0)], -1)

    def less(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """a < b, or a <= b where ties."""
        depth = self.common(a, b)
        x, y = self.after(a, depth), self.after(b, depth)
        return (x < y) | (ties & (x == y))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Sequence numbers by group, then by content."""
        seq = np.argsort(group, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], group[seq][1:] != group[seq][:-1], [True]]))
        count = np.diff(edge)
        first, last = np.repeat(edge[:-1], count), np.repeat(edge[1:], count)
        index = np.arange(len(seq))
        width = 1
        while width < count.max(initial=0):
            live = np.flatnonzero(last - first > width)  # groups that are still in several runs
            run = (index[live] - first[live]) // width
            start = first[live] + run * width
            other = np.minimum(first[live] + (run ^ 1) * width, last[live])
            end = np.minimum(other + width, last[live])
            lo, hi = other.copy(), end.copy()
            right = run & 1 == 1  # of equal ones those of the left run come first
            while (open_ := lo < hi).any():
                at = np.flatnonzero(open_)
                mid = (lo[at] + hi[at]) >> 1
                before = self.less(seq[mid], seq[live[at]], right[at])
                lo[at] = np.where(before, mid + 1, lo[at])
                hi[at] = np.where(before, hi[at], mid)
            place = np.minimum(start, other) + (index[live] - start) + (lo - other)
            moved = seq.copy()
            moved[place] = seq[live]
            seq = moved
            width *= 2
        return seq

    def verified(self, seq: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(order, common extension with the one before, -1 at a group's first) if bytes bear out both; else None."""
        a, b = seq[:-1], seq[1:]
        depth = self.common(a, b)
        total = np.cumsum(depth) - depth
        inside = np.arange(int(depth.sum())) - np.repeat(total, depth)
        equal = self.values[np.repeat(self.begin[a], depth) + inside] == self.values[np.repeat(self.begin[b], depth) + inside]
        same = group[a] == group[b]
        x, y = self.after(a, depth), self.after(b, depth)
        if not equal[np.repeat(same, depth)].all() or not ((x < y) | (x == -1) & (y == -1))[same].all():
            return None
        return seq, np.concatenate([[-1], np.where(same, depth, -1)])

    def plain(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by comparing bytes."""
        text = self.values.astype(np.uint8).tobytes()
        own = [text[b : b + n] for b, n in zip(self.begin.tolist(), self.size.tolist(), strict=True)]
        seq = sorted(range(len(own)), key=lambda i: (group[i], own[i]))
        common = [-1]
        for i, j in zip(seq, seq[1:], strict=False):
            n = 0
            while group[i] == group[j] and n < min(len(own[i]), len(own[j])) and own[i][n] == own[j][n]:
                n += 1
            common.append(n if group[i] == group[j] else -1)
        return np.array(seq, np.int64), np.array(common[: len(seq)], np.int64)


def classes(values: np.ndarray, begin: np.ndarray, end: np.ndarray, group: np.ndarray, depth: int, step: int) -> list[np.ndarray]:
    """out[r][i]: a number shared by the sequences of a group that agree on r values; -1 where i is alone or shorter."""
    own = Suffixes(values, begin, end, depth, step)
    if not len(begin):
        return [np.zeros(0, np.int32)] * (depth + 1)
    seq, common = own.verified(own.sort(group), group) or own.plain(group)
    out = []
    for r in range(depth + 1):
        new = common < r
        alone = new & np.append(new[1:], True)
        number = np.cumsum(new).astype(np.int32)
        number[alone | (own.size[seq] < r)] = -1
        placed = np.empty_like(number)
        placed[seq] = number
        out.append(placed)
    return out


def without_later_repeats(docs: DataFrame, window: int = 100, gram: int = 24) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): bytes of windows that also start earlier are removed."""
    out = repeats.repeated(docs, repeats.Bytes(window, gram), classes, first_stays=True, halves=False)
    return out.select("doc_id", out.n.alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
