"""Substring dedup by prefix-partitioned suffix trees.

The sparse suffixes (see repeats) are dealt by prefixes of variable length: the anchor's gram, where too many suffixes for
memory share it a longer one, and at last the whole window. Groups travel together in runs. Of a run
the sorted suffixes and their common extensions with their neighbours give the tree with compressed paths: an internal node
is a stretch of suffixes that share more units than their parent's. Deep internal nodes of the tree to the right and of
the one to the left that together span a whole window are the maximal repeats that matter.

Defined cases: null and empty texts have no words and nothing removed; documents shorter than a window stay whole;
exact copies and repeated rows of at least a window go whole, in every copy; a null doc_id is kept; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import repeats


def tree(units: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """units (n, depth), sequences padded with -1 after their size -> their sorted order and the internal nodes of each group's tree.

    A node is (first, last, depth, parent's depth): the sequences from first to last in order share depth units, and the
    edge to it has those after the parent's depth (-1 above a root).
    """
    order = np.lexsort((*units.T[::-1], group))
    sorted_units, sizes = units[order], size[order]
    same = sorted_units[1:] == sorted_units[:-1]
    common = np.where(same.all(axis=1), units.shape[1], same.argmin(axis=1)) if len(same) and units.shape[1] else np.zeros(max(0, len(order) - 1), np.int64)
    common = np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))
    common[group[order][1:] != group[order][:-1]] = -1
    nodes: list[tuple[int, int, int, int]] = []
    path: list[tuple[int, int]] = []  # open nodes from the root: depth, first
    for i, depth in enumerate([*common.tolist(), -1]):
        first = i
        while path and path[-1][0] > depth:
            own, first = path.pop()
            nodes.append((first, i, own, max(depth, path[-1][0] if path else -1)))
        if depth >= 0 and (not path or path[-1][0] < depth):
            path.append((depth, first))
    return order, nodes


def nodes(values: np.ndarray, begin: np.ndarray, end: np.ndarray, group: np.ndarray, depth: int, step: int) -> list[np.ndarray]:
    """out[r][i]: the internal node on or under whose edge sequence i has its first r units, or -1 where it is alone or ends before.

    Sequence i is values[begin[i]], values[begin[i] + step], ... up to but not including end[i].
    """
    size = np.minimum((end - begin) * step, depth)
    inside = np.arange(depth) < size[:, None]
    units = np.where(inside, values[np.where(inside, begin[:, None] + step * np.arange(depth), 0)], -1) if depth and len(values) else np.zeros((len(begin), 0), np.int64)
    order, inner = tree(units, size, group)
    deep = np.full((depth + 1, len(begin)), -1, np.int32)
    for number, (first, last, own, above) in enumerate(inner):
        deep[above + 1 : own + 1, first : last + 1] = number
    out = np.empty_like(deep)
    out[:, order] = deep
    return list(out)


def without_repeats(docs: DataFrame, window: int = 35, gram: int = 12) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): words of windows that occur elsewhere, in any document, go in all of them."""
    out = repeats.repeated(docs, repeats.Words(window, gram), nodes, first_stays=False, halves=True)
    return out.select("doc_id", out.n.alias("n_words"), "n_removed", "kept_sha256")
