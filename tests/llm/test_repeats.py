import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from quirebase.llm import repeats, suffixarray, suffixtree


def brute_words(rows, size):
    docs = [(d, (t or "").encode().split()) for d, t in rows]
    seen = defaultdict(int)
    for _, w in docs:
        for i in range(len(w) - size + 1):
            seen[tuple(w[i : i + size])] += 1
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def brute_bytes(rows, size):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if w in seen:
                gone[i : i + size] = True
            seen.add(w)
        runs = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def same(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def pasted(seed, n=150):
    """Documents that share passages, with low and high entropy."""
    rng = random.Random(seed)
    words = [f"{rng.choice('abcd')}{i}" for i in range(60)]
    pool = [[rng.choice(words) for _ in range(rng.randint(5, 90))] for _ in range(12)]
    rows = []
    for i in range(n):
        out = []
        for _ in range(rng.randint(0, 4)):
            out += rng.choice(pool) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 60))]
        if rng.random() < 0.1:
            out += ["a"] * rng.randint(1, 80)
        rows.append((i, " ".join(out)))
    return rows


@pytest.mark.parametrize("which", ["odd", "real"])
def test_words(which, request):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same(suffixtree.without_repeats(docs).collect(), brute_words(rows, 35))


def ordered(rows):
    """Rows of one doc_id with different texts have no order of their own in the contract: leave them out of the comparison."""
    count = defaultdict(set)
    for d, t in rows:
        count[d].add(t)
    return {d for d, t in count.items() if len(t) == 1}


@pytest.mark.parametrize("which", ["odd", "real"])
def test_bytes(which, request):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    known = ordered(rows)
    same([r for r in suffixarray.without_later_repeats(docs).collect() if r.doc_id in known], [r for r in brute_bytes(rows, 100) if r[0] in known])


@pytest.mark.parametrize(("hot", "often"), [(20_000, 16), (20_000, 2), (3, 16), (40, 1)])
def test_pasted_and_hot(spark, monkeypatch, hot, often):
    """With salted grams, and with prefixes that grow until groups fit."""
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "OFTEN", often)
    rows = pasted(hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(suffixtree.without_repeats(docs, 12, 4).collect(), brute_words(rows, 12))
    same(suffixarray.without_later_repeats(docs, 40, 10).collect(), brute_bytes(rows, 40))


def test_sort_by_hashes():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2, 400)
    begin = rng.integers(0, 360, 300)
    end = begin + rng.integers(0, 41, 300)
    group = rng.integers(0, 4, 300)
    own = suffixarray.Suffixes(values, begin, end, 30, 1)
    got = own.verified(own.sort(group), group)
    want = own.plain(group)
    key = lambda i: (group[i], values[begin[i] : begin[i] + own.size[i]].tolist())
    assert got is not None and [key(i) for i in got[0]] == [key(i) for i in want[0]] and (got[1] == want[1]).all()


def test_collisions_are_caught(monkeypatch):
    """With hashes that all agree, the bytes decide."""
    monkeypatch.setattr(repeats, "between", lambda pre, a, b: np.zeros(len(a), np.uint64))
    values, begin, end = np.array([1, 2, 1, 3, 1, 2]), np.array([0, 2, 4]), np.array([2, 4, 6])
    out = suffixarray.classes(values, begin, end, np.zeros(3, np.int64), 2, 1)
    assert out[1][0] == out[1][1] == out[1][2] >= 0 and out[2][0] == out[2][2] >= 0 and out[2][1] == -1


@pytest.mark.parametrize("order", [suffixtree.nodes, suffixarray.classes])
def test_both_structures_agree_with_slices(order):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 3, 300)
    begin, group = rng.integers(40, 200, 80), rng.integers(0, 3, 80)
    for step in (1, -1):
        end = begin + step * rng.integers(0, 20, 80)
        out = order(values, begin, end, group, 12, step)
        for r in range(13):
            cut = [(group[i], *values[begin[i] : begin[i] + r]) if step == 1 else (group[i], *values[begin[i] - r + 1 : begin[i] + 1][::-1]) for i in range(80)]
            fits = (end - begin) * step >= r
            for i in range(80):
                mates = {j for j in range(80) if fits[j] and cut[j] == cut[i]}
                if not fits[i] or len(mates) == 1:
                    assert out[r][i] == -1 or not fits[i]
                else:
                    assert {j for j in range(80) if fits[j] and out[r][j] == out[r][i]} == mates


def test_tree_nodes():
    """Every internal node is a maximal repeat: its sequences share its depth, and no two of its children the next unit."""
    rng = np.random.default_rng(3)
    units, size = rng.integers(0, 2, (60, 10)), rng.integers(0, 11, 60)
    units[np.arange(10) >= size[:, None]] = -1
    group = rng.integers(0, 2, 60)
    order, inner = suffixtree.tree(units, size, group)
    assert len({(a, b) for a, b, _, _ in inner}) == len(inner)
    for first, last, depth, above in inner:
        own = order[first : last + 1]
        assert len(own) > 1 and above < depth and len({(group[i], *units[i, :depth].tolist()) for i in own}) == 1
        assert depth == 10 or len({(units[i, depth], i if units[i, depth] < 0 else 0) for i in own}) > 1


def test_empty(none):
    assert suffixtree.without_repeats(none).count() == 0 and suffixarray.without_later_repeats(none).count() == 0
