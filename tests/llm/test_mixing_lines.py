import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import pytest

from quirebase.llm import linededup, mixing


def brute_lines(rows):
    total, seen = Counter(), defaultdict(int)
    blank = lambda x: not x.strip(" \t\n\v\f\r")
    for _, t, s in rows:
        total[s] += 1
        for x in set((t or "").split("\n")):
            seen[s, x] += not blank(x)
    bad = {(s, x) for (s, x), n in seen.items() if n >= linededup.MIN_PAGES and n > linededup.RATIO * total[s]}
    out = []
    for d, t, s in rows:
        lines = None if t is None else t.split("\n")
        good = None if t is None else [x for x in lines if (s, x) not in bad]
        out.append((d, None if t is None else "\n".join(good), len(lines or []), len(lines or []) - len(good or [])))
    return out


@pytest.mark.parametrize("which", ["odd", "real"])
def test_lines(which, request, spark):
    docs = request.getfixturevalue(which)
    docs = docs.unionByName(docs.limit(0)) if which == "real" else docs.unionByName(docs.where("source = 'a'").selectExpr("doc_id", "'menu\n' || text || '\n\nfoot' as text", *docs.columns[2:]))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want = brute_lines(rows)
    got = linededup.without_boilerplate(docs, "source").select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert which == "real" or any(w[3] for w in want)  # sf0.001 has too few pages a host for boilerplate


def brute_mix(rows, seed, weights=None):
    size = Counter()
    for _, t, s in rows:
        size[s] += max(1, len((t or "").encode()))
    w = weights if weights is not None else dict.fromkeys(size, 1.0)
    whole = sum(w.get(s, 0.0) for s in size)
    out = Counter()
    for d, t, s in rows:
        rate = sum(size.values()) / whole * w.get(s, 0.0) / size[s]
        parts = max(1, math.ceil(rate / mixing.SPLIT))
        n = 0
        for j in range(parts):
            u = int(hashlib.md5(f"{seed}:{j}:{'null' if d is None else d}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-rate / parts)
            k = 0
            while c <= u and k < 5000:
                k += 1
                p *= rate / parts / k
                c += p
            n += k
        out[d, t, s] += n
    return +out


@pytest.mark.parametrize("which", ["odd", "real"])
@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0, "src1": 2.0, "src0": 0.01}])
def test_mixing(which, weights, request):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = Counter((r.doc_id, r.text, r.source) for r in mixing.mixed(docs, weights).collect())
    assert got == brute_mix(rows, mixing.SEED, weights)


def test_large_mean(spark):
    docs = spark.createDataFrame([(1, "x", "tiny"), (2, "y" * 3000, "big")], "doc_id long, text string, source string")
    out = Counter(r.source for r in mixing.mixed(docs).collect())
    assert 1300 < out["tiny"] < 1700


def test_empty(none):
    assert mixing.mixed(none).count() == 0 and linededup.without_boilerplate(none, "source").count() == 0
