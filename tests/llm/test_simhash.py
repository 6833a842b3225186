import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from quirebase.llm import simhash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def joined(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("which", ["odd", "real"])
def test_against_brute_force(which, request):
    docs = request.getfixturevalue(which)
    rows = docs.collect()
    fps = {(r.doc_id, r.text): fingerprint(r.text) for r in rows}
    comp = joined(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(lambda: None)
    for (d, _), f in fps.items():
        if d is not None:
            least[comp[f]] = d if least[comp[f]] is None else min(d, least[comp[f]])
    want = sorted(str((r.doc_id, f"{fps[r.doc_id, r.text]:016x}", least[comp[fps[r.doc_id, r.text]]])) for r in rows)
    assert want == sorted(str(tuple(r)) for r in simhash.near_duplicates(docs).collect())


def test_golay_is_perfect():
    words = np.random.default_rng(1).integers(0, 2**23, 2000)
    assert (np.bitwise_count(simhash.ERRORS) <= 3).all() and len(set(simhash.ERRORS.tolist())) == 2048
    for bit in range(23):
        a, b = simhash.near_codewords(words, 23), simhash.near_codewords(words ^ (1 << bit), 23)
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a[:200], b[:200], strict=True))


def signed(f):
    return f - 2**64 if f >> 63 else f


@pytest.mark.parametrize("block", [4, 16, 1024])
def test_links_lose_nothing(spark, monkeypatch, block):
    """Random fingerprints with planted chains, and keys with more rows than a block: split by quarters, then by cells."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash.links, "__defaults__", (block,))
    monkeypatch.setattr(simhash, "ROWS", 500)
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:60]:
        for _ in range(4):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(f)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << b) ^ (1 << c) for b in range(12) for c in range(12)}
    prints = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(sorted(fps))], "doc_id long, fp long").repartition(4)
    got = defaultdict(set)
    for r in simhash.grouped(prints, 3).collect():
        got[r.component_id].add(r.fp % 2**64)
    want = defaultdict(set)
    for n, c in joined(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 3).items():
        want[c].add(n)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_narrow_tables_take_few_files(spark, sf, monkeypatch):
    """Many tasks make fingerprints and links, but they don't leave a file each."""
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    before, tables, write = {k: spark.conf.get(k) for k in settings}, [], simhash.written

    def kept(df, name):
        tables.append((name, write(df, name)))
        return tables[-1][1]

    monkeypatch.setattr(simhash, "written", kept)
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(24)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert simhash.near_duplicates(docs).count() == docs.count()
        files = [(name, len(t.inputFiles())) for name, t in tables if name in ("simhash", "links")]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {name for name, _ in files} == {"simhash", "links"} and all(n <= 2 for _, n in files), files


def test_components_of_a_sorted_path(spark):
    """A path of ascending ids ends in one component after a few rounds."""
    from quirebase.llm.shared import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(3000)] + [(5000, 5001), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(3001), 0), 5000: 5000, 5001: 5000}


def test_stage_keeps_one_of_each_group(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(900)]
    rows, group = [], {}
    for i in range(60):
        text = [rng.choice(words) for _ in range(300)]
        for j in range(3):
            copy = list(text)
            for _ in range(j):
                copy[rng.randrange(300)] = "edited"
            rows.append((10 * i + j, " ".join(copy)))
            group[10 * i + j] = i
    out = simhash.deduplicated(spark.createDataFrame(rows + rows[:5], "doc_id long, text string"))
    kept = [r.doc_id for r in out.collect()]
    assert len(kept) == len(set(kept)) and {group[d] for d in kept} == set(range(60)) and len(kept) <= 63


def sets_of(rows):
    return {d: frozenset(simhash.hashes(t, 5).tolist()) for d, t in rows}


def share(x, y):
    return len(x & y) >= 0.8 * len(x | y)


@pytest.mark.parametrize("partitions", ["4", "64"])
def test_similar_texts_against_brute_force(spark, sf, partitions):
    """The components of all similar pairs, the same at any number of partitions."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(trim(text)) > 0")
    sets = sets_of([(r.doc_id, r.text) for r in docs.collect()])
    comp = joined(sorted(sets), lambda a, b: share(sets[a], sets[b]))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.doc_id: r.component for r in simhash.similar(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len({(comp[d], bytes(got[d])) for d in sets}) == len(set(comp.values())) == len({bytes(c) for c in got.values()})


def test_least_forest():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n, m = rng.integers(2, 30), rng.integers(1, 120)
        a, b, w = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 9, m)
        root, want, count = list(range(n)), 0, 0

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for d, x, y in sorted(zip(w.tolist(), a.tolist(), b.tolist(), strict=True)):
            if find(x) != find(y):
                root[find(x)] = find(y)
                want, count = want + d, count + 1
        x, y, d = simhash.forest(a, b, w)
        assert len(x) == count and d.sum() == want
        assert {(i, j, k) for i, j, k in zip(x, y, d, strict=True)} <= {(i, j, k) for i, j, k in zip(a, b, w, strict=True)}
    assert [len(z) for z in simhash.forest(*(np.zeros(0, np.int64) for _ in range(3)))] == [0, 0, 0]


def test_odd_and_empty(odd, none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicated(none).count() == 0
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (7, 8, 9)").count() == 1


@pytest.mark.parametrize("block", [8, 1024])
def test_stage_looks_at_every_candidate(spark, monkeypatch, block):
    """Templated pages, many of them just under the similarity: the components are those of all similar pairs, in bands split into cells too."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(11)
    rows = []
    for _ in range(12):
        base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
        for i in range(16):
            text = list(base)
            for at in rng.sample(range(8, 192), 2 + i % 3):
                text[at] = "x" + str(rng.random())
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = sets_of(rows)
    comp = joined(sorted(sets), lambda a, b: share(sets[a], sets[b]))
    got = {r.doc_id: bytes(r.component) for r in simhash.similar(docs).collect()}
    assert len({(comp[d], got[d]) for d in sets}) == len(set(comp.values())) == len(set(got.values()))


def test_null_and_shared_ids(spark):
    """Of copies without an id one stays; of two texts with one id each is judged in its own group."""
    rng = random.Random(13)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b, c = say(100), say(100), say(100)
    rows = [(None, a), (None, a + " end"), (None, a), (5, b), (5, c), (3, c + " end"), (9, b), (None, ""), (4, None), (9, b)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, _stay string, component string").repartition(3)
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    (own,) = [r for r in kept if r[0] is None and r[1]]
    assert own[1] in (a, a + " end") and sorted([r for r in kept if r != own], key=str) == sorted([(5, b), (3, c + " end"), (None, ""), (4, None)], key=str)


def test_stage_compares_sets(spark):
    """A word repeated over most of a text doesn't make different texts copies; unequally repeated passages don't keep copies apart."""
    rng = random.Random(12)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    rows = [(i, "spam " * 900 + say(120)) for i in range(4)]
    p, q = say(60), say(60)
    rows += [(10, " ".join([p] * 9 + [q])), (11, " ".join([p] + [q] * 9 + [p, q])), (12, p + " " + q)]
    got = {r.doc_id: bytes(r.component) for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({got[i] for i in (0, 1, 2, 3, 10)}) == 5 and got[10] == got[11] == got[12]
