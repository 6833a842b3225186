"""SimHash near-duplicates through Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of at most 23 bits. The binary Golay code (23, 12, 7) is perfect:
every 23-bit word lies within 3 bits of exactly one codeword. A segment's keys are the codewords of itself and of all
its one-bit neighbours (five on average), so two segments that differ in at most one bit share a key. At most 3 errors
in three segments leave at least two segments with at most one error each, so keys are pairs of codewords (24 bits for
each of the three pairs of segments) and no link is lost.

Rows of equal keys meet by sorting, every pair of a key is verified by counting bits, and only a spanning forest of the
links leaves a task. Equal fingerprints were merged before, so a group of copies, however large, is one row. A key with
more than BLOCK fingerprints is handed on unread: it is split by quarters (of four quarters of two fingerprints that
differ in 3 bits or fewer one is equal), and what is still too large by pairs of blocks, one task for each pair. So no
task holds more than a few BLOCK rows of a key, and nothing is lost.

`similar` (the pipeline's stage) wants texts that share 0.8 of their five-word shingles. There two fingerprints of 64
bits may differ in ten or more bits, where Golay keys short enough to meet compare a fixed share of all pairs (see
README). So the fingerprints' links name the first candidates, MinHash bands of the same shingles the others, and every
candidate is verified on the sets.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows are documents of their
own; a component whose doc_ids are all null has component_id null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import components, gathered, shelved, small_batches, unshelved, written

#: Fixed value: the generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Fingerprints of one key that a task compares as they come; keys with more are split first.
BLOCK = 1024
#: Edges that a task holds before it reduces them to a forest; rows that it holds; shingles hashed at once.
PAIRS, ROWS, SHINGLES = 1_000_000, 200_000, 65_536


def _syndrome(words: np.ndarray) -> np.ndarray:
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


def _errors() -> np.ndarray:
    """The error pattern of at most 3 bits for each syndrome."""
    patterns = np.array([sum(1 << i for i in c) for n in range(4) for c in combinations(range(23), n)], np.int64)
    table = np.zeros(2048, np.int64)
    table[_syndrome(patterns)] = patterns
    return table


ERRORS = _errors()


def decode(words: np.ndarray) -> np.ndarray:
    """The index, 0 to 4095, of the codeword nearest to each 23-bit word."""
    return (words ^ ERRORS[_syndrome(words)]) >> 11


def near_codewords(words: np.ndarray, bits: int) -> np.ndarray:
    """(n, bits + 1) codeword indices of each word and its one-bit neighbours; repeats are -1."""
    near = words[:, None] ^ np.array([0, *(1 << i for i in range(bits))], np.int64)
    near = np.sort(decode(near.ravel()).reshape(near.shape), axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    return near


def hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the text's shingles of `width` words, repeats included; A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=False)], np.uint64)


def majority(h: np.ndarray) -> np.ndarray:
    """(64,) booleans, most significant bit first: set in over half of h."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), SHINGLES):
        count += np.unpackbits(h[i : i + SHINGLES].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return 2 * count > len(h)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """Rows (doc_id, fp): fp is the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(np.packbits(majority(hashes(text, width))).tobytes() for text in batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def keyed(nodes: DataFrame) -> DataFrame:
    """nodes (fp long) -> rows (key long, fp): the pairs of codewords by which fingerprints at most 3 bits apart meet."""
    edges = [64 * i // 3 for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in (big.slice(i, 4096) for i in range(0, len(big), 4096)):
                fp = batch.column(0).to_numpy().view(np.uint64)
                words = [((fp >> np.uint64(64 - b)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64) for a, b in zip(edges, edges[1:], strict=False)]
                near = [near_codewords(w, b - a) for w, a, b in zip(words, edges, edges[1:], strict=False)]
                for k, (x, y) in enumerate(combinations(near, 2)):
                    real = (x[:, :, None] >= 0) & (y[:, None, :] >= 0)
                    row = np.nonzero(real)[0]
                    yield pa.record_batch([pa.array(((k << 24) + (x[:, :, None] << 12) + y[:, None, :])[real]), batch.column(0).take(pa.array(row))], ["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64)


def forest(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of the edges a-b of least distances: of two sets of edges, that of both is that of their forests'."""
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), apart))
    a, b, apart = a[order], b[order], apart[order]
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    at, chosen, own = np.arange(len(a)), np.zeros(len(a), bool), np.arange(len(nodes))
    while True:
        live = x != y
        if not live.any():
            return a[chosen], b[chosen], apart[chosen]
        x, y, at = x[live], y[live], at[live]
        first = np.full(len(nodes), len(a))  # of each part: its nearest edge out
        np.minimum.at(first, x, at)
        np.minimum.at(first, y, at)
        best = np.unique(first[first < len(a)])
        chosen[best] = True
        here = np.searchsorted(at, best)
        u, v = x[here], y[here]
        root = own.copy()
        while (root[u] != root[v]).any():
            np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
            while (root != root[root]).any():
                root = root[root]
        x, y = root[x], root[y]


Edges = tuple[np.ndarray, np.ndarray, np.ndarray]


def _in_keys(key: np.ndarray, fp: np.ndarray, within: int) -> Iterator[Edges]:
    """The links among the rows of equal key (sorted): each row against the one 1, 2, ... places behind it."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    left = np.repeat(edge[1:], np.diff(edge)) - np.arange(len(key)) - 1  # rows of the key behind this one
    at, shift = np.flatnonzero(left > 0), 1
    while len(at):
        apart = _apart(fp[at], fp[at + shift])
        close = (apart <= within) & (apart > 0)
        if close.any():
            yield fp[at[close]], fp[at[close] + shift], apart[close]
        shift += 1
        at = at[left[at] >= shift]


def links(keys: DataFrame, within: int, limit: int | None = BLOCK) -> DataFrame:
    """Rows (key, fp) -> rows (a, b, hot): links between fingerprints of equal key, in each task the spanning forest of least
    distances; of keys with more than `limit` rows the rows themselves, as (key, fp, true)."""

    def compact(parts: Iterator[Edges]) -> Iterator[Edges]:
        held: list[Edges] = []
        size = 0
        for part in parts:
            held.append(part)
            size += len(part[0])
            if size > PAIRS:
                held = [forest(*(np.concatenate(z) for z in zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > PAIRS // 2:
                    yield held[0]
                    held, size = [], 0
        if held:
            yield forest(*(np.concatenate(z) for z in zip(*held, strict=True)))

    def rows(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a), pa.array(b), pa.array(np.full(len(a), hot))], ["a", "b", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp, passing = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def settled(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            _, number, count = np.unique(key, return_inverse=True, return_counts=True)
            hot = count[number] > limit if limit is not None else np.zeros(len(key), bool)
            if hot.any():
                yield rows(key[hot], fp[hot], True)
            for a, b, _ in compact(_in_keys(key[~hot], fp[~hot], within)):
                yield rows(a, b, False)

        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if passing is not None and len(key):
                on = int(np.searchsorted(key, passing, side="right"))
                if on:
                    yield rows(key[:on], fp[:on], True)
                key, fp = key[on:], fp[on:]
                passing = passing if not len(key) else None
            held_key, held_fp = np.concatenate([held_key, key]), np.concatenate([held_fp, fp])
            if len(held_key) >= ROWS:
                end = int(np.searchsorted(held_key, held_key[-1]))  # the last key may go on
                yield from settled(held_key[:end], held_fp[:end])
                held_key, held_fp = held_key[end:], held_fp[end:]
                if limit is not None and len(held_key) > limit:
                    passing = int(held_key[0])
                    yield rows(held_key, held_fp, True)
                    held_key, held_fp = held_key[:0], held_fp[:0]
        yield from settled(held_key, held_fp)

    # in one order, so that a task which runs again gives the same rows
    return keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long, hot boolean")


def quartered(hot: DataFrame) -> DataFrame:
    """Rows (key, fp) of too large a key -> four rows each, by a quarter of the bits: of fingerprints at most 3 bits apart one is equal."""
    quarter = F.explode(F.array(*(F.xxhash64("key", F.lit(k), F.shiftright("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4))))
    return hot.select(quarter.alias("key"), "fp")


def celled(rows: DataFrame, item: str, block: int, weight: str | None = None, most: int = 1 << 20) -> DataFrame:
    """rows (key, item, ...) -> the rows of each key once for each pair of blocks that its block is in, so that any two meet in some key.

    Keys with at most `block` rows (and `most` of the weight) stay whole; the others get blocks of about half of it.
    """
    heavy = F.sum(weight) if weight else F.lit(0)
    counts = rows.groupBy("key").agg(F.count("*").alias("many"), heavy.alias("heavy")).where((F.col("many") > block) | (F.col("heavy") > most))
    n = F.coalesce(F.ceil(F.greatest(2 * F.col("many") / block, 2 * F.col("heavy") / most)), F.lit(1)).cast("long")
    own = F.pmod(F.xxhash64(F.lit("block"), item), F.col("blocks"))
    df = rows.join(counts, "key", "left").withColumn("blocks", n).withColumn("own", own)
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return df.withColumn("key", cell).select(*rows.columns)


def linked(nodes: DataFrame, within: int) -> DataFrame:
    """nodes (fp), distinct -> edges (a, b) whose components are those of all pairs at most `within` bits apart."""
    rows, edges = keyed(nodes), []
    for split in (quartered, lambda hot: celled(hot, "fp", BLOCK), None):
        found = written(gathered(links(rows, within, BLOCK if split else None)), "links")
        edges.append(found.where(~F.col("hot")).select("a", "b"))
        hot = found.where("hot").select(F.col("a").alias("key"), F.col("b").alias("fp"))
        if split is None or hot.isEmpty():
            break
        rows = split(hot)
    return reduce(DataFrame.unionByName, edges)


def labelled(nodes: DataFrame, node: str, edges: DataFrame, name: str) -> DataFrame:
    """nodes with a column `name`: the component of each under edges (a, b), itself without any."""
    label = components(edges).select(F.col("node").alias(node), F.col("label").alias(name))
    return nodes.join(label, node, "left").withColumn(name, F.coalesce(name, node))


def grouped(prints: DataFrame, within: int) -> DataFrame:
    """prints (doc_id, fp), written -> rows (doc_id, fp, component_id), components of fingerprints at most `within` bits apart."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = labelled(nodes, "fp", linked(nodes, within), "label")
    least = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    return prints.join(nodes.join(least, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, within: int = 3) -> DataFrame:
    """64-bit fingerprints linked at `within` (3 or fewer) differing bits: rows (doc_id, fingerprint, component_id). Exact."""
    if not 0 <= within <= 3:
        raise ValueError("three segments and one corrected bit each prove links of 3 bits or fewer")
    out = grouped(written(gathered(fingerprints(docs, width)), "simhash"), within)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The stage's similarity, and MinHash: BANDS keys of BAND_ROWS values each. A pair of similarity s shares a key with
#: probability 1 - (1 - s^5)^20: 0.9996 at 0.8.
SIMILAR, BANDS, BAND_ROWS = 0.8, 20, 5
#: A byte of each value makes a sketch of 100. Pairs whose sketches agree on fewer than this many are not looked up: at a
#: similarity of 0.8 that is 6 standard errors below the mean.
SKETCH_LEAST = 56
#: Rounds in which the nodes of a band that are still apart are compared with one of them, another one each round, before all pairs are.
STARS = 1
_ODD = np.random.default_rng(20260101).integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(h: np.ndarray) -> np.ndarray:
    """(BANDS * BAND_ROWS,) least values of as many hash functions over the shingles' hashes."""
    out = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 4096):
        out = np.minimum(out, ((h[i : i + 4096, None] ^ (h[i : i + 4096, None] >> np.uint64(31))) * _ODD).min(axis=0, initial=np.iinfo(np.uint64).max))
    return out


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Two sets of shingles, sorted distinct hashes each, share SIMILAR of their union."""
    z = np.concatenate([x, y])
    z.sort(kind="stable")
    both = int(np.count_nonzero(z[1:] == z[:-1]))
    return both / max(1, len(z) - both) >= SIMILAR


def node_of(h: np.ndarray) -> bytes:
    """What a set of shingles is known by: 128 bits of its content."""
    return xxhash.xxh3_128_digest(h.tobytes())


NODE = "id binary, fp long, n long, bands array<long>, sketch binary"


def shingled(rows: DataFrame) -> DataFrame:
    """rows (text, ...) -> (..., id, fp, n, bands, sketch) of each text's distinct five-word shingles."""
    keep = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fps, ns, bands, sketches = [], [], [], [], []
            for text in batch.column(len(keep)).to_pylist():
                h = np.unique(hashes(text, 5))
                least = minhashes(h)
                ids.append(node_of(h))
                fps.append(int.from_bytes(np.packbits(majority(h)).tobytes(), "big", signed=True))
                ns.append(len(h))
                bands.append([xxhash.xxh3_64_intdigest(v.tobytes(), i) - 2**63 for i, v in enumerate(least.reshape(BANDS, BAND_ROWS))])
                sketches.append((least >> np.uint64(56)).astype(np.uint8).tobytes())
            cols = [pa.array(ids, pa.binary()), pa.array(fps, pa.int64()), pa.array(ns, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.record_batch([*batch.columns[: len(keep)], *cols], [*keep, "id", "fp", "n", "bands", "sketch"])

    small_batches(rows.sparkSession)
    named = ", ".join(f"{c} {t}" for c, t in rows.select(*keep).dtypes)
    return rows.select(*keep, "text").mapInArrow(run, f"{named}, {NODE}")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """texts (text) -> (id, grams): the sets themselves, each once for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(hashes(text, 5)) for text in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array([node_of(h) for h in sets], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())], ["id", "grams"])

    return texts.select("text").mapInArrow(run, "id binary, grams binary")


def fits(a: str, b: str) -> Column:
    """By size alone two sets may be similar."""
    return F.least(a, b) >= SIMILAR * F.greatest(a, b)


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ([np.frombuffer(g, np.uint64) for g in batch.column(c).to_pylist()] for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array([alike(x, y) for x, y in zip(*sets, strict=True)], pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    return both.select("a", "b", "ga", "gb").mapInArrow(run, "a binary, b binary")


def across(rows: DataFrame) -> DataFrame:
    """rows (key, at, id, n, label, sketch, bands, grams) -> similar pairs (a, b) of equal key and different label, in each task as many as
    join the labels that they join. A pair is looked at in the first band that it shares, if its sizes and sketches allow the similarity."""
    names = ["key", "at", "id", "n", "label", "sketch", "bands", "grams"]

    def candidates(key: np.ndarray, at: np.ndarray, n: np.ndarray, label: np.ndarray, sketch: np.ndarray, bands: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        left = np.repeat(edge[1:], np.diff(edge)) - np.arange(len(key)) - 1
        own, shift = np.flatnonzero(left > 0), 1
        while len(own):
            other = own + shift
            some = (label[own] != label[other]) & (np.minimum(n[own], n[other]) >= SIMILAR * np.maximum(n[own], n[other]))
            x, y = own[some], other[some]
            near = (sketch[x] == sketch[y]).sum(axis=1) >= SKETCH_LEAST
            x, y = x[near], y[near]
            first = bands[x, (bands[x] == bands[y]).argmax(axis=1)] == at[x]
            yield x[first], y[first]
            shift += 1
            own = own[left[own] >= shift]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, weight = 0, 0

        def out(part: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(part).combine_chunks()
            key, at, n = (t.column(i).to_numpy() for i in (0, 1, 3))
            label = np.unique(np.array([*t.column(4).to_pylist(), b""], object), return_inverse=True)[1][:-1]
            sketch = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint8).reshape(len(t), -1)
            bands = t.column(6).combine_chunks().flatten().to_numpy().reshape(len(t), -1)
            ids, grams = t.column(2).to_pylist(), t.column(7).to_pylist()
            up = list(range(int(label.max(initial=-1)) + 1))

            def root(i: int) -> int:
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = up[i]
                return i

            pairs = []
            for xs, ys in candidates(key, at, n, label, sketch, bands):
                for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                    p, q = root(label[x]), root(label[y])
                    if p != q and alike(np.frombuffer(grams[x], np.uint64), np.frombuffer(grams[y], np.uint64)):
                        up[q] = p
                        pairs.append((ids[x], ids[y]))
            return pa.record_batch([pa.array(c, pa.binary()) for c in (zip(*pairs, strict=True) if pairs else [[], []])], ["a", "b"])

        for big in batches:
            for batch in (big.slice(i, 256) for i in range(0, len(big), 256)):
                held.append(batch)
                rows += len(batch)
                weight += int(batch.column(3).to_numpy().sum())
                if rows >= 4 * BLOCK or weight >= 4 << 20:
                    key = batch.column(0).to_numpy()
                    end = int(np.searchsorted(key, key[-1]))  # the last key may go on; cells keep it small
                    if end:
                        yield out([*held[:-1], batch.slice(0, end)])
                        held, rows, weight = [batch.slice(end)], len(batch) - end, int(batch.column(3).to_numpy()[end:].sum())
        if held:
            yield out(held)

    return rows.repartition("key").sortWithinPartitions("key").select(*names).mapInArrow(run, "a binary, b binary")


def similar(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with at least a word each -> (doc_id, t1, t2, id, component): components of texts that share 0.8
    of their five-word shingles. t1 and t2 are hashes of the text, id and component 128-bit names of sets of shingles.

    A node is a set of shingles. Candidates are pairs with fingerprints in one component of at most 3 bits (the operator's
    links) and pairs that share a MinHash band. First every node is compared with the least node of each of its
    groups, then with another that a hash chooses, which joins groups of copies without looking at all their pairs; then, in
    bands whose nodes are still in different components, all pairs across these are, where the sets lie. What comes out is the components of all similar candidates, however
    the rows are dealt out.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("other"), "text").alias("t2"), F.col("text").cast("string"))
    prints = written(shingled(rows), "shingled")
    first = (F.any_value(c).alias(c) for c in ("fp", "n", "bands", "sketch"))
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("row")
    nodes = written(prints.groupBy("id").agg(*first, row), "nodes")

    fps = written(nodes.select("fp").distinct(), "fps")
    by_fp = nodes.select("id", "n", "fp").join(labelled(fps, "fp", linked(fps, 3), "at"), "fp").select("at", "id", "n")
    by_band = nodes.select(F.explode("bands").alias("at"), "id", "n")
    several = lambda rows: rows.groupBy("at").agg(F.count("*").alias("many"), F.min(F.struct("id", "n")).alias("least")).where("many > 1")
    band = written(by_band.join(several(by_band), "at").select("at", "id", "n", "least"), "bands")
    stars = by_fp.join(several(by_fp), "at").select("id", "n", "least").unionByName(band.select("id", "n", "least"))
    stars = stars.where(F.col("id") != F.col("least.id")).where(fits("n", "least.n")).select(F.least("id", "least.id").alias("a"), F.greatest("id", "least.id").alias("b")).distinct()
    stars = written(stars, "stars")

    wanted = band.select("id").union(stars.select("a")).union(stars.select("b")).distinct()
    texts = nodes.select("id", "row").join(wanted, "id", "left_semi").select("row.none", F.coalesce("row.doc_id", F.lit(0)).alias("known"), "row.t1", "row.t2")
    keyed_rows = rows.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("known"), "t1", "t2", "text")
    sets = written(shingle_sets(keyed_rows.join(texts, ["none", "known", "t1", "t2"], "left_semi")).dropDuplicates(["id"]), "sets")

    near = written(checked(stars, sets), "near")
    for again in range(1, STARS + 1):
        at = written(labelled(nodes.select("id"), "id", near, "label"), "parts")
        member = band.select("at", "id", "n").join(at, "id")
        centre = F.min_by(F.struct("id", "n", "label"), F.struct(F.xxhash64(F.lit(again), "id"), "id")).alias("centre")
        apart = member.groupBy("at").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), centre).where("lo <> hi").select("at", "centre")
        open_ = written(member.join(apart, "at"), "open")
        more = open_.where(F.col("label") != F.col("centre.label")).where(fits("n", "centre.n"))
        more = more.select(F.least("id", "centre.id").alias("a"), F.greatest("id", "centre.id").alias("b")).distinct()
        tried = written(more.join(stars, ["a", "b"], "left_anti"), "more")
        found = written(checked(tried, sets), "near")
        if found.isEmpty():
            break
        near, stars = near.unionByName(found), stars.unionByName(tried)
    else:
        at = written(labelled(nodes.select("id"), "id", near, "label"), "parts")
        member = band.select("at", "id", "n").join(at, "id")
        apart = member.groupBy("at").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("at")
        open_ = written(member.join(apart, "at"), "open")
    last = celled(open_.select(F.col("at").alias("key"), "at", "id", "n", "label"), "id", BLOCK, "n")
    last = last.join(nodes.select("id", "sketch", "bands"), "id").join(sets, "id")
    found = written(across(last), "near")
    if not found.isEmpty():
        at = labelled(nodes.select("id"), "id", near.unionByName(found), "label")
    return prints.select("doc_id", "t1", "t2", "id").join(at.select("id", F.col("label").alias("component")), "id").select("doc_id", "t1", "t2", "id", "component")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: of each group of `similar` one row stays, that of the least doc_id (a null one
    is the greatest; of several rows with it that of the least text hash; of equal texts with it any one).

    Texts without a word have nothing to compare and stay. So of a group whose doc_ids are all null one row stays, and of two
    different texts with one doc_id each is judged in its own group.
    """
    docs, names = shelved(docs, "doc_id", "text")
    some = F.length(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")) > 0
    found = written(similar(docs.where(some)), "similar")
    stay = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("row")).select("row.*")
    key = [F.col("doc_id").cast("long").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64("text"), F.xxhash64(F.lit("other"), "text")]
    names_of = ["k0", "k1", "k2", "k3"]
    own = docs.where(some).select("*", *(c.alias(k) for c, k in zip(key, names_of, strict=True)))
    again = found.groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("rows")).where("rows > 1")
    again = written(again.select(F.col("doc_id").isNull().alias("k0"), F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("t1").alias("k2"), F.col("t2").alias("k3")), "again")
    stay = stay.select(F.col("none").alias("k0"), F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("t1").alias("k2"), F.col("t2").alias("k3"))
    if again.isEmpty():
        kept = own.join(stay, names_of, "left_semi").select(*docs.columns)
    else:
        repeated = stay.join(again, names_of, "left_semi")
        kept = own.join(stay.join(again, names_of, "left_anti"), names_of, "left_semi").select(*docs.columns)
        one = Window.partitionBy(*names_of).orderBy(F.lit(0))
        kept = kept.unionByName(own.join(repeated, names_of, "left_semi").withColumn("nth", F.row_number().over(one)).where("nth = 1").select(*docs.columns))
    return unshelved(kept.unionByName(docs.where(~some)), names)
