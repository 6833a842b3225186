"""What substring dedup by suffix trees and by suffix arrays share: sparse suffixes at content-defined anchors.

A window is L consecutive units (words or bytes) of one document. Of the grams of K units in a window the one of least
hash (the leftmost of equal ones) is the window's anchor, so equal windows have equal anchors at equal offsets, and
only the suffixes that begin at anchors (one unit in (L - K + 2) / 2) have to be compared. The steps:

1. scan: every document's anchors, each with the range of windows that it stands for;
2. anchors by gram hash: exact copies of a text collapse to the first of them, anchors that occur once go;
3. the documents with anchors left give the text around these: at most 2L - K units each;
4. by gram hash again, in runs that fit in memory, the suffix structure (tree or array) of the text to the right of the
   anchors and of the reversed text to the left says which anchors agree how far. Two windows are equal if they agree
   on L - d units to the right and d to the left of their anchors;
5. the runs of repeated windows go back to their documents, which drop the units that these cover.

Gram hashes only choose what is compared; in groups that fit in memory the text itself decides whether windows are equal
(whole copies of a text are known by 128 bits of hash). A gram that a task meets often is salted by the text's hash before
anything is shuffled. The prefix that deals a suffix out is as long as the counts ask for: the gram; for a gram with more
than HOT distinct anchors (in suffix trees) all the units that the windows of one half of the distances to the anchor have in
common; and where more than HOT share those too, as in a passage that very many documents have, the whole window: a deep node whose
leaves are only counted, map-side first, by 128 bits of hash.
The filter of step 3 that keeps other documents' texts out of the shuffle has at most BLOOM bits at any size of corpus;
its false positives only cost time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import removed, small_batches, written

HOT = 20_000
BLOOM = 1 << 25
#: A gram that a task has met so often is salted; counters are shared by grams of equal leading bits, which only salts more.
OFTEN, SALTS, COUNTERS = 64, 1024, 1 << 20
#: Units hashed at once, leaves compared at once.
SPAN, LEAVES = 1 << 18, 30_000
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


BYTE = mixed(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
#: An odd base and its inverse modulo 2^64.
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 2**64)
_POWERS: dict[int, list[np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse."""
    if not _POWERS or len(_POWERS[0][0]) <= n:
        size = max(n + 1, 1 << 16)
        ladder = []
        for b in (BASE, INVERSE):
            p = np.full(size, b, _U)
            p[0] = 1
            ladder.append(np.multiply.accumulate(p))
        _POWERS[0] = ladder
    return _POWERS[0][0], _POWERS[0][1]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes, one longer than values."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def between(pre: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of values[a:b], whatever stands before."""
    return (pre[b] - pre[a]) * powers(len(pre))[1][a]


class Bytes:
    """Documents as UTF-8 bytes."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram

    def load(self, text: str | None) -> tuple[bytes, np.ndarray | None]:
        return (text or "").encode("utf-8", "surrogatepass"), None

    def count(self, doc) -> int:
        return len(doc[0])

    def hashes(self, doc, a: int, b: int) -> np.ndarray:
        return BYTE[np.frombuffer(doc[0], np.uint8, b - a, a)]

    def cut(self, doc, a: int, b: int) -> bytes:
        return doc[0][a:b]

    def cut_loaded(self, cut: bytes) -> tuple[bytes, np.ndarray | None]:
        return cut, None

    def kept(self, doc, gone: np.ndarray) -> bytes:
        return np.frombuffer(doc[0], np.uint8)[~gone].tobytes()

    def units(self, cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All cuts' units as numbers, and where each cut ends."""
        return np.frombuffer(b"".join(cuts), np.uint8).astype(np.int64), np.cumsum([len(c) for c in cuts])


class Words:
    """Documents as words: runs of bytes other than space and \\x09 to \\x0d."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram

    def load(self, text: str | None) -> tuple[bytes, np.ndarray]:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        return b" ".join(words), np.concatenate([[0], ends])

    def count(self, doc) -> int:
        return len(doc[1]) - 1

    def hashes(self, doc, a: int, b: int) -> np.ndarray:
        at = doc[1][a : b + 1]
        pre = prefix(BYTE[np.frombuffer(doc[0], np.uint8, int(at[-1] - at[0] - 1), int(at[0]))])
        at = at - at[0]
        return mixed(between(pre, at[:-1], at[1:] - 1))

    def cut(self, doc, a: int, b: int) -> bytes:
        return doc[0][doc[1][a] : doc[1][b] - 1]

    def cut_loaded(self, cut: bytes) -> tuple[bytes, np.ndarray | None]:
        spaces = np.flatnonzero(np.frombuffer(cut, np.uint8) == 32)
        return cut, np.concatenate([[0], spaces + 1, [len(cut) + 1]])

    def kept(self, doc, gone: np.ndarray) -> bytes:
        words = doc[0].split(b" ") if doc[0] else []
        return b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])

    def units(self, cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [c.split(b" ") for c in cuts]
        number: dict[bytes, int] = {}
        flat = [number.setdefault(w, len(number)) for c in words for w in c]
        return np.array(flat, np.int64), np.cumsum([len(c) for c in words])


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive keys."""
    size = 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    rest = width - size
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


def anchors(unit, docs: list) -> Iterator[tuple[np.ndarray, ...]]:
    """(document index, gram hash, anchor, lo, hi): the windows from anchor - hi to anchor - lo have this anchor."""
    size, gram = unit.window, unit.gram
    jobs = []  # (document, first unit, end): stretches with whole windows, overlapping by a window less one
    for i, d in enumerate(docs):
        n = unit.count(d)
        jobs += [(i, a, min(n, a + SPAN + size - 1)) for a in range(0, n - size + 1, SPAN)]
    part: list[tuple[int, int, int]] = []
    held = 0
    for job in [*jobs, None]:
        if job is not None:
            part.append(job)
            held += job[2] - job[1]
            if held < SPAN:
                continue
        if not part:
            continue
        length = np.array([b - a for _, a, b in part])
        begin = np.cumsum(length) - length
        values = np.concatenate([unit.hashes(docs[i], a, b) for i, a, b in part])
        pre = prefix(values)
        at = np.arange(len(values) - gram + 1)
        hashed = mixed(between(pre, at, at + gram))
        least = sliding_least((hashed & _U(0xFFFFFFFF00000000)) | at.astype(_U), size - gram + 1)
        owner = np.repeat(np.arange(len(part)), length)[: len(least)]
        start = np.arange(len(least))
        real = start + size <= (begin + length)[owner]
        start, owner = start[real], owner[real]
        anchor = (least[real] & _U(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
        last = np.append(first[1:], len(anchor)) - 1
        a, own = anchor[first], owner[first]
        shift = np.array([p[1] for p in part])[own] - begin[own]
        yield np.array([p[0] for p in part])[own], hashed[a], a + shift, a - start[last], a - start[first]
        part, held = [], 0


#: An anchor's place in one number: unit position, then lo and hi of the windows it stands for.
def packed(pos: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return pos << 20 | lo << 10 | hi


def unpacked(loc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return loc >> 20, loc >> 10 & 1023, loc & 1023


def verdicts(unit, order: Callable, cuts: list[bytes], group: np.ndarray, lo: np.ndarray, hi: np.ndarray, first_stays: bool) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, d) of the windows, d units before their leaf's anchor, that are repeated.

    Leaves come in the order that says which of equal windows is the first. order(values, ends, group, depth) tells how
    far sequences agree: out[r] has equal numbers >= 0 where the first r values (and the group) are equal and shared.
    """
    values, ends = unit.units(cuts)
    begin = ends - np.diff(np.concatenate([[0], ends]))
    right = order(values, begin + hi, ends, group, unit.window, 1)
    left = order(values, begin + hi - 1, begin - 1, group, int(hi.max(initial=0)), -1)
    leaves, offsets = [], []
    for d in range(int(lo.min(initial=0)), int(hi.max(initial=-1)) + 1):
        r, l = right[unit.window - d], left[d]
        own = np.flatnonzero((lo <= d) & (d <= hi) & (r >= 0) & (l >= 0))
        if not len(own):
            continue
        key = r[own].astype(np.int64) << 32 | l[own]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        again = np.concatenate([[False], same])
        if not first_stays:
            again[:-1] |= same
        leaves.append(own[by[again]])
        offsets.append(np.full(int(again.sum()), d))
    if not leaves:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(leaves), np.concatenate(offsets)


def in_runs(did: np.ndarray, t1: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Consecutive window starts as (did, t1, start, windows)."""
    by = np.lexsort((start, t1, did))
    did, t1, start = did[by], t1[by], start[by]
    new = np.concatenate([[True], (did[1:] != did[:-1]) | (t1[1:] != t1[:-1]) | (start[1:] > start[:-1] + 1)]) if len(by) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(by)) - 1 if len(first) else first
    return pa.record_batch([pa.array(did[first]), pa.array(t1[first]), pa.array(start[first]), pa.array(start[last] - start[first] + 1)], ["did", "t1", "start", "windows"])


SPANS = "did long, t1 long, start long, windows long"


def repeated(docs: DataFrame, unit, order: Callable, first_stays: bool, halves: bool) -> DataFrame:
    """documents -> (doc_id, n, n_removed, n_spans, kept_sha256): units without those that repeated windows cover.

    first_stays: the first occurrence (least doc_id, then earliest start) is no repetition; else every occurrence is.
    halves: between the gram and the whole window, prefixes are tried that half of an anchor's windows share.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumns({"did": F.coalesce("doc_id", F.lit(-(2**63))), "t1": F.xxhash64("text")})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, told = np.zeros(COUNTERS, np.int32), set()
        names = ["h", "salt", "did", "t1", "loc"]
        for batch in batches:
            did, t1 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            loaded = [unit.load(t) for t in batch.column(2).to_pylist()]
            for i, h, pos, lo, hi in anchors(unit, loaded):
                at = (h >> _U(64 - COUNTERS.bit_length() + 1)).astype(np.int64)
                np.add.at(met, at, 1)
                salt = np.where(met[at] >= OFTEN, 1 + (t1[i] & (SALTS - 1)), 0)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(salt), pa.array(did[i]), pa.array(t1[i]), pa.array(packed(pos, lo, hi))], names)
                new = set(np.unique(h[salt > 0]).view(np.int64).tolist()) - told
                if new:  # tells the unsalted rows of the gram that it has others
                    told |= new
                    none = pa.array(np.zeros(len(new), np.int64))
                    yield pa.record_batch([pa.array(sorted(new)), none, none, none, pa.array(np.full(len(new), -1))], names)

    found = rows.select("did", "t1", "text").mapInArrow(find, "h long, salt long, did long, t1 long, loc long")
    one = Window.partitionBy("h", "salt").orderBy("t1", "loc", "did")
    found = found.withColumn("copy", F.lag("t1").over(one).eqNullSafe(F.col("t1")) & F.lag("loc").over(one).eqNullSafe(F.col("loc"))).where(~F.col("copy"))
    group = Window.partitionBy("h", "salt")
    found = found.withColumns({"n": F.count("*").over(group), "often": F.min("loc").over(group) < 0}).where("(n > 1 or salt > 0) and loc >= 0")
    anchored = written(found.select("h", "did", "t1", "loc", (F.col("often") | (F.col("salt") > 0)).alias("often")), "anchors")
    # An anchor of a salted gram may have come unsalted too, from another task.
    once = anchored.where("often").groupBy("h", "t1", "loc").agg(F.min("did").alias("did")).select("h", "did", "t1", "loc")
    found = anchored.where("not often").select("h", "did", "t1", "loc").unionByName(once)
    hot = found.groupBy("h").agg(F.count("*").alias("all")).where(f"all > {HOT}")
    hot = written(hot, "hot")
    found = found.join(hot.select("h", F.lit(True).alias("hot")), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    marks = written(found.groupBy("did", "t1").agg(F.collect_list(F.struct("h", "loc", "hot")).alias("at")), "marks")
    removed(anchored, hot)

    hot_marks = marks.where(F.exists("at", lambda a: a["hot"]))
    total = marks.count()
    bits = 1 << max(16, min((16 * total).bit_length(), BLOOM.bit_length() - 1))
    bit = F.explode(F.array(F.pmod(F.xxhash64("did"), F.lit(bits)), F.pmod(F.xxhash64(F.lit(1), "did"), F.lit(bits))))
    words = marks.select(bit.alias("i")).groupBy(F.shiftright("i", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("b")).toArrow()
    bloom = np.zeros(bits // 64, np.int64)
    bloom[words["w"].to_numpy()] = words["b"].to_numpy()

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The text goes on only where the filter says that it may be needed; else its digest is final."""
        for batch in batches:
            maybe = np.ones(len(batch), bool)
            for c in (4, 5):
                i = batch.column(c).to_numpy()
                maybe &= (bloom[i >> 6] >> (i & 63) & 1).astype(bool)
            texts, n, digest = [], [], []
            for t, m in zip(batch.column(3).to_pylist(), maybe.tolist(), strict=True):
                doc = unit.load(t)
                n.append(unit.count(doc))
                texts.append(t if m else None)
                digest.append(None if m else hashlib.sha256(doc[0]).hexdigest())
            yield pa.record_batch([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "did", "t1", "text", "n", "whole"])

    sorted_out = rows.select("doc_id", "did", "t1", "text", F.pmod(F.xxhash64("did"), F.lit(bits)).alias("b1"), F.pmod(F.xxhash64(F.lit(1), "did"), F.lit(bits)).alias("b2"))
    sorted_out = sorted_out.mapInArrow(sort_out, "doc_id long, did long, t1 long, text string, n long, whole string")
    again = Window.partitionBy("did", "t1").orderBy("n")
    shelf = sorted_out.withColumn("nth", F.row_number().over(again))

    def cut(hot: bool, make: Callable, schema: str) -> DataFrame:
        """The text around each anchor of the documents, once for repeated rows."""
        own = marks.select("did", "t1", F.filter("at", lambda a: a["hot"] == F.lit(hot)).alias("at")).where(F.size("at") > 0)
        own = own.select("did", "t1", F.transform("at", lambda a: a["h"]).alias("h"), F.transform("at", lambda a: a["loc"]).alias("loc"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                did, t1 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                hs, locs = batch.column(3), batch.column(4)
                sizes = np.diff(hs.offsets.to_numpy())
                h, loc = hs.flatten().to_numpy(), locs.flatten().to_numpy()
                row = np.repeat(np.arange(len(batch)), sizes)
                pos, lo, hi = unpacked(loc)
                loaded = [unit.load(t) for t in batch.column(2).to_pylist()]
                for i in range(0, len(row), LEAVES):
                    s = slice(i, i + LEAVES)
                    cuts = [unit.cut(loaded[r], a, b) for r, a, b in zip(row[s].tolist(), (pos - hi)[s].tolist(), (pos + unit.window - lo)[s].tolist(), strict=True)]
                    yield make(h[s], did[row[s]], t1[row[s]], loc[s], cuts)

        joined = shelf.where("nth = 1").join(own, ["did", "t1"]).select("did", "t1", "text", "h", "loc")
        return joined.mapInArrow(run, schema)

    def leaf(h, did, t1, loc, cuts) -> pa.RecordBatch:
        return pa.record_batch([pa.array(h), pa.array(did), pa.array(t1), pa.array(loc), pa.array(cuts, pa.binary())], ["h", "did", "t1", "loc", "cut"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(part: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(part).combine_chunks()
            h, did, t1, loc = (t.column(i).to_numpy() for i in range(4))
            pos, lo, hi = unpacked(loc)
            by = np.lexsort((pos, t1, did))
            cuts = t.column(4).to_pylist()
            cuts = [cuts[i] for i in by.tolist()]
            group = np.unique(h[by], return_inverse=True)[1]
            at, d = verdicts(unit, order, cuts, group, lo[by], hi[by], first_stays)
            return in_runs(did[by][at], t1[by][at], pos[by][at] - d)

        for big in batches:
            for batch in (big.slice(i, LEAVES) for i in range(0, len(big), LEAVES)):
                held.append(batch)
                rows += len(batch)
                if rows >= LEAVES:
                    h = batch.column(0).to_numpy()
                    end = int(np.flatnonzero(h == h[-1])[0])  # the last group may go on
                    if end or (len(held) > 1 and held[-2].column(0)[-1].as_py() != int(h[0])):
                        yield flush([*held[:-1], batch.slice(0, end)])
                        held, rows = [batch.slice(end)], len(batch) - end
        if held:
            yield flush(held)

    schema = "h long, did long, t1 long, loc long, cut binary"

    def judged(leaves: DataFrame) -> DataFrame:
        return leaves.repartition("h").sortWithinPartitions("h").mapInArrow(judge, SPANS)

    def halved(leaves: DataFrame, width: int) -> DataFrame:
        """Each leaf once for every `width` of its windows' distances to the anchor, dealt by the units these windows share."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for batch in (big.slice(i, 4096) for i in range(0, len(big), 4096)):
                    out = []
                    pos, lo, hi = (x.tolist() for x in unpacked(batch.column(3).to_numpy()))
                    for j, (h, did, t1, c) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True)):
                        doc = unit.cut_loaded(c)
                        for x in range(lo[j] // width * width, hi[j] + 1, width):
                            a, b = max(lo[j], x), min(hi[j], x + width - 1)
                            shared = unit.cut(doc, hi[j] - x, hi[j] + unit.window - x - width + 1)
                            key = hashlib.blake2b(shared, digest_size=8, salt=(h % 2**64).to_bytes(8, "big") + x.to_bytes(8, "big")).digest()
                            loc = int(packed(np.int64(pos[j]), np.int64(a), np.int64(b)))
                            out.append((int.from_bytes(key, "big", signed=True), did, t1, loc, unit.cut(doc, hi[j] - b, hi[j] + unit.window - a)))
                    yield leaf(*(list(c) for c in (zip(*out, strict=True) if out else [[]] * 5)))

        return leaves.mapInArrow(run, schema)

    def windows_of(h, did, t1, loc, cuts) -> pa.RecordBatch:
        out = []
        pos, lo, hi = (x.tolist() for x in unpacked(loc))
        for j, (d, t, c) in enumerate(zip(did.tolist(), t1.tolist(), cuts, strict=True)):
            doc = unit.cut_loaded(c)
            for i in range(hi[j] - lo[j] + 1):
                digest = hashlib.blake2b(unit.cut(doc, i, i + unit.window), digest_size=16).digest()
                out.append((int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), d, t, pos[j] - hi[j] + i))
        return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], ["w1", "w2", "did", "t1", "start"])

    def one_window_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in (big.slice(i, 4096) for i in range(0, len(big), 4096)):
                yield windows_of(*(batch.column(i).to_numpy() for i in range(4)), batch.column(4).to_pylist())

    spans = judged(cut(False, leaf, schema))
    if not hot_marks.isEmpty():
        window_schema = "w1 long, w2 long, did long, t1 long, start long"
        if halves:
            leaves = written(halved(cut(True, leaf, schema), (1 << (unit.window - unit.gram).bit_length()) // 2), "leaves")
            large = written(leaves.groupBy("h").agg(F.count("*").alias("n")).where(f"n > {HOT}").select("h"), "large")
            spans = spans.unionByName(judged(leaves.join(large, "h", "left_anti")))
            windows = leaves.join(large, "h", "left_semi").mapInArrow(one_window_each, window_schema)
        else:
            windows = cut(True, windows_of, window_schema)
        least = windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(F.struct("did", "t1", "start")).alias("first")).where("n > 1")
        again = windows.join(least, ["w1", "w2"])
        if first_stays:
            again = again.where(F.struct("did", "t1", "start") > F.col("first"))
        spans = spans.unionByName(again.select("did", "t1", "start", F.lit(1).cast("long").alias("windows")))

    spans = spans.groupBy("did", "t1").agg(F.collect_list("start").alias("starts"), F.collect_list("windows").alias("windows"))
    names = rows.select("did", "t1", F.xxhash64(F.lit("other"), "text").alias("t2"))
    classes = names.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min("did").alias("least")).where("copies > 1")
    copies = names.join(classes, ["t1", "t2"]).groupBy("did", "t1").agg(F.min("least").alias("least"))
    final = shelf.join(spans, ["did", "t1"], "left").join(copies, ["did", "t1"], "left")
    #: All of a document repeats if it is another copy of a text (if the first stays: of a text that came before).
    all_of_it = F.col("least").isNotNull() & ((F.col("did") > F.col("least")) | (F.col("nth") > 1)) if first_stays else F.col("least").isNotNull()
    empty = hashlib.sha256(b"").hexdigest()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ns, whole, texts, gone, starts, windows = (batch.column(i).to_pylist() for i in range(1, 7))
            for n, digest, text, everything, at, size in zip(ns, whole, texts, gone, starts, windows, strict=True):
                if everything and n >= unit.window:
                    out.append((n, n, 1, empty))
                elif digest is not None:
                    out.append((n, 0, 0, digest))
                else:
                    doc = unit.load(text)
                    edge = np.zeros(n + 1, np.int64)
                    a = np.array(at or [], np.int64)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, a + np.array(size or [], np.int64) + unit.window - 1, -1)
                    gone_units = np.cumsum(edge)[:n] > 0
                    runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone_units.astype(np.int8)])) == 1))
                    out.append((n, int(gone_units.sum()), runs, hashlib.sha256(unit.kept(doc, gone_units)).hexdigest()))
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.record_batch([batch.column(0), *cols], ["doc_id", "n", "n_removed", "n_spans", "kept_sha256"])

    final = final.select("doc_id", "n", "whole", "text", all_of_it.alias("gone"), "starts", "windows")
    return final.mapInArrow(finish, "doc_id long, n long, n_removed long, n_spans long, kept_sha256 string")
