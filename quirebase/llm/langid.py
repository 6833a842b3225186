"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text tells, from any place of a document, how long a match the language
has. Parsing a document greedily into such longest matches needs few phrases under its own language and many under
others. The language with the fewest phrases per symbol wins (equal ones: the first by name).

Symbols are the UTF-8 bytes of lower-case letters, so letters of all scripts stay apart; everything between letters is one
separator. Transitions are kept sparse, in one array per language by row displacement: a state is a place in the array,
its transition by symbol s is at the place s further on, and holds the state as its owner. Languages may be many
and their letters too. Parsing runs in lock step: documents are cut into pieces of PIECE symbols, and two gathers move
all pieces of all languages by a symbol. A piece's parse starts afresh, for every language alike.

Training is the fit of a classifier on a bounded sample: per language TRAIN_DOCS documents, those of least
xxhash64(doc_id), of each a stretch of TRAIN_CHARS characters that begins at a place chosen by hash. The sample (not the
automata) is what workers receive.

Defined cases: null text and text without a letter is `und` with score 0; without any labelled text all is `und`;
repeated rows get equal answers; bytes that no sample has are one symbol of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches

TRAIN_DOCS, TRAIN_CHARS = 64, 500
#: Levels by length at which a language's usual rates are measured, and parts of 1 to which rates are rounded up, so that any number of them are counted in little memory.
USUAL_LEVELS, USUAL_PARTS = 10, 1 << 16
#: Of those rates the quantile, and the allowance on it, up to which a text fits the language; without any such document the bound.
USUAL, ALLOWANCE, FOREIGN = 0.99, 1.25, 0.5
PIECE = 4096


def _kinds() -> np.ndarray:
    """Code point -> its lower-case form if a letter, else 0 (built from Python's Unicode tables)."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTERS: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """UTF-8 bytes of the lower-case letters, each run of anything else as one 0."""
    if not _LETTERS:
        _LETTERS.append(_kinds())
    raw = _LETTERS[0][np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    keep = raw != 0
    keep[1:] |= raw[:-1] != 0
    return np.frombuffer(raw[keep].astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8"), np.uint8)


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of a sequence."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


def displaced(states: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each state, owner, next): the transition of state i by symbol c is at place[i] + c, where owner is place[i] and next the
    place it leads to. Places are unique and from 0; states with many transitions are placed first, those with one fill the gaps."""
    size = 2 * sum(map(len, states)) + 2 * len(states) + 2 * width
    taken, used, place = np.zeros(size, bool), set(), np.zeros(len(states), np.int64)
    order = sorted(range(len(states)), key=lambda i: -len(states[i]))
    single = next((k for k, i in enumerate(order) if len(states[i]) <= 1), len(order))
    rng = np.random.default_rng(len(states))
    for i in order[:single]:
        symbols = np.array(list(states[i]))
        while True:  # a fraction of the array is taken, so few draws are needed
            draw = rng.integers(0, size - width, 32)
            fit = [d for d in draw[~taken[draw[:, None] + symbols].any(axis=1)].tolist() if d not in used]
            if fit:
                break
        place[i] = fit[0]
        used.add(fit[0])
        taken[fit[0] + symbols] = True
    free = iter(np.flatnonzero(~taken[width:]) + width)
    rest = []
    for i in order[single:]:
        if not states[i]:
            rest.append(i)
            continue
        (c,) = states[i]
        slot = next(s for s in free if s - c not in used)
        place[i] = slot - c
        used.add(int(slot - c))
        taken[slot] = True
    spare = iter(p for p in range(size) if p not in used)
    for i in rest:
        place[i] = next(spare)
    end = int(place.max(initial=0)) + width
    owner, following = np.full(end, -1, np.int64), np.zeros(end, np.int64)
    for i, t in enumerate(states):
        for c, to in t.items():
            owner[place[i] + c] = place[i]
            following[place[i] + c] = place[to]
    return place, owner, following


class CrossParser:
    """All languages' automata one behind the other in one array of owners and one of next states."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        texts = {k: [letters(t) for t in v] for k, v in samples.items()}
        known = np.unique(np.concatenate([t for v in texts.values() for t in v] or [np.zeros(0, np.uint8)]))
        known = known[known > 0]
        #: 0: separator; 1: any byte that no sample has.
        self.symbol = np.ones(256, np.int64)
        self.symbol[0] = 0
        self.symbol[known] = np.arange(2, 2 + len(known))
        self.width = 2 + len(known)
        owners, nexts, starts, firsts, base = [], [], [], [], 0
        zero = np.zeros(1, np.uint8)
        for lang in self.langs:
            joined = np.concatenate([x for t in texts[lang] for x in (zero, t, zero)])
            # The state behind the last one has no transitions: before the first symbol, and after one the language lacks.
            states = [*automaton(self.symbol[joined].tolist()), {}]
            place, owner, following = displaced(states, self.width)
            owners.append(np.where(owner >= 0, owner + base, -1))
            nexts.append(following + base)
            starts.append(base + place[-1])
            firsts.append([base + place[states[0].get(c, -1)] for c in range(self.width)])
            base += len(owner)
        self.owner = np.concatenate(owners or [np.zeros(0)]).astype(np.int32)
        self.next = np.concatenate(nexts or [np.zeros(0)]).astype(np.int32)
        self.starts = np.array(starts, np.int32)
        #: (languages, symbols): where no match goes on, the state that a new phrase with the symbol leads to.
        self.first = np.array(firsts, np.int32).reshape(len(self.langs), self.width)

    def phrases(self, docs: list[np.ndarray]) -> np.ndarray:
        """(docs, languages): phrases each document needs."""
        total = np.zeros((len(docs), len(self.langs)), np.int64)
        pieces = [(i, d[j : j + PIECE]) for i, d in enumerate(docs) for j in range(0, len(d), PIECE)]
        pieces.sort(key=lambda x: -len(x[1]))
        for at in range(0, len(pieces), 2048):
            part = pieces[at : at + 2048]
            size = np.array([len(p) for _, p in part])
            block = np.zeros((size[0], len(part)), np.int32)
            for k, (_, p) in enumerate(part):
                block[: len(p), k] = self.symbol[p]
            state = np.repeat(self.starts[:, None], len(part), axis=1)
            count = np.zeros(state.shape, np.int32)
            live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right").tolist()
            for row, n in zip(block, live, strict=True):
                if n < state.shape[1]:
                    np.add.at(total, [i for i, _ in part[n : state.shape[1]]], count[:, n:].T)
                    state, count = state[:, :n].copy(), count[:, :n].copy()
                at = state + row[:n]
                ended = self.owner.take(at) != state
                count += ended
                state = np.where(ended, self.first.take(row[:n], axis=1), self.next.take(at))
            np.add.at(total, [i for i, _ in part[: state.shape[1]]], count.T)
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Languages, scores from 0 to 1 (how far the second needs more phrases), phrases per symbol of the winner."""
        docs = [letters(t or "") for t in texts]
        some = [i for i, d in enumerate(docs) if d.any()] if self.langs else []
        lang, score, rate = ["und"] * len(docs), [0.0] * len(docs), [1.0] * len(docs)
        if some:
            need = self.phrases([docs[i] for i in some])
            best = need.argmin(axis=1)
            order = np.sort(need, axis=1)
            for k, i in enumerate(some):
                lang[i] = self.langs[best[k]]
                score[i] = float(1 - order[k, 0] / order[k, 1]) if order.shape[1] > 1 else 1.0
                rate[i] = float(min(1.0, order[k, 0] / len(docs[i])))
        return lang, score, rate


_FITTED: dict[int, CrossParser] = {}


def parser_of(samples: dict[str, list[str]]) -> CrossParser:
    """Built once in a worker."""
    key = hash(tuple((k, *samples[k]) for k in sorted(samples)))
    if key not in _FITTED:
        _FITTED.clear()
        _FITTED[key] = CrossParser(samples)
    return _FITTED[key]


def _labelled(docs: DataFrame) -> DataFrame:
    """Labelled documents that have text, with the hashes that order them."""
    own = F.col("doc_id").cast("string")
    return docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", own.alias("own"), F.xxhash64(own).alias("at"), F.xxhash64("text").alias("of"))


def _least(rows: DataFrame) -> DataFrame:
    """Of each language the TRAIN_DOCS rows of least hash, i from 1. Spark keeps the least rows of each language before the shuffle."""
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("at", "of"))).where(F.col("i") <= TRAIN_DOCS)


def sample(docs: DataFrame, train: Column | None = None) -> dict[str, list[str]]:
    """The bounded training sample: {language: texts}."""
    begin = F.pmod(F.xxhash64(F.lit("begin"), F.col("own")), F.greatest(F.char_length("text") - TRAIN_CHARS, F.lit(0)) + 1).cast("int") + 1
    rows = _labelled(docs if train is None else docs.where(train))
    top = _least(rows.select("lang", F.substring("text", begin, F.lit(TRAIN_CHARS)).alias("text"), "at", "of"))
    out: dict[str, list[str]] = {}
    for r in top.orderBy("lang", "i").collect():
        out.setdefault(r.lang, []).append(r.text)
    return out


def level(symbols: int) -> int:
    """Texts of one level have from 2**level to twice as many symbols: short ones need more phrases a symbol."""
    return max(0, symbols.bit_length() - 1)


def bounds(docs: DataFrame, samples: dict[str, list[str]]) -> dict[str, list[float]]:
    """{language: by level, the phrases a symbol up to which a text fits it}, from all labelled documents that come after the sample's.

    Their beginnings of 2**level symbols are parsed under their own language, at the last level whole texts of at least as many. A level
    that a language has no documents for takes the largest bound that others have there, else its own of the level below, else FOREIGN.
    """
    last = USUAL_LEVELS - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(samples)
        for batch in batches:
            texts = [letters(t) for t in batch.column(1).to_pylist()]
            cuts = [(lang, k, t if k == last else t[: 1 << k]) for lang, t in zip(batch.column(0).to_pylist(), texts, strict=True) for k in range(USUAL_LEVELS) if t.any() and len(t) >= 1 << k]
            need = parser.phrases([t for _, _, t in cuts])
            count = Counter((lang, k, -(-int(need[i, parser.langs.index(lang)]) * USUAL_PARTS // len(t))) for i, (lang, k, t) in enumerate(cuts))
            rows = [(*key, n) for key, n in count.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["lang", "level", "rate", "n"])

    small_batches(docs.sparkSession)
    rows = _labelled(docs)
    taken = _least(rows.select("lang", "at", "of")).groupBy("lang").agg(F.max(F.struct("at", "of")).alias("taken"))
    held = rows.join(F.broadcast(taken), "lang").where(F.struct("at", "of") > F.col("taken")).select("lang", "text")
    counts = held.mapInArrow(run, "lang string, level int, rate long, n long").groupBy("lang", "level", "rate").agg(F.sum("n").alias("n"))
    rates = counts.groupBy("lang", "level").agg(F.percentile("rate", F.lit(USUAL), F.col("n")).alias("rate"))
    usual = {(r.lang, r.level): ALLOWANCE * r.rate / USUAL_PARTS for r in rates.collect()}
    out: dict[str, list[float]] = {}
    for lang in samples:
        row = out.setdefault(lang, [])
        for k in range(USUAL_LEVELS):
            others = [v for (_, at), v in usual.items() if at == k]
            row.append(usual.get((lang, k), max(others) if others else row[-1] if row else FOREIGN))
    return out


def identified(docs: DataFrame, samples: dict[str, list[str]], keep: list[str] | None = None, bound: dict[str, list[float]] | None = None) -> DataFrame:
    """Columns `keep` of docs, and lang_pred, score, phrase_rate from the text alone; with `bound` also fits, whether the rate is within it."""
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(samples)
        for batch in batches:
            lang, score, rate = parser.predict(batch.column(len(keep)).to_pylist())
            out = [*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())]
            if bound is not None:
                size = [len(letters(t or "")) for t in batch.column(len(keep)).to_pylist()]
                fits = [k != "und" and r <= bound[k][min(level(n), len(bound[k]) - 1)] for k, r, n in zip(lang, rate, size, strict=True)]
                out.append(pa.array(fits, pa.bool_()))
            yield pa.RecordBatch.from_arrays(out, names)

    small_batches(docs.sparkSession)
    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double").add("phrase_rate", "double")
    schema = schema if bound is None else schema.add("fits", "boolean")
    names = schema.names
    return rows.mapInArrow(run, schema)


def held_out() -> Column:
    """True for documents that training never reads."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """Trained on the documents that aren't held out, predicted for all: (doc_id, held_out, lang_pred, score, phrase_rate)."""
    out = identified(docs.select(F.col("doc_id").cast("long"), "text"), sample(docs, ~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "phrase_rate")
