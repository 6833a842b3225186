import zlib

import numpy as np

from quirebase.llm import langid


def test_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "lang").join(langid.languages(docs), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_parse_against_greedy_substrings():
    """Phrases counted by plain substring search, piece by piece."""
    rng = np.random.default_rng(4)
    say = lambda abc, n: "".join(rng.choice(list(abc), n))
    samples = {"x": [say("abcd ", 200), say("abcd", 50)], "y": [say("cdef ", 300)]}
    parser = langid.CrossParser(samples)
    docs = [say("abcdefg ", n) for n in (1, 7, 900, 5000, 9000)] + [say("abcd ", 700)]
    seqs = [langid.letters(t) for t in docs]
    got = parser.phrases(seqs)
    for i, seq in enumerate(seqs):
        for k, lang in enumerate(parser.langs):
            train = np.concatenate([np.concatenate([[0], langid.letters(t), [0]]) for t in samples[lang]])
            base = bytes(parser.symbol[train].tolist())
            need = 0
            for at in range(0, len(seq), langid.PIECE):
                text, p = bytes(parser.symbol[seq[at : at + langid.PIECE]].tolist()), 0
                while p < len(text):
                    q = p + 1
                    while q < len(text) and text[p : q + 1] in base:
                        q += 1
                    need += 1
                    p = q
            assert got[i, k] == need


def test_undetermined(odd, none, spark):
    rows = langid.languages(odd).collect()
    for r, text in ((r, t.text) for t in odd.collect() for r in rows if r.doc_id == t.doc_id and t.doc_id in (0, 1, 2, 16)):
        assert (r.lang_pred, r.score) == ("und", 0.0), text
    assert len(rows) == odd.count() and {r.lang_pred for r in rows} <= {"und", "en", "de", "ja"}
    assert langid.languages(none).count() == 0
    assert {r.lang_pred for r in langid.languages(odd.withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}


def test_scripts_of_many_letters(spark):
    """Languages of thousands of letters, and many languages at once: every letter counts, none is merged with another."""
    rng = np.random.default_rng(6)
    sets = {f"k{i}": [chr(0x4E00 + 500 * i + j) for j in range(800)] for i in range(12)} | {f"a{i}": [chr(0x61 + (5 * i + j) % 26) for j in range(9)] for i in range(4)}
    words = {k: ["".join(rng.choice(v, rng.integers(1, 4))) for _ in range(400)] for k, v in sets.items()}
    rows = [(i, " ".join(rng.choice(words[k], 80)), k, "s", 0) for i, k in enumerate(list(sets) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = {r.doc_id: (r.lang_pred, r.held_out) for r in langid.languages(docs).collect()}
    held = [r for r in rows if got[r[0]][1]]
    assert len(held) > 50 and sum(got[r[0]][0] == r[2] for r in held) >= 0.98 * len(held)


def test_transitions_are_whole():
    rng = np.random.default_rng(7)
    states = langid.automaton(rng.integers(0, 30, 3000).tolist())
    place, owner, following = langid.displaced(states, 30)
    assert len(set(place.tolist())) == len(states)
    for i in range(0, len(states), 17):
        found = {c: following[place[i] + c] for c in range(30) if owner[place[i] + c] == place[i]}
        assert found == {c: place[to] for c, to in states[i].items()}


def test_bounds_are_of_all_labelled_documents(spark):
    """Against each labelled document beyond the training ones, parsed by itself: more than fit a sample, whole texts at the last level."""
    rng = np.random.default_rng(8)
    words = {k: ["".join(rng.choice(list(abc), rng.integers(2, 6))) for _ in range(60)] for k, abc in (("x", "abcdefgh"), ("y", "ghijklmnop"))}
    rows = [(i, " ".join(rng.choice(words["xy"[i % 2]], rng.integers(1, 500) if i % 5 else 3)), "xy"[i % 2]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    samples = langid.sample(docs)
    parser, text = langid.CrossParser(samples), {r[0]: r[1] for r in rows}
    got = langid.bounds(docs, samples)
    for lang in "xy":
        order = [r.doc_id for r in docs.where(f"lang = '{lang}'").selectExpr("doc_id", "xxhash64(string(doc_id)) AS at").orderBy("at").collect()]
        held = [langid.letters(text[i]) for i in order[langid.TRAIN_DOCS :]]
        assert len(held) > 380
        for k in range(10):
            cuts = [t if k == 9 else t[: 1 << k] for t in held if len(t) >= 1 << k]
            need = parser.phrases(cuts)[:, parser.langs.index(lang)]
            want = langid.ALLOWANCE * np.percentile(need / [len(t) for t in cuts], 99)
            assert -1e-9 <= got[lang][k] - want <= 2 * langid.ALLOWANCE / (1 << 16), (lang, k)
