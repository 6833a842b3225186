import hashlib
import re

import pytest

from quirebase.llm import winnow

TOKEN = re.compile(r"[々-〇〡-〩㐀-䶿一-鿿豈-﫿]|[^\s々-〇〡-〩㐀-䶿一-鿿豈-﫿]+", re.ASCII)


def marks(fingerprint):
    """(hash, position) of a shown fingerprint."""
    return [(int(h, 16), int(p)) for h, p in (m.split("@") for m in fingerprint.split(",") if m)]


@pytest.mark.parametrize("size", [winnow.RANGE_BYTES, 300])
@pytest.mark.parametrize("which", ["odd", "real"])
def test_windows_and_next(which, size, request, monkeypatch):
    """Every column against the order of documents in one list; with tiny ranges (two levels of cuts) too."""
    monkeypatch.setattr(winnow, "RANGE_BYTES", size)
    monkeypatch.setattr(winnow, "COARSE", winnow.COARSE if size > 300 else 7)
    docs = request.getfixturevalue(which)
    rows = winnow.halves_swapped(docs).collect()
    prints = {r.text or "": r for r in winnow.picked(docs.selectExpr("coalesce(text, '') as text").distinct(), "text", "m").select("text", winnow.shown("m").alias("fp")).collect()}
    source = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    want = []
    for i, (known, d, t) in enumerate(source):
        n, m = source[(i + 1) % len(source)][2], len(t) // 2
        e = t[: len(t) - m] + n[:m]
        x, y = ({h for h, _ in marks(prints[z].fp)} for z in (t, n))
        want.append((d if known else None, len(t), hashlib.sha256(e.encode()).hexdigest(), prints[t].fp, len(x & y) / len(x | y) if x | y else 1.0))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_next)) for r in rows)
    for r in rows:
        x, y = ({h for h, _ in marks(f)} for f in (r.fingerprint, r.edited_fingerprint))
        assert r.near_edited == (len(x & y) / len(x | y) if x | y else 1.0)


def test_winnowing_rule(odd):
    """Against the rule spelled out: least hash of each window, the rightmost of equal ones, with its position."""
    df = winnow.picked(odd.selectExpr("coalesce(text, '') as text"), "text", "m").selectExpr("text", "m_at", "m_hash", "regexp_extract_all(text, r'" + winnow.TOKEN + "', 0) as words")
    for r in df.collect():
        assert r.words == TOKEN.findall(r.text)
    df = df.selectExpr("text", "m_at", "m_hash", "transform(words, (w, i) -> xxhash64(w, get(words, i+1), get(words, i+2), get(words, i+3), get(words, i+4))) as h")
    ties = 0
    for r in df.collect():
        h = [x >> 3 for x in r.h][: max(1, len(r.h) - winnow.K + 1)]
        want = []
        for i in range(max(1, len(h) - winnow.W + 1) if h else 0):
            part = h[i : i + winnow.W]
            ties += part.count(min(part)) > 1
            at = max(j for j in range(i, min(len(h), i + winnow.W)) if h[j] == min(part))
            if (h[at] % 2**61, at) not in want:
                want.append((h[at] % 2**61, at))
        assert list(zip(r.m_hash, r.m_at, strict=True)) == want
    assert ties > 100


def test_guarantee(spark):
    shared = " ".join(f"s{i}" for i in range(winnow.K + winnow.W - 1))
    docs = spark.createDataFrame([("a b c " + shared + " d e",), (shared,), ("q " * 50 + shared + " z" * 50,)], "text string")
    sets = [set(r.m_hash) for r in winnow.picked(docs, "text", "m").collect()]
    assert sets[0] & sets[1] and sets[1] & sets[2]


def test_empty(none):
    assert winnow.halves_swapped(none).count() == 0
