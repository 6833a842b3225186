"""Plans bound to written rows with known results, on both engines; and average precision against numpy."""

import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quirebase.plans.catalog import PLANS
from quirebase.plans.dialect import DUCK, SPARK
from quirebase.queries import QUERIES, boxes


def view(name, columns, *rows):
    text = lambda v: "NULL" if v is None else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns}))"


@pytest.fixture
def results(spark):
    def run(name, *views):
        bound = ", ".join(views)
        got = spark.sql(PLANS[name](SPARK, bound))
        mine = sorted((tuple(r[c] for c in got.columns) for r in got.collect()), key=str)
        theirs = duckdb.sql(PLANS[name](DUCK, bound))
        assert theirs.columns == got.columns and sorted(theirs.fetchall(), key=str) == mine
        return mine

    return run


GROUNDED = "head\ntitle [1, 2, 3, 4.5] A\n more \n\nnote [1, 2, 3] x\n<|ref|>fig<|/ref|> [9, 8, 1, 0]<PAGE>new\nlast\n<PAGE><PAGE>text[1,2,3,4]y"


def test_grounded(results):
    rows = results("s07_grounded_records", view("grounded", "doc, text", (1, GROUNDED)))
    assert rows == [
        (1, 1, 1, "text", None, None, None, None, "head"),
        (1, 2, 1, "title", 1.0, 2.0, 3.0, 4.5, "A\nmore\nnote [1, 2, 3] x"),
        (1, 3, 1, "fig", 9.0, 8.0, 1.0, 0.0, ""),
        (1, 4, 2, "text", None, None, None, None, "new\nlast"),
        (1, 5, 4, "text", None, None, None, None, "text[1,2,3,4]y"),
    ]
    assert results("s08_grounded_blocks", view("grounded", "doc, text", (1, "lost\nTitle[3, 2,1,4.5]\n a\nb\nX-y [1,1,2,2] c"))) == [(1, 1, "title", 1.0, 2.0, 3.0, 4.5, "a b"), (1, 2, "x-y", 1.0, 1.0, 2.0, 2.0, "c")]


def test_html(results):
    rows = (1, "<p>a &lt; b &amp;amp;</p>"), (2, "x<math a=1>\n y^2 <i>z</i></math><math>w</math>"), (3, "<table><tr><td>a\n b</td><th></th></tr><tr><td> </td></tr><TR><td>c</td></TR></table>"), (4, None), (5, "<table> no  rows</table>")
    got = {r[0]: r[1:] for r in results("x13_x14_x15_html", view("markup", "item, html", *rows))}
    assert got[1] == ("a < b &amp;", "", "a < b &amp;") and got[2][1] == "y^2 z"
    assert got[3][2] == "a b |\nc" and got[4] == ("", "", "") and got[5][2] == "no rows"


def test_answers(results):
    rows = (1, '```json\n{"a": [1]}\n```'), (2, "Sure: [1, [2]] ok"), (3, "[1] and [2]"), (4, "no"), (5, " 7 "), (6, "``` [1, 2]```")
    assert results("x35_json_answers", view("answers", "item, content", *rows)) == [(1, '{"a": [1]}'), (2, "[1, [2]]"), (3, None), (4, None), (5, "7"), (6, "[1, 2]")]


def test_stream(results):
    said = lambda c: 'data: {"choices": [{"delta": {"content": ' + c + "}}]}"
    rows = (1, "\n".join([": hi", "", said('"a"'), "data: {broken", said('[{"text": "b"}, "c"]'), "data: [DONE]", said('"late"')])), (2, '{"choices": [{"message": {"content": "all"}}]}'), (3, 'data: {"choices": []}\nevent: x')
    assert results("x36_sse_deltas", view("streams", "item, text", *rows)) == [(1, 2, "abc"), (2, 1, "all"), (3, 0, "")]


def test_entries(results):
    numbered = [(1, 1, "[1]  A. One"), (1, 2, "17"), (1, 3, "goes on"), (1, 4, "(2) B. Two"), (1, 5, "3. C. Three, 1999")]
    years = [(2, 1, "Intro words"), (2, 2, "[Wu et al., 1998] Deep parsing"), (2, 3, "of text"), (2, 4, "Smith. 2003. More"), (2, 5, "[9] x"), (2, 6, "abc")]
    short = [(3, 1, "[1] one"), (3, 2, "[2] two"), (4, 1, "[1] one"), (4, 2, "y" * 1600), (4, 3, "zzzz")]
    got = results("a03_a04_entries", view("region_", "doc, blk, text", *numbered, *years, *short))
    assert got[:3] == [(1, 0, "1", "1,3", "[1] A. One goes on"), (1, 1, "2", "4", "(2) B. Two"), (1, 2, "3", "5", "3. C. Three, 1999")]
    assert got[3:6] == [(2, 0, None, "1", "Intro words"), (2, 1, None, "2,3", "[Wu et al., 1998] Deep parsing of text"), (2, 2, None, "4,5", "Smith. 2003. More [9] x")]
    assert got[6:8] == [(3, 0, "1", "1", "[1] one"), (3, 1, "2", "2", "[2] two")] and got[8][3] == "1,2,3" and len(got[8][4]) == 1500


def test_author_year(results):
    region = view("region_", "doc, blk, text", (1, 1, "[Wu et al., 1998] Deep parsing with trees"), (1, 2, "Smith, Proceedings of 2003, Learning"))
    assert results("x06_author_year_profiles", region) == [(1, 0, "1998", "deep parsing trees", "wu"), (1, 1, "2003", "learning smith", "")]
    text = "As (see [Wu, 1998]) and (Smith, 2003; Wu, 2003) or (Wu, 2003), (1998), [parsings 1998] (blacksmith 2003)."
    got = results("j03_j04_x07_author_year", region, view("citing", "doc, blk, text", (1, 7, text)))
    assert [(r[4], r[5]) for r in sorted(got, key=lambda r: r[2])] == [("[Wu, 1998]", "0"), ("(Smith, 2003; Wu, 2003)", "1"), ("[parsings 1998]", "0"), ("(blacksmith 2003)", "1")]
    assert all(text[r[2] : r[3]] == r[4] for r in got)


def test_segments(results):
    rows = (1, "Refs\n[1] a\n b\n(2)c\n[Wu, 1998] d"), (2, "[Wu et al., 1998a] e\nmore\n[wu, 1998] f\n[Ke, 2017] g"), (3, "none")
    assert results("x09_entry_segments", view("lists", "doc, text", *rows)) == [(1, 1, "1", 5, "[1] a\n b"), (1, 2, "2", 14, "(2)c\n[Wu, 1998] d"), (2, 1, None, 0, "[Wu et al., 1998a] e\nmore\n[wu, 1998] f"), (2, 2, None, 39, "[Ke, 2017] g")]


def test_lockout(results):
    tries = [(i, "a", 10 * i, "no") for i in range(8)] + [(8, "a", 80, "no"), (9, "a", 500, "yes"), (10, "a", 501, "no"), (11, "b", 60, "no")]
    got = {r[0]: r[2:] for r in results("m12_m21_lockout", view("tries", "event_id, who, sec, said", *tries) + ", attempts AS (SELECT event_id, who, sec, said = 'yes' AS ok FROM tries)")}
    assert got[7] == (7, 0) and got[8] == (8, 290) and got[9] == (9, 0) and got[10] == (0, 0) and got[11] == (0, 0)


def test_stores(results):
    blocks = view("old_", "doc, blk, text", (1, 1, "a"), (1, 2, "b"), (1, 3, "c")), view("new_", "doc, blk, text", (1, 1, "A"), (1, 2, "b"), (1, 3, "C"), (1, 4, "D")), view("langs", "lang", ("zh",), ("en",))
    key = lambda t: f"sha1('zh' || chr(0) || '{t}')"
    cache = f"cache_ AS (SELECT 1 AS doc, {key('a')} AS k, 'za' AS answer UNION ALL SELECT 1, {key('b')}, 'zb' UNION ALL SELECT 1, {key('c')}, 'zc' UNION ALL SELECT 1, {key('C')}, 'has')"
    assert [(r[0], r[2]) for r in results("j12_key_migration", *blocks, cache)] == [(1, "za")]
    assert results("j28_missing_images", view("named", "doc, name", (1, "x"), (1, "x"), (1, "y"), (2, "z")), view("stored", "doc, name", (1, "x"), (2, "q"))) == [(1, 2, 1, "y"), (2, 1, 0, "z")]


def test_tracks(results):
    points = view("points", "track, sec, cls, x, y, frame", (1, 0, "a", 40.0, 10.0, 0), (1, 2, "a", 60.0, 40.0, 0), (1, 3, "a", 40.0, 50.0, 1), (2, 0, "b", 70.0, 30.0, 0), (2, 5, "b", 50.0, 20.0, 1), (3, 1, "a", 5.0, 5.0, 1))
    assert results("a35_w24_line_crossings", points) == [(1, 2, "a", "IN", 15.0), (2, 5, "b", "OUT", 2.0)]
    assert results("a36_frame_counts", points) == [(0, "a", 2, 2), (0, "b", 1, 1), (1, "a", 2, 4), (1, "b", 1, 2)]
    assert results("a34_a37_region", points) == [(0, 2, 2), (1, 2, 2)]


def test_average_precision(spark, sf):
    """Against the definition: envelope of precision over recall with sentinels, 101 points, trapezoids."""
    preds, truths = ([r for r in boxes(spark, sf).collect() if r.det % 2 == odd] for odd in (1, 0))

    def iou(a, b):
        w, h = min(a.x2, b.x2) - max(a.x1, b.x1), min(a.y2, b.y2) - max(a.y1, b.y1)
        inter = max(w, 0) * max(h, 0)
        return inter / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - inter)

    met = [(p, t, iou(p, t)) for p in preds for t in truths if p.page == t.page and p.cls == t.cls]
    want = {}
    for level in [n / 100 for n in range(50, 100, 5)]:
        best, hit = {}, {}
        for p, t, v in sorted((m for m in met if m[2] >= level), key=lambda m: (-m[2], m[1].det)):
            best.setdefault((p.page, p.det), t.det)
        for (page, det), t in sorted(best.items()):
            hit.setdefault((page, t), (page, det))
        for cls in {p.cls for p in preds}:
            own = sorted((p for p in preds if p.cls == cls), key=lambda p: (-p.conf, p.page, p.det))
            tp = np.cumsum([(p.page, p.det) in set(hit.values()) for p in own])
            rec = np.concatenate([[0], tp / (sum(t.cls == cls for t in truths) + 1e-16), [1]])
            pre = np.concatenate([[1], tp / np.arange(1, len(own) + 1), [0]])
            x = np.linspace(0, 1, 101)
            want[round(level, 2), cls] = float(np.trapezoid(np.interp(x, rec, np.maximum.accumulate(pre[::-1])[::-1]), x))
    got = {(round(r.level, 2), r.cls): r.ap for r in spark.sql(PLANS["a31_a32_a44_average_precision"](SPARK)).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want) and max(want.values()) > 0


def test_places_in_texts(results):
    """Stretches meet inside parts; characters of two and four bytes count as one."""
    n = 1024  # a stretch
    rng = random.Random(23)
    texts = {1: "x" * (n - 1) + "an" + "x" * (n - 2) + "an", 2: "an" * (2 * n), 3: "".join(rng.choices("aann\n é漢\U0001f600", k=5 * n + 7)), 4: "ban", 5: "na", 6: "a", 7: "\U0001f600" * (n - 1) + "an"}
    got = dict(results("x23_positions", view("texts", "item, text", *texts.items(), (8, ""), (9, None))))
    assert got == {k: ",".join(str(m.start() + 1) for m in re.finditer("an", t)) for k, t in texts.items()}


def test_places_in_a_long_text(spark):
    """400,000 characters: a look at each character from the text's beginning takes minutes."""
    began = time.time()
    (row,) = spark.sql(PLANS["x23_positions"](SPARK, "texts AS (SELECT 1 AS item, repeat('some an é ', 40000) AS text)")).collect()
    assert row.places == ",".join(str(10 * i + 6) for i in range(40000)) and time.time() - began < 20


def test_confusion_of_equal_numbers(spark):
    """Two truths of one number overlap a prediction equally: rows in either order give one matrix."""
    truths = [(1, 2, 3, 0.0, 0.0, 10.0, 10.0), (1, 2, 4, 0.0, 0.0, 10.0, 10.0)]
    preds = view("preds", "page, det, cls, conf, x1, y1, x2, y2", (1, 1, 5, 0.9, 0.0, 0.0, 10.0, 8.0))
    for rows in (truths, truths[::-1]):
        bound = preds + ", " + view("truths", "page, det, cls, x1, y1, x2, y2", *rows)
        assert [tuple(r) for r in spark.sql(PLANS["a30_confusion"](SPARK, bound)).collect()] == [(5, 3, 1)]


def test_share_entries_at_one_place(spark, tmp_path):
    """Of two entries of one account at one place the first as stored counts, whichever task has its rows first."""
    spark.sql("SELECT 1L AS o_orderkey, 1L AS o_custkey, 'F' AS o_orderstatus, TIMESTAMP '2026-01-01 00:00:00' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT 1L AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    (tmp_path / "lineitem.parquet").mkdir()
    for first, perm in ((0, "edit"), (1, "read")):
        # The larger file is read first.
        for name, rows in (("a", [(1, 1, 7, first)]), ("b", [(1, 1, 7, 1 - first), *((2, i, 8, 0) for i in range(50_000))])):
            pq.write_table(pa.Table.from_pylist([dict(zip(("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), r, strict=True)) for r in rows]), tmp_path / "lineitem.parquet" / f"{name}.parquet")
        (row,) = QUERIES["f39_f40_f48_j14_j41_j45_visible"](spark, str(tmp_path)).collect()
        assert tuple(row) == (1, perm, 2, False)
