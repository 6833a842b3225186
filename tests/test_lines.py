"""Plans of lines, sessions and predictors on written rows with known results, on both engines; rotated boxes against numpy."""

import math

from tests.test_rules import results, view  # noqa: F401  a fixture


def test_baseline_and_top(results):
    spans = [
        (1, 1, 100.0, 9.0, "x2", 91.0, 88.0), (1, 2, 100.02, 9.0, " of it ", 92.0, 88.0), (1, 3, 96.0, 6.0, "sup", 85.0, 88.0), (1, 4, None, 20.0, "longest of all", None, 88.0),
        (2, 1, 50.0, 7.0, "ab", 41.0, 40.0), (2, 2, 47.0, 9.0, "cd", 42.0, 40.0), (3, 1, 7.0, 9.0, "  ", 3.0, 2.0), (4, 1, None, 9.0, "a", 3.0, 2.0),
    ]
    rows = results("a12_a13_baseline_and_top", view("spans", "line, run, base, size, text, top, line_top", *spans))
    assert rows == [(1, 100.0, 88.0), (2, 47.0, 41.0), (3, 7.0, 2.0), (4, None, 3.0)]


def test_block_texts(results):
    rows = results("a24_block_texts", view("blocks", "doc, pos, id, text", (1, 1, "a", "old"), (1, 3, "a", None), (1, 2, "b", "x"), (1, 4, "b", "y"), (1, 5, "", "z"), (2, 1, None, "z")))
    assert rows == [(1, "a", ""), (1, "b", "y")]


LINES = (1, 0, "ab x c word d", 1.0, 0.0, 10.0, 2.0), (1, 1, "   ", 0.0, 9.0, 50.0, 2.0), (1, 2, "co-", 2.0, 4.0, 10.0, 2.0), (1, 3, "op", 3.0, 6.0, 10.0, 3.0), (2, 0, " ", 0.0, 0.0, 1.0, 1.0)


def pieces(*segs):
    return view("erased", "blk, line, text, x, y, w, h", *LINES), view("segs", "blk, line, a, b, n", *segs)


def test_formula_pieces(results):
    text = "p=1+q  r=ab and= s"  # pieces around =1+q : no blank; then a blank; then a word
    lines = view("erased", "blk, line, text, x, y, w, h", (1, 0, text, 0.0, 0.0, 1.0, 1.0), (1, 1, "a12345b", 0.0, 0.0, 1.0, 1.0), (1, 2, "a1234b", 0.0, 0.0, 1.0, 1.0), (1, 3, "aandb", 0.0, 0.0, 1.0, 1.0))
    segs = [(1, 0, 0, 1, 1), (1, 0, 4, 5, 1), (1, 0, 7, 8, 1), (1, 1, 0, 1, 1), (1, 1, 6, 7, 1), (1, 2, 0, 1, 2), (1, 2, 5, 6, 3), (1, 3, 0, 1, 1), (1, 3, 4, 5, 1)]
    rows = results("w12_formula_pieces", lines, view("segs", "blk, line, a, b, n", *segs))
    assert rows == [(1, 0, 0, 5, 2, 2), (1, 0, 7, 8, 1, 1), (1, 1, 0, 1, 1, 1), (1, 1, 6, 7, 1, 1), (1, 2, 0, 6, 5, 2), (1, 3, 0, 1, 1, 1), (1, 3, 4, 5, 1, 1)]


def test_rebuilt_blocks_and_slots(results):
    segs = [(1, 0, 2, 3, 1), (1, 1, 0, 3, 3), (1, 3, 1, 2, 1), (2, 0, 0, 1, 1)]
    assert results("f55_rebuilt_blocks", *pieces(*segs)) == [(1, 3, 1.0, 0.0, 12.0, 9.0, "ab x c word d coop")]
    assert results("f55_formula_slots", *pieces(*segs)) == [(1, 0, 2, 2, 3, 1, False), (1, 1, 0, -1, -1, 3, True), (1, 3, 1, 19, 20, 1, False), (2, 0, 0, -1, -1, 1, True)]


def test_selected_range(results):
    sentences = view("sentences", "doc, item, si, kind", *[(d, i, s, "img" if i == 2 else "blk") for d in (1, 2, 3) for i in (1, 2, 3, 4) for s in (0, 1)])
    ends = view("ends", "doc, item_a, si_a, item_b, si_b", (1, 4, 0, 1, 1), (2, 3, 0, 3, 0), (3, 2, 0, 2, 1))
    assert results("w19_selected_range", sentences, ends) == [(1, 1, 1), (1, 3, 0), (1, 3, 1), (1, 4, 0), (2, 3, 0), (3, 2, 0)]


def requests():
    rows = [("old", 1, 0, 10, 1, None), ("back", 2, 0, 5, 0, "x"), ("back", 3, 1806, 1900, 1, None), ("stays", 4, 0, 5, 0, "y"), ("stays", 5, 1805, 1806, 1, None), ("runs", 6, 0, None, 1, None), ("runs", 7, 1900, 1950, 0, "z"), ("late", 8, 4000, 4001, 1, None)]
    rows += [("many", 10 + i, 3000 + i, 3001 + i, 1, None) for i in range(11)]
    cast = "requests AS (SELECT session, request, began, ended, ok_ = 1 AS ok, error, 2 AS formulas, 1 AS tables FROM raw)"
    return view("raw", "session, request, began, ended, ok_, error", *rows), cast, "moment AS (SELECT 3600 AS now_)"


def test_session_snapshot(results):
    rows = {r[0]: r[1:] for r in results("a47_session_snapshot", *requests())}
    assert set(rows) == {"back", "stays", "runs", "many"}
    assert rows["back"] == (1806, 1900, 1, 1, 0, 2, 1, 0, None, 1)
    assert rows["stays"] == (0, 1806, 2, 1, 1, 4, 2, 0, "y", 1)
    assert rows["runs"] == (0, 1950, 2, 0, 1, 4, 2, 1, "z", 0)
    assert rows["many"][2:4] == (11, 11) and rows["many"][-1] == 8


def test_session_results(results):
    rows = results("m22_session_results", *requests())
    assert [r for r in rows if r[0] != "many"] == [("back", 3, 1), ("stays", 5, 1)]
    assert sorted(r[1:] for r in rows if r[0] == "many") == [(13 + i, 1 + i) for i in range(8)]


def test_predictors(results):
    calls = view("raw", "pool, call, came, began, ended, refused, broke_, images, worker", (1, 1, 0, 0, 4, None, 0, 3, 0), (1, 2, 1, 1, 6, None, 1, 5, 1), (1, 3, 2, 4, 20, None, 0, 7, 0), (1, 4, 3, None, None, 8, 0, 1, None), (1, 5, 9, 12, 13, None, 0, 1, 1), (1, 6, 30, 30, 31, None, 0, 1, 1), (1, 7, 5, None, None, 15, 0, 1, None))
    cast, moment = "calls AS (SELECT pool, call, came, began, ended, refused, broke_ = 1 AS broke, images, worker FROM raw)", "moment AS (SELECT 10 AS now_)"
    assert results("a48_predictor_counters", calls, cast, moment) == [(1, 1, 1, 2, 6, 1, 3, 1, 1)]
    assert results("a48_workers", calls, cast, moment) == [(1, 0, 1, 3, 4.0), (1, 1, 1, 5, 5.0)]


def test_extended_rows(results):
    row = lambda formula, det, x1, x2, y1=0.0, seed=0, barred=0, math=9, chars=10, high=20.0: (formula, det, float(x1), y1, float(x2), y1 + 10, seed, barred, math, chars, 0.0, high)
    chain = [row(1, i, 20 * i, 20 * i + 8) for i in range(1, 7)]  # each 12 from the one before: one a pass, the fifth and sixth too late
    rows = [row(1, 0, 0, 8, seed=1), *chain, row(1, 9, -21, -13), row(2, 0, 0, 8, seed=1), row(2, 1, 9, 20, barred=1), row(2, 2, 9, 20, y1=6.5), row(2, 3, 9, 20, y1=6.0), row(2, 4, -9, -1, math=4), row(2, 5, -9, -1, math=5), row(2, 6, 9, 20, math=None), row(2, 7, 9, 20, y1=5.0, high=7.0), row(3, 1, 0, 8)]
    raw = view("raw", "formula, det, x1, y1, x2, y2, seed_, barred_, math_, chars, low, high", *rows)
    cast = "rows_ AS (SELECT formula, det, x1, y1, x2, y2, seed_ = 1 AS seed, barred_ = 1 AS barred, CAST(math_ AS INTEGER) AS math, chars, low, high FROM raw)"
    got = [(r[0], r[1], r[4]) for r in results("j35_extended_rows", raw, cast)]
    assert sorted(got) == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 4), (2, 0, 0), (2, 3, 1), (2, 5, 1)]


def test_reference_strategy(results):
    assert results("z03_reference_strategy", view("parsed", "doc, parser", (1, "surya"), (2, "unlimited_ocr"), (3, None), (4, "other"))) == [(1, "surya"), (2, "unlimited_ocr"), (3, "text_layer"), (4, "text_layer")]


def likeness(p, q):
    """Of two boxes (x, y, w, h, angle): one less the Hellinger distance of their Gaussians."""

    def gauss(b):
        c, s = math.cos(b[4]), math.sin(b[4])
        u, v = b[2] ** 2 / 12, b[3] ** 2 / 12
        return u * c * c + v * s * s, u * s * s + v * c * c, (u - v) * c * s

    (a1, b1, c1), (a2, b2, c2) = gauss(p), gauss(q)
    a, b, c, dx, dy = (a1 + a2) / 2, (b1 + b2) / 2, (c1 + c2) / 2, p[0] - q[0], p[1] - q[1]
    det = a * b - c * c
    distance = (b * dx * dx - 2 * c * dx * dy + a * dy * dy) / det / 8 + math.log(det / math.sqrt((a1 * b1 - c1 * c1) * (a2 * b2 - c2 * c2))) / 2
    return 1 - math.sqrt(max(0.0, 1 - math.exp(-max(distance, 0.0))))


def test_rotated_suppression(spark, results):
    rows = [(1, 1, 0, 0.9, 10.0, 10.0, 20.0, 4.0, 0.0), (1, 2, 0, 0.8, 10.0, 10.0, 20.0, 4.0, 0.1), (1, 3, 0, 0.7, 10.0, 10.0, 20.0, 4.0, 1.57), (1, 4, 1, 0.6, 10.0, 10.0, 20.0, 4.0, 0.0), (1, 5, 0, 0.5, 13.0, 10.5, 20.0, 4.0, 0.2), (1, 6, 0, 0.9, 10.0, 10.0, 20.0, 4.0, 0.0), (2, 1, 0, 0.1, 10.0, 10.0, 20.0, 4.0, 0.0)]
    rows += [(3, 1 + i, 0, 1 - i / 100, 10.0 + i * i * 7 % 31, 10.0 + i * 5 % 17, 8.0 + i % 5 * 4, 5.0 + i % 3, i * 0.37) for i in range(40)]
    kept = results("a41_fast_nms", view("turned", "page, det, cls, conf, x, y, w, h, angle", *[(*r[:3], float(r[3]), *map(float, r[4:])) for r in rows]))
    before = lambda a, b: a[:1] == b[:1] and a[2] == b[2] and (-a[3], a[1]) < (-b[3], b[1])
    want = [b[:3] for b in rows if not any(before(a, b) and likeness(a[4:], b[4:]) >= 0.45 for a in rows)]
    assert kept == sorted(want, key=str) and 10 < len(kept) < len(rows)
