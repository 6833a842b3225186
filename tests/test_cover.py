"""Covered lines, ghosts, figures and absorbed gaps against plain loops over pages, and on written rows."""

import random
from collections import defaultdict

import pytest

from quirebase.operators import cover, gaps, greedy

BOX = "page long, x1 double, y1 double, x2 double, y2 double"


def hulls(boxes, near):
    """Plain merging: any two near ones become their hull, until there are none."""
    boxes = [list(b) for b in boxes]
    while True:
        pair = next(((i, j) for i in range(len(boxes)) for j in range(i) if near(boxes[i], boxes[j])), None)
        if pair is None:
            return boxes
        a, b = boxes.pop(pair[0]), boxes.pop(pair[1])
        boxes.append([min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])])


def touch(pad):
    return lambda a, b: a[0] - pad < b[2] and b[0] - pad < a[2] and a[1] - pad < b[3] and b[1] - pad < a[3]


def common(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def area(b):
    return (b[2] - b[0]) * (b[3] - b[1])


def share(b, rects):
    return min(1, sum(common(b, r) for r in rects) / area(b)) if area(b) > 0 else 0


@pytest.fixture(scope="module")
def pages():
    """Per page: lines, images with a mark, hidden rectangles, shapes."""
    rng, out = random.Random(5), {}
    box = lambda most, high: (lambda x, y: (x, y, x + rng.randint(0, most), y + rng.randint(1, high)))(rng.randint(0, 170), rng.randint(0, 120))
    for page in range(60):
        out[page] = ([box(60, 9) for _ in range(rng.randint(1, 9))], [(*box(90, 60), rng.random() < 0.5) for _ in range(rng.randint(0, 3))], [box(150, 70) for _ in range(rng.randint(0, 4))], [box(26, 22) for _ in range(rng.randint(0, 16))])
    out[0] = ([(10, 10, 60, 20)], [], [], [(0, 0, 200, 150), (5, 5, 150, 90), (1, 1, 22, 22), (20, 2, 40, 30), (39, 3, 41, 4)])
    return out


def frame(spark, pages, at, schema=BOX):
    return spark.createDataFrame([(p, *[float(v) for v in b[:4]], *b[4:]) for p, parts in pages.items() for b in parts[at]], schema)


def test_merged(spark, pages):
    got = defaultdict(list)
    for r in greedy.merged(frame(spark, pages, 3), 5.0).collect():
        got[r.page].append(list(r[1:]))
    assert all(sorted(got[p]) == sorted(hulls(parts[3], touch(2.5))) for p, parts in pages.items())


def test_hidden_pages(spark, pages):
    got = dict(map(tuple, cover.hidden_pages(frame(spark, pages, 0), frame(spark, pages, 2)).collect()))
    want = {p: sum(share(b, hulls(parts[2], touch(0.5))) for b in parts[0]) / len(parts[0]) >= 0.5 for p, parts in pages.items()}
    assert got == want and len(set(want.values())) == 2


def test_ghosts(spark, pages):
    got = sorted(map(tuple, cover.ghosts(frame(spark, pages, 0), frame(spark, pages, 1, BOX + ", baked boolean"), frame(spark, pages, 2)).collect()))
    want = []
    for p, (lines, images, hidden, _) in pages.items():
        all_, baked, lost = (hulls(bs, touch(0.5)) for bs in ([i[:4] for i in images], [i[:4] for i in images if i[4]], hidden))
        for b in lines:
            x, y = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
            centred = any(c[0] <= x <= c[2] and c[1] <= y <= c[3] for c in all_)
            want.append((p, *map(float, b), area(b) > 0 and share(b, all_) >= 0.6 and centred and (share(b, baked) >= 0.6 or share(b, lost) >= 0.6)))
    assert got == sorted(want) and {r[-1] for r in got} == {True, False}


def test_figures(spark, pages):
    sizes = spark.createDataFrame([(p, 200.0, 150.0) for p in pages], "page long, width double, height double")
    got = sorted(map(tuple, cover.figures(frame(spark, pages, 3), frame(spark, pages, 0), frame(spark, pages, 1, BOX + ", baked boolean"), sizes).collect()))
    want, sheet = [], 200 * 150
    for p, (lines, images, _, shapes) in pages.items():
        shapes = [b for b in shapes if area(b) > 0 and area(b) <= 0.96 * sheet and not (b[2] - b[0] > 100 and area(b) > 0.25 * sheet)]
        for r in hulls(shapes, touch(2.5)):
            inside = [b for b in shapes if common(b, r) == area(b)]
            if r[2] - r[0] >= 30 and r[3] - r[1] >= 20 and len(inside) >= 3 and any(b[2] - b[0] > 1 and b[3] - b[1] > 1 for b in inside):
                r = [max(0, r[0] - 2), max(0, r[1] - 2), min(200, r[2] + 2), min(150, r[3] + 2)]
                if sum(common(r, b) for b in lines) <= (0.7 if area(r) <= 0.03 * sheet else 0.25) * area(r) and sum(common(r, b) for b in images) <= 0.6 * area(r):
                    want.append((p, *map(float, r)))
    assert got == sorted(want) and 5 < len(want) < 60 and (0, 0.0, 0.0, 43.0, 32.0) in got


LINES = "page long, det int, kept boolean, size double, tail double, head double, x1 double, y1 double, x2 double, y2 double"


def test_absorbed_rows(spark):
    rows = [
        # an erased stretch in two pieces between two texts; a third text further on
        (1, 1, True, 10.0, None, None, 0.0, 0.0, 50.0, 10.0), (1, 2, False, None, None, None, 51.0, 1.0, 60.0, 9.0), (1, 3, False, None, None, None, 63.0, 3.0, 90.0, 14.0), (1, 4, True, 10.0, None, None, 80.0, 0.0, 99.0, 10.0), (1, 5, True, 10.0, None, None, 120.0, 0.0, 130.0, 10.0),
        # the same with blanks at the end already
        (2, 1, True, 10.0, 5.0, None, 0.0, 0.0, 50.0, 10.0), (2, 2, False, None, None, None, 50.0, 0.0, 70.0, 10.0), (2, 3, True, 10.0, None, None, 75.0, 0.0, 99.0, 10.0),
        # a row that opens with the erased stretch, in a column with text far to the left
        (3, 1, True, 10.0, None, 1.0, 40.0, 0.0, 90.0, 10.0), (3, 2, False, None, None, None, 5.0, 0.0, 39.0, 10.0), (3, 3, True, 10.0, None, None, 0.0, 2.0, 10.0, 12.0), (3, 4, True, 10.0, None, None, 0.0, 30.0, 10.0, 40.0),
        # a formula with no text in its row, and one with text at its left alone
        (4, 1, False, None, None, None, 0.0, 0.0, 9.0, 10.0), (4, 2, True, 10.0, None, None, 0.0, 20.0, 30.0, 30.0), (4, 3, False, None, None, None, 31.0, 20.0, 50.0, 30.0),
    ]
    got = {r[:2]: r[2:] for r in map(tuple, gaps.absorbed(spark.createDataFrame(rows, LINES)).collect())}
    assert got == {(1, 1): (0.0, 80.0, 30.0, None, 12, 0), (2, 1): (0.0, 70.0, 25.0, None, 0, 0), (3, 1): (10.0, 80.0, None, 31.0, 0, 0)}


def test_absorbed_against_loops(spark):
    rng, rows = random.Random(8), []
    for page in range(150):
        for det in range(rng.randint(2, 14)):
            x, y = rng.randint(0, 12) * 10, rng.randint(0, 3) * 11
            rows.append((page, det, rng.random() < 0.6, float(rng.randint(6, 12)), rng.choice([None, 3.0]), rng.choice([None, 2.0]), float(x), float(y), float(x + rng.randint(4, 28)), float(y + rng.randint(6, 10))))
    got = {r[:2]: r[2:] for r in map(tuple, gaps.absorbed(spark.createDataFrame(rows, LINES)).collect())}
    band = lambda a, b: min(a[3], b[3]) - max(a[1], b[1])
    want = {}
    for page in range(150):
        mine = [r for r in rows if r[0] == page]
        hosts, tails, heads = [r for r in mine if r[2]], defaultdict(float), defaultdict(float)
        for c in hulls([r[6:] for r in mine if not r[2]], lambda a, b: b[0] <= a[2] + 4 and a[0] <= b[2] + 4 and band(a, b) > -2):
            near = [h for h in hosts if band(h[6:], c) > 0 and c[0] - 8 <= h[8] <= c[0] + 2]
            if near:
                h = max(near, key=lambda h: (band(h[6:], c), h[8], -h[1]))
                stops = [o[6] for o in hosts if o is not h and band(o[6:], h[6:]) > 0 and o[6] > h[8] - (h[4] or 0) + 2]
                if stops and c[0] < min(stops) - 2 and min(c[2], *stops) - h[8] > 0.5:
                    tails[h[1]] = max(tails[h[1]], min(c[2], *stops) - h[8])
                    continue
            near = [h for h in hosts if band(h[6:], c) > 0 and c[2] - 2 <= h[6] <= c[2] + 8]
            if near:
                h = min(near, key=lambda h: (h[6], h[1]))
                start = max([c[0], *[o[8] for o in hosts if o is not h and band(o[6:], h[6:]) > 0 and o[8] < h[6] + (h[5] or 0) - 2]])
                if h[6] - start > 0.5:
                    heads[h[1]] = max(heads[h[1]], h[6] - start)
        for h in hosts:
            t, d = tails.get(h[1]), heads.get(h[1])
            if t or d:
                blanks = lambda own, extra, size=h[3]: max(1, round(extra / (0.25 * size))) if extra and own is None else 0
                want[page, h[1]] = (h[6] - (d or 0), h[8] - h[6] + (t or 0) + (d or 0), (h[4] or 0) + t if t else h[4], (h[5] or 0) + d if d else h[5], blanks(h[4], t), blanks(h[5], d))
    assert got == want and len(want) > 30 and any(w[5] for w in want.values()) and any(w[4] for w in want.values())
