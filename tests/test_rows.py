"""Order-dependent layout operators by properties and small cases; the tracker against brute force."""

from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from quirebase import queries
from quirebase.operators import markup, rows
from quirebase.streaming import tracker

BOX = "page long, det int, block int, blank boolean, text string, several boolean, is_link boolean, x1 double, y1 double, x2 double, y2 double"


def page(spark, *boxes, **more):
    base = {"block": 0, "blank": False, "text": "t", "several": True, "is_link": False}
    names = [c.split()[0] for c in BOX.split(", ")]
    data = [{**base, **more.get(f"b{i}", {}), "page": 1, "det": i, "x1": float(b[0]), "y1": float(b[1]), "x2": float(b[2]), "y2": float(b[3])} for i, b in enumerate(boxes)]
    return spark.createDataFrame([tuple(d[n] for n in names) for d in data], BOX)


def by_page(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.page].append(r)
    return out


def test_rows_are_the_components_of_overlapping_heights(spark, sf):
    got = {p: {r.det: r.row_ for r in rs} for p, rs in by_page(queries.QUERIES["j15_j16_row_groups"](spark, sf)).items()}
    boxes = by_page(queries.boxes(spark, sf))
    assert got.keys() == boxes.keys()
    for p, bs in boxes.items():
        if len({b.det for b in bs}) < len(bs):
            continue
        near = lambda a, b: min(a.y2, b.y2) - max(a.y1, b.y1) > 0.5 * min(a.y2 - a.y1, b.y2 - b.y1)
        label = {b.det: b.det for b in bs}
        for _ in bs:
            for a in bs:
                for b in bs:
                    if near(a, b):
                        label[a.det] = label[b.det] = min(label[a.det], label[b.det])
        same = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
        assert same(label) == same(got[p])


def groups(spark, *boxes, **more):
    return [r.block_group for r in sorted(rows.grouped(page(spark, *boxes, **more)).collect(), key=lambda r: r.det)]


def test_groups_along_rows(spark):
    b = {f"b{i}": {"block": i} for i in range(8)}
    assert groups(spark, (0, 0, 50, 10), (60, 0, 90, 10), (140, 0, 190, 10), **b) == [0, 0, 2]
    assert groups(spark, (0, 0, 50, 10), (60, 0, 90, 10), (140, 0, 190, 10), **b | {"b1": {"block": 1, "blank": True}}) == [0, 1, 0]
    assert groups(spark, (0, 0, 50, 10), (60, 0, 90, 10), **b | {"b1": {"block": 1, "text": " (3) "}}) == [0, 1]
    columns = [(x, y, x + 50, y + 10) for y in (0, 20, 40) for x in (0, 60)]
    assert groups(spark, *columns, **b) == list(range(6)) and groups(spark, *columns[:4], **b) == [0, 0, 2, 2]
    assert [tuple(r) for r in rows.corridors(page(spark, *columns)).collect()] == [(1, 50.0, 60.0)]
    assert rows.grouped(page(spark)).count() == 0


def flow(spark, *boxes, **more):
    return [(r.det, r.flow, r.place) for r in sorted(rows.flows(page(spark, *boxes, **more)).collect(), key=lambda r: r.det)]


def test_flows(spark, sf):
    a, b, c = (0, 0, 50, 10), (0, 20, 50, 30), (0, 40, 50, 50)
    assert flow(spark, a, b, c) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]
    assert flow(spark, a, b, c, b0={"text": "End."}, b2={"text": "(2)"}) == [(0, 0, 0), (1, 1, 0), (2, 2, 0)]
    assert flow(spark, a, (13, 20, 50, 30), (0, 71, 50, 80)) == [(0, 0, 0), (1, 1, 0), (2, 2, 0)]
    assert flow(spark, a, (5, 0, 60, 10), (2, 20, 50, 30)) == [(0, 0, 0), (1, 1, 0), (2, 0, 1)]
    out = by_page(queries.QUERIES["j17_flows"](spark, sf))
    assert sum(map(len, out.values())) == queries.boxes(spark, sf).count()


def test_clusters_cover_all_boxes(spark, sf):
    regions, boxes = by_page(queries.QUERIES["a17_clustered_rects"](spark, sf)), by_page(queries.boxes(spark, sf))
    for p, bs in boxes.items():
        assert len(regions[p]) <= len(bs) and all(any(r.x1 <= b.x1 and r.y1 <= b.y1 and r.x2 >= b.x2 and r.y2 >= b.y2 for r in regions[p]) for b in bs)
    two = rows.clustered(page(spark, (0, 0, 10, 10), (12, 0, 14, 10), (30, 0, 31, 1))).collect()
    assert [tuple(r)[2:] for r in two] == [(0.0, 0.0, 14.0, 10.0), (30.0, 0.0, 31.0, 1.0)]


def test_settled_items_keep_apart(spark, sf):
    shift = {(r.page, r.det): r.shift for r in queries.QUERIES["w27_settled"](spark, sf).collect()}
    for p, bs in by_page(queries.boxes(spark, sf)).items():
        if len({b.det for b in bs}) == len(bs):
            for a in bs:
                assert shift[p, a.det] >= 0
                for b in bs:
                    if (a.y1, a.x1, a.det) < (b.y1, b.x1, b.det) and min(a.x2, b.x2) - max(a.x1, b.x1) >= 0.5 * min(a.x2 - a.x1, b.x2 - b.x1):
                        assert b.y1 + shift[p, b.det] >= a.y2 + shift[p, a.det] + 2 - 1e-9


def test_column_gaps_and_claims(spark):
    out = lambda df: [tuple(r)[1:] for r in sorted(df.collect())]
    assert out(rows.spaced(page(spark, (0, 0, 100, 50), (104, 0, 200, 50), (203, 0, 300, 50)))) == [(0, 0.0, 97.0), (1, 107.0, 200.0), (2, 203.0, 300.0)]
    alone = {"several": False}
    assert out(rows.spaced(page(spark, (0, 0, 100, 50), (104, 0, 200, 50), b0=alone, b1=alone)))[0] == (0, 0.0, 100.0)
    link = {"is_link": True}
    claims = rows.claimed(page(spark, (0, 0, 10, 10), (0, 0, 12, 10), (5, 0, 30, 10), (90, 90, 99, 99), b0=link, b1=link, b3=link))
    assert out(claims) == [(0, 2)]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("<p>a  <b>b</b></p><p>c</p>", "a b\nc"),
        ("<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>x", "1 | 2\n3\nx"),
        ("a<script>no</script>&amp;<br/>b", "a&\nb"),
        ("x <math> a_1 </math>y <sup>2</sup>", "x a_1y 2"),
        ("<p>open <i>it", "open it"),
    ],
)
def test_markup(html, text):
    got, runs, math = markup.text_of(html)
    assert got == text == "".join(r[0] for r in runs) and all(a[1:] != b[1:] for a, b in zip(runs, runs[1:], strict=False))
    assert [got[a:b] for a, b in math] == (["a_1"] if html and "math" in html else [])


def test_markup_table(spark, sf):
    out = queries.QUERIES["x12_markup_text"](spark, sf).collect()
    assert out and all("".join(x.t for x in r.runs) == r.text and "  " not in r.text for r in out)


def test_assignment_is_the_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = map(int, rng.integers(1, 5, 2))
        cost, limit = rng.random((n, m)).round(3), 0.8
        best = 0.0  # a pair saves what it costs less than the limit
        for cols in permutations(range(m + n), n):
            best = max(best, sum(max(0.0, limit - cost[i, c]) for i, c in enumerate(cols) if c < m))
        pairs = tracker.assigned(cost, limit)
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
        assert sum(limit - cost[a, b] for a, b in pairs) == pytest.approx(best)
    assert tracker.assigned(np.zeros((0, 3)), 1) == []


def test_filter_is_the_gaussian_posterior():
    mean, cov = tracker.predicted(*tracker.started(np.array([10.0, 20.0, 1.5, 40.0])))
    box = np.array([12.0, 19.0, 1.4, 41.0])
    noise = np.diag(np.square([2.0, 2.0, 0.1, 2.0]))
    look = np.eye(4, 8)
    after = np.linalg.inv(np.linalg.inv(cov) + look.T @ np.linalg.inv(noise) @ look)
    wanted = after @ (np.linalg.inv(cov) @ mean + look.T @ np.linalg.inv(noise) @ box)
    got = tracker.corrected(mean, cov, box)
    assert np.allclose(got[0], wanted) and np.allclose(got[1], after)


def test_tracks_survive_weak_and_missing_frames():
    t, seen = tracker.Tracker(), []
    for f in range(60):
        boxes = np.array([[10.0 + 2 * f, 50.0, 1.0, 40.0], [300.0 - f, 200.0, 0.5, 60.0]])
        scores = np.array([0.9, 0.15 if f in (10, 11) else 0.8])
        keep = [i for i in (0, 1) if not (i == 0 and 20 <= f < 26)]
        seen += [(keep[d], k) for d, k in t.step(boxes[keep], scores[keep])]
    assert set(seen) == {(0, 1), (1, 2)} and len(seen) == 114
    for _ in range(40):
        assert t.step(np.zeros((0, 4)), np.zeros(0)) == []
    assert t.tracks == []


def test_duplicates():
    make = lambda i, first, last, lost: tracker.Track(i, np.r_[10.0, 10, 1, 20, 0, 0, 0, 0], np.eye(8), first, last, True, lost)
    assert [t.id for t in tracker.without_duplicates([make(1, 1, 9, False), make(2, 5, 9, True)])] == [1]
    assert [t.id for t in tracker.without_duplicates([make(1, 5, 9, False), make(2, 5, 9, True)])] == [2]


def test_tracking_a_stream_equals_the_batch(spark, sf, tmp_path):
    frames = queries.frames(spark, sf).where("stream < 8")
    cut = frames.approxQuantile("frame", [0.5], 0)[0]
    for name, part in (("a", frames.where(f"frame <= {cut}")), ("b", frames.where(f"frame > {cut}"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tracker.tracked_stream(source).writeStream.format("memory").queryName("tracks").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("tracks").collect())) == sorted(map(tuple, tracker.tracked(frames).collect()))
