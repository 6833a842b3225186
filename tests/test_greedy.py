import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirebase import queries
from quirebase.operators import greedy
from quirebase.sources import records


@given(st.text(alphabet="Aa1 .!?。\"')é\n", max_size=80))
@settings(max_examples=300, deadline=None)
def test_sentences_cover_the_text(text):
    spans = greedy.sentences(text)
    assert "".join(text[a:b] for a, b in spans) == text and all(a < b for a, b in spans)


def test_sentence_rules():
    cut = lambda t: [t[a:b] for a, b in greedy.sentences(t)]
    assert cut("One. Two. three.") == ["One.", " Two. three."]
    assert cut("See Fig. 3 here. Next") == ["See Fig. 3 here.", " Next"]
    assert cut("By Smith et al. A lot.") == ["By Smith et al.", " A lot."]
    assert cut("It is 3.14 now. Dr. Who 1. 2") == ["It is 3.14 now.", " Dr. Who 1. 2"]
    assert cut("好。。是") == ["好。", "。", "是"] and cut('He said "No!" (Yes) A.B ') == ['He said "No!"', " (Yes) A.", "B "]
    assert cut("End. ") == ["End.", " "] and cut("") == []


def greedy_pages(boxes, order, clash):
    """Brute force: (page, det) of the boxes taken; ties go by all the columns."""
    kept = []
    for b in sorted(boxes, key=lambda b: (order(b), b.det, b.cls, b.conf, b.x1, b.y1, b.x2, b.y2)):
        if not any((k.page, k.cls) == (b.page, b.cls) and clash(k, b) for k in kept):
            kept.append(b)
    return sorted((b.page, b.det, b.cls) for b in kept)


def test_greedy_against_brute_force(spark, sf):
    boxes = [b for b in queries.boxes(spark, sf).collect() if b.page <= 600]
    inter = lambda a, b: max(0, min(a.x2, b.x2) - max(a.x1, b.x1)) * max(0, min(a.y2, b.y2) - max(a.y1, b.y1))
    area = lambda a: (a.x2 - a.x1) * (a.y2 - a.y1)
    iou = lambda a, b: inter(a, b) / (area(a) + area(b) - inter(a, b))
    cases = {
        "a01_duplicate_suppression": (lambda b: (-area(b), -b.conf), lambda a, b: max(iou(a, b), inter(a, b) / min(area(a), area(b))) >= 0.5),
        "a02_nms": (lambda b: -b.conf, lambda a, b: iou(a, b) >= 0.45),
        "a39_distinct_formulas": (lambda b: (b.y1, b.x1), lambda a, b: abs(a.x1 - b.x1) <= 12 and abs(a.y1 - b.y1) <= 12),
    }
    for name, (order, clash) in cases.items():
        out = queries.QUERIES[name](spark, sf).where("page <= 600").collect()
        assert sorted((r.page, r.det, r.cls) for r in out if "kept" not in r.__fields__ or r.kept) == greedy_pages(boxes, order, clash), name


def test_suppression_keeps_no_overlapping_pair(spark, sf):
    for query, by_area, limit in (("a01_duplicate_suppression", True, 0.5), ("a02_nms", False, 0.45)):
        out = queries.QUERIES[query](spark, sf).collect()
        assert len(out) == queries.boxes(spark, sf).count()
        assert all(r.kept or (r.ratio if by_area else r.iou) >= limit for r in out)
        assert any(r.kept for r in out) and any(not r.kept for r in out)


def test_merge_reaches_a_fixpoint(spark, sf):
    pages = {}
    for r in queries.a15_merged_rects(spark, sf).collect():
        pages.setdefault(r.page, []).append(r)
    for rects in pages.values():
        for i, a in enumerate(rects):
            for b in rects[:i]:
                assert not (a.x1 < b.x2 + 0.5 and b.x1 < a.x2 + 0.5 and a.y1 < b.y2 + 0.5 and b.y1 < a.y2 + 0.5)


def test_records(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, records.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [tuple(r) for r in records.without({"t": old}, new, "k")["t"].collect()] == [(1, "a")]
