"""Multi-object tracking by stream: constant-velocity filters, thresholded assignment in two score bands, track lifecycle."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Score bands, limits of the three associations, frames a lost track is kept, distance of duplicates.
HIGH, LOW, NEW = 0.25, 0.1, 0.25
FIRST, SECOND, FRESH = 0.8, 0.5, 0.7
BUFFER, DUPLICATE = 30, 0.15
#: Deviations of place and velocity in heights.
PLACE, SPEED = 1 / 20, 1 / 160
_MOTION = np.eye(8) + np.eye(8, k=4)


def started(box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State of a box (centre x, y, aspect, height) seen first, velocities zero."""
    h = box[3]
    dev = [2 * PLACE * h, 2 * PLACE * h, 1e-2, 2 * PLACE * h, 10 * SPEED * h, 10 * SPEED * h, 1e-5, 10 * SPEED * h]
    return np.r_[box, np.zeros(4)], np.diag(np.square(dev))


def predicted(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mean[3]
    noise = np.diag(np.square([PLACE * h, PLACE * h, 1e-2, PLACE * h, SPEED * h, SPEED * h, 1e-5, SPEED * h]))
    return _MOTION @ mean, _MOTION @ cov @ _MOTION.T + noise


def corrected(mean: np.ndarray, cov: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mean[3]
    seen = cov[:4, :4] + np.diag(np.square([PLACE * h, PLACE * h, 1e-1, PLACE * h]))
    gain = np.linalg.solve(seen, cov[:4]).T
    return mean + gain @ (box - mean[:4]), cov - gain @ seen @ gain.T


def corners(boxes: np.ndarray) -> np.ndarray:
    boxes = np.asarray(boxes, float).reshape(-1, 4)
    half = np.c_[boxes[:, 2] * boxes[:, 3], boxes[:, 3]] / 2
    return np.c_[boxes[:, :2] - half, boxes[:, :2] + half]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - IoU of boxes (centre x, y, aspect, height)."""
    a, b = corners(a)[:, None], corners(b)[None]
    side = np.clip(np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]), 0, None)
    inter, area = side.prod(-1), lambda c: (c[..., 2:] - c[..., :2]).prod(-1)
    return 1 - inter / (area(a) + area(b) - inter + 1e-7)


def assigned(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Pairs of least total cost where a row or column may stay alone for half the limit (shortest augmenting paths).

    The smaller side's members each take one of the other or a place of their own, at the limit.
    """
    n, m = cost.shape
    if not n or not m:
        return []
    if n > m:
        return sorted((a, b) for b, a in assigned(cost.T, limit))
    full, size = np.c_[cost, np.full((n, n), limit)], m + n
    u, v, row_of, way = np.zeros(n + 1), np.zeros(size + 1), np.zeros(size + 1, int), np.zeros(size + 1, int)
    for i in range(1, n + 1):
        row_of[0], at = i, 0
        least, used = np.full(size + 1, np.inf), np.zeros(size + 1, bool)
        while row_of[at]:
            used[at] = True
            slack = full[row_of[at] - 1] - u[row_of[at]] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], at
            nxt = int(np.argmin(np.where(used, np.inf, least)))
            step = least[nxt]
            u[row_of[used]] += step
            v[used] -= step
            least[~used] -= step
            at = nxt
        while at:
            row_of[at], at = row_of[way[at]], way[at]
    return sorted((int(r) - 1, j) for j, r in enumerate(row_of[1 : m + 1]) if r)


@dataclass
class Track:
    id: int
    mean: np.ndarray
    cov: np.ndarray
    first: int
    last: int
    confirmed: bool
    lost: bool = False

    def take(self, box: np.ndarray, frame: int) -> None:
        self.mean, self.cov = corrected(self.mean, self.cov, box)
        self.last, self.confirmed, self.lost = frame, True, False


@dataclass
class Tracker:
    tracks: list[Track] = field(default_factory=list)
    frame: int = 0
    ids: int = 0

    def step(self, boxes: np.ndarray, scores: np.ndarray) -> list[tuple[int, int]]:
        """One frame's boxes (centre x, y, aspect, height): (index of the box, track) for tracks seen in it."""
        self.frame += 1
        found: dict[int, int] = {}

        def associate(tracks: list[Track], free: list[int], limit: float, fused: bool) -> tuple[list[Track], list[int]]:
            cost = distances([t.mean[:4] for t in tracks], boxes[free])
            pairs = assigned(1 - (1 - cost) * scores[free] if fused else cost, limit)
            for t, d in pairs:
                tracks[t].take(boxes[free[d]], self.frame)
                found[free[d]] = tracks[t].id
            gone, taken = {t for t, _ in pairs}, {d for _, d in pairs}
            return [t for i, t in enumerate(tracks) if i not in gone], [f for i, f in enumerate(free) if i not in taken]

        known = sorted((t for t in self.tracks if t.confirmed), key=lambda t: t.lost)
        fresh = [t for t in self.tracks if not t.confirmed]
        for t in known:
            if t.lost:
                t.mean[7] = 0
            t.mean, t.cov = predicted(t.mean, t.cov)
        left, high = associate(known, list(np.flatnonzero(scores >= HIGH)), FIRST, True)
        left, _ = associate([t for t in left if not t.lost], list(np.flatnonzero((scores > LOW) & (scores < HIGH))), SECOND, False)
        for t in left:
            t.lost = True
        dropped, high = associate(fresh, high, FRESH, True)
        gone = {t.id for t in dropped} | {t.id for t in known if t.lost and self.frame - t.last > BUFFER}
        for d in high:
            if scores[d] >= NEW:
                self.ids += 1
                self.tracks.append(Track(self.ids, *started(boxes[d]), self.frame, self.frame, self.frame == 1))
                if self.frame == 1:
                    found[d] = self.ids
        self.tracks = without_duplicates([t for t in self.tracks if t.id not in gone])
        alive = {t.id for t in self.tracks}
        return sorted((int(d), t) for d, t in found.items() if t in alive)


def without_duplicates(tracks: list[Track]) -> list[Track]:
    """Of a seen and a lost track at the same place the one that lived longer stays, the lost one of equals."""
    seen, lost = [t for t in tracks if not t.lost], [t for t in tracks if t.lost]
    near = distances([t.mean[:4] for t in seen], [t.mean[:4] for t in lost]) < DUPLICATE
    drop = {(lost[q] if seen[p].last - seen[p].first > lost[q].last - lost[q].first else seen[p]).id for p, q in zip(*np.nonzero(near), strict=True)}
    return [t for t in tracks if t.id not in drop]


SCHEMA = "stream long, frame long, det int, track int"


def _frames(tracker: Tracker, rows) -> Iterator[tuple]:
    """Frames one after another; only the boxes of one are held."""
    for (stream, frame), some in groupby(rows, key=lambda r: (r.stream, r.frame)):
        some = list(some)
        boxes = np.array([[(r.x1 + r.x2) / 2, (r.y1 + r.y2) / 2, (r.x2 - r.x1) / (r.y2 - r.y1), r.y2 - r.y1] for r in some])
        yield from ((stream, frame, some[d].det, t) for d, t in tracker.step(boxes, np.array([r.conf for r in some])))


COLUMNS = ["stream", "frame", "det", "x1", "y1", "x2", "y2", "conf"]


def tracked(boxes: DataFrame) -> DataFrame:
    """Whole streams of frames as a batch: (stream, frame, det, track). Boxes without an area are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for pdf in parts for r in pdf.itertuples(index=False))
        for _, stream in groupby(rows, key=lambda r: r.stream):
            yield pd.DataFrame(_frames(Tracker(), stream), columns=["stream", "frame", "det", "track"])

    return boxes.select(*COLUMNS).where("x2 > x1 AND y2 > y1").repartition("stream").sortWithinPartitions("stream", "frame", "det", "x1", "y1").mapInPandas(run, SCHEMA)


def tracked_stream(boxes: DataFrame) -> DataFrame:
    """The same on a stream whose triggers bring frames in order; tracks are its state."""

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tracker = pickle.loads(state.get[0]) if state.exists else Tracker()
        rows = pd.concat(parts).sort_values(["frame", "det", "x1", "y1"]).itertuples(index=False)
        out = pd.DataFrame(list(_frames(tracker, rows)), columns=["stream", "frame", "det", "track"])
        state.update((pickle.dumps(tracker),))
        yield out

    return boxes.select(*COLUMNS).where("x2 > x1 AND y2 > y1").groupBy("stream").applyInPandasWithState(run, SCHEMA, "tracker binary", "append", "NoTimeout")
