"""Plans that score detections against truths: matching, confusion matrix, average precision."""

from __future__ import annotations

from .catalog import AREA, INTER, plan
from .dialect import Dialect
from .views import BOXES

#: Odd detections of a page are predictions, even ones truths, so that boxes overlap as they do in a table of results.
SCORED = f"""{BOXES}, preds AS (SELECT page, det, cls, conf, x1, y1, x2, y2 FROM boxes WHERE det % 2 = 1), truths AS (SELECT page, det, cls, x1, y1, x2, y2 FROM boxes WHERE det % 2 = 0)"""
IOU = f"({INTER}) / ({AREA.format('a')} + {AREA.format('b')} - {INTER})"
#: Thresholds of the overlap that count as a hit; confidence and overlap from which a matrix counts; what keeps a recall finite.
LEVELS = [f"0.{n}e0" for n in range(50, 100, 5)]
CONF, OVERLAP, EPS = "0.25e0", "0.45e0", "1e-16"
BACKGROUND = -1


def met(on: str) -> str:
    return f"met AS (SELECT a.page, a.det AS p, b.det AS t, a.cls AS pc, b.cls AS tc, a.conf, {IOU} AS iou FROM preds a JOIN truths b ON a.page = b.page AND {on})"


def hits(d: Dialect) -> str:
    """CTEs up to hits (level, page, p): predictions that have a truth of their class; each takes its best, a truth the first that wants it."""
    levels = "levels AS (" + " UNION ALL ".join(f"SELECT {v} AS level" for v in LEVELS) + ")"
    best = "row_number() OVER (PARTITION BY level, page, p ORDER BY iou DESC, t)"
    first = "row_number() OVER (PARTITION BY level, page, t ORDER BY p)"
    return f"{met('a.cls = b.cls')}, {levels}, wanted AS (SELECT level, page, p, t, {best} AS k FROM met JOIN levels ON iou >= level), taken AS (SELECT level, page, p, t, {first} AS k2 FROM wanted WHERE k = 1), hits AS (SELECT level, page, p FROM taken WHERE k2 = 1)"


@plan
def j24_matches(d: Dialect, view: str = SCORED) -> str:
    return f"WITH {view}, {hits(d)} SELECT page, p AS det, count(*) AS levels, max(level) AS highest FROM hits GROUP BY page, p"


def matrix(d: Dialect) -> str:
    best = f"row_number() OVER (PARTITION BY page, p ORDER BY iou DESC, t{d.settled('pc, tc')})"  # a page may have a number twice
    own = "row_number() OVER (PARTITION BY page, t ORDER BY iou DESC, p)"
    sure = f"sure AS (SELECT page, det AS p, cls AS pc FROM preds WHERE conf > {CONF})"
    pairs = f"pairs_ AS (SELECT page, p, t, pc, tc FROM (SELECT *, {own} AS k2 FROM (SELECT *, {best} AS k FROM met WHERE iou > {OVERLAP} AND conf > {CONF}) q1 WHERE k = 1) q2 WHERE k2 = 1)"
    cells = f"SELECT pc, tc FROM pairs_ UNION ALL SELECT {BACKGROUND} AS pc, t.cls AS tc FROM truths t LEFT JOIN pairs_ m ON t.page = m.page AND t.det = m.t WHERE m.page IS NULL UNION ALL SELECT s.pc, {BACKGROUND} AS tc FROM sure s LEFT JOIN pairs_ m ON s.page = m.page AND s.p = m.p WHERE m.page IS NULL"
    return f"{met('a.det <> b.det')}, {sure}, {pairs}, matrix AS (SELECT pc, tc, count(*) AS n FROM ({cells}) q3 GROUP BY pc, tc)"


@plan
def a30_confusion(d: Dialect, view: str = SCORED) -> str:
    """Counts of (predicted, true) classes, each side with the background for what found no partner."""
    return f"WITH {view}, {matrix(d)} SELECT pc, tc, n FROM matrix"


@plan
def a46_true_false(d: Dialect, view: str = SCORED) -> str:
    return f"WITH {view}, {matrix(d)} SELECT pc AS cls, CAST(sum(CASE WHEN pc = tc THEN n ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN pc <> tc THEN n ELSE 0 END) AS BIGINT) AS fp FROM matrix WHERE pc <> {BACKGROUND} GROUP BY pc"


@plan
def a31_a32_a44_average_precision(d: Dialect, view: str = SCORED) -> str:
    """Area under the envelope of precision over recall at 101 points, by class and level, over the detections of all pages.

    Running sums and the envelope are made in two steps, by thousandths of confidence and inside these, so that no task has a whole class.
    """
    part = "PARTITION BY level, cls"
    flags = "flags AS (SELECT l.level, p.cls, p.page, p.det, p.conf, CAST(floor(p.conf * 1000) AS INTEGER) AS bin, CASE WHEN h.p IS NULL THEN 0 ELSE 1 END AS tp FROM preds p CROSS JOIN levels l LEFT JOIN hits h ON h.level = l.level AND h.page = p.page AND h.p = p.det)"
    bins = f"bins AS (SELECT level, cls, bin, coalesce(sum(tp) OVER ({part} ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tp0, coalesce(sum(n) OVER ({part} ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n0 FROM (SELECT level, cls, bin, sum(tp) AS tp, count(*) AS n FROM flags GROUP BY level, cls, bin) q4)"
    inner = "OVER (PARTITION BY f.level, f.cls, f.bin ORDER BY f.conf DESC, f.page, f.det ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    total = "totals AS (SELECT cls, count(*) AS labels FROM truths GROUP BY cls)"
    curve = f"curve AS (SELECT f.level, f.cls, f.bin, b.n0 + count(*) {inner} AS k, (b.tp0 + sum(f.tp) {inner}) / (CAST(t.labels AS DOUBLE) + {EPS}) AS rec, (b.tp0 + sum(f.tp) {inner}) / CAST(b.n0 + count(*) {inner} AS DOUBLE) AS pre FROM flags f JOIN bins b ON f.level = b.level AND f.cls = b.cls AND f.bin = b.bin JOIN totals t ON f.cls = t.cls)"
    later = f"later AS (SELECT level, cls, bin, coalesce(max(top) OVER ({part} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS rest FROM (SELECT level, cls, bin, max(pre) AS top FROM curve GROUP BY level, cls, bin) q5)"
    upper = "upper AS (SELECT c.level, c.cls, c.bin, c.k, c.rec, greatest(l.rest, max(c.pre) OVER (PARTITION BY c.level, c.cls, c.bin ORDER BY c.k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS env FROM curve c JOIN later l ON c.level = l.level AND c.cls = l.cls AND c.bin = l.bin)"
    # Stretches between neighbours; the last point of a bin goes on at the first of the next one, before the first and after the last are the sentinels.
    ends = "ends AS (SELECT level, cls, bin, min(k) AS k0, min_by(rec, k) AS rec0, min_by(env, k) AS env0, max_by(rec, k) AS rec1, max_by(env, k) AS env1 FROM upper GROUP BY level, cls, bin)"
    inside = "SELECT level, cls, rec AS a, env AS ya, lead(rec) OVER (PARTITION BY level, cls, bin ORDER BY k) AS b, lead(env) OVER (PARTITION BY level, cls, bin ORDER BY k) AS yb FROM upper"
    across = f"SELECT level, cls, rec1 AS a, env1 AS ya, coalesce(lead(rec0) OVER ({part} ORDER BY bin DESC), 1e0) AS b, coalesce(lead(env0) OVER ({part} ORDER BY bin DESC), 0e0) AS yb FROM ends"
    before = "SELECT level, cls, 0e0 AS a, 1e0 AS ya, min_by(rec0, k0) AS b, min_by(env0, k0) AS yb FROM ends GROUP BY level, cls"
    grid = d.ints("CAST(floor(a * 100) AS INTEGER)", "CAST(ceil(b * 100) AS INTEGER)")
    points = f"points AS (SELECT level, cls, x, ya + (yb - ya) * (x / 100e0 - a) / (b - a) AS y FROM (SELECT *, {grid} AS x FROM (SELECT * FROM ({inside}) q6 WHERE b IS NOT NULL UNION ALL SELECT * FROM ({across}) q7 UNION ALL SELECT * FROM ({before}) q8) q9 WHERE b > a) q10 WHERE x / 100e0 >= a AND x / 100e0 < b)"
    area = "sum(CASE WHEN x = 0 THEN y / 200 ELSE y / 100 END)"  # the point at 1 is the sentinel's 0
    return f"WITH {view}, {hits(d)}, {flags}, {bins}, {total}, {curve}, {later}, {upper}, {ends}, {points} SELECT level, cls, round({area}, 9) AS ap, count(*) AS points FROM points GROUP BY level, cls"
