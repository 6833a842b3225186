"""Plans over the text runs of lines, erased formula pieces, marked ranges, and the states of sessions and predictors.

Each takes the view it reads as a second argument; tests bind it to written rows with known results.
"""

from __future__ import annotations

from .catalog import plan
from .dialect import Dialect
from .views import BOXES

S = "CAST({0} AS VARCHAR(20))"

#: Text runs: baseline y where known, top of the run's box, top of the line's box.
SPANS = """spans AS (SELECT CAST(floor(p_partkey / 6) AS BIGINT) AS line, p_partkey AS run, CASE WHEN p_partkey % 11 = 3 THEN NULL ELSE 100 + CAST(p_partkey % 3 AS DOUBLE) / 4 END AS base, CAST(p_size AS DOUBLE) AS size,
 CASE WHEN p_partkey % 7 = 2 THEN '  ' ELSE substring(p_name, 1, CAST(4 + p_partkey % 9 AS INTEGER)) END AS text, CASE WHEN p_partkey % 13 = 5 THEN NULL ELSE 90 + CAST(p_partkey % 5 AS DOUBLE) END AS top, 88e0 AS line_top FROM part)"""


@plan
def a12_a13_baseline_and_top(d: Dialect, view: str = SPANS) -> str:
    """A line's baseline: the height, to a tenth, of most characters (a blank run counts one), then of the largest run, then the first.

    Its top: that of the first run of most visible characters, or the line's own where no run has any, or that run has no box.
    """
    n = f"length({d.trim('text')})"
    heights = f"heights AS (SELECT line, {d.even('base', 1)} AS y, sum(greatest(1, {n})) AS chars, max(coalesce(size, 0)) AS size, min(run) AS run FROM spans WHERE base IS NOT NULL GROUP BY line, {d.even('base', 1)})"
    bases = "bases AS (SELECT line, y, row_number() OVER (PARTITION BY line ORDER BY chars DESC, size DESC, run) AS k FROM heights)"
    tops = f"tops AS (SELECT line, CASE WHEN {n} > 0 THEN coalesce(top, line_top) ELSE line_top END AS top, row_number() OVER (PARTITION BY line ORDER BY {n} DESC, run) AS k FROM spans)"
    return f"WITH {view}, {heights}, {bases}, {tops} SELECT t.line, b.y AS baseline, t.top FROM tops t LEFT JOIN bases b ON t.line = b.line AND b.k = 1 WHERE t.k = 1"


#: Blocks of documents in reading order, some without id, some ids twice.
BLOCKS = f"blocks AS (SELECT l_orderkey AS doc, l_linenumber AS pos, CASE WHEN l_partkey % 9 = 0 THEN '' WHEN l_partkey % 10 = 1 THEN NULL ELSE 'p' || {S.format('l_suppkey % 3')} END AS id, CASE WHEN l_partkey % 8 = 2 THEN NULL ELSE 'text ' || {S.format('l_partkey')} END AS text FROM lineitem)"


@plan
def a24_block_texts(d: Dialect, view: str = BLOCKS) -> str:
    """The last text of each block id of a document, empty where it has none; blocks without id are left out. Of texts at one place the greatest counts."""
    return f"WITH {view}, ranked AS (SELECT doc, id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY doc, id ORDER BY pos DESC, coalesce(text, '') DESC) AS k FROM blocks WHERE id <> '') SELECT doc, id, text FROM ranked WHERE k = 1"


#: Lines after their formula glyphs became blanks, and the blanked pieces as character ranges.
PIECES = f"""erased AS (SELECT CAST(floor(p_partkey / 3) AS BIGINT) AS blk, p_partkey % 3 AS line, CASE WHEN p_partkey % 5 = 1 THEN '    ' WHEN p_partkey % 7 = 2 THEN '' WHEN p_partkey % 6 = 4 THEN p_name || '-' ELSE 'x' || {S.format('p_size')} || '+ where ' || p_name END AS text, CAST(10 + p_partkey % 4 AS DOUBLE) AS x, CAST(12 * (p_partkey % 3) AS DOUBLE) AS y, CAST(50 + p_size AS DOUBLE) AS w, 10e0 AS h FROM part),
segs AS (SELECT CAST(floor(p_partkey / 3) AS BIGINT) AS blk, p_partkey % 3 AS line, CAST(k * (3 + p_partkey % 5) AS INTEGER) AS a, CAST(k * (3 + p_partkey % 5) + 1 + (p_partkey + k) % 3 AS INTEGER) AS b, CAST(1 + (p_partkey + k) % 3 AS INTEGER) AS n FROM part CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k UNION ALL SELECT 3 AS k) ks WHERE p_partkey % 5 < 4)"""
#: Most characters between two pieces of a formula, and the word that parts them.
BETWEEN, WORD = 4, "[A-Za-z]{3,}"


def grouped(d: Dialect) -> str:
    """CTEs: the pieces of a line that are one formula, (blk, line, a, b, spaces, parts). A piece's own predecessor decides, so a lag does."""
    own = "PARTITION BY blk, line ORDER BY a, b"
    gap = "substring(text, before + 1, a - before)"
    near = f"before IS NOT NULL AND a >= before AND length({gap}) <= {BETWEEN} AND NOT {d.rx(gap, d.pat('§s'))} AND NOT {d.rx(gap, WORD)}"
    lagged = f"lagged AS (SELECT s.blk, s.line, s.a, s.b, s.n, e.text, lag(s.b) OVER (PARTITION BY s.blk, s.line ORDER BY s.a, s.b) AS before FROM segs s JOIN erased e ON s.blk = e.blk AND s.line = e.line)"
    marked = f"marked AS (SELECT blk, line, a, b, n, sum(CASE WHEN {near} THEN 0 ELSE 1 END) OVER ({own} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM lagged)"
    last = f"lasts AS (SELECT *, row_number() OVER (PARTITION BY blk, line, grp ORDER BY a DESC, b DESC) AS k FROM marked)"
    return f"{lagged}, {marked}, {last}, formulas_ AS (SELECT blk, line, min(a) AS a, max(CASE WHEN k = 1 THEN b END) AS b, CAST(sum(n) AS BIGINT) AS spaces, count(*) AS parts FROM lasts GROUP BY blk, line, grp)"


@plan
def w12_formula_pieces(d: Dialect, view: str = PIECES) -> str:
    """Blanked pieces of a line are one formula where at most four characters, no white space and no word of three letters part them."""
    return f"WITH {view}, {grouped(d)} SELECT blk, line, a, b, spaces, parts FROM formulas_"


def kept_lines(d: Dialect) -> str:
    """CTE: lines that still have text, with the offset of their first character among a block's kept lines, a break counting one."""
    return f"kept AS (SELECT blk, line, text, {d.trim('text')} AS t, x, y, w, h, coalesce(sum(length(text) + 1) OVER (PARTITION BY blk ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM erased WHERE {d.trim('text')} <> '')"


@plan
def f55_rebuilt_blocks(d: Dialect, view: str = PIECES) -> str:
    """Blocks without the lines that became blank: box and text of the others, a hyphen at a line's end gone with the break; empty blocks go."""
    glued = f"CASE WHEN line = first_ THEN t WHEN before LIKE '%-' THEN t ELSE ' ' || t END"
    cut = "CASE WHEN t LIKE '%-' AND line <> last_ THEN substring({0}, 1, length({0}) - 1) ELSE {0} END"
    ends = "SELECT *, min(line) OVER (PARTITION BY blk) AS first_, max(line) OVER (PARTITION BY blk) AS last_, lag(t) OVER (PARTITION BY blk ORDER BY line) AS before FROM kept"
    return f"WITH {view}, {kept_lines(d)}, joined AS (SELECT *, {cut.format('g')} AS piece FROM (SELECT *, {glued} AS g FROM ({ends}) s1) s2) SELECT blk, count(*) AS lines, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, {d.glue('piece', chr(39) * 2, 'line')} AS text FROM joined GROUP BY blk"


@plan
def f55_formula_slots(d: Dialect, view: str = PIECES) -> str:
    """Where a formula's blanks lie in the rebuilt block, at -1 if the line went; whether the line has nothing else."""
    return f"WITH {view}, {grouped(d)}, {kept_lines(d)} SELECT f.blk, f.line, f.a AS from_, CAST(coalesce(k.at_ + f.a, -1) AS BIGINT) AS a, CAST(coalesce(k.at_ + f.b, -1) AS BIGINT) AS b, f.spaces, k.blk IS NULL AS whole_line FROM formulas_ f LEFT JOIN kept k ON f.blk = k.blk AND f.line = k.line"


#: Sentences of a document's items in reading order, and one selection a document by its two ends, in either order.
RANGES = """sentences AS (SELECT l_orderkey AS doc, l_linenumber AS item, si, CASE WHEN l_suppkey % 5 = 0 THEN 'img' ELSE 'blk' END AS kind FROM lineitem CROSS JOIN (SELECT 0 AS si UNION ALL SELECT 1 AS si UNION ALL SELECT 2 AS si) q WHERE si <= l_partkey % 3),
ends AS (SELECT o_orderkey AS doc, CAST(1 + o_custkey % 5 AS INTEGER) AS item_a, CAST(o_custkey % 3 AS INTEGER) AS si_a, CAST(1 + o_orderkey % 6 AS INTEGER) AS item_b, CAST(o_orderkey % 2 AS INTEGER) AS si_b FROM orders)"""


@plan
def w19_selected_range(d: Dialect, view: str = RANGES) -> str:
    """Whole sentences of text between two ends, both included, across items; the lesser end alone where there are none."""
    swap = "(item_b < item_a OR (item_b = item_a AND si_b < si_a))"
    low = ", ".join(f"CASE WHEN {swap} THEN {b} ELSE {a} END AS {n}" for n, a, b in (("i0", "item_a", "item_b"), ("s0", "si_a", "si_b"), ("i1", "item_b", "item_a"), ("s1", "si_b", "si_a")))
    within = "(s.item > e.i0 OR (s.item = e.i0 AND s.si >= e.s0)) AND (s.item < e.i1 OR (s.item = e.i1 AND s.si <= e.s1))"
    return f"WITH {view}, spans_ AS (SELECT doc, {low} FROM ends) SELECT e.doc, CAST(coalesce(s.item, e.i0) AS BIGINT) AS item, CAST(coalesce(s.si, e.s0) AS BIGINT) AS si FROM spans_ e LEFT JOIN sentences s ON e.doc = s.doc AND s.kind = 'blk' AND {within}"


#: Requests of sessions in seconds, still running where they have no end; the moment of the snapshot.
REQUESTS = f"""requests AS (SELECT 's' || {S.format('user_id')} AS session, event_id AS request, event_id * 3 AS began, CASE WHEN event_id % 17 <> 0 THEN event_id * 3 + 1 + event_id % 5 END AS ended, event_type <> 'error' AND event_id % 6 <> 1 AS ok, CASE WHEN event_id % 6 = 1 THEN 'busy ' || {S.format('event_id')} END AS error, event_id % 4 AS formulas, event_id % 2 AS tables FROM events),
moment AS (SELECT max(event_id) * 3 AS now_ FROM events)"""
#: Seconds a session outlives its last request, results kept a session, predictors of a pool, places in its queue.
TTL, KEPT, POOL, QUEUE = 1800, 8, 2, 4


def alive(d: Dialect) -> str:
    """CTEs: requests of the sessions that a snapshot finds, with their states then.

    A session ends when it has been idle for over TTL; a later request opens a new one of the same name, without the old one's counts.
    """
    seen = "seen AS (SELECT r.*, CASE WHEN r.ended <= m.now_ THEN r.ended END AS done, m.now_ FROM requests r CROSS JOIN moment m WHERE r.began <= m.now_)"
    own = "PARTITION BY session ORDER BY began, request ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    gaps = f"gaps AS (SELECT *, max(greatest(began, coalesce(done, began))) OVER ({own}) AS last_, coalesce(sum(CASE WHEN done IS NULL THEN 1 ELSE 0 END) OVER ({own}), 0) AS open_ FROM seen)"
    lives = f"lives AS (SELECT *, sum(CASE WHEN open_ = 0 AND began - last_ > {TTL} THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY began, request ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS life FROM gaps)"
    ends = "ends_ AS (SELECT session, life, max(greatest(began, coalesce(done, began))) AS updated, sum(CASE WHEN done IS NULL THEN 1 ELSE 0 END) AS in_flight, row_number() OVER (PARTITION BY session ORDER BY life DESC) AS k, max(now_) AS now_ FROM lives GROUP BY session, life)"
    return f"{seen}, {gaps}, {lives}, {ends}, alive AS (SELECT l.*, e.updated, e.in_flight FROM lives l JOIN ends_ e ON l.session = e.session AND l.life = e.life WHERE e.k = 1 AND (e.in_flight > 0 OR e.now_ - e.updated <= {TTL}))"


@plan
def a47_session_snapshot(d: Dialect, view: str = REQUESTS) -> str:
    """Every session that has not expired: requests, outcomes, what was sent and is running, the last error, results kept."""
    total = lambda f: f"CAST(sum({f}) AS BIGINT)"
    failed = "CASE WHEN done IS NOT NULL AND error IS NOT NULL THEN {0} END"
    return f"WITH {view}, {alive(d)} SELECT session, min(began) AS created, max(updated) AS updated, count(*) AS requests, {total('CASE WHEN done IS NOT NULL AND ok THEN 1 ELSE 0 END')} AS succeeded, {total('CASE WHEN done IS NOT NULL AND NOT ok THEN 1 ELSE 0 END')} AS failed, {total('formulas')} AS formulas, {total('tables')} AS tables, CAST(max(in_flight) AS BIGINT) AS in_flight, max_by({failed.format('error')}, {failed.format('done * 1000000 + request % 1000000')}) AS last_error, least({KEPT}, {total('CASE WHEN done IS NOT NULL AND ok THEN 1 ELSE 0 END')}) AS results FROM alive GROUP BY session"


@plan
def m22_session_results(d: Dialect, view: str = REQUESTS) -> str:
    """The results that a session still has, the last eight in the order they came; none of a session that expired."""
    return f"WITH {view}, {alive(d)}, ranked AS (SELECT session, request, done, row_number() OVER (PARTITION BY session ORDER BY done DESC, request DESC) AS back FROM alive WHERE done IS NOT NULL AND ok) SELECT session, request, CAST(row_number() OVER (PARTITION BY session ORDER BY back DESC) AS BIGINT) AS place FROM ranked WHERE back <= {KEPT}"


#: Calls to pools of predictors: when they came, got a predictor and were done; those that waited too long were turned away.
CALLS = """calls AS (SELECT user_id % 5 AS pool, event_id AS call, event_id AS came, CASE WHEN event_id % 13 <> 0 THEN event_id + event_id % 4 END AS began, CASE WHEN event_id % 13 <> 0 THEN event_id + event_id % 4 + 1 + event_id % 3 END AS ended, CASE WHEN event_id % 13 = 0 THEN event_id + 5 END AS refused, event_id % 10 = 7 AS broke, 1 + event_id % 6 AS images, event_id % 2 AS worker FROM events),
moment AS (SELECT max(event_id) AS now_ FROM events)"""


@plan
def a48_predictor_counters(d: Dialect, view: str = CALLS) -> str:
    """A pool at a moment: who waits and works, idle predictors, places, calls and images done, errors, calls turned away."""
    count = lambda c, v="1": f"CAST(sum(CASE WHEN {c} THEN {v} ELSE 0 END) AS BIGINT)"
    busy = count("began <= now_ AND ended > now_")
    return f"WITH {view}, at_ AS (SELECT c.*, m.now_ FROM calls c CROSS JOIN moment m WHERE c.came <= m.now_) SELECT pool, {POOL} - {busy} AS idle, {busy} AS busy, {count('(began IS NULL OR began > now_) AND (refused IS NULL OR refused > now_)')} AS waiting, {POOL + QUEUE} AS capacity, {count('ended <= now_ AND NOT broke')} AS requests, {count('ended <= now_ AND NOT broke', 'images')} AS images, {count('ended <= now_ AND broke')} AS errors, {count('refused <= now_')} AS rejected FROM at_ GROUP BY pool"


@plan
def a48_workers(d: Dialect, view: str = CALLS) -> str:
    """A pool's predictors at a moment: calls, images and busy time of all that they ended, also of those that broke."""
    return f"WITH {view} SELECT pool, worker, count(*) AS requests, CAST(sum(images) AS BIGINT) AS images, {d.even('CAST(sum(ended - began) AS DOUBLE)', 2)} AS busy FROM calls CROSS JOIN moment WHERE ended <= now_ GROUP BY pool, worker"


#: Rotated boxes: centre, sides and angle, with scores.
ROTATED = f"{BOXES}, turned AS (SELECT page, det, cls, conf, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, w, h, CAST(det AS DOUBLE) / 5 AS angle FROM boxes)"
#: The overlap that suppresses, the guard of divisions and logarithms, the bound of a distance.
OVERLAP, TINY, FAR = "0.45e0", "1e-7", "100e0"


@plan
def a41_fast_nms(d: Dialect, view: str = ROTATED) -> str:
    """Set-based: a rotated box goes if any of higher score is like it, as Gaussians by Hellinger distance, whether or not that one stays."""
    var = "pow(w, 2) / 12 * pow(cos(angle), 2) + pow(h, 2) / 12 * pow(sin(angle), 2) AS a, pow(w, 2) / 12 * pow(sin(angle), 2) + pow(h, 2) / 12 * pow(cos(angle), 2) AS b, (pow(w, 2) - pow(h, 2)) / 12 * cos(angle) * sin(angle) AS c"
    det = "((p.a + q.a) * (p.b + q.b) - pow(p.c + q.c, 2))"
    t1 = f"((p.a + q.a) * pow(p.y - q.y, 2) + (p.b + q.b) * pow(p.x - q.x, 2)) / ({det} + {TINY}) * 0.25e0"
    t2 = f"(p.c + q.c) * (q.x - p.x) * (p.y - q.y) / ({det} + {TINY}) * 0.5e0"
    own = "greatest({0}.a * {0}.b - pow({0}.c, 2), 0e0)"
    t3 = f"ln({det} / (4 * sqrt({own.format('p')} * {own.format('q')}) + {TINY}) + {TINY}) * 0.5e0"
    like = f"1 - sqrt(1 - exp(-least(greatest({t1} + {t2} + {t3}, {TINY}), {FAR})) + {TINY})"
    return f"WITH {view}, gauss AS (SELECT page, det, cls, conf, x, y, {var} FROM turned), hit AS (SELECT DISTINCT p.page, p.cls, p.det FROM gauss p JOIN gauss q ON p.page = q.page AND p.cls = q.cls AND (q.conf > p.conf OR (q.conf = p.conf AND q.det < p.det)) WHERE {like} >= {OVERLAP}) SELECT t.page, t.det, t.cls FROM turned t LEFT JOIN hit h ON t.page = h.page AND t.cls = h.cls AND t.det = h.det WHERE h.det IS NULL"


#: Documents by the parser that made them.
PARSED = "parsed AS (SELECT o_orderkey AS doc, CASE o_orderkey % 4 WHEN 0 THEN 'surya' WHEN 1 THEN 'unlimited_ocr' WHEN 2 THEN '' END AS parser FROM orders)"


@plan
def z03_reference_strategy(d: Dialect, view: str = PARSED) -> str:
    """The way in which a document's references are read: that of its parser, or of the text layer for none and all others."""
    return f"WITH {view} SELECT doc, CASE parser WHEN 'surya' THEN 'surya' WHEN 'unlimited_ocr' THEN 'unlimited_ocr' ELSE 'text_layer' END AS strategy FROM parsed"


#: Lines about formulas, one a page: rows already taken as the formula's, rows barred from it, characters in mathematical fonts.
ROWS = f"{BOXES}, rows_ AS (SELECT page AS formula, det, x1 * 2 AS x1, y1 / 4 AS y1, x1 * 2 + w / 4 AS x2, y1 / 4 + 10 AS y2, det <= 1 AS seed, cls = 5 AS barred, CASE WHEN cls <> 2 THEN CAST(8 + cls AS INTEGER) END AS math, 14 AS chars, 0e0 AS low, 28e0 AS high FROM boxes)"
#: Passes, share of the lesser height that is the same row, farthest neighbour, share of mathematical characters, slack of the formula's extent.
PASSES, SAME_ROW, BESIDE, MATHS, EXTENT = 4, "0.4e0", 12, "0.5e0", 2


@plan
def j35_extended_rows(d: Dialect, view: str = ROWS) -> str:
    """Rows of a formula: those taken first, then four times the ones level with them, mostly mathematical, and next to what is taken by then."""
    own = "OVER (PARTITION BY formula)"
    fit = f"NOT barred AND math IS NOT NULL AND math >= {MATHS} * greatest(1, chars) AND (y1 + y2) / 2 BETWEEN low - {EXTENT} AND high + {EXTENT} AND least(y2, bottom) - greatest(y1, top) >= {SAME_ROW} * least(y2 - y1, bottom - top)"
    steps = f"t0 AS (SELECT *, 0 AS pass, {fit} AS fit FROM (SELECT *, min(CASE WHEN seed THEN y1 END) {own} AS top, max(CASE WHEN seed THEN y2 END) {own} AS bottom FROM rows_) s0), p0 AS (SELECT *, CASE WHEN seed THEN 0 END AS taken FROM t0)"
    for i in range(1, PASSES + 1):
        hull = f"SELECT *, min(CASE WHEN taken IS NOT NULL THEN x1 END) {own} AS left{i}, max(CASE WHEN taken IS NOT NULL THEN x2 END) {own} AS right{i} FROM p{i - 1}"
        steps += f", p{i} AS (SELECT formula, det, x1, x2, fit, CASE WHEN taken IS NOT NULL THEN taken WHEN fit AND greatest(x1 - right{i}, left{i} - x2) <= {BESIDE} THEN {i} END AS taken FROM ({hull}) h{i})"
    return f"WITH {view}, {steps} SELECT formula, det, x1, x2, taken FROM p{PASSES} WHERE taken IS NOT NULL"
