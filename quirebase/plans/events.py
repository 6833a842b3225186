"""Plans over accounts, caches, stores, recogniser outcomes, tracked points and anchors: rules that keep state or pick one of many."""

from __future__ import annotations

from .catalog import plan
from .dialect import Dialect
from .views import BOXES

S = "CAST({0} AS VARCHAR(20))"

#: Sign-in attempts in whole seconds; ok ends a row of failures.
ATTEMPTS = "attempts AS (SELECT event_id, 'u' || CAST(user_id % 40 AS VARCHAR(20)) || '|10.0.0.' || CAST(user_id % 2 AS VARCHAR(20)) AS who, event_id AS sec, event_type = 'purchase' AND event_id % 3 = 0 AS ok FROM events)"
#: Failures that lock, seconds from the last one on.
FAILURES, LOCK = 8, 300


@plan
def m12_m21_lockout(d: Dialect, view: str = ATTEMPTS) -> str:
    """Before each attempt: failures since the last success, and the seconds left of the lock that FAILURES of them set."""
    order = "PARTITION BY who ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    runs = f"runs AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER ({order}), 0) AS run FROM attempts)"
    own = "PARTITION BY who, run ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    seen = f"seen AS (SELECT event_id, who, sec, coalesce(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER ({own}), 0) AS failures, max(CASE WHEN ok THEN NULL ELSE sec END) OVER ({own}) AS last_ FROM runs)"
    return f"WITH {view}, {runs}, {seen} SELECT event_id, who, CAST(failures AS BIGINT) AS failures, CAST(CASE WHEN failures >= {FAILURES} THEN greatest(0, {LOCK} - (sec - last_)) ELSE 0 END AS BIGINT) AS locked FROM seen"


#: A document's blocks before and after it was read anew, and the translations kept so far, by key of language and text.
BLOCKS = """old_ AS (SELECT l_orderkey AS doc, l_linenumber AS blk, 'text ' || CAST(l_partkey AS VARCHAR(20)) AS text FROM lineitem), new_ AS (SELECT doc, blk, CASE WHEN doc % 3 = 0 THEN text || ' x' WHEN doc % 7 = 1 THEN '' ELSE text END AS text FROM old_),
langs AS (SELECT 'zh' AS lang UNION ALL SELECT 'en' AS lang), cache_ AS (SELECT o.doc, sha1(l.lang || chr(0) || o.text) AS k, l.lang || ':' || o.text AS answer FROM old_ o CROSS JOIN langs l WHERE o.blk % 2 = 1 AND (l.lang = 'zh' OR o.doc % 5 = 0) UNION ALL SELECT n.doc, sha1('zh' || chr(0) || n.text) AS k, 'kept' AS answer FROM new_ n WHERE n.doc % 6 = 0 AND n.blk = 1)"""


@plan
def j12_key_migration(d: Dialect, view: str = BLOCKS) -> str:
    """Answers of blocks whose text changed go to the new text's key, in each language, unless that key has one."""
    changed = "changed AS (SELECT n.doc, n.blk, o.text AS was, n.text AS now_ FROM new_ n JOIN old_ o ON n.doc = o.doc AND n.blk = o.blk WHERE n.text <> '' AND o.text <> '' AND o.text <> n.text)"
    keys = "keys_ AS (SELECT c.doc, sha1(l.lang || chr(0) || c.was) AS from_, sha1(l.lang || chr(0) || c.now_) AS to_ FROM changed c CROSS JOIN langs l)"
    return f"WITH {view}, {changed}, {keys} SELECT DISTINCT k.doc, k.to_ AS k, c.answer FROM keys_ k JOIN cache_ c ON k.doc = c.doc AND k.from_ = c.k LEFT JOIN cache_ h ON k.doc = h.doc AND k.to_ = h.k WHERE h.k IS NULL AND c.answer <> ''"


#: Image names that documents refer to, several times some, and those that the store has.
IMAGES = "named AS (SELECT l_orderkey AS doc, 'p' || CAST(l_partkey % 4 AS VARCHAR(20)) || '.png' AS name FROM lineitem), stored AS (SELECT DISTINCT l_orderkey AS doc, 'p' || CAST(l_partkey % 4 AS VARCHAR(20)) || '.png' AS name FROM lineitem WHERE l_suppkey % 3 <> 0)"


@plan
def j28_missing_images(d: Dialect, view: str = IMAGES) -> str:
    """Of the distinct names that a document refers to those that are stored, and the list of the others."""
    gone = "CASE WHEN s.name IS NULL THEN n.name END"
    return f"WITH {view}, names AS (SELECT DISTINCT doc, name FROM named) SELECT n.doc, count(*) AS all_, count(s.name) AS have, {d.glue(gone, 'chr(32)', 'n.name')} AS missing FROM names n LEFT JOIN stored s ON n.doc = s.doc AND n.name = s.name GROUP BY n.doc"


#: What recognisers answered: nothing readable, an error, an empty or blank result, a good one.
OUTCOMES = """outcomes AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 2 = 0 THEN 'formula' ELSE 'table' END AS kind, p_partkey % 7 <> 5 AS is_record, CASE WHEN p_partkey % 5 = 1 THEN 'busy' WHEN p_partkey % 5 = 2 THEN '' END AS error, CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE p_name END AS rec_formula, CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE '<table>' || p_name END AS html FROM part)"""


@plan
def m07_outcomes(d: Dialect, view: str = OUTCOMES) -> str:
    """ok with a value, or an error: what the service said, else that there is nothing, else that the answer is no record."""
    value = f"CASE WHEN is_record THEN CASE WHEN kind = 'formula' THEN CASE WHEN {d.trim('rec_formula')} <> '' THEN rec_formula END ELSE CASE WHEN {d.trim('html')} <> '' THEN html END END END"
    error = "CASE WHEN NOT is_record THEN 'no record' WHEN error <> '' THEN error WHEN value_ IS NULL THEN 'no content' END"
    return f"WITH {view}, v AS (SELECT *, {value} AS value_ FROM outcomes) SELECT item, kind, coalesce(value_, '') AS value_, coalesce({error}, '') AS error, {error} IS NULL AS ok FROM v"


#: Points of tracks in time, in a field of 100 by 100.
POINTS = "points AS (SELECT user_id % 200 AS track, event_id AS sec, event_type AS cls, value AS x, CAST(event_id * 37 % 101 AS DOUBLE) AS y, CAST(floor(event_id / 50) AS BIGINT) AS frame FROM events)"
#: A line, upright, and a region with corners against the clock.
LINE, CORNERS = 50, [(10, 10), (90, 20), (80, 90), (20, 70)]


@plan
def a35_w24_line_crossings(d: Dialect, view: str = POINTS) -> str:
    """The first time that a track's step meets the line: IN to the right, OUT else, and its speed along the line; once per track."""
    order = "PARTITION BY track ORDER BY sec"
    steps = f"steps AS (SELECT track, sec, cls, x, y, lag(x) OVER ({order}) AS x0, lag(y) OVER ({order}) AS y0, lag(sec) OVER ({order}) AS sec0 FROM points)"
    met = f"met AS (SELECT *, row_number() OVER ({order}) AS k FROM steps WHERE x0 IS NOT NULL AND (x0 - {LINE}) * (x - {LINE}) <= 0)"
    return f"WITH {view}, {steps}, {met} SELECT track, sec, cls, CASE WHEN x > x0 THEN 'IN' ELSE 'OUT' END AS way, round(abs(y - y0) / (sec - sec0), 6) AS speed FROM met WHERE k = 1"


@plan
def a36_frame_counts(d: Dialect, view: str = POINTS) -> str:
    """Boxes by frame and class, and the class's total up to the frame."""
    return f"WITH {view}, c AS (SELECT frame, cls, count(*) AS n FROM points GROUP BY frame, cls) SELECT frame, cls, n, CAST(sum(n) OVER (PARTITION BY cls ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS so_far FROM c"


def within() -> str:
    """A point is left of every edge."""
    edges = zip(CORNERS, CORNERS[1:] + CORNERS[:1], strict=True)
    return " AND ".join(f"({bx - ax}) * (y - {ay}) - ({by - ay}) * (x - {ax}) > 0" for (ax, ay), (bx, by) in edges)


@plan
def a34_a37_region(d: Dialect, view: str = POINTS) -> str:
    """Points and tracks inside the region, by frame."""
    return f"WITH {view} SELECT frame, count(CASE WHEN {within()} THEN 1 END) AS inside, count(DISTINCT CASE WHEN {within()} THEN track END) AS tracks FROM points GROUP BY frame"


#: Places looked up on a page, and the lines there.
PLACES = f"{BOXES}, places AS (SELECT page, det, x2 + 3 AS px, y1 - 2 AS py FROM boxes WHERE det % 3 = 0), lines_ AS (SELECT page, det, x1, y1, x2, y2 FROM boxes WHERE det % 3 <> 0)"


@plan
def j32_nearest_line(d: Dialect, view: str = PLACES) -> str:
    """The line within 12 of a point in both directions that is nearest, heights counting twice."""
    dx, dy = "greatest(l.x1 - p.px, p.px - l.x2, 0e0)", "greatest(l.y1 - p.py, p.py - l.y2, 0e0)"
    near = f"near AS (SELECT p.page, p.det, l.det AS line, {dx} + 2 * {dy} AS far FROM places p JOIN lines_ l ON p.page = l.page AND {dx} <= 12 AND {dy} <= 12)"
    return f"WITH {view}, {near} SELECT page, det, line, far FROM (SELECT *, row_number() OVER (PARTITION BY page, det ORDER BY far, line) AS k FROM near) q WHERE k = 1"


@plan
def j08_candidates(d: Dialect, view: str = PLACES) -> str:
    """Of all candidates of a link the one least away from its middle, heights counting twice, the first of equal ones."""
    far = "abs(l.x1 - p.px) + 2 * abs(l.y1 - p.py)"
    return f"WITH {view} SELECT page, det, line, far FROM (SELECT p.page, p.det, l.det AS line, {far} AS far, row_number() OVER (PARTITION BY p.page, p.det ORDER BY {far}, l.det) AS k FROM places p JOIN lines_ l ON p.page = l.page) q WHERE k = 1"


#: Characters of a stretch in which places are counted: time grows with the text, not with its square.
STRETCH = 1024


@plan
def x23_positions(d: Dialect, view: str = "texts AS (SELECT doc_id AS item, text FROM documents)") -> str:
    """All places of a part in a text, overlapping ones too.

    Spark takes texts by stretches, each with the character behind it, and adds up lengths between parts, which can't overlap themselves.
    """
    if d.spark:
        stretches = f"regexp_extract_all(text, '(?s)(?=(.{{1,{STRETCH + 1}}})).{{1,{STRETCH}}}', 1)"
        step = "struct(acc.at + length(p) + 2 AS at, coalesce(concat(acc.found, ',', acc.at), '') AS found)"
        listed = f"aggregate(split(c, 'an', -1), struct(i * {STRETCH} - 1 AS at, CAST(NULL AS STRING) AS found), (acc, p) -> {step}, acc -> acc.found)"
        return f"WITH {view} SELECT item, substring(array_join(transform({stretches}, (c, i) -> {listed}), ''), 2) AS places FROM texts WHERE text <> ''"
    places = d.only("range(1, length(text) + 1)", "substring(text, CAST(x AS INTEGER), 2) = 'an'")
    return f"WITH {view} SELECT item, {d.join(d.each(places, 'CAST(x AS VARCHAR(20))'), 'chr(44)')} AS places FROM texts WHERE text <> ''"
