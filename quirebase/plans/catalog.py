"""The set-based operators as plans: one statement each, for Catalyst to plan and for the oracle to check.

"""

from __future__ import annotations

from .dialect import Dialect, Plan
from .views import BOXES, CITES, NOTES, RECORDS, SHARES, TRACKS

PLANS: dict[str, Plan] = {}


def plan(f: Plan) -> Plan:
    PLANS[f.__name__] = f
    return f


# --- geometry and routing -------------------------------------------------------------------------------------------

INTER = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0e0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0e0)"
AREA = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
PAIRS = f"{BOXES}, pairs AS (SELECT a.page, a.det, b.det AS other, a.cls, b.cls AS other_cls, a.conf, b.conf AS other_conf, {INTER} AS inter, {AREA.format('a')} AS area_a, {AREA.format('b')} AS area_b, a.x1, a.y1, a.x2, a.y2, b.x1 AS u1, b.y1 AS v1, b.x2 AS u2, b.y2 AS v2 FROM boxes a JOIN boxes b ON a.page = b.page AND a.det < b.det)"


@plan
def f01_f04_f57_box_area(d: Dialect) -> str:
    return f"WITH {BOXES} SELECT page, det, coalesce(x1, 0e0) AS x0, coalesce(y1, 0e0) AS y0, greatest(w, 0e0) * greatest(h, 0e0) AS area FROM boxes WHERE greatest(w, 0e0) * greatest(h, 0e0) > 0"


@plan
def f02_f03_f11_f12_x54_overlaps(d: Dialect) -> str:
    iou = "inter / (area_a + area_b - inter)"
    return f"WITH {PAIRS} SELECT page, det, other, inter, CASE WHEN inter > 0 THEN greatest({iou}, inter / least(area_a, area_b)) ELSE 0e0 END AS ratio, CASE WHEN inter > 0 THEN {iou} ELSE 0e0 END AS iou, inter / area_b AS ioa, 1e0 - {iou} AS iou_distance FROM pairs"


@plan
def f13_giou_diou(d: Dialect) -> str:
    hull = "((greatest(x2, u2) - least(x1, u1)) * (greatest(y2, v2) - least(y1, v1)))"
    diag = "((greatest(x2, u2) - least(x1, u1)) * (greatest(x2, u2) - least(x1, u1)) + (greatest(y2, v2) - least(y1, v1)) * (greatest(y2, v2) - least(y1, v1)))"
    gap = "(((u1 + u2 - x1 - x2) * (u1 + u2 - x1 - x2) + (v1 + v2 - y1 - y2) * (v1 + v2 - y1 - y2)) / 4e0)"
    return f"WITH {PAIRS} SELECT page, det, other, inter / (area_a + area_b - inter) - ({hull} - (area_a + area_b - inter)) / {hull} AS giou, inter / (area_a + area_b - inter) - {gap} / {diag} AS diou FROM pairs"


@plan
def f05_f07_f08_f10_f56_box_formats(d: Dialect) -> str:
    cx = "least(greatest(x1, 0e0), 100e0)"
    c2 = "least(greatest(x2, 0e0), 100e0)"
    return f"WITH {BOXES} SELECT page, det, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, {cx} AS x1c, {c2} AS x2c, ({cx} + {c2}) / 2 / 100e0 AS cxn, ({c2} - {cx}) / 100e0 AS wn, {d.even('(x1 + x2) / 2 / 128e0', 6)} AS cx_norm FROM boxes"


@plan
def f06_normalised_rect(d: Dialect) -> str:
    return f"WITH {BOXES} SELECT page, det, CASE WHEN x2 > x1 AND y2 > y1 THEN x1 * 612e0 / 1000e0 END AS px, CASE WHEN x2 > x1 AND y2 > y1 THEN y1 * 792e0 / 1000e0 END AS py FROM boxes WHERE cls <> 3"


@plan
def f09_x50_scale_boxes(d: Dialect) -> str:
    return f"WITH {BOXES}, g AS (SELECT page, det, x1, y1, x2, y2, least(64e0 / 128e0, 96e0 / 100e0) AS gain FROM boxes), p AS (SELECT *, (96e0 - 100e0 * gain) / 2 AS pad FROM g) SELECT page, det, least(greatest(x1 / gain, 0e0), 128e0) AS sx1, least(greatest((y1 - pad) / gain, 0e0), 100e0) AS sy1, least(greatest(x2 / gain, 0e0), 128e0) AS sx2, pad FROM p"


@plan
def f15_f16_m04_routing(d: Dialect) -> str:
    name = "CASE cls WHEN 0 THEN 'InlineFormula' WHEN 1 THEN 'DISPLAYEDFORMULALINE' WHEN 2 THEN 'table' WHEN 3 THEN 'Figure' WHEN 4 THEN '' ELSE 'Footer' END"
    return f"WITH {BOXES}, named AS (SELECT page, det, cls, conf, lower({name}) AS name FROM boxes) SELECT page, det, CASE WHEN name IN ('inlineformula', 'displayedformulaline', 'displayedformulablock') THEN 'formula' WHEN name = 'table' THEN 'table' WHEN name = 'figure' THEN 'figure' WHEN name = '' AND cls = 4 THEN 'formula' ELSE 'other' END AS kind FROM named"


@plan
def f18_class_filter(d: Dialect) -> str:
    return f"WITH {BOXES} SELECT page, det, cls FROM boxes WHERE cls IN (SELECT CASE WHEN c <= 5 THEN c ELSE c - 1 END FROM (SELECT 2 AS c UNION ALL SELECT 6 AS c) q)"


@plan
def t01_reading_order(d: Dialect) -> str:
    return f"WITH {BOXES} SELECT page, det, CAST(row_number() OVER (PARTITION BY page ORDER BY y1, x1, det) AS INTEGER) AS place FROM boxes"


@plan
def a14_a21_a33_a45_page_summary(d: Dialect) -> str:
    return f"WITH {BOXES} SELECT page, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n, count(DISTINCT cls) AS classes, count(CASE WHEN cls = 2 THEN 1 END) AS tables FROM boxes GROUP BY page"


@plan
def a16_covered_ratio(d: Dialect) -> str:
    return f"WITH {BOXES} SELECT a.page, a.det, round(least(1e0, coalesce(sum({INTER}), 0e0) / max({AREA.format('a')})), 9) AS covered FROM boxes a LEFT JOIN boxes b ON a.page = b.page AND b.cls = 2 AND a.det <> b.det GROUP BY a.page, a.det"


@plan
def j05_nearest_block(d: Dialect) -> str:
    """First block that contains a point (margin 3), else the nearest within 28."""
    return f"WITH {BOXES}, points AS (SELECT DISTINCT l_orderkey AS page, CAST(l_orderkey % 100 AS DOUBLE) AS px, CAST(l_orderkey * 3 % 90 AS DOUBLE) AS py FROM lineitem), c AS (SELECT p.page, b.det, CASE WHEN px BETWEEN x1 - 3 AND x2 + 3 AND py BETWEEN y1 - 3 AND y2 + 3 THEN 0 ELSE 1 END AS outside, abs(px - (x1 + x2) / 2) + abs(py - (y1 + y2) / 2) AS dist FROM points p JOIN boxes b ON p.page = b.page), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY outside, CASE WHEN outside = 0 THEN 0e0 ELSE dist END, det, dist) AS k FROM c WHERE outside = 0 OR dist <= 28) SELECT page, det, outside, dist FROM r WHERE k = 1"


@plan
def j06_source_blocks(d: Dialect) -> str:
    return f"WITH {PAIRS}, r AS (SELECT page, det, other, inter, CAST(row_number() OVER (PARTITION BY page, det ORDER BY inter DESC, other) AS INTEGER) AS k FROM pairs WHERE inter > 0) SELECT page, det, other, inter, k FROM r WHERE k <= 6"


@plan
def j23_outcome_merge(d: Dialect) -> str:
    return f"WITH {BOXES}, outcome AS (SELECT page, det, CASE WHEN det % 3 = 0 THEN NULL ELSE 'latex' END AS latex FROM boxes WHERE cls < 3) SELECT b.page, count(CASE WHEN latex IS NOT NULL THEN 1 END) AS recognised, count(CASE WHEN latex IS NULL THEN 1 END) AS unrecognised, count(CASE WHEN cls < 2 THEN 1 END) AS formula, count(CASE WHEN cls = 2 THEN 1 END) AS tables FROM boxes b LEFT JOIN outcome o ON b.page = o.page AND b.det = o.det GROUP BY b.page"


@plan
def j26_f14_windows_of_objects(d: Dialect) -> str:
    return f"WITH {BOXES}, w AS (SELECT 0e0 AS wx, 0e0 AS wy UNION ALL SELECT 64e0 AS wx, 0e0 AS wy UNION ALL SELECT 0e0 AS wx, 64e0 AS wy UNION ALL SELECT 64e0 AS wx, 64e0 AS wy) SELECT page, det, wx, wy, greatest(least(x2, wx + 64) - greatest(x1, wx), 0e0) * greatest(least(y2, wy + 64) - greatest(y1, wy), 0e0) / (w * h) AS iof FROM (SELECT b.*, wx, wy FROM boxes b CROSS JOIN w) q WHERE greatest(least(x2, wx + 64) - greatest(x1, wx), 0e0) * greatest(least(y2, wy + 64) - greatest(y1, wy), 0e0) >= 0.7e0 * (w * h)"


@plan
def j40_fused_cost(d: Dialect) -> str:
    return f"WITH {PAIRS} SELECT page, det, other, round(1 - inter / (area_a + area_b - inter) * other_conf, 9) AS cost FROM pairs"


@plan
def s22_s23_label_rows(d: Dialect) -> str:
    return f"WITH {BOXES} SELECT page, CAST(cls AS VARCHAR(20)) || ' ' || CAST(CAST(x1 AS BIGINT) AS VARCHAR(20)) || ' ' || CAST(CAST(y1 AS BIGINT) AS VARCHAR(20)) || ' ' || CAST(CAST(w AS BIGINT) AS VARCHAR(20)) || ' ' || CAST(CAST(h AS BIGINT) AS VARCHAR(20)) AS label FROM boxes"


@plan
def s24_s26_s27_label_check(d: Dialect) -> str:
    return f"WITH {BOXES}, rows_ AS (SELECT DISTINCT page, cls, (x1 + x2) / 2 / 160e0 AS cx, (y1 + y2) / 2 / 160e0 AS cy, w / 160e0 AS wn, h / 160e0 AS hn FROM boxes WHERE w > 0 AND h > 0 AND det % 7 <> 0) SELECT cls, count(*) AS found, count(CASE WHEN cx + wn / 2 > 1 OR cy + hn / 2 > 1 THEN 1 END) AS outside, count(DISTINCT page) AS images FROM rows_ GROUP BY cls"


@plan
def s11_s12_formula_boxes(d: Dialect) -> str:
    return f"WITH {BOXES} SELECT page, det, CASE WHEN cls < 2 THEN 'formula' ELSE 'figure' END AS kind, {d.even('x1 / 160e0', 6)} AS xn, {d.even('conf', 4)} AS score FROM boxes WHERE (cls < 2 AND det % 5 <> 0) OR cls = 3"


@plan
def w25_tiling(d: Dialect) -> str:
    return f"SELECT p_partkey AS image, CAST(least(i * 48, p_size * 8) AS INTEGER) AS tile_x FROM (SELECT p_partkey, p_size, {d.ints('0', 'CAST(ceil(p_size * 8 / 48e0) AS INTEGER)')} AS i FROM part) q GROUP BY p_partkey, least(i * 48, p_size * 8)"


@plan
def x53_embedding_distance(d: Dialect) -> str:
    dot = "aggregate(zip_with(a.e, b.e, (x, y) -> x * y), 0e0, (s, x) -> s + x)" if d.spark else "list_dot_product(a.e, b.e)"
    own = lambda t: dot.replace("a.e", f"{t}.e").replace("b.e", f"{t}.e")
    return f"WITH v AS (SELECT vec_id, CAST(embedding AS {'ARRAY<DOUBLE>' if d.spark else 'DOUBLE[]'}) AS e FROM embeddings) SELECT a.vec_id, b.vec_id AS other, round(greatest(0e0, 1 - {dot} / sqrt({own('a')}) / sqrt({own('b')})), 6) AS distance FROM v a JOIN v b ON b.vec_id = a.vec_id + 1"


# --- library: records, shares, notes -----------------------------------------------------------------------------------


@plan
def f39_f40_f48_j14_j41_j45_visible(d: Dialect) -> str:
    """What user u7 may see: the owner, or the first share entry with the name; odd permissions read. Of entries at one place the first as stored (the oracle's sort is stable on one thread)."""
    shares = SHARES.replace(" AS pos,", " AS pos, stored,") if d.spark else SHARES
    return f"WITH {RECORDS}, {shares}, mine AS (SELECT id, perm, row_number() OVER (PARTITION BY id ORDER BY pos{d.settled('stored')}) AS k FROM shares WHERE who = 'u7'), heads AS (SELECT id, count(*) AS shares FROM shares WHERE who <> '' GROUP BY id) SELECT r.id, CASE WHEN r.owner = 'u7' THEN 'owner' WHEN m.perm = 'edit' THEN 'edit' ELSE 'read' END AS my_perm, coalesce(h.shares, 0) AS shares, r.owner = 'u7' AS is_mine FROM records r LEFT JOIN (SELECT * FROM mine WHERE k = 1) m ON r.id = m.id LEFT JOIN heads h ON r.id = h.id WHERE r.owner = 'u7' OR m.id IS NOT NULL"


@plan
def f49_a26_status_counts(d: Dialect) -> str:
    return f"WITH {RECORDS} SELECT owner, count(CASE WHEN status = 'unread' THEN 1 END) AS unread, count(CASE WHEN status = 'reading' THEN 1 END) AS reading, count(CASE WHEN status = 'done' THEN 1 END) AS done FROM records GROUP BY owner"


@plan
def t02_t03_recent_first(d: Dialect) -> str:
    return f"WITH {RECORDS} SELECT id, owner, CAST(row_number() OVER (PARTITION BY owner ORDER BY coalesce(last_read_at, created_at, '') DESC, id) AS INTEGER) AS place FROM records"


@plan
def t05_w21_last_notes(d: Dialect) -> str:
    return f"WITH {NOTES}, r AS (SELECT doc, note, block_id, row_number() OVER (PARTITION BY doc ORDER BY note DESC, block_id) AS k FROM notes) SELECT doc, note, block_id FROM r WHERE k <= 3"


@plan
def t08_profile_cap(d: Dialect) -> str:
    return f"WITH {RECORDS}, r AS (SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY id) AS k FROM records WHERE owner <> '') SELECT owner, id FROM r WHERE k <= 3"


@plan
def a25_annotation_counts(d: Dialect) -> str:
    return f"WITH {NOTES} SELECT doc, count(*) AS notes, count(DISTINCT block_id) AS blocks FROM notes WHERE text <> '' GROUP BY doc"


@plan
def a20_notes_fingerprint(d: Dialect) -> str:
    return f"WITH {NOTES} SELECT doc, substring(sha1({d.glue('block_id || chr(1) || text', 'chr(2)', 'block_id || chr(1) || text')}), 1, 16) AS fingerprint FROM notes WHERE text <> '' GROUP BY doc"


@plan
def j27_note_authors(d: Dialect) -> str:
    return f"WITH {NOTES}, {RECORDS}, {SHARES}, s AS (SELECT DISTINCT id FROM shares WHERE who <> '') SELECT n.doc, n.note, CASE WHEN s.id IS NOT NULL THEN coalesce(nullif(n.who, ''), r.owner) END AS author FROM notes n JOIN records r ON n.doc = r.id LEFT JOIN s ON n.doc = s.id"


@plan
def j30_x49_note_keys(d: Dialect) -> str:
    return f"WITH {NOTES} SELECT doc, note, regexp_extract(block_id, '^(.*)#([0-9]+)$', 1) AS block, CAST(regexp_extract(block_id, '^(.*)#([0-9]+)$', 2) AS INTEGER) AS sentence FROM notes WHERE text <> ''"


@plan
def j29_not_shared(d: Dialect) -> str:
    """J29: for each document the accounts that it isn't shared with; accounts are the records' owners."""
    return f"WITH {RECORDS}, {SHARES}, accounts AS (SELECT DISTINCT owner AS who FROM records WHERE owner <> '') SELECT r.id, a.who FROM records r CROSS JOIN accounts a LEFT JOIN (SELECT DISTINCT id, who FROM shares WHERE who <> '') s ON r.id = s.id AND a.who = s.who WHERE s.id IS NULL"


@plan
def j42_j43_reading_patch(d: Dialect) -> str:
    return f"WITH {RECORDS}, {SHARES}, r AS (SELECT s.id, s.who, max(s.pos) AS last_page FROM shares s WHERE who <> '' GROUP BY s.id, s.who) SELECT q.id, coalesce(r.who, 'none') AS who, CASE WHEN q.owner = r.who THEN q.progress ELSE CAST(r.last_page AS DOUBLE) / 7 END AS progress FROM records q LEFT JOIN r ON q.id = r.id"


@plan
def u03_adopt_orphans(d: Dialect) -> str:
    return f"WITH {RECORDS} SELECT id, coalesce(nullif(owner, ''), 'u1') AS owner FROM records"


@plan
def u04_cascade_delete(d: Dialect) -> str:
    return f"WITH {NOTES}, {RECORDS}, gone AS (SELECT id FROM records WHERE owner = 'u3') SELECT n.doc, n.note FROM notes n LEFT JOIN gone g ON n.doc = g.id WHERE g.id IS NULL"


@plan
def u05_u06_s18_upsert(d: Dialect) -> str:
    return f"WITH {NOTES}, fresh AS (SELECT doc, note, upper(text) AS text FROM notes WHERE note = 2) SELECT doc, note, text FROM fresh UNION ALL SELECT n.doc, n.note, n.text FROM notes n LEFT JOIN fresh f ON n.doc = f.doc AND n.note = f.note WHERE f.doc IS NULL"


@plan
def u07_share_edit(d: Dialect) -> str:
    return f"WITH {SHARES} SELECT id, who, perm FROM shares WHERE who <> 'u9' AND who <> '' UNION ALL SELECT DISTINCT id, 'u9' AS who, 'edit' AS perm FROM shares WHERE who = 'u9'"


@plan
def w29_progress_rule(d: Dialect) -> str:
    p = "max(value) OVER (PARTITION BY track ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"WITH {TRACKS}, r AS (SELECT event_id, track, {p} AS top FROM frames) SELECT event_id, track, top, CASE WHEN top > 98.5e0 THEN 'done' ELSE 'reading' END AS status FROM r"


# --- text ----------------------------------------------------------------------------------------------------------------

LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"


@plan
def f35_f36_f37_needs_translation(d: Dialect) -> str:
    cjk = f"length({d.sub('text', '[^一-鿿]', '')}) / CAST(greatest(length(text), 1) AS DOUBLE)"
    return f"WITH b AS ({d.lines()}) SELECT doc_id, blk, {cjk} > 0.12e0 AS looks_chinese, length(text) >= 2 AND {d.rx('text', '[A-Za-zÀ-ÖØ-öø-ÿ0-9]')} AND NOT {cjk} > 0.12e0 AS needs FROM b"


@plan
def x34_j10_j11_translation_plan(d: Dialect) -> str:
    """The translation job: which blocks have an answer, which go out, which are junk (flagship)."""
    norm = d.sub("text", "[ ]+", " ")
    key = "CASE WHEN lang = 'en' THEN sha1(t) ELSE sha1(lang || chr(0) || t) END"
    return f"WITH b AS (SELECT doc_id, blk, lang, {norm} AS t FROM ({d.lines()}) q), k AS (SELECT doc_id, blk, lang, t, {key} AS k, length(t) >= 2 AND {d.rx('t', LETTER)} AS needs FROM b), cache AS (SELECT DISTINCT k FROM k WHERE doc_id % 4 = 0 AND needs), j AS (SELECT k.*, c.k IS NOT NULL AS hit FROM k LEFT JOIN cache c ON k.k = c.k) SELECT lang, CASE WHEN NOT needs THEN 'skipped' WHEN hit THEN 'result' ELSE 'todo' END AS decision, count(*) AS blocks, count(DISTINCT k) AS keys_ FROM j GROUP BY lang, CASE WHEN NOT needs THEN 'skipped' WHEN hit THEN 'result' ELSE 'todo' END"


@plan
def j13_layout_diff(d: Dialect) -> str:
    return f"WITH b AS ({d.lines()}), old AS (SELECT doc_id, blk, text FROM b WHERE blk % 5 <> 0), new AS (SELECT doc_id, blk, CASE WHEN blk % 3 = 0 THEN upper(text) ELSE text END AS text FROM b WHERE blk % 7 <> 0) SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, count(CASE WHEN o.blk IS NOT NULL AND n.blk IS NOT NULL AND o.text <> n.text THEN 1 END) AS changed, count(CASE WHEN o.blk IS NULL THEN 1 END) AS added, count(CASE WHEN n.blk IS NULL THEN 1 END) AS gone FROM old o FULL OUTER JOIN new n ON o.doc_id = n.doc_id AND o.blk = n.blk GROUP BY coalesce(o.doc_id, n.doc_id)"


@plan
def x04_x20_x46_normalised(d: Dialect) -> str:
    return f"WITH b AS ({d.lines()}) SELECT doc_id, blk, {d.sub('text', '[ ]+', ' ')} AS folded, lower({d.sub('text', '[^0-9A-Za-z一-鿿]', '')}) AS anchor FROM b"


@plan
def f20_f21_heading_level(d: Dialect) -> str:
    num = "regexp_extract(t, '^([0-9]+([.][0-9]+)*)', 1)"
    return f"WITH b AS (SELECT doc_id, blk, CAST(1 + blk % 3 AS VARCHAR(20)) || CASE WHEN blk % 2 = 0 THEN '.' || CAST(doc_id % 9 AS VARCHAR(20)) ELSE '' END || ' ' || text AS t FROM ({d.lines()}) q) SELECT doc_id, blk, CASE WHEN {num} = '' THEN 2 ELSE least(4, {d.size(f'split({num}, {chr(39)}[.]{chr(39)})') if d.spark else d.size(f'split({num}, {chr(39)}.{chr(39)})')}) END AS level FROM b"


@plan
def x28_x29_x59_a08_a09_size_estimate(d: Dialect) -> str:
    est = "sqrt(h * w / (0.725e0 * length(text)))"
    return f"WITH b AS ({d.lines()}), e AS (SELECT doc_id, {est} AS s FROM b WHERE length(text) >= 60) SELECT doc_id, round(least(20e0, greatest(6e0, median(s))), 6) AS body FROM e WHERE s BETWEEN 1 AND 22 GROUP BY doc_id"


@plan
def x10_estimated_lines(d: Dialect) -> str:
    return f"WITH b AS ({d.lines()}) SELECT doc_id, blk, greatest(1, CAST(ceil(length(text) / greatest(1e0, floor(w / 5e0))) AS INTEGER)) AS lines FROM b"


@plan
def f27_f28_mathish(d: Dialect) -> str:
    return f"WITH b AS ({d.lines()}) SELECT doc_id, blk, {d.count('text', '[A-Za-z]{4,}')} AS long_words, {d.count('text', '[A-Za-z]{4,}')} <= 1 AND text <> '' AS mathish, {d.rx('text', '[A-Za-z0-9]')} AS has_glyphs FROM b"


@plan
def x41_x42_masks(d: Dialect) -> str:
    return f"SELECT c_custkey, substring(c_name, 1, 3) || '***' || substring(c_name, length(c_name) - 2, 3) AS key_, {d.sub(chr(39) + 'mongodb://' + chr(39) + ' || c_name || ' + chr(39) + ':secret@host/db' + chr(39), ':[^:@/]*@', ':***@')} AS uri FROM customer"


@plan
def x43_x68_lists(d: Dialect) -> str:
    raw = "CAST(p_size AS VARCHAR(20)) || 'x' || CAST(p_partkey AS VARCHAR(20))"
    return f"SELECT p_partkey, CAST(regexp_extract({raw}, '^([0-9]+)x([0-9]+)$', 1) AS INTEGER) AS w, CAST(regexp_extract({raw}, '^([0-9]+)x([0-9]+)$', 2) AS INTEGER) AS h FROM part"


@plan
def x31_space_count(d: Dialect) -> str:
    return f"WITH b AS ({d.lines()}) SELECT doc_id, blk, greatest(1, CAST({d.even('w / (0.25e0 * h)', 0)} AS INTEGER)) AS spaces FROM b"


@plan
def x11_x03_canonical(d: Dialect) -> str:
    """Lines glued: a trailing hyphen goes with the break, other breaks become a space."""
    text = d.sub(d.sub("text", "-" + chr(10), ""), chr(10), " ")
    return f"SELECT doc_id, {text} AS joined FROM documents"


@plan
def a19_bag_ratio(d: Dialect) -> str:
    """2 sum(min(counts)) / (len a + len b) of each line with the next one, both whole and cleaned: the first as a formula, the second as glyphs."""
    back = "chr(92) || "  # patterns hold no backslash in their text
    words = f"regexp_replace(text, {back}{back}'[A-Za-z]+', ' '{'' if d.spark else ', ' + chr(39) + 'g' + chr(39)})"
    bare = lambda x: f"lower({d.sub(x, '[^0-9A-Za-z]', '')})"
    chars = lambda c: f"SELECT doc_id, blk, ch, count(*) AS n FROM (SELECT doc_id, blk, {'explode' if d.spark else 'unnest'}(split({c}, '')) AS ch FROM p) q WHERE ch <> '' GROUP BY doc_id, blk, ch"
    return f"WITH t AS ({d.lines()}), p AS (SELECT doc_id, blk, {bare(words)} AS a, {bare('down')} AS b FROM (SELECT doc_id, blk, text, lead(text) OVER (PARTITION BY doc_id ORDER BY blk) AS down FROM t) q WHERE down IS NOT NULL), ca AS ({chars('a')}), cb AS ({chars('b')}), i AS (SELECT ca.doc_id, ca.blk, sum(least(ca.n, cb.n)) AS common FROM ca JOIN cb ON ca.doc_id = cb.doc_id AND ca.blk = cb.blk AND ca.ch = cb.ch GROUP BY ca.doc_id, ca.blk) SELECT p.doc_id, p.blk, coalesce(2e0 * i.common / (length(a) + length(b)), 0e0) AS ratio FROM p LEFT JOIN i ON p.doc_id = i.doc_id AND p.blk = i.blk"


@plan
def f41_f43_sentence_ends(d: Dialect) -> str:
    return f"WITH b AS ({d.lines()}), n AS (SELECT doc_id, blk, text, lead(text) OVER (PARTITION BY doc_id ORDER BY blk) AS down FROM b) SELECT doc_id, blk, {d.rx('text', '[.!?。！？][ ]*$')} AS ends, coalesce(NOT {d.rx('text', '[.!?。！？][ ]*$')} AND {d.rx('down', '^[ ]*[a-z,;)]')}, false) AS continues FROM n"


# --- ordered prefixes and segments ---------------------------------------------------------------------------------------


def _plain(d: Dialect, x: str) -> str:
    """Runs of white space as one space, none at the ends."""
    return f"trim({d.sub(x, f'[ {chr(9)}-{chr(13)}]+', ' ')})"


@plan
def w01_w02_w05_budget(d: Dialect) -> str:
    """W01: of a document's first 200 lines those before the first overflow of 12,000; a line is a note (to 1,500), the next one its sentence (to 600)."""
    return f"WITH b AS ({d.lines()}), r AS (SELECT doc_id, blk, length(substring({_plain(d, 'text')}, 1, 1500)) AS note, length(substring({_plain(d, 'coalesce(down, chr(32))')}, 1, 600)) AS sent FROM (SELECT doc_id, blk, text, lead(text) OVER (PARTITION BY doc_id ORDER BY blk) AS down FROM b) q WHERE blk < 200), s AS (SELECT doc_id, blk, note + sent AS n, sum(note + sent + 24) OVER (PARTITION BY doc_id ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM r WHERE note > 0) SELECT doc_id, blk, CAST(n AS INTEGER) AS n, CAST(used AS BIGINT) AS used FROM s WHERE used <= 12000"


@plan
def w03_chat_suffix(d: Dialect) -> str:
    """Of a conversation's last 24 turns, from the last back, those before the first overflow of 8,000; a turn counts to 1,500 and its speaker's mark."""
    return f"WITH r AS (SELECT conv_id, turn, length(substring({_plain(d, 'text')}, 1, 1500)) AS n, CASE WHEN role = 'user' THEN 2 ELSE 3 END AS mark, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations), s AS (SELECT *, sum(n + mark) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM r WHERE k <= 24 AND n > 0) SELECT conv_id, turn, CAST(n AS INTEGER) AS n FROM s WHERE used <= 8000"


@plan
def w04_stream_cap(d: Dialect) -> str:
    return "WITH s AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM conversations WHERE text <> '') SELECT conv_id, turn, substring(text, 1, CAST(greatest(0, 6000 - before_) AS INTEGER)) AS text FROM s WHERE before_ < 6000"


@plan
def w06_w07_offsets(d: Dialect) -> str:
    return f"WITH b AS ({d.lines()}) SELECT doc_id, blk, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM b"


@plan
def w08_w28_offset_lookup(d: Dialect) -> str:
    return f"WITH b AS ({d.lines()}), o AS (SELECT doc_id, blk, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM b) SELECT doc_id, max(blk) AS blk FROM o WHERE base <= 100 + doc_id % 300 GROUP BY doc_id"


@plan
def w14_filled_edges(d: Dialect) -> str:
    ig = "last_value(e) IGNORE NULLS" if d.spark else "last_value(e IGNORE NULLS)"
    ih = "first_value(e) IGNORE NULLS" if d.spark else "first_value(e IGNORE NULLS)"
    return f"WITH b AS (SELECT doc_id, blk, CASE WHEN (doc_id + blk) % 3 = 0 THEN NULL ELSE w END AS e FROM ({d.lines()}) q) SELECT doc_id, blk, coalesce(e, {ig} OVER (PARTITION BY doc_id ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {ih} OVER (PARTITION BY doc_id ORDER BY blk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS edge FROM b"


@plan
def w11_w26_w31_islands(d: Dialect) -> str:
    """Runs of blocks of one kind."""
    return f"WITH b AS (SELECT doc_id, blk, length(text) > 80 AS long_ FROM ({d.lines()}) q), c AS (SELECT *, CASE WHEN long_ = lag(long_) OVER (PARTITION BY doc_id ORDER BY blk) THEN 0 ELSE 1 END AS change FROM b), s AS (SELECT *, sum(change) OVER (PARTITION BY doc_id ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM c) SELECT doc_id, CAST(run AS BIGINT) AS run, min(blk) AS from_, max(blk) AS to_, max(CASE WHEN long_ THEN 1 ELSE 0 END) AS long_ FROM s GROUP BY doc_id, run"


@plan
def w09_f53_gap_spaces(d: Dialect) -> str:
    return f"WITH {BOXES}, s AS (SELECT page, det, x1, lag(x2) OVER (PARTITION BY page ORDER BY x1, det, x2, h) AS before_, h FROM boxes) SELECT page, det, coalesce(x1 - before_ > 0.25e0 * h, false) AS gap FROM s"


@plan
def w10_dominant(d: Dialect) -> str:
    return f"WITH b AS ({d.lines()}), r AS (SELECT doc_id, blk, h, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, blk) AS k FROM b) SELECT doc_id, blk, h FROM r WHERE k = 1"


@plan
def a10_a11_page_fonts(d: Dialect) -> str:
    return f"WITH b AS ({d.lines()}), f AS (SELECT doc_id, h AS font, sum(length(text)) AS chars FROM b GROUP BY doc_id, h), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, font) AS k, sum(chars) OVER (PARTITION BY doc_id) AS total FROM f) SELECT doc_id, font, CAST(chars AS BIGINT) AS chars, chars < 0.5e0 * total AS minority FROM r WHERE k = 1"


@plan
def w16_w17_region(d: Dialect) -> str:
    """Blocks after the last heading-like one of the document, up to the first terminator after it; without a heading the blocks of reference kind.

    On the view a heading is a line of under 30 characters, a terminator one of 30 to 40, and a line that opens with a number in brackets is of reference kind.
    """
    return f"WITH b AS (SELECT doc_id, blk, length(text) BETWEEN 1 AND 29 AS head, length(text) BETWEEN 30 AND 40 AS ends, {d.rx('text', '^ *[(][0-9]+[)]')} AS ref FROM ({d.lines()}) q), s AS (SELECT doc_id, max(CASE WHEN head THEN blk END) AS start FROM b GROUP BY doc_id), e AS (SELECT b.doc_id, min(b.blk) AS stop FROM b JOIN s ON b.doc_id = s.doc_id AND b.blk > s.start AND b.ends GROUP BY b.doc_id) SELECT b.doc_id, b.blk FROM b JOIN s ON b.doc_id = s.doc_id LEFT JOIN e ON b.doc_id = e.doc_id WHERE CASE WHEN s.start IS NULL THEN b.ref ELSE b.blk > s.start AND (e.stop IS NULL OR b.blk < e.stop) END"


@plan
def w18_anchors(d: Dialect) -> str:
    return f"WITH b AS ({d.lines()}) SELECT doc_id, blk, substring(lag(text) OVER (PARTITION BY doc_id ORDER BY blk), 1, 16) AS before_, substring(lead(text) OVER (PARTITION BY doc_id ORDER BY blk), 1, 16) AS after_ FROM b WHERE length(text) >= 4"


@plan
def w20_side_notes(d: Dialect) -> str:
    """y = max(target, bottom of the one before + 10), in closed form: a running maximum over y less the heights before."""
    return f"WITH b AS (SELECT doc_id, blk, y, h, coalesce(sum(h + 10) OVER (PARTITION BY doc_id ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS above FROM ({d.lines()}) q) SELECT doc_id, blk, max(y - above) OVER (PARTITION BY doc_id ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + above AS placed FROM b"


@plan
def a43_smoothing(d: Dialect) -> str:
    return f"WITH {TRACKS} SELECT event_id, round(avg(value) OVER (PARTITION BY track ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM frames"


# --- citations -----------------------------------------------------------------------------------------------------------


@plan
def j01_j02_x05_a07_u01_numeric_citations(d: Dialect) -> str:
    """[a, b-c] tokens expanded (a range only to 40 long), joined to the first entry of each number."""
    tok = f"SELECT doc, blk, {'explode' if d.spark else 'unnest'}({d.found('text', '[0-9]+(-[0-9]+)?')}) AS t FROM body"
    lo, hi = "CAST(regexp_extract(t, '^([0-9]+)', 1) AS INTEGER)", "CAST(coalesce(nullif(regexp_extract(t, '-([0-9]+)$', 1), ''), regexp_extract(t, '^([0-9]+)', 1)) AS INTEGER)"
    return f"WITH {CITES}, toks AS ({tok}), spans AS (SELECT doc, blk, {lo} AS a, {hi} AS b FROM toks), nums AS (SELECT DISTINCT doc, blk, {d.ints('a', 'CASE WHEN a < b AND b <= a + 40 THEN b ELSE a END')} AS n FROM spans) SELECT n.doc, n.blk, CAST(n.n AS INTEGER) AS n, e.entry FROM nums n JOIN entries e ON n.doc = e.doc AND n.n = e.n"


@plan
def u02_fallback(d: Dialect) -> str:
    return f"WITH {CITES}, goto_ AS (SELECT doc, n, entry FROM entries WHERE entry % 5 = 0), text_ AS (SELECT doc, n, entry FROM entries WHERE n <= 2) SELECT doc, n, entry FROM goto_ UNION ALL SELECT t.doc, t.n, t.entry FROM text_ t LEFT JOIN (SELECT DISTINCT doc FROM goto_) g ON t.doc = g.doc WHERE g.doc IS NULL"


# --- sessions, queues, tracks --------------------------------------------------------------------------------------------


@plan
def a27_a28_session_stats(d: Dialect) -> str:
    return f"WITH {TRACKS} SELECT track, count(*) AS submitted, count(CASE WHEN k % 7 = 0 THEN 1 END) AS failed, min(ts) AS created, max(ts) AS updated, max_by(cls, event_id) AS last_kind FROM frames GROUP BY track"


@plan
def a29_metrics(d: Dialect) -> str:
    return f"WITH {TRACKS} SELECT 'events_total' || chr(123) || 'type=' || cls || chr(125) || ' ' || CAST(count(*) AS VARCHAR(20)) AS line FROM frames GROUP BY cls"


@plan
def w23_track_history(d: Dialect) -> str:
    return f"WITH {TRACKS}, r AS (SELECT track, event_id, value, row_number() OVER (PARTITION BY track ORDER BY ts DESC, event_id DESC) AS k FROM frames) SELECT track, event_id, value FROM r WHERE k <= 30"


@plan
def m01_micro_batches(d: Dialect) -> str:
    """Batches of at most 8 items, or those of one window of an hour from the batch's hour on."""
    return f"WITH {TRACKS}, s AS (SELECT event_id, cls, date_trunc('hour', ts) AS hour_, row_number() OVER (PARTITION BY cls, date_trunc('hour', ts) ORDER BY ts, event_id) AS i FROM frames) SELECT event_id, cls, CAST(floor((i - 1) / 8) AS BIGINT) AS batch FROM s"


@plan
def m08_m09_m13_sessions(d: Dialect) -> str:
    """Sessions end after a day without events."""
    gap = "ts > lag(ts) OVER (PARTITION BY track ORDER BY ts, event_id) + INTERVAL '1' DAY"
    return f"WITH {TRACKS}, g AS (SELECT track, event_id, ts, CASE WHEN {gap} OR lag(ts) OVER (PARTITION BY track ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new_ FROM frames), s AS (SELECT *, sum(new_) OVER (PARTITION BY track ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_ FROM g) SELECT track, CAST(session_ AS BIGINT) AS session_no, count(*) AS requests, min(ts) AS first_, max(ts) AS last_ FROM s GROUP BY track, session_"


@plan
def m17_latest_version(d: Dialect) -> str:
    return f"WITH {TRACKS} SELECT track, max_by(k, event_id) AS rev, count(*) AS versions FROM frames GROUP BY track"
