"""Further plans: greedy selection as folds, record and layout rules, citation and prompt texts. See catalog.py."""

from __future__ import annotations

from .catalog import AREA, INTER, PAIRS, plan
from .dialect import Dialect
from .views import BOXES, NOTES, RECORDS, SHARES, TRACKS

V = "VARCHAR(20)"


def chosen(d: Dialect, order: list[str], clash: str) -> str:
    """CTEs u, boxes with a number n of their own in the page (detections may repeat), and k (page, cls, pos, n, det): those of
    a page and class taken in order, if they clash with none taken before. One shuffle, by page."""
    items = d.ranked([*order, "n"], d.array(["CAST(n AS DOUBLE)", "x1", "y1", "x2", "y2", "CAST(det AS DOUBLE)"]))
    taken = d.fold("items", f"CASE WHEN {d.size(d.only('acc', clash))} > 0 THEN acc ELSE concat(acc, e) END")
    at = lambda i: d.at("b", i)
    return f"""{BOXES}, u AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY det, cls, conf, x1, y1, x2, y2) AS n FROM boxes),
lists AS (SELECT page, cls, {items} AS items FROM u GROUP BY page, cls), taken AS (SELECT page, cls, {taken} AS kept FROM lists),
k AS (SELECT page, cls, pos, CAST({at(0)} AS INTEGER) AS n, CAST({at(5)} AS INTEGER) AS det, {at(1)} AS x1, {at(2)} AS y1, {at(3)} AS x2, {at(4)} AS y2 FROM ({d.spread('page, cls', 'kept', 'taken')}) q)"""


def suppression(d: Dialect, order: list[str], measure: str, limit: str) -> str:
    """Every box with the first taken one that overlaps it enough: itself, if it was taken."""
    c = lambda v, i: d.at("x" if v == "x" else d.at("e", 0), i)
    inter = f"greatest(least({c('x', 3)}, {c('e', 3)}) - greatest({c('x', 1)}, {c('e', 1)}), 0e0) * greatest(least({c('x', 4)}, {c('e', 4)}) - greatest({c('x', 2)}, {c('e', 2)}), 0e0)"
    area = lambda v: f"(({c(v, 3)} - {c(v, 1)}) * ({c(v, 4)} - {c(v, 2)}))"
    fill = lambda f, one, two, i: f.replace("ONE", one).replace("TWO", two).replace("INTER", i)
    iou, ratio = "INTER / (ONE + TWO - INTER)", "greatest(INTER / (ONE + TWO - INTER), INTER / least(ONE, TWO))"
    form = ratio if measure == "ratio" else iou
    own = lambda f: fill(f, AREA.format("a"), AREA.format("b"), f"({INTER})")
    return f"""WITH {chosen(d, order, fill(form, area('x'), area('e'), f'({inter})') + f' >= {limit}')},
m AS (SELECT a.page, a.n, a.det, a.cls, b.n AS kept_n, b.det AS keeper, {own(ratio)} AS ratio, {own(iou)} AS iou, b.pos FROM u a JOIN k b ON a.page = b.page AND a.cls = b.cls),
r AS (SELECT *, row_number() OVER (PARTITION BY page, n ORDER BY pos) AS place FROM m WHERE {measure} >= {limit})
SELECT page, det, cls, kept_n = n AS kept, keeper, ratio, iou FROM r WHERE place = 1"""


# --- greedy selection --------------------------------------------------------------------------------------------------


@plan
def a01_duplicate_suppression(d: Dialect) -> str:
    """Larger boxes first, then confidence; the larger of IoU and share of the smaller box decides."""
    return suppression(d, ["-(x2 - x1) * (y2 - y1)", "-conf"], "ratio", "0.5e0")


@plan
def a02_nms(d: Dialect) -> str:
    """Confidence first; IoU decides."""
    return suppression(d, ["-conf"], "iou", "0.45e0")


@plan
def a39_distinct_formulas(d: Dialect) -> str:
    """Boxes near an earlier kept one in both axes go."""
    near = " AND ".join(f"abs({d.at('x', i)} - {d.at(d.at('e', 0), i)}) <= 12" for i in (1, 2))
    return f"WITH {chosen(d, ['y1', 'x1'], near)} SELECT page, det, cls FROM k"


# --- geometry ------------------------------------------------------------------------------------------------------------


@plan
def f42_row_band(d: Dialect) -> str:
    return f"WITH {PAIRS} SELECT page, det, other, least(y2, v2) - greatest(y1, v1) > 0.5e0 * least(y2 - y1, v2 - v1) AS same_row FROM pairs"


@plan
def a42_gaussian_iou(d: Dialect) -> str:
    """Hellinger similarity of boxes as Gaussians; upright boxes have no covariance."""
    p, q = "((x2 - x1) * (x2 - x1) + (u2 - u1) * (u2 - u1)) / 12e0", "((y2 - y1) * (y2 - y1) + (v2 - v1) * (v2 - v1)) / 12e0"
    dx, dy = "(x1 + x2 - u1 - u2) / 2e0", "(y1 + y2 - v1 - v2) / 2e0"
    far = f"({p} * ({dy}) * ({dy}) + {q} * ({dx}) * ({dx})) / ({p} * {q} + 1e-7) / 4e0"
    spread = f"ln({p} * {q} / (4e0 * area_a * area_b / 144e0 + 1e-7) + 1e-7) / 2e0"
    return f"WITH {PAIRS}, s AS (SELECT page, det, other, least(greatest({far} + {spread}, 1e-7), 100e0) AS bd FROM pairs) SELECT page, det, other, round(1e0 - sqrt(1e0 - exp(-bd) + 1e-7), 6) + 0e0 AS similarity FROM s"


@plan
def f52_corridor_veto(d: Dialect) -> str:
    """Gaps that cover 60 % of a corridor (boxes of class 2) are vetoed."""
    return f"WITH {BOXES} SELECT a.page, a.det, max(CASE WHEN least(a.x2, b.x2) - greatest(a.x1, b.x1) >= 0.6e0 * (b.x2 - b.x1) THEN 1 ELSE 0 END) AS vetoed FROM boxes a JOIN boxes b ON a.page = b.page AND b.cls = 2 AND a.cls <> 2 GROUP BY a.page, a.det"


@plan
def s04_link_rows(d: Dialect) -> str:
    return f"""WITH {BOXES} SELECT page, det, round(x1, 2) AS x, round(y1, 2) AS y, CASE WHEN cls % 2 = 0 THEN 'goto' ELSE 'uri' END AS kind,
CASE WHEN cls % 2 = 0 AND NOT (x1 / 20 <= 0.5e0 AND y1 / 20 <= 0.5e0) THEN round(x1 / 20, 2) END AS to_x FROM boxes WHERE x2 > x1 AND y2 > y1 AND det BETWEEN 1 AND 6"""


@plan
def s25_polygon_labels(d: Dialect) -> str:
    return f"WITH {BOXES} SELECT page, det, cls, {d.even('x1 / 160e0', 6)} AS px1, {d.even('y1 / 160e0', 6)} AS py1, {d.even('x2 / 160e0', 6)} AS px3, {d.even('y2 / 160e0', 6)} AS py3 FROM boxes WHERE cls < 5"


@plan
def s33_figure_rows(d: Dialect) -> str:
    """The box in points, or the normalised one times the page; degenerate ones go."""
    return f"""WITH {BOXES}, f AS (SELECT page, det, coalesce(CASE WHEN det % 2 = 0 THEN x1 END, x1 / 160e0 * 612e0) AS left_, coalesce(CASE WHEN det % 2 = 0 THEN x2 END, x2 / 160e0 * 612e0) AS right_ FROM boxes WHERE cls = 3)
SELECT page, det, left_, right_, substring(sha2_(page, det), 1, 12) AS name FROM f WHERE right_ > left_""".replace("sha2_(page, det)", d.sha256(f"CAST(page AS {V}) || '-' || CAST(det AS {V})"))


@plan
def t06_formula_order(d: Dialect) -> str:
    return f"WITH {BOXES}, f AS (SELECT page, det, CASE WHEN det % 4 = 0 THEN NULL ELSE (y1 + y2) / 2 END AS cy, CASE WHEN det % 4 = 0 THEN NULL ELSE (x1 + x2) / 2 END AS cx FROM boxes) SELECT page, det, CAST(row_number() OVER (PARTITION BY page ORDER BY cy NULLS LAST, cx NULLS LAST, det) AS INTEGER) AS place FROM f"


@plan
def t07_best_five(d: Dialect) -> str:
    return f"WITH {BOXES}, r AS (SELECT page, det, conf, CAST(row_number() OVER (PARTITION BY page ORDER BY conf DESC, det) AS INTEGER) AS k FROM boxes) SELECT page, k, det, conf FROM r WHERE k <= 5"


# --- records, accounts, notes --------------------------------------------------------------------------------------------


@plan
def t04_account_order(d: Dialect) -> str:
    return f"WITH {RECORDS}, u AS (SELECT owner, min(created_at) AS created FROM records WHERE owner <> '' GROUP BY owner) SELECT owner, created FROM u ORDER BY created, owner"


@plan
def f46_expired(d: Dialect) -> str:
    """What can't be read as a time has expired."""
    return f"SELECT o_orderkey, coalesce(try_cast(CASE WHEN o_orderkey % 5 = 0 THEN 'soon' ELSE CAST(o_orderdate AS {'STRING' if d.spark else 'VARCHAR'}) END AS TIMESTAMP) <= TIMESTAMP '1995-06-17 00:00:00', true) AS expired FROM orders"


@plan
def f44_a40_image_names(d: Dialect) -> str:
    """Distinct image names of a customer's orders in order of their first use, and whether they may be served."""
    ext = "CASE o_orderkey % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.JPEG' WHEN 2 THEN '.txt' ELSE '.webp' END"
    return f"""WITH n AS (SELECT o_custkey AS doc, 'p' || CAST(o_custkey % 9 AS {V}) || '_i' || CAST(o_orderkey % 5 AS {V}) || {ext} AS name, o_orderkey AS pos FROM orders), f AS (SELECT doc, name, min(pos) AS pos FROM n GROUP BY doc, name)
SELECT doc, name, {d.rx('lower(name)', '^p[0-9]+_i[0-9]+[.](png|jpe?g|webp|gif)$')} AS served, CAST(row_number() OVER (PARTITION BY doc ORDER BY pos) AS INTEGER) AS place FROM f"""


@plan
def j31_note_order(d: Dialect) -> str:
    return f"WITH {NOTES}, k AS (SELECT doc, regexp_extract(block_id, '^(.*)#([0-9]+)$', 1) AS block, CAST(regexp_extract(block_id, '^(.*)#([0-9]+)$', 2) AS INTEGER) AS sentence, note FROM notes WHERE text <> '') SELECT doc, block, note, CAST(row_number() OVER (PARTITION BY doc, block ORDER BY sentence, note) AS INTEGER) AS place FROM k"


@plan
def j44_reading_dropped(d: Dialect) -> str:
    return f"WITH {SHARES} SELECT id, who, max(pos) AS last_page FROM shares WHERE who <> '' AND who <> 'u5' GROUP BY id, who"


@plan
def x63_notes_text(d: Dialect) -> str:
    """Numbered notes with page and sentence, as a prompt wants them. The labels are fixed values."""
    line = f"CAST(i AS {V}) || '. ' || CASE WHEN page > 0 THEN '【第 ' || CAST(page AS {V}) || ' 页】' ELSE '' END || CASE WHEN sent <> '' THEN chr(10) || '   原文句：' || sent ELSE '' END || chr(10) || '   我的笔记：' || text"
    return f"""WITH {NOTES}, n AS (SELECT doc, note, text, CAST(regexp_extract(block_id, '^p([0-9]+)', 1) AS INTEGER) AS page, CASE WHEN note % 2 = 0 THEN block_id ELSE '' END AS sent, row_number() OVER (PARTITION BY doc ORDER BY note, block_id, text) AS i FROM notes WHERE text <> ''),
l AS (SELECT doc, i, {line} AS line FROM n) SELECT doc, {d.glue('line', 'chr(10)', 'i')} AS prompt FROM l GROUP BY doc"""


@plan
def x52_config_precedence(d: Dialect) -> str:
    """Account, then environment, then file, then default, field by field."""
    return "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END, ''), CASE WHEN c_custkey % 5 = 0 THEN 'env' END, CASE WHEN c_custkey % 7 = 0 THEN 'file' END, 'default') AS model FROM customer"


@plan
def f38_language(d: Dialect) -> str:
    """Aliases, then the exact code, then its base, in the order in which targets are declared; empty is the default. Codes are fixed values."""
    codes = ["zh-CN", "zh-TW", "en", "ja", "ko", "fr", "de", "es", "pt", "ru", "ar", "hi"]
    alias = {"zh": "zh-CN", "zh-hans": "zh-CN", "zh-sg": "zh-CN", "cn": "zh-CN", "zh-hant": "zh-TW", "zh-hk": "zh-TW", "zh-mo": "zh-TW"}
    langs = " UNION ALL ".join(f"SELECT {i} AS pos, '{c}' AS code" for i, c in enumerate(codes))
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in alias.items())
    raw = "CASE c_custkey % 9 WHEN 0 THEN 'zh' WHEN 1 THEN 'EN-us' WHEN 2 THEN ' zh-Hant ' WHEN 3 THEN 'fr' WHEN 4 THEN 'xx' WHEN 5 THEN '' WHEN 6 THEN 'pt-BR' WHEN 7 THEN 'zh-tw' ELSE 'DE' END"
    return f"""WITH langs AS ({langs}), c AS (SELECT c_custkey, lower(trim({raw})) AS low FROM customer), b AS (SELECT *, regexp_extract(low, '^([^-]*)', 1) AS base FROM c)
SELECT b.c_custkey, CASE WHEN low = '' THEN '{codes[0]}' ELSE coalesce(CASE low {known} END, CASE WHEN e.pos <= f.pos OR f.pos IS NULL THEN e.code ELSE f.code END) END AS target
FROM b LEFT JOIN langs e ON lower(e.code) = b.low LEFT JOIN langs f ON lower(f.code) = b.base"""


@plan
def m06_backoff(d: Dialect) -> str:
    return f"SELECT p_partkey, n, least(8e0, 0.5e0 * power(2e0, least(n, 4))) AS delay FROM (SELECT p_partkey, {d.ints('0', 'p_size % 8')} AS n FROM part) q"


@plan
def a22_a23_page_stats(d: Dialect) -> str:
    return f"WITH {TRACKS} SELECT cls, count(*) AS pages, CAST(sum(k) AS BIGINT) AS spans, count(CASE WHEN k % 3 <> 0 THEN 1 END) AS latex FROM frames GROUP BY cls"


@plan
def a38_structure_score(d: Dialect) -> str:
    return "SELECT l_orderkey, round(avg(l_discount), 6) AS score FROM lineitem GROUP BY l_orderkey"


# --- text ------------------------------------------------------------------------------------------------------------------


@plan
def f17_x62_crop_uri(d: Dialect) -> str:
    data = "trim(CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN 'data:' || p_brand ELSE p_name END)"
    kind = "coalesce(nullif(lower(trim(CASE p_size % 3 WHEN 0 THEN 'JPG' WHEN 1 THEN '' ELSE ' WebP ' END)), ''), 'png')"
    return f"""WITH c AS (SELECT p_partkey, {data} AS data, {kind} AS kind FROM part) SELECT p_partkey, data <> '' AS has_crop,
CASE WHEN data = '' OR substring(data, 1, 5) = 'data:' THEN data ELSE 'data:image/' || CASE WHEN kind IN ('jpg', 'jpeg') THEN 'jpeg' ELSE kind END || ';base64,' || data END AS uri FROM c"""


@plan
def x57_cell_latex(d: Dialect) -> str:
    """A cell is LaTeX between delimiters, with a command, or without blanks but with ^ or _."""
    b = "chr(92)"
    raw = f"CASE p_partkey % 8 WHEN 0 THEN '$x + 1$' WHEN 1 THEN {b} || '( a ' || {b} || ')' WHEN 2 THEN {b} || '[y' || {b} || ']' WHEN 3 THEN 'n^2' WHEN 4 THEN {b} || 'frac 12' WHEN 5 THEN 'a b^2' WHEN 6 THEN ' ' ELSE p_name END"
    ends = lambda a, z: f"length(t) > 4 AND substring(t, 1, 2) = {b} || '{a}' AND substring(t, length(t) - 1, 2) = {b} || '{z}'"
    return f"""WITH c AS (SELECT p_partkey, trim({raw}) AS t FROM part) SELECT p_partkey, CASE WHEN t = '' OR length(t) > 200 THEN '' WHEN {d.rx('t', '^[$][^$]+[$]$')} THEN trim(substring(t, 2, length(t) - 2))
WHEN ({ends('(', ')')}) OR ({ends('[', ']')}) THEN trim(substring(t, 3, length(t) - 4)) WHEN {d.rx(f"replace(t, {b}, '§')", '§[a-zA-Z]{2,}')} THEN t WHEN NOT {d.rx('t', '[ ]')} AND {d.rx('t', '[_^]')} AND {d.rx('t', '^[ -~]+$')} THEN t ELSE '' END AS latex FROM c"""


@plan
def w30_flow_text(d: Dialect) -> str:
    """Fragments of a row as one text: a blank where a row begins or the gap is over 4; offsets of each."""
    return f"""WITH b AS (SELECT doc_id, blk, CAST(floor(blk / 3) AS INTEGER) AS row_, 100e0 * (blk % 3) AS x, CASE WHEN blk % 2 = 0 THEN 100e0 ELSE 90e0 END AS w, text FROM ({d.lines()}) q WHERE {d.rx('text', '[^ ]')}),
p AS (SELECT *, lag(x + w) OVER (PARTITION BY doc_id, row_ ORDER BY blk) AS edge, row_number() OVER (PARTITION BY doc_id ORDER BY blk) AS i FROM b),
g AS (SELECT *, CASE WHEN i > 1 AND (edge IS NULL OR x > edge + 4) THEN 1 ELSE 0 END AS gap FROM p)
SELECT doc_id, blk, CAST(sum(gap + length(text)) OVER (PARTITION BY doc_id ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(text) AS BIGINT) AS start FROM g"""


@plan
def s03_x37_outline(d: Dialect) -> str:
    """Levels from 1 to 4, titles to 200, pages from 1; blank titles go; at most 120 rows."""
    return f"""WITH o AS (SELECT doc_id, blk, least(4, greatest(1, blk % 7)) AS level, substring(trim(text), 1, 200) AS title, greatest(1, blk - 1) AS page FROM ({d.lines()}) q WHERE trim(text) <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY blk) AS k FROM o) SELECT doc_id, blk, level, title, page FROM r WHERE k <= 120"""


@plan
def x39_string_list(d: Dialect) -> str:
    item = f"substring(trim({d.sub('text', '[ ]+', ' ')}), 1, 40)"
    return f"WITH i AS (SELECT doc_id, blk, {item} AS item FROM ({d.lines()}) q), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY blk) AS k FROM i WHERE item <> '') SELECT doc_id, {d.glue('item', 'chr(10)', 'k')} AS items FROM r WHERE k <= 5 GROUP BY doc_id"


@plan
def x55_selection_text(d: Dialect) -> str:
    return f"SELECT doc_id, {d.sub('substring(text, 6, 60)', '[ ' + chr(10) + ']+', ' ')} AS picked FROM documents"


@plan
def f58_f59_range_checks(d: Dialect) -> str:
    """Math ranges and gaps that lie in the text of their line."""
    return f"WITH b AS (SELECT doc_id, blk, length(text) AS n, CAST(blk % 11 AS INTEGER) AS a, CAST(doc_id % 23 AS INTEGER) AS z, text FROM ({d.lines()}) q) SELECT doc_id, blk, a, z FROM b WHERE trim(text) <> '' AND a < z AND z <= n"


@plan
def x08_token_position(d: Dialect) -> str:
    return f"SELECT doc_id, blk, round(x + w * least(20, length(text)) / greatest(length(text), 1), 6) AS tx, y + h / 2 AS ty FROM ({d.lines()}) q"


@plan
def x44_x67_recognised(d: Dialect) -> str:
    """Structure tokens in order; the first key with a value."""
    return f"SELECT l_orderkey, {d.glue(f'l_returnflag || CAST(l_linenumber AS {V})', chr(39) * 2, 'l_linenumber, l_returnflag')} AS tokens, max(coalesce(nullif(trim(CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_linestatus END), ''), l_returnflag)) AS formula FROM lineitem GROUP BY l_orderkey"
