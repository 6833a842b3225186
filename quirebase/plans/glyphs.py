"""Plans over text runs, recognised formulas and line fragments: fonts, LaTeX, slicing, gaps. See catalog.py."""

from __future__ import annotations

from .catalog import PAIRS, plan
from .dialect import Dialect
from .views import BOXES, CITES, FORMULAS, RUNS

V = "VARCHAR(20)"

# Font name parts by family, math font prefixes by strength, text fonts that formulas use, symbol fonts.
SERIF = ["times", "georgia", "garamond", "palatino", "book", "caslon", "minion", "charter", "utopia", "song", "serif", "latinmodern", "notoserif"]
MONO = ["courier", "consolas", "menlo", "mono", "sfmono", "dejavusansmono"]
SANS = ["helvetica", "arial", "verdana", "tahoma", "trebuchet", "gill", "futura", "univers", "myriad", "calibri", "roboto", "inter", "notosans", "sans"]
STRONG = ["cmmi", "cmsy", "cmex", "cmmib", "cmbsy", "cmbex", "msam", "msbm", "eufm", "eurm", "symbol", "mtmi", "mtsy", "mtex", "euclid", "rsfs", "stmary", "stmry", "wasy", "lmmi", "lmsy", "lmex", "lmmib"]
WEAK = ["cmr", "cmb", "cmss", "cmtt", "cmu", "latinmodern", "lmr", "lmss", "lmtt", "stix", "xits", "cambria math", "campmath", "newtxmath", "mathpazo", "txfonts"]
TEXT_CM = ["cmr", "cmbx", "cmti", "cmss", "cmtt", "cmsl"]
SYMBOLS = ["cmsy", "cmex", "msam", "msbm", "wasy", "stmary", "stmry", "eufm", "euex", "symbol"]
COMMANDS = "frac dfrac tfrac sum prod int iint oint sqrt lim nabla partial infty cdot times leq geq neq approx equiv ell mathcal mathbb mathbf mathrm operatorname left right quad qquad begin[{]".split()
#: Recogniser labels by kind.
KINDS = {
    "text": "text paragraph body",
    "heading": "sectionheader heading title subheader subtitle",
    "caption": "caption",
    "footnote": "footnote endnote",
    "formula": "equation formula equationblock formulablock mathblock",
    "list": "listgroup list listitem",
    "table": "table tableblock",
    "header": "pageheader header",
    "footer": "pagefooter footer pagenumber",
    "figure": "picture figure diagram image chemicalblock complexblock",
}


def starts(d: Dialect, s: str, words: list[str]) -> str:
    return d.rx(s, f"^({'|'.join(words)})")


def leveled(d: Dialect) -> str:
    """CTE f: runs with the base name of their font, its math level and the level at which it is blanked."""
    base = d.sub(d.sub(f"lower(trim({d.sub('coalesce(font, chr(32))', '^.*[+]', '')}))", "[^a-z0-9 ]", ""), "[0-9 ]+$", "")
    return f"""{RUNS}, named AS (SELECT *, {base} AS base FROM runs),
leveled AS (SELECT *, CASE WHEN base = '' THEN 0 WHEN {starts(d, 'base', STRONG)} THEN 2 WHEN weak_on AND {starts(d, 'base', WEAK)} THEN 1 ELSE 0 END AS level FROM named),
f AS (SELECT *, CASE WHEN level > 0 THEN level WHEN cm_on AND {starts(d, 'base', TEXT_CM)} THEN 1 ELSE 0 END AS blanked FROM leveled)"""


# --- fonts -------------------------------------------------------------------------------------------------------------


@plan
def f22_font_family(d: Dialect) -> str:
    """Mono before serif before sans; what is unknown or missing is serif."""
    low = d.sub(f"lower({d.sub('coalesce(font, chr(32))', '^.*[+]', '')})", "[^a-z0-9 ]", "")
    has = lambda words: d.rx("low", "|".join(words))
    return f"WITH {RUNS}, n AS (SELECT run, {low} AS low FROM runs) SELECT run, CASE WHEN {has(MONO)} THEN 'mono' WHEN {has(['symbol', *SERIF])} THEN 'serif' WHEN {has(SANS)} THEN 'sans' ELSE 'serif' END AS family FROM n"


@plan
def f23_f24_f25_math_fonts(d: Dialect) -> str:
    return f"WITH {leveled(d)} SELECT run, base, level, blanked FROM f"


@plan
def f26_superscript(d: Dialect) -> str:
    """Bit 0 of the flags, and a baseline raised by over a fifth of the size where both are known."""
    base = "CASE WHEN run % 5 = 0 THEN NULL ELSE CAST(run % 11 AS DOUBLE) END"
    return f"WITH {RUNS}, g AS (SELECT run, size, {base} AS base, CASE WHEN run % 7 = 0 THEN NULL ELSE CAST(run % 8 AS DOUBLE) END AS origin FROM runs) SELECT run, size % 2 = 1 AND (base IS NULL OR origin IS NULL OR base - origin > 0.2e0 * coalesce(nullif(size, 0), 10)) AS raised FROM g"


@plan
def f33_symbol_font_lines(d: Dialect) -> str:
    """Lines with a run of a symbol font that isn't blank."""
    return f"WITH {leveled(d)} SELECT line, max(CASE WHEN trim(t) <> '' AND {starts(d, 'base', SYMBOLS)} THEN 1 ELSE 0 END) = 1 AS symbols FROM f GROUP BY line"


@plan
def f50_f51_sentence_probe(d: Dialect) -> str:
    """Line text with math glyphs as blanks, so that offsets stay; lines of formula blocks with LaTeX are left out."""
    glue = lambda v: d.glue(v, "''", "run")
    probe = glue("CASE WHEN blanked > 0 THEN repeat(' ', length(t)) ELSE t END")
    return f"WITH {leveled(d)}, l AS (SELECT line, {glue('t')} AS text, {probe} AS probe FROM f WHERE line % 10 <> 3 GROUP BY line) SELECT line, text, probe, trim(probe) = '' AS blank FROM l"


@plan
def a49_math_font_index(d: Dialect) -> str:
    """Spans of successive math runs of a line, as character intervals, those with glyphs."""
    return f"""WITH {leveled(d)}, o AS (SELECT line, run, t, level, sum(length(t)) OVER w - length(t) AS a, sum(length(t)) OVER w AS b, sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER w AS island FROM f
WINDOW w AS (PARTITION BY line ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT line, CAST(min(a) AS BIGINT) AS start, CAST(max(b) AS BIGINT) AS stop, max(level) AS level FROM o WHERE level > 0 GROUP BY line, island HAVING max(CASE WHEN trim(t) <> '' THEN 1 ELSE 0 END) = 1"""


# --- recognised text ---------------------------------------------------------------------------------------------------


@plan
def f19_label_kind(d: Dialect) -> str:
    """The label, then the raw label, then the shape of the markup, then plain text; rows without any kind are null."""
    known = lambda s: f"CASE {d.sub(f'lower({s})', '[^a-z]', '')} " + " ".join(f"WHEN '{w}' THEN '{k}'" for k, ws in KINDS.items() for w in ws.split()) + " END"
    label = "CASE p_partkey % 6 WHEN 0 THEN 'Section-Header' WHEN 1 THEN 'Page_Footer' WHEN 2 THEN 'odd' WHEN 3 THEN 'ListItem' ELSE NULL END"
    raw = "CASE p_partkey % 4 WHEN 0 THEN 'Equation Block' WHEN 1 THEN 'Picture' ELSE '' END"
    html = "CASE p_partkey % 7 WHEN 0 THEN '<TABLE><td>1</td></TABLE>' WHEN 1 THEN '<math></math>' WHEN 2 THEN '<math>x</math> y' ELSE '' END"
    return f"""WITH b AS (SELECT p_partkey, coalesce({label}, '') AS label, {raw} AS raw, lower({html}) AS html, CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_name END AS text FROM part)
SELECT p_partkey, coalesce({known('label')}, {known('raw')}, CASE WHEN html LIKE '%<table%' THEN 'table' WHEN html LIKE '%<math%' AND trim({d.sub('html', '<[^>]+>', '')}) = '' THEN 'formula' WHEN trim(text) <> '' THEN 'text' END) AS kind FROM b"""


@plan
def f29_f30_math_text(d: Dialect) -> str:
    """Whether a block is LaTeX without delimiters, and whether the inside of single dollars is."""
    strong = d.rx("t", f"§({'|'.join(COMMANDS)})")
    latex = f"length(t) BETWEEN 1 AND 500 AND {strong} AND ({d.count('t', '§[A-Za-z]{2,}')} >= 2 OR {d.rx('t', '[=_{}]|[}^]')})"
    return f"WITH {FORMULAS}, t AS (SELECT item, coalesce(raw, '') AS raw, trim(coalesce(raw, '')) AS t FROM formulas) SELECT item, {latex} AS latex, raw <> '' AND raw = t AND {d.rx('raw', '[§_{}]|[}^]')} AS body FROM t"


@plan
def f31_anchor_gap(d: Dialect) -> str:
    """Up to 160 characters with at most one long word, which the line or the formula must have; something must be there."""
    keep = lambda s: d.sub(f"lower({s})", "[^0-9a-z]", "")
    return f"""WITH {FORMULAS}, g AS (SELECT item, trim(coalesce(raw, '')) AS gap, name, CASE WHEN item % 2 = 0 THEN name ELSE '' END AS latex FROM formulas),
w AS (SELECT item, gap, latex, {d.count('gap', '[A-Za-z]{4,}')} AS words, lower(regexp_extract(gap, '([A-Za-z]{{4,}})', 1)) AS word, {keep('name')} || {keep('latex')} AS seen FROM g)
SELECT item, length(gap) <= 160 AND words <= 1 AND (words = 0 OR instr(seen, word) > 0) AND (gap <> '' OR trim(latex) <> '') AS ok FROM w"""


def segments(d: Dialect, s: str) -> str:
    """Formulas with their delimiters; square brackets become ⟦ and ⟧, which need no escape in a pattern."""
    return d.found(f"replace(replace({s}, '[', '⟦'), ']', '⟧')", "(?s)§⟦.+?§⟧|§[(].+?§[)]|[$][$].+?[$][$]|[$][^$]+[$]")


@plan
def x18_extract_latex(d: Dialect) -> str:
    """Formulas between delimiters, a line each, and their share of the characters."""
    body = "trim(CASE WHEN substring(x, 1, 1) = '$' AND substring(x, 2, 1) <> '$' THEN substring(x, 2, length(x) - 2) ELSE substring(x, 3, length(x) - 4) END)"
    nonblank = d.only(d.each("found", body), "x <> ''")
    empty = "''"
    return f"""WITH {FORMULAS}, s AS (SELECT item, trim(coalesce(raw, '')) AS t, {segments(d, "coalesce(raw, '')")} AS found FROM formulas)
SELECT item, replace(replace({d.join(nonblank, 'chr(10)')}, '⟦', '['), '⟧', ']') AS latex, CASE WHEN t = '' THEN 0e0 ELSE length({d.join('found', empty)}) * 1e0 / length(t) END AS share FROM s"""


@plan
def x17_x58_delimiters_and_tags(d: Dialect) -> str:
    """Formula without the first pair of delimiters that fits, and split from the equation number at its end."""
    tag = "(?:§(?:qquad|quad|hspace[*]?(?:[{][^}]*[}])?|,|;|:|!)|[ ]{3,})+[ ]*[（(][ ]*([0-9]+[a-z]?)[ ]*[)）][ ]*$"
    ends = lambda a, z, n: f"WHEN length(t) > {2 * n} AND substring(t, 1, {n}) = '{a}' AND substring(t, length(t) - {n - 1}, {n}) = '{z}' THEN trim(substring(t, {n + 1}, length(t) - {2 * n}))"
    return f"""WITH {FORMULAS}, b AS (SELECT item, coalesce(raw, '') AS raw, trim(coalesce(raw, '')) AS t, regexp_extract(coalesce(raw, ''), '{tag}', 1) AS tag, trim({d.sub("coalesce(raw, '')", tag, '')}) AS head FROM formulas)
SELECT item, CASE {ends('§[', '§]', 2)} {ends('§(', '§)', 2)} {ends('$$', '$$', 2)} {ends('$', '$', 1)} ELSE t END AS body, CASE WHEN tag <> '' AND head <> '' THEN head ELSE raw END AS head, CASE WHEN head <> '' THEN tag ELSE '' END AS tag FROM b"""


@plan
def x24_replacements(d: Dialect) -> str:
    """Text with the intervals [a, b) replaced in order; where intervals overlap or leave the text the line stays as it is."""
    two = "SELECT p_partkey, CAST(p_size % 9 AS INTEGER) AS a, CAST(p_size % 9 + 3 AS INTEGER) AS b, 'x' AS latex, p_name FROM part UNION ALL SELECT p_partkey, CAST(p_size % 13 + 4 AS INTEGER), CAST(p_size % 13 + 5 AS INTEGER), 'y', p_name FROM part WHERE p_partkey % 3 > 0"
    return f"""WITH r AS ({two}), o AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY p_partkey ORDER BY a, b, latex), 0) AS cur FROM r),
j AS (SELECT p_partkey, p_name, max(CASE WHEN a < cur OR b > length(p_name) OR a > b THEN 1 ELSE 0 END) AS clash, {d.glue("substring(p_name, cur + 1, a - cur) || '§(' || latex || '§)'", "''", 'a, b, latex')} AS text, max(b) AS stop FROM o GROUP BY p_partkey, p_name)
SELECT p_partkey, CASE WHEN clash = 1 THEN p_name ELSE text || substring(p_name, stop + 1, length(p_name)) END AS text FROM j"""


@plan
def x56_copied_sentence(d: Dialect) -> str:
    """Sentence [s, e) of a block with the formulas that meet it as LaTeX, clipped to it; line ends become blanks."""
    return f"""WITH {FORMULAS}, k AS (SELECT item, name, 2 AS s, 2 + n AS e FROM formulas), c AS (SELECT *, substring(name, s + 1, e - s) AS text FROM k),
r AS (SELECT item, text, greatest(0, 4 - s) AS a, least(length(text), 6 - s) AS b, 'z' AS latex FROM c WHERE 4 < e AND 6 > s UNION ALL SELECT item, text, greatest(0, 9 - s), least(length(text), 40 - s), 'w^2' FROM c WHERE 9 < e AND 40 > s),
o AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY item ORDER BY a), 0) AS cur FROM r WHERE a <= length(text)), j AS (SELECT item, text, {d.glue("substring(text, cur + 1, a - cur) || '$' || latex || '$'", "''", 'a')} AS head, max(b) AS stop FROM o GROUP BY item, text)
SELECT c.item, trim({d.sub("coalesce(j.head || substring(j.text, j.stop + 1, length(j.text)), c.text)", '[' + chr(10) + ']+', ' ')}) AS copied FROM c LEFT JOIN j ON c.item = j.item"""


@plan
def x21_normalised_offsets(d: Dialect) -> str:
    """Letters and digits in lower case, ligatures spelled out, each with the offset of its source character. Ligatures are fixed values."""
    ligatures = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
    spelled = "CASE substring(t, i, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ligatures.items()) + " ELSE lower(substring(t, i, 1)) END"
    return f"""WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'ﬁnal eﬃcient ' ELSE '' END || p_name AS t FROM part), c AS (SELECT p_partkey, t, {d.ints('1', 'length(t)')} AS i FROM s),
k AS (SELECT p_partkey, i, {spelled} AS chars FROM c WHERE {d.rx('substring(t, i, 1)', '[0-9A-Za-zﬀ-ﬆ一-鿿]')}), e AS (SELECT p_partkey, i, chars, {d.ints('1', 'length(chars)')} AS j FROM k)
SELECT p_partkey, CAST(i - 1 AS INTEGER) AS source, CAST(j AS INTEGER) AS j, substring(chars, CAST(j AS INTEGER), 1) AS c FROM e"""


@plan
def x25_tightened_span(d: Dialect) -> str:
    """An interval without the marks and blanks before its first glyph and the blanks after its last."""
    return f"""WITH {FORMULAS}, s AS (SELECT item, n % 7 AS a, substring(coalesce(raw, ''), n % 7 + 1, 12) AS seg FROM formulas), m AS (SELECT item, a + length(seg) - length(rest) AS a, rest FROM (SELECT *, {d.sub('seg', '^[^0-9A-Za-z=+^_§]*', '')} AS rest FROM s) q)
SELECT item, CAST(a AS INTEGER) AS start, CAST(a + length(trim(rest)) AS INTEGER) AS stop FROM m"""


@plan
def x26_x27_sliced_lines(d: Dialect) -> str:
    """Characters [4, 4 + size) of each line's runs, and where they lie if all characters are as wide."""
    return f"""WITH {RUNS}, o AS (SELECT line, run, t, sum(length(t)) OVER (PARTITION BY line ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(t) AS p, sum(length(t)) OVER (PARTITION BY line) AS n, 4 AS a, 4 + max(size) OVER (PARTITION BY line) AS b FROM runs),
s AS (SELECT *, greatest(a, p) AS s0, least(b, p + length(t)) AS s1 FROM o)
SELECT line, run, substring(t, CAST(s0 - p + 1 AS INTEGER), CAST(s1 - s0 AS INTEGER)) AS t, round(10e0 + 400e0 * a / greatest(1, n), 6) AS x, round(greatest(1e0, 400e0 * (b - a) / greatest(1, n)), 6) AS w FROM s WHERE s1 > s0"""


@plan
def x64_summary_text(d: Dialect) -> str:
    """A summary as lines: overview, themes with points, questions. The labels are fixed values."""
    part = lambda place, label, text, cond: f"SELECT o_custkey AS doc, o_orderkey AS k, {place} AS place, {label} || {text} AS line FROM orders WHERE {cond}"
    heads = f"SELECT DISTINCT o_custkey AS doc, CAST(0 AS BIGINT) AS k, 3 AS place, '【待想清楚】' AS line FROM orders WHERE o_orderkey % 4 = 2"
    rows = [part(1, "'【主题】'", "o_orderpriority", "o_orderkey % 4 = 0"), part(2, "'  - '", "o_orderstatus", "o_orderkey % 4 = 0"), heads, part(4, "'  - '", "o_orderpriority", "o_orderkey % 4 = 2")]
    return f"""WITH c AS ({' UNION ALL '.join(rows)}), l AS (SELECT doc, line, CASE WHEN place < 3 THEN 0 ELSE 1 END AS part, k, place FROM c)
SELECT doc, {d.glue('line', 'chr(10)', 'part, k, place')} AS summary FROM l GROUP BY doc"""


@plan
def x65_language_in_prompt(d: Dialect) -> str:
    """The language's display name into a template; unknown codes take the default's. Names are fixed values."""
    names = {"zh-CN": "简体中文", "zh-TW": "繁体中文", "en": "英文", "ja": "日文"}
    pick = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE '{names['zh-CN']}' END"
    return f"SELECT c_custkey, replace('Translate to {{}}; text that is {{}} stays.', '{{}}', {pick}) AS prompt FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'ja' WHEN 2 THEN 'zh-TW' WHEN 3 THEN 'zh-CN' ELSE 'xx' END AS code FROM customer) q"


@plan
def x45_cell_boxes(d: Dialect) -> str:
    """Cells as lists of numbers; what can't be read so is no cell."""
    text = "CASE p_partkey % 4 WHEN 0 THEN '[[1,2,3,4],[5,6,7,8]]' WHEN 1 THEN '[]' WHEN 2 THEN 'bad' ELSE '[[' || CAST(p_size AS VARCHAR(20)) || ',2.5]]' END"
    cells = f"from_json({text}, 'array<array<double>>')" if d.spark else f"TRY_CAST(TRY_CAST({text} AS JSON) AS DOUBLE[][])"
    return f"WITH c AS (SELECT p_partkey, {cells} AS cells FROM part) SELECT p_partkey, pos, {d.at('b', 0)} AS x, {d.at('b', 1)} AS y FROM ({d.spread('p_partkey', 'cells', 'c')}) q"


@plan
def x51_options(d: Dialect) -> str:
    """Defaults under file, environment and explicit values, field by field, then clamped."""
    env = "CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 1000 AS INTEGER) END"
    return f"SELECT c_custkey, CAST(least(600, greatest(72, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 50 END, {env}, CASE WHEN c_custkey % 2 = 0 THEN 150 END, 200))) AS INTEGER) AS dpi, least(1e0, greatest(0e0, coalesce(CASE WHEN c_custkey % 4 = 0 THEN c_acctbal / 1000e0 END, 0.6e0))) AS overlap FROM customer"


# --- geometry of lines -------------------------------------------------------------------------------------------------


@plan
def f45_lines_outside_rects(d: Dialect) -> str:
    """Blocks rebuilt from the lines whose centre no formula box (class 3) holds; blocks left empty go."""
    centred = "l.page = r.page AND (l.x1 + l.x2) / 2 >= r.x1 AND (l.x1 + l.x2) / 2 <= r.x2 AND (l.y1 + l.y2) / 2 >= r.y1 AND (l.y1 + l.y2) / 2 <= r.y2"
    anti = f"SELECT l.* FROM lines_ l LEFT ANTI JOIN rects r ON {centred}" if d.spark else f"SELECT * FROM lines_ l ANTI JOIN rects r ON {centred}"
    return f"WITH {BOXES}, lines_ AS (SELECT * FROM boxes WHERE cls <> 3), rects AS (SELECT page, x1, x2, y1, y2 FROM boxes WHERE cls = 3), kept AS ({anti}) SELECT page, min(x1) AS x, min(y1) AS y, max(x2) - min(x1) AS w, max(y2) - min(y1) AS h, count(*) AS lines FROM kept GROUP BY page"


@plan
def f54_joinable(d: Dialect) -> str:
    return f"WITH {PAIRS} SELECT page, det, other, u1 <= x2 + 4 AND x1 <= u2 + 4 AND least(y2, v2) - greatest(y1, v1) > -2 AS joinable FROM pairs"


@plan
def j33_row_span(d: Dialect) -> str:
    """Interval of an anchor's row (boxes of class 0): neighbours that overlap by 40 % in height, cut at gaps over 12; the island that overlaps most, the first of equals."""
    return f"""WITH {BOXES}, s AS (SELECT a.page, a.det, a.x1 AS x0, a.x2 AS xe, b.x1 AS lo, b.x2 AS hi, row_number() OVER (PARTITION BY a.page, a.det ORDER BY b.x1, b.x2) AS i FROM boxes a JOIN boxes b ON a.page = b.page
 AND least(a.y2, b.y2) - greatest(a.y1, b.y1) >= 0.4e0 * least(a.y2 - a.y1, b.y2 - b.y1) WHERE a.cls = 0),
e AS (SELECT *, max(hi) OVER (PARTITION BY page, det ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM s),
g AS (SELECT *, sum(CASE WHEN edge IS NULL OR lo - edge > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY page, det ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM e),
n AS (SELECT page, det, min(x0) AS x0, max(xe) AS xe, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY page, det, island),
r AS (SELECT *, row_number() OVER (PARTITION BY page, det ORDER BY least(hi, xe) - greatest(lo, x0) DESC, lo) AS place FROM n)
SELECT page, det, least(lo, x0) AS left_, greatest(hi, xe) AS right_ FROM r WHERE place = 1"""


@plan
def j39_page_formulas(d: Dialect) -> str:
    """Formulas of a page from detections that were read, and from formula blocks: name and relative place."""
    return f"""WITH {BOXES} SELECT page, det, 'InlineFormula' AS name, round((y1 + y2) / 2 / 160e0, 6) AS cy, round((x1 + x2) / 2 / 160e0, 6) AS cx FROM boxes WHERE cls < 2 AND det % 5 > 0
UNION ALL SELECT page, det, 'formula_block', CASE WHEN page % 3 > 0 THEN round((y1 + h / 2) / 160e0, 6) END, CASE WHEN page % 3 > 0 THEN round((x1 + w / 2) / 160e0, 6) END FROM boxes WHERE cls = 3"""


@plan
def w13_blank_split(d: Dialect) -> str:
    """Blanks of a gap over its runs by width, one at least each; what rounding leaves goes to the widest, what it lacks is taken from the widest on."""
    share = d.even("n * w / total", 0)
    return f"""WITH {RUNS}, k AS (SELECT line, run, CASE WHEN run % 4 = 0 THEN 0e0 ELSE w END AS w, greatest(max(size) OVER (PARTITION BY line) % 12, count(*) OVER (PARTITION BY line)) AS n FROM runs),
s AS (SELECT line, run, w, n, coalesce(nullif(sum(w) OVER (PARTITION BY line), 0e0), count(*) OVER (PARTITION BY line)) AS total FROM k), o AS (SELECT line, run, n, greatest(1, CAST({share} AS INTEGER)) AS part FROM s),
r AS (SELECT *, n - sum(part) OVER (PARTITION BY line) AS diff, row_number() OVER (PARTITION BY line ORDER BY part DESC, run) AS place, sum(part - 1) OVER (PARTITION BY line ORDER BY part DESC, run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (part - 1) AS taken FROM o)
SELECT line, run, CAST(CASE WHEN diff >= 0 THEN part + CASE WHEN place = 1 THEN diff ELSE 0 END ELSE part - greatest(0, least(part - 1, -diff - taken)) END AS INTEGER) AS blanks FROM r"""


@plan
def w15_gap_widths(d: Dialect) -> str:
    """Width left in a line, over its gaps by their estimates; unknown estimates are the mean of known ones, or all are equal."""
    return f"""WITH {RUNS}, g AS (SELECT line, run, CASE WHEN run % 3 = 0 THEN NULL WHEN line % 7 = 0 THEN 0e0 ELSE w END AS est, 300e0 - 40e0 * (line % 9) AS total FROM runs),
f AS (SELECT line, run, total, count(*) OVER (PARTITION BY line) AS n, coalesce(est, avg(est) OVER (PARTITION BY line), 1e0) AS e FROM g), s AS (SELECT *, sum(e) OVER (PARTITION BY line) AS whole FROM f)
SELECT line, run, CASE WHEN total > 0 THEN round(CASE WHEN whole > 0 THEN total * e / whole ELSE total / n END, 3) END AS width FROM s"""


@plan
def x30_x60_type_size(d: Dialect) -> str:
    """Type size and line height of a block by kind, and the size shrunk to the box, by 30 % at most."""
    kind = "CASE p_partkey % 7 WHEN 0 THEN 'heading' WHEN 1 THEN 'caption' WHEN 2 THEN 'footnote' WHEN 3 THEN 'table' WHEN 4 THEN 'formula' ELSE 'text' END"
    head = "CASE p_size % 7 WHEN 1 THEN 1.45e0 WHEN 2 THEN 1.22e0 WHEN 3 THEN 1.08e0 WHEN 4 THEN 1.02e0 WHEN 0 THEN 1.22e0 ELSE 1e0 END"
    return f"""WITH b AS (SELECT p_partkey, {kind} AS kind, {head} AS head, 6e0 + p_size % 23 AS body, 40e0 + p_size * 5 AS w, 10e0 + p_size AS h, length(p_name) * 4 AS chars FROM part),
s AS (SELECT *, least(28e0, greatest(5.5e0, body * CASE kind WHEN 'heading' THEN head WHEN 'caption' THEN 0.92e0 WHEN 'footnote' THEN 0.88e0 WHEN 'table' THEN 0.95e0 ELSE 1e0 END)) AS size FROM b),
e AS (SELECT *, chars * 0.62e0 * size / w * 1.42e0 * size AS est FROM s)
SELECT p_partkey, round(size, 4) AS size, round(size * CASE kind WHEN 'heading' THEN 1.25e0 WHEN 'caption' THEN 1.32e0 WHEN 'footnote' THEN 1.32e0 WHEN 'table' THEN 1.3e0 WHEN 'formula' THEN 1.3e0 ELSE 1.42e0 END, 4) AS line_h,
round(CASE WHEN chars < 40 OR est <= h * 1.05e0 THEN size ELSE greatest(size * 0.7e0, size * sqrt(h * 1.05e0 / est)) END, 4) AS fitted FROM e"""


@plan
def a05_a06_reference_blocks(d: Dialect) -> str:
    """A recognised bibliography block cut into its entries, each as high as its estimated lines."""
    return f"""WITH e AS (SELECT o_custkey AS doc, o_orderkey AS k, '[' || CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS {V}) || '] ' || repeat(o_orderpriority || ' ', CAST(1 + o_orderkey % 9 AS INTEGER)) AS text FROM orders),
l AS (SELECT doc, k, text, greatest(1, CAST(ceil(length(text) / (300e0 / 5.5e0)) AS INTEGER)) AS weight FROM e), c AS (SELECT *, sum(weight) OVER (PARTITION BY doc) AS total, sum(weight) OVER (PARTITION BY doc ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - weight AS above, count(*) OVER (PARTITION BY doc) AS entries FROM l)
SELECT doc, k, CAST(regexp_extract(text, '^.([0-9]+)', 1) AS INTEGER) AS n, round(40e0 + 500e0 * above / total, 6) AS y, round(500e0 * weight / total, 6) AS h FROM c WHERE entries > 1"""


@plan
def s28_split(d: Dialect) -> str:
    """Items to train and validation by a hash of their key: nine tenths and one."""
    part = f"{'conv(substring(md5(CAST(p_partkey AS STRING)), 1, 8), 16, 10)' if d.spark else chr(39) + '0x' + chr(39) + ' || substring(md5(CAST(p_partkey AS VARCHAR)), 1, 8)'}"
    return f"SELECT p_partkey, CASE WHEN CAST({part} AS BIGINT) % 10 < 9 THEN 'train' ELSE 'val' END AS part FROM part"


# --- batches and pages -------------------------------------------------------------------------------------------------


@plan
def m03_fan_in(d: Dialect) -> str:
    """Results joined to their items; what has none, or an error, counts as failed."""
    return f"""WITH {BOXES}, results AS (SELECT page, det, cls, max(CASE WHEN det % 5 = 0 THEN 'timeout' END) AS error FROM boxes WHERE det % 3 > 0 GROUP BY page, det, cls)
SELECT b.page, count(*) AS items, count(CASE WHEN r.page IS NOT NULL AND r.error IS NULL THEN 1 END) AS done, count(CASE WHEN r.page IS NULL OR r.error IS NOT NULL THEN 1 END) AS failed
FROM boxes b LEFT JOIN results r ON b.page = r.page AND b.det = r.det AND b.cls = r.cls WHERE b.cls < 3 GROUP BY b.page"""


@plan
def z02_enriched_pages(d: Dialect) -> str:
    """Pages with the formula boxes found for them; pages without any stay, with a warning."""
    return f"""WITH {BOXES}, pages_ AS (SELECT DISTINCT page FROM boxes), found AS (SELECT page, count(*) AS formulas FROM boxes WHERE cls < 2 AND conf > 0.5e0 GROUP BY page)
SELECT p.page, coalesce(f.formulas, 0) AS formulas, CASE WHEN f.page IS NULL THEN 'not enriched' END AS warning FROM pages_ p LEFT JOIN found f ON p.page = f.page"""


@plan
def s34_upload_rows(d: Dialect) -> str:
    """A record and its first status for each upload that has a page and text; the others are refused with the reason."""
    return f"""WITH p AS (SELECT doc_id, source, coalesce(length(trim(text)), 0) AS chars, CAST(floor(coalesce(length(text), 0) / 100e0) AS INTEGER) AS pages_n FROM documents)
SELECT doc_id, CASE WHEN pages_n < 1 THEN 'no pages' WHEN chars = 0 THEN 'no content' END AS refused, CASE WHEN pages_n > 0 AND chars > 0 THEN 'unread' END AS status, CASE WHEN pages_n > 0 AND chars > 0 THEN 0e0 END AS progress FROM p"""


@plan
def s30_raster_places(d: Dialect) -> str:
    """One image per rounded box, of those the one of most pixels, coloured before grey; slivers and whole pages go."""
    return f"""WITH {BOXES}, p AS (SELECT page, det, round(x1, 1) AS x, round(y1, 1) AS y, w, h, CAST(w * h AS BIGINT) AS pixels, cls % 2 AS colour, conf FROM boxes WHERE w >= 3 AND h >= 3 AND w * h <= 0.97e0 * 100 * 100),
r AS (SELECT *, row_number() OVER (PARTITION BY page, x, y ORDER BY pixels DESC, colour DESC, det, conf) AS place FROM p) SELECT page, det, x, y, pixels, colour FROM r WHERE place = 1"""


@plan
def j07_goto_citations(d: Dialect) -> str:
    """Links to a bibliography entry at the first token of their block that names it: all known numbers of the token, and the entry; once a token."""
    lo, hi = "CAST(regexp_extract(t, '^([0-9]+)', 1) AS INTEGER)", "CAST(coalesce(nullif(regexp_extract(t, '-([0-9]+)$', 1), ''), regexp_extract(t, '^([0-9]+)', 1)) AS INTEGER)"
    return f"""WITH {CITES}, toks AS (SELECT doc, blk, text, {'explode' if d.spark else 'unnest'}({d.found('text', '[0-9]+(-[0-9]+)?')}) AS t FROM body), spans AS (SELECT DISTINCT doc, blk, instr(text, t) AS start, t, {lo} AS a, {hi} AS b FROM toks),
nums AS (SELECT doc, blk, start, t, {d.ints('a', 'greatest(a, b)')} AS n FROM spans), links AS (SELECT doc, n, entry FROM entries WHERE entry % 3 = 0),
hit AS (SELECT {d.merged('l', 's')}l.doc, l.n AS target, s.start, row_number() OVER (PARTITION BY l.doc, l.n ORDER BY s.start, s.t) AS place, s.t FROM links l JOIN nums s ON l.doc = s.doc AND l.n = s.n),
used AS (SELECT DISTINCT doc, start, t FROM hit WHERE place = 1)
SELECT {d.merged('u', 'x', 'e')}DISTINCT u.doc, CAST(u.start AS INTEGER) AS start, u.t AS token, CAST(e.n AS INTEGER) AS n, e.entry FROM used u JOIN nums x ON u.doc = x.doc AND u.start = x.start AND u.t = x.t JOIN entries e ON e.doc = x.doc AND e.n = x.n"""


@plan
def x32_synthetic_layout(d: Dialect) -> str:
    """Plain text laid out from the top: lines as high as the page allows, paragraphs (here of five lines) a gap apart."""
    return f"""WITH l AS (SELECT doc_id, blk, CAST(floor(blk / 5) AS INTEGER) AS para, trim(text) AS t FROM ({d.lines()}) q WHERE trim(text) <> ''),
n AS (SELECT doc_id, blk, para, t, least(28e0, greatest(9e0, 720e0 / count(*) OVER (PARTITION BY doc_id))) AS lh, row_number() OVER (PARTITION BY doc_id ORDER BY blk) - 1 AS k, dense_rank() OVER (PARTITION BY doc_id ORDER BY para) - 1 AS p FROM l)
SELECT doc_id, blk, round(36e0 + k * lh + p * least(lh * 0.6e0, 12e0), 4) AS y, round(lh, 4) AS h, greatest(6e0, least(14e0, round(lh * 0.78e0, 1))) AS size FROM n"""


@plan
def x38_cleaned_summary(d: Dialect) -> str:
    """A model's summary within bounds: 1,500 characters of overview, eight items of 300; blank ones go."""
    return f"""WITH i AS (SELECT doc_id, blk, substring(trim(text), 1, 300) AS item FROM ({d.lines()}) q WHERE trim(text) <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY blk) AS k FROM i)
SELECT d.doc_id, substring(trim(coalesce(d.text, '')), 1, 1500) AS overview, r.k, r.item FROM documents d JOIN r ON d.doc_id = r.doc_id WHERE r.k <= 8"""


@plan
def f32_formula_lines(d: Dialect) -> str:
    """Lines that are formulas alone: without math runs nothing is left but marks, or nine tenths are math and the rest has an operator."""
    return f"""WITH {leveled(d)}, l AS (SELECT line, {d.glue("CASE WHEN level > 0 THEN '' ELSE t END", "''", 'run')} AS rest, sum(CASE WHEN level > 0 THEN length(trim(t)) ELSE 0 END) AS covered, length(trim({d.glue('t', "''", 'run')})) AS n, max(level) AS top FROM f GROUP BY line)
SELECT line, top > 0 AND (NOT {d.rx('rest', '[0-9A-Za-z]')} OR covered >= 0.9e0 * greatest(1, n) AND {d.rx('rest', '[=+^_/()]')}) AS formula FROM l"""


@plan
def j18_passengers(d: Dialect) -> str:
    """Blanked lines (here every fourth) ride on the nearest line above, else on the nearest below; half a height may overlap."""
    up, down = "b.y2 <= a.y1 + 0.5e0 * a.h", "a.y2 <= b.y1 + 0.5e0 * b.h"
    return f"""WITH {BOXES}, m AS (SELECT a.page, a.det, a.cls, a.conf, b.det AS host, row_number() OVER (PARTITION BY a.page, a.det, a.cls, a.conf, a.x1, a.y1 ORDER BY CASE WHEN {up} THEN 0 ELSE 1 END, abs(CASE WHEN {up} THEN a.y1 - b.y2 ELSE b.y1 - a.y2 END), b.det) AS place
FROM boxes a JOIN boxes b ON a.page = b.page AND a.det % 4 = 0 AND b.det % 4 > 0 AND ({up} OR {down})) SELECT page, det, cls, host FROM m WHERE place = 1"""


@plan
def j34_j36_rows_between(d: Dialect) -> str:
    """Formula rows (classes 0 and 1) between two anchor lines (first and last of the page) whose centre lies in the gap and which share the anchors' width; jobs have six at most."""
    return f"""WITH {BOXES}, a AS (SELECT page, min(y2) AS lo, max(y1) AS hi, min(x1) AS x_lo, max(x2) AS x_hi FROM boxes WHERE cls > 3 GROUP BY page),
r AS (SELECT b.page, b.det, b.y1, count(*) OVER (PARTITION BY b.page) AS rows_ FROM boxes b JOIN a ON a.page = b.page AND a.hi >= a.lo AND (b.y1 + b.y2) / 2 BETWEEN a.lo - 2 AND a.hi + 2 AND b.x2 >= a.x_lo AND b.x1 <= a.x_hi WHERE b.cls < 2)
SELECT page, det, rows_, rows_ <= 6 AS job FROM r"""
