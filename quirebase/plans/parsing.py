"""Plans over text that has a grammar: grounded OCR output, HTML, model answers, event streams, bibliographies and citations.

Each takes the view it reads as a second argument; tests bind it to written rows with known results.
§ stands for the backslash, which the engines' literals treat differently.
"""

from __future__ import annotations

from .catalog import plan
from .dialect import Dialect

N = "CAST({0} AS VARCHAR(20))"

#: Grounded output of a page or two: records, continuations, page marks, records with a wrong number of coordinates.
GROUNDED = f"""grounded AS (SELECT p_partkey AS doc, CASE WHEN p_partkey % 4 = 0 THEN 'loose start' || chr(10) ELSE '' END || 'Title [' || {N.format('p_partkey % 500')} || ', 203, ' || {N.format('700 - p_size')} || ', 229.5] ' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END
 || chr(10) || '  goes on  ' || chr(10) || chr(10) || CASE p_partkey % 3 WHEN 0 THEN 'text [1, 2, 3] three' WHEN 1 THEN '<|det|>figure<|/det|> [9, 8, -7, 6]' ELSE 'more<PAGE>next page' END || chr(10) || 'table_a [0, 4, 10, ' || {N.format('p_size')} || ']' || CASE WHEN p_partkey % 2 = 0 THEN '<PAGE> tail ' || p_brand ELSE '' END AS text FROM part)"""

#: Fragments of HTML as recognisers return them.
MARKUP = """markup AS (SELECT p_partkey AS item, CASE p_partkey % 7 WHEN 0 THEN '<table><tr><td>' || p_name || ' &amp; co</td><TH class="x"> ' || p_brand || ' </TH></tr><tr><td> </td></tr><tr></tr></table>' WHEN 1 THEN '<p>Let <math display="block"> x &lt; <annotation>y</annotation></math> and <math>z</math></p>'
 WHEN 2 THEN '<table>' || p_name || chr(10) || '  no rows</table>' WHEN 3 THEN '<h2>1.' || p_brand || '</h2>' WHEN 4 THEN NULL WHEN 5 THEN '&amp;lt;b&gt; &quot;' || p_name || '&quot; it&#39;s' ELSE '<tr><td>a</td></tr><tr><td>b<br>c</td><td></td></tr>' END AS html FROM part)"""

#: What a language model answers when asked for JSON.
ANSWERS = f"""answers AS (SELECT p_partkey AS item, CASE p_partkey % 8 WHEN 0 THEN '```json' || chr(10) || '[{{"a": 1}}, {{"b": ' || {N.format('p_size')} || '}}]' || chr(10) || '```' WHEN 1 THEN 'Here: [' || {N.format('p_size')} || ', 2, 3] done' WHEN 2 THEN ' {{"ok": true}} ' WHEN 3 THEN 'no list' WHEN 4 THEN '[1, 2'
 WHEN 5 THEN 'see [1] and [2]' WHEN 6 THEN '```' || chr(10) || 'x [' || chr(10) || '1]```' ELSE {N.format('p_size')} END AS content FROM part)"""

#: A streamed answer: comments, deltas, parts, a whole message, broken lines, the end mark and what comes after it.
EVENTS = """streams AS (SELECT p_partkey AS item, ': ping' || chr(10) || 'event: x' || chr(10) || CASE p_partkey % 4 WHEN 0 THEN 'data: {"choices": [{"delta": {"content": "Hel"}}]}' || chr(10) || chr(10) || ' data:{"choices": [{"delta": {"content": "lo ' || p_brand || '"}}]}  ' WHEN 1 THEN 'data: {"choices": [{"delta": {"content": [{"text": "p"}, "q", {"no": 1}]}}]}'
 WHEN 2 THEN '{"choices": [{"message": {"content": "whole ' || p_name || '"}}]}' ELSE 'data: {"choices": []}' || chr(10) || 'data: {"choices": [{"delta": {"reasoning_content": "r"}}]}' END || chr(10) || 'data: {"choices": [' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN 'data: [DONE]' || chr(10) ELSE '' END || 'data: {"choices": [{"delta": {"content": "!"}}]}' AS text FROM part)"""

#: Blocks of a reference section per customer: numbered in even ones, with authors and years in the others; continuations, page numbers.
REGION = f"""region_ AS (SELECT o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS blk, CASE WHEN o_orderkey % 9 = 4 THEN {N.format('o_orderkey % 1000')} WHEN o_orderkey % 5 = 3 THEN ' continued   in the Journal of ' || o_orderpriority
 WHEN o_custkey % 2 = 0 THEN '[' || {N.format('row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)')} || '] ' || o_clerk || '. ' || o_comment_ ELSE '[' || CASE o_orderkey % 3 WHEN 0 THEN 'Wu' WHEN 1 THEN 'Smith et al.' ELSE 'van Dyke' END || ', ' || {N.format('1990 + o_orderkey % 30')} || '] The ' || o_comment_ END AS text
 FROM (SELECT o_custkey, o_orderkey, o_orderpriority, o_clerk_ AS o_clerk, o_comment_ FROM (SELECT o_custkey, o_orderkey, o_orderpriority, 'Clerk' || {N.format('o_orderkey % 7')} AS o_clerk_, 'Parsing ' || lower(o_orderstatus) || 'orpora of ' || lower(o_orderpriority) AS o_comment_ FROM orders) q) q2)"""

#: A sentence per customer that cites by author and year, in both kinds of brackets, one inside the other.
CITING = f"""citing AS (SELECT c_custkey AS doc, 0 AS blk, 'As (see [Smith et al., ' || {N.format('1990 + c_custkey % 30')} || ']) and (Wu, ' || {N.format('1990 + c_custkey * 7 % 30')} || '; van Dyke, ' || {N.format('1990 + c_custkey * 11 % 30')} || ') say, [3] ' || 'too (parsing, ' || {N.format('1990 + c_custkey % 13')} || ').' AS text FROM customer)"""

#: Words that name no author, and further ones that a label may have.
STOP = "et al the and for with from this that proc proceedings conference journal vol pp ed eds press university arxiv https http www".split()
LABEL_STOP = [*STOP, *"de van von der la jr sr ii iii".split()]
#: Years, label of an entry, start of a numbered one, tokens in square brackets and in parentheses, most characters of an entry.
YEAR, LABEL = "(?:19|20)[0-9]{2}", "^§s*§[([^§[§]§n]{1,120}?),§s*(?:19|20)[0-9]{2}[a-z]?§]"
NUMBERED = "^§s*(?:§[([0-9]{1,3})§]|§(([0-9]{1,3})§)|([0-9]{1,3})§s*[.)])"
SQUARE, ROUND, MOST = "§[([^§[§]§n]{2,150}?)§]", "§(([^()§n]{2,180}?)§)", 1500


def parts(d: Dialect, cols: str, array: str, src: str, at: str, name: str) -> str:
    """Rows of a list's items, their place from 0 as `at`."""
    return f"SELECT {cols}, pos AS {at}, b AS {name} FROM ({d.spread(cols, array, src)}) spread_{at}"


@plan
def s07_grounded_records(d: Dialect, view: str = GROUNDED) -> str:
    """`type [x0, y0, x1, y1] text` opens an item, <PAGE> a page; other lines join the item before, or open one on a new page."""
    record, number = d.pat("^([A-Za-z_][A-Za-z0-9_-]*)§s+§[([^§]]+)§]§s*(.*)$"), "-?[0-9]+(?:[.][0-9]+)?"
    bare = f"SELECT doc, {d.sub('text', d.pat('<§|/?(?:ref|det)§|>'), '')} AS text FROM grounded"
    lines = parts(d, "doc", d.split("text", d.pat("§n")), f"({bare}) s0", "line", "l")
    pieces = parts(d, "doc, line", d.split("l", "<PAGE>"), f"({lines}) s1", "piece", "p")
    pages = f"SELECT doc, line, piece, {d.trim('p')} AS t, 1 + sum(CASE WHEN piece > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line, piece ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page FROM ({pieces}) s2"
    read = f"SELECT *, {d.rx('t', record)} AND {d.size(d.found(f'regexp_extract(t, {chr(39)}{record}{chr(39)}, 2)', number))} = 4 AS rec, row_number() OVER (PARTITION BY doc, page ORDER BY line, piece) AS k FROM ({pages}) s3 WHERE t <> ''"
    items = f"SELECT *, sum(CASE WHEN rec OR k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line, piece ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS item FROM ({read}) s4"
    box = d.found(f"regexp_extract(t, '{record}', 2)", number)
    fields = ", ".join(f"max(CASE WHEN rec THEN CAST({d.at(box, i)} AS DOUBLE) END) AS {c}" for i, c in enumerate(("x0", "y0", "x1", "y1")))
    body = f"CASE WHEN rec THEN nullif({d.trim(f'regexp_extract(t, {chr(39)}{record}{chr(39)}, 3)')}, '') ELSE t END"
    return f"WITH {view} SELECT doc, CAST(item AS BIGINT) AS item, CAST(min(page) AS BIGINT) AS page, coalesce(max(CASE WHEN rec THEN regexp_extract(t, '{record}', 1) END), 'text') AS type, {fields}, {d.glue('body', 'chr(10)', 'line, piece')} AS text FROM (SELECT *, {body} AS body FROM ({items}) s5) s6 GROUP BY doc, item"


@plan
def s08_grounded_blocks(d: Dialect, view: str = GROUNDED) -> str:
    """The same family by lines: labels in lower case, corners in order, continuations joined by a space, lines before the first block dropped."""
    n = "§s*(-?[0-9]+(?:[.][0-9]+)?)§s*"
    record = d.pat(f"^([A-Za-z_][A-Za-z0-9_-]*)§s*§[{n},{n},{n},{n}§]§s*(.*)$")
    part = lambda i: f"regexp_extract(t, '{record}', {i})"
    lines = parts(d, "doc", d.split("text", d.pat("§n")), "grounded", "line", "l")
    read = f"SELECT doc, line, t, {d.rx('t', record)} AS rec FROM (SELECT doc, line, {d.trim('l')} AS t FROM ({lines}) s1) s2 WHERE t <> ''"
    items = f"SELECT *, sum(CASE WHEN rec THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS item FROM ({read}) s3"
    side = lambda f, a, b: f"max(CASE WHEN rec THEN {f}(CAST({part(a)} AS DOUBLE), CAST({part(b)} AS DOUBLE)) END)"
    return f"WITH {view} SELECT doc, CAST(item AS BIGINT) AS item, max(CASE WHEN rec THEN lower({part(1)}) END) AS label, {side('least', 2, 4)} AS x0, {side('least', 3, 5)} AS y0, {side('greatest', 2, 4)} AS x1, {side('greatest', 3, 5)} AS y1, {d.glue(f'nullif(CASE WHEN rec THEN {d.trim(part(6))} ELSE t END, {chr(39) * 2})', 'chr(32)', 'line')} AS text FROM ({items}) s4 WHERE item > 0 GROUP BY doc, item"


def plain(d: Dialect, s: str) -> str:
    """Tags out, the named references of XML and the blank resolved, the ampersand last."""
    out = d.sub(s, "<[^>]+>", "")
    for name, sign in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&nbsp;", "chr(32)"), ("&amp;", "'&'")):
        out = f"replace({out}, '{name}', {sign})"
    return out


@plan
def x13_x14_x15_html(d: Dialect, view: str = MARKUP) -> str:
    """Text without tags; the LaTeX of the first <math>; a table's rows, cells joined by bars, or all the text where there are none."""
    math = f"coalesce(regexp_extract(html, '{d.pat('(?is)<math[^>]*>(.*?)</math>')}', 1), '')"
    rows = d.found("h", d.pat("(?is)<tr§b[^>]*>(.*?)</tr>"), 1)
    cell = d.found("x", d.pat("(?is)<t[dh]§b[^>]*>(.*?)</t[dh]>"), 1)
    inner = f"transform({cell}, y -> {d.collapsed(plain(d, 'y'))})" if d.spark else f"list_transform({cell}, lambda y: {d.collapsed(plain(d, 'y'))})"
    lines = d.only(d.each(rows, f"trim({d.join(inner, chr(39) + ' | ' + chr(39))})"), "x <> ''")
    return f"WITH {view} SELECT item, {d.trim(plain(d, 'h'))} AS stripped, {d.trim(plain(d, math))} AS latex, CASE WHEN {d.size('rows_')} = 0 THEN {d.collapsed(plain(d, 'h'))} ELSE {d.join('rows_', 'chr(10)')} END AS table_text FROM (SELECT *, {lines} AS rows_ FROM (SELECT item, html, coalesce(html, '') AS h FROM markup) s1) s2"


@plan
def x35_json_answers(d: Dialect, view: str = ANSWERS) -> str:
    """Code fences off; the whole if it is JSON, else what stands between the first [ and the last ] if that is."""
    bare = f"CASE WHEN c LIKE '```%' THEN {d.trim(d.sub('c', d.pat('^```[a-zA-Z]*§s*|§s*```$'), ''))} ELSE c END"
    listed = f"regexp_extract(b, '{d.pat('(?s)§[.*§]')}', 0)"
    return f"WITH {view}, s1 AS (SELECT item, {d.trim('content')} AS c FROM answers), s2 AS (SELECT item, {bare} AS b FROM s1), s3 AS (SELECT item, b, {listed} AS l FROM s2) SELECT item, CASE WHEN {d.json('b')} THEN b WHEN l <> '' AND {d.json('l')} THEN l END AS json FROM s3"


@plan
def x36_sse_deltas(d: Dialect, view: str = EVENTS) -> str:
    """The text of a streamed answer: data lines up to [DONE], broken ones skipped; a delta is a string or parts; else the whole message."""
    if d.spark:
        text = lambda path: f"CASE WHEN schema_of_variant(try_variant_get(j, '{path}', 'variant')) = 'STRING' THEN try_variant_get(j, '{path}', 'string') ELSE array_join(transform(try_variant_get(j, '{path}', 'array<variant>'), x -> CASE WHEN schema_of_variant(x) = 'STRING' THEN try_variant_get(x, '$', 'string') ELSE try_variant_get(x, '$.text', 'string') END), '') END"
        parsed = f"CASE WHEN {d.json('t')} THEN try_parse_json(t) END"
    else:
        one = "CASE WHEN json_type(x) = 'VARCHAR' THEN x ->> '$' ELSE x ->> '$.text' END"
        text = lambda path: f"CASE WHEN json_type(j, '{path}') = 'VARCHAR' THEN j ->> '{path}' WHEN json_type(j, '{path}') = 'ARRAY' THEN array_to_string(list_transform(CAST(json_extract(j, '{path}') AS JSON[]), lambda x: {one}), '') END"
        parsed = "CASE WHEN json_valid(t) THEN CAST(t AS JSON) END"
    lines = parts(d, "item", d.split("text", d.pat("§n")), "streams", "line", "l")
    cut = f"SELECT item, line, CASE WHEN r LIKE 'data:%' THEN {d.trim('substring(r, 6)')} ELSE r END AS t FROM (SELECT item, line, {d.trim('l')} AS r FROM ({lines}) s1) s2 WHERE r <> '' AND r NOT LIKE ':%'"
    until = "SELECT *, max(CASE WHEN t = '[DONE]' THEN 1 ELSE 0 END) OVER (PARTITION BY item ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done FROM s3"
    said = f"coalesce(nullif({text('$.choices[0].delta.content')}, ''), nullif({text('$.choices[0].message.content')}, ''))"
    return f"WITH {view}, s3 AS ({cut}), s4 AS ({until}), s5 AS (SELECT item, line, {parsed} AS j FROM s4 WHERE done = 0) SELECT item, count(said) AS deltas, {d.glue('said', chr(39) * 2, 'line')} AS answer FROM (SELECT item, line, {said} AS said FROM s5) s6 GROUP BY item"


def entries(d: Dialect) -> str:
    """CTEs of a bibliography: numbered or not by vote, blocks put together to entries."""
    start = f"nullif(coalesce(nullif(regexp_extract(t, '{d.pat(NUMBERED)}', 1), ''), nullif(regexp_extract(t, '{d.pat(NUMBERED)}', 2), ''), regexp_extract(t, '{d.pat(NUMBERED)}', 3)), '')"
    return f"""clean AS (SELECT doc, blk, {d.collapsed('text')} AS t, row_number() OVER (PARTITION BY doc ORDER BY blk) AS place FROM region_),
read_ AS (SELECT *, CAST({start} AS INTEGER) AS n FROM clean),
votes AS (SELECT doc, count(n) >= CASE WHEN count(*) <= 4 THEN 2 ELSE 3 END AS numbered FROM read_ WHERE place <= 12 GROUP BY doc),
usable AS (SELECT r.doc, r.blk, r.t, CASE WHEN v.numbered THEN r.n END AS n, CASE WHEN v.numbered THEN r.n IS NOT NULL ELSE {d.rx('r.t', YEAR)} OR row_number() OVER (PARTITION BY r.doc ORDER BY r.blk) = 1 END AS opens, v.numbered
 FROM read_ r JOIN votes v ON r.doc = v.doc WHERE length(r.t) >= 4 AND NOT {d.rx('r.t', '^[0-9]+$')}),
dealt AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS entry FROM usable),
entries AS (SELECT doc, CAST(entry - 1 AS BIGINT) AS entry, max(n) AS n, {d.glue('CAST(blk AS VARCHAR(20))', 'chr(44)', 'blk')} AS blocks, substring({d.glue('t', 'chr(32)', 'blk')}, 1, {MOST}) AS text FROM dealt WHERE entry > 0 GROUP BY doc, entry)"""


@plan
def a03_a04_entries(d: Dialect, view: str = REGION) -> str:
    """Numbered if 3 of the first 12 blocks are (2 of 4 or fewer); a block with a number (else: a year) opens an entry, others join it, to 1,500 characters."""
    return f"WITH {view}, {entries(d)} SELECT doc, entry, CAST(n AS VARCHAR(20)) AS n, blocks, text FROM entries"


def profiles(d: Dialect) -> str:
    label = f"lower(regexp_extract(text, '{d.pat(LABEL)}', 1))"
    return f"profiles AS (SELECT doc, entry, {d.words(d.found('text', YEAR), [])} AS years, {d.words(d.each(d.found('text', '[A-Za-z]{4,}'), 'lower(x)'), STOP)} AS words, {d.words(d.found(label, '[a-z]{2,}'), LABEL_STOP)} AS labels FROM entries WHERE n IS NULL)"


@plan
def x06_author_year_profiles(d: Dialect, view: str = REGION) -> str:
    """What tells an entry without a number: its years, its words of four letters, the words of its label."""
    return f"WITH {view}, {entries(d)}, {profiles(d)} SELECT doc, entry, {d.join('years', 'chr(32)')} AS years, {d.join('words', 'chr(32)')} AS words, {d.join('labels', 'chr(32)')} AS labels FROM profiles"


def tokens(d: Dialect, src: str, pattern: str, kind: str) -> str:
    """Tokens of a pattern with their places: the text between them and they themselves, added up."""
    p = d.pat(pattern)
    between, inner = d.split("text", p), d.found("text", p)
    rows = parts(d, "doc, blk, text", between, src, "k", "piece")
    tok = f"element_at(found, k + 1)" if d.spark else "found[k + 1]"
    listed = f"SELECT doc, blk, k, piece, CASE WHEN k < {d.size('found')} THEN {tok} END AS token FROM (SELECT *, {inner} AS found FROM ({rows}) t1) t2"
    upto = "OVER (PARTITION BY doc, blk ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"SELECT doc, blk, '{kind}' AS kind, CAST(sum(length(piece)) {upto} CURRENT ROW) + coalesce(sum(length(token)) {upto} 1 PRECEDING), 0) AS BIGINT) AS start, token FROM ({listed}) t3"


@plan
def j03_j04_x07_author_year(d: Dialect, view: str = f"{REGION}, {CITING}") -> str:
    """Tokens against profiles, by part between semicolons: a year in common, and a word of the entry inside it or a label word of its
    own. Square brackets first; a token that overlaps an accepted one before it goes."""
    segments = parts(d, "doc, blk, kind, start, token", d.split("substring(token, 2, length(token) - 2)", "[;；]"), "toks", "seg_at", "seg")
    years = f"SELECT DISTINCT doc, blk, kind, start, token, seg, {'explode' if d.spark else 'unnest'}({d.found('seg', YEAR)}) AS year FROM segs"
    entry_years = f"SELECT doc, entry, words, labels, {'explode' if d.spark else 'unnest'}(years) AS year FROM profiles"
    own = d.only(d.found("lower(s.seg)", "[a-z]{2,}"), "x NOT IN (" + ", ".join(f"'{w}'" for w in LABEL_STOP) + ")")
    both = f"arrays_overlap({own}, e.labels)" if d.spark else f"list_has_any({own}, e.labels)"
    inside = d.any("e.words", f"{'instr' if d.spark else 'strpos'}(lower(s.seg), x) > 0")
    hit = f"SELECT DISTINCT s.doc, s.blk, s.kind, s.start, s.token, e.entry FROM seg_years s JOIN entry_years e ON s.doc = e.doc AND s.year = e.year WHERE {inside} OR {both}"
    lost = "SELECT DISTINCT r.doc, r.blk, r.start FROM hits r JOIN hits q ON r.doc = q.doc AND r.blk = q.blk AND r.kind = 'round' AND q.kind = 'square' AND r.start < q.start + length(q.token) AND q.start < r.start + length(r.token)"
    toks = " UNION ALL ".join(f"SELECT * FROM ({tokens(d, 'citing', p, k)}) u_{k} WHERE token IS NOT NULL" for p, k in ((SQUARE, "square"), (ROUND, "round")))
    return f"WITH {view}, {entries(d)}, {profiles(d)}, toks AS ({toks}), segs AS ({segments}), seg_years AS ({years}), entry_years AS ({entry_years}), hits AS ({hit}), lost AS ({lost}) SELECT h.doc, h.blk, h.start, h.start + length(h.token) AS stop, h.token, {d.glue('CAST(h.entry AS VARCHAR(20))', 'chr(44)', 'h.entry')} AS refs FROM hits h LEFT JOIN lost l ON h.doc = l.doc AND h.blk = l.blk AND h.start = l.start AND h.kind = 'round' WHERE l.doc IS NULL GROUP BY h.doc, h.blk, h.start, h.token"


#: Bibliographies as one text of many lines.
LISTS = """lists AS (SELECT p_partkey AS doc, CASE p_partkey % 4 WHEN 0 THEN 'Header' || chr(10) || '[1] ' || p_name || chr(10) || '  2000 more' || chr(10) || ' 2. ' || p_brand || chr(10) || '[Wu, 1998] not an entry' WHEN 1 THEN '[Smith et al., 2020a] ' || p_name || chr(10) || 'goes on' || chr(10) || '[Wu, 1998]   ' || chr(10) || ' [Ke, 2017] x' WHEN 2 THEN p_name ELSE '(12) a' || chr(10) || '(13)b' END AS text FROM part)"""


@plan
def x09_entry_segments(d: Dialect, view: str = LISTS) -> str:
    """Spans of entries: from each line that begins with a number to the next such line; without any, from lines that begin with a label."""
    label = d.pat("^[ §t]*§[[A-Z][^§[§]§n]{1,120}?,§s*(?:19|20)[0-9]{2}[a-z]?§][ §t]*[^ §t]")
    start = d.pat("^[ §t]*(?:§[([0-9]{1,3})§]|§(([0-9]{1,3})§)|([0-9]{1,3})§s*[.)])")
    number = f"CAST(coalesce(nullif(regexp_extract(l, '{start}', 1), ''), nullif(regexp_extract(l, '{start}', 2), ''), nullif(regexp_extract(l, '{start}', 3), '')) AS INTEGER)"
    lines = parts(d, "doc", d.split("text", d.pat("§n")), "lists", "line", "l")
    read = f"SELECT *, {number} AS n, {d.rx('l', label)} AS labelled, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_ FROM ({lines}) s1"
    opens = f"SELECT *, CASE WHEN count(n) OVER (PARTITION BY doc) > 0 THEN n IS NOT NULL ELSE labelled END AS opens FROM ({read}) s2"
    dealt = f"SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS entry FROM ({opens}) s3"
    return f"WITH {view} SELECT doc, CAST(entry AS BIGINT) AS entry, CAST(max(n) AS VARCHAR(20)) AS n, CAST(min(begin_) AS BIGINT) AS start, {d.glue('l', 'chr(10)', 'line')} AS text FROM ({dealt}) s4 WHERE entry > 0 GROUP BY doc, entry"


@plan
def x22_plain_latex(d: Dialect, view: str = "latex AS (SELECT p_partkey AS item, CASE p_partkey % 3 WHEN 0 THEN 'E = §frac{m_1}{c^2}§, x' WHEN 1 THEN p_name ELSE NULL END AS raw FROM part)") -> str:
    """Letters and digits of a formula alone, in lower case, without its commands."""
    raw = f"replace(coalesce(raw, ''), '§', {'chr(92)'})"
    return f"WITH {view} SELECT item, lower({d.sub(d.sub(raw, d.pat('§§[A-Za-z]+'), ' '), '[^0-9A-Za-z]', '')}) AS plain FROM latex"
