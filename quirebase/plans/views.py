"""Deterministic layout, citation, record and tracking views of the driver's tables, the same text on both engines."""

BOXES = """boxes AS (SELECT page, det, cls, conf, x1, y1, x1 + w AS x2, y1 + h AS y2, w, h FROM (
 SELECT l_orderkey AS page, l_linenumber AS det, CAST(l_partkey % 6 AS INTEGER) AS cls, l_discount * 5 + 0.3e0 AS conf,
 CAST(l_partkey * 7 % 90 AS DOUBLE) AS x1, CAST(l_suppkey * 13 % 80 AS DOUBLE) AS y1, 20e0 + l_quantity AS w, CAST(15 + l_partkey % 40 AS DOUBLE) AS h FROM lineitem))"""

RECORDS = """records AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 17 = 0 THEN '' ELSE 'u' || CAST(o_custkey % 40 AS VARCHAR(20)) END AS owner, 'paper ' || CAST(o_orderkey AS VARCHAR(20)) AS title,
 CAST(o_orderdate AS VARCHAR(30)) AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS VARCHAR(30)) END AS last_read_at,
 CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'unread' ELSE 'reading' END AS status, CAST(o_orderkey % 101 AS DOUBLE) / 100 AS progress FROM orders)"""

SHARES = """shares AS (SELECT l_orderkey AS id, l_linenumber AS pos, CASE WHEN l_partkey % 11 = 0 THEN '' ELSE 'u' || CAST(l_partkey % 40 AS VARCHAR(20)) END AS who,
 CASE l_suppkey % 4 WHEN 0 THEN 'edit' WHEN 1 THEN 'read' WHEN 2 THEN 'odd' ELSE NULL END AS perm FROM lineitem)"""

NOTES = """notes AS (SELECT l_orderkey AS doc, l_linenumber AS note, 'p' || CAST(l_partkey % 5 AS VARCHAR(20)) || 'b' || CAST(l_suppkey % 7 AS VARCHAR(20)) || '#' || CAST(l_linenumber AS VARCHAR(20)) AS block_id,
 CASE WHEN l_partkey % 13 = 0 THEN '' ELSE 'note ' || l_returnflag || ' ' || CAST(l_partkey AS VARCHAR(20)) END AS text, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'u' || CAST(l_suppkey % 40 AS VARCHAR(20)) END AS who FROM lineitem)"""

#: A bibliography per customer: entries are its orders, numbered by date; the body cites them in brackets.
CITES = """entries AS (SELECT o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS n, o_orderkey AS entry, 2000 + CAST(o_orderkey % 25 AS INTEGER) AS year FROM orders),
body AS (SELECT c_custkey AS doc, c_custkey % 4 AS blk, 'as shown [' || CAST(1 + c_custkey % 7 AS VARCHAR(20)) || ', ' || CAST(2 + c_custkey % 5 AS VARCHAR(20)) || '-' || CAST(4 + c_custkey % 9 AS VARCHAR(20)) || '] and [' || CAST(1 + c_custkey % 30 AS VARCHAR(20)) || ']' AS text FROM customer)"""

TRACKS = """frames AS (SELECT event_id, user_id AS track, ts, event_type AS cls, value, CAST(substring(props, 7, length(props) - 7) AS INTEGER) AS k FROM events)"""

#: Text runs of lines, five parts each: font by modulo, some text blank, raised flag in bit 0 of the size.
RUNS = """runs AS (SELECT CAST(floor(p_partkey / 5) AS BIGINT) AS line, p_partkey AS run, CASE p_partkey % 13 WHEN 0 THEN 'ABCDEF+CMMI10' WHEN 1 THEN 'Times-Roman' WHEN 2 THEN 'XYZABC+CMR7' WHEN 3 THEN 'Courier New' WHEN 4 THEN 'Arial,Bold'
 WHEN 5 THEN 'CMSY10' WHEN 6 THEN 'NotoSansSC' WHEN 7 THEN 'QWERTY+Cambria Math' WHEN 8 THEN NULL WHEN 9 THEN 'Symbol' WHEN 10 THEN 'STIXGeneral' WHEN 11 THEN 'CMBX12' ELSE '' END AS font,
 p_size AS size, p_partkey % 3 = 0 AS weak_on, p_partkey % 2 = 0 AS cm_on, CASE WHEN p_partkey % 9 = 4 THEN '  ' ELSE p_name END AS t, CAST(p_partkey * 7 % 90 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS w FROM part)"""

#: Recognised text with and without formulas; § stands for the backslash, which the engines' literals treat differently.
FORMULAS = """formulas AS (SELECT p_partkey AS item, p_size AS n, p_name AS name, CASE p_partkey % 14 WHEN 0 THEN '§[ a_1 + b §]' WHEN 1 THEN 'rate of §(x^2§) and §( y §) here' WHEN 2 THEN '$$E = mc^2$$' WHEN 3 THEN ' $ 5 $ ' WHEN 4 THEN 'E = §sum_{i=1}^{n} x_i'
 WHEN 5 THEN '§frac 12 §alpha' WHEN 6 THEN '§frac 12' WHEN 7 THEN 'a = b §qquad (12a)' WHEN 8 THEN '§quad (3)' WHEN 9 THEN 'x + y     （4） ' WHEN 10 THEN '' WHEN 11 THEN NULL WHEN 12 THEN 'costs $3 and $x_1$ more' ELSE p_name END AS raw FROM part)"""
