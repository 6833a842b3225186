"""Line dedup by site-relative frequency.

A line is boilerplate of a host if the pages of the host that contain it, divided by all pages of the host, exceed
RATIO, and MIN_PAGES pages have it at least. Lines are counted by 128-bit hash, once a page, summed map-side. A page
has few lines, so at most (lines a page) / RATIO lines of a host can be boilerplate: the list joined back to the pages
is short for each host. Its table is written first, so Spark knows its size and broadcasts it only where it is small;
else the join's skewed hosts are split at run time.

Defined cases: a null text stays null and has no lines; blank lines are never counted and never dropped; a null host
is a host; repeated rows are pages of their own; a text of boilerplate alone becomes empty; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shelved, unshelved, written

RATIO, MIN_PAGES = 0.1, 5


def filled(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def named(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("other"), line).alias("b"))


def boilerplate(pages: DataFrame, host: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row (host, bad) for each host that has boilerplate: bad are the lines' hashes."""
    totals = pages.groupBy(F.col(host).alias("h")).agg(F.count("*").alias("total"))
    own = F.array_distinct(F.filter(F.split("text", "\n"), filled))
    lines = pages.select(F.col(host).alias("h"), F.explode(own).alias("line")).select("h", named(F.col("line")).alias("name"))
    counts = lines.groupBy("h", "name").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = totals.withColumnRenamed("h", "host")
    often = counts.join(totals, counts.h.eqNullSafe(totals.host)).where(F.col("n") > ratio * F.col("total"))
    return often.groupBy("host").agg(F.collect_list("name").alias("bad"))


def without_boilerplate(pages: DataFrame, host: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages with the boilerplate lines of their hosts taken out of text, and n_lines, n_dropped (in place of columns of these names)."""
    pages, names = shelved(pages, "text", host)
    bad = written(boilerplate(pages, host, ratio, min_pages), "boilerplate").withColumnRenamed("host", "_host")
    df = pages.join(bad, F.col(host).eqNullSafe(F.col("_host")), "left").withColumn("_lines", F.split("text", "\n"))
    good = F.filter("_lines", lambda x: ~(filled(x) & F.array_contains("bad", named(x))))
    df = df.withColumn("_good", F.when(F.col("bad").isNull(), F.col("_lines")).otherwise(good))
    df = df.withColumns({"text": F.array_join("_good", "\n"), "n_lines": F.coalesce(F.size("_lines"), F.lit(0)), "n_dropped": F.coalesce(F.size("_lines") - F.size("_good"), F.lit(0))})
    return unshelved(df, names, "n_lines", "n_dropped")


SQL = f"""
WITH lines AS (SELECT DISTINCT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
counts AS (SELECT source, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY source, line),
bad AS (SELECT c.source, list(c.line) AS bad FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
        WHERE n >= {MIN_PAGES} AND n > {RATIO}::DOUBLE * total GROUP BY c.source),
split AS (SELECT doc_id, string_split(text, chr(10)) AS l, coalesce(bad, []) AS bad FROM documents d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source),
kept AS (SELECT doc_id, l, list_filter(l, lambda x: NOT list_contains(bad, x)) AS good FROM split)
SELECT doc_id, array_to_string(good, chr(10)) AS text, CAST(len(l) AS INTEGER) AS n_lines, CAST(len(l) - len(good) AS INTEGER) AS n_dropped FROM kept
"""
