"""Document fingerprints by winnowing, in DataFrame functions alone.

Tokens are runs of characters that are not white space (an ideograph is a token of its own). Every run of K tokens
is hashed, every window of W such hashes gives its least hash (the rightmost of equal ones), and the chosen hashes
are kept with their positions. So two texts that share W + K - 1 consecutive tokens share a chosen hash.

A hash has 61 bits; while a window is judged, its last three hold the place in the window, so that one `least` decides
ties too. Positions are whole numbers of any size.

The next document is found by ranges of doc_id of about RANGE_BYTES of text each, whatever the size of the table: up to
COARSE cuts, and within each as many again as needed. Only texts are shuffled, fingerprints are made where they arrive.

Defined cases: null is an empty text; a text without tokens has the empty fingerprint; fewer than K tokens are one
gram; repeated rows and equal texts have equal fingerprints; a null doc_id comes first in the order of documents, rows of
one doc_id come in the order of their texts and share a range; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, written

K, W = 5, 8
TOKEN = r"\p{IsIdeographic}|[^\s\p{IsIdeographic}]+"
RANGE_BYTES, COARSE = 32 << 20, 1000


def picked(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds <out>_at and <out>_hash: positions of the chosen grams in order, and their hashes."""
    words, grams, at = f"{out}_words", f"{out}_grams", f"{out}_at"

    def gram(_, i):
        return F.xxhash64(*(F.get(F.col(words), i + j) for j in range(K))).bitwiseAND(F.lit(-W))

    def least(_, i):
        best = F.least(*(F.get(F.col(grams), i + j) + F.lit(W - 1 - j) for j in range(W)))
        return i.cast("long") + (F.lit(W - 1) - best.bitwiseAND(F.lit(W - 1)))

    df = df.withColumn(words, F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)))
    df = df.withColumn(grams, F.slice(F.transform(F.col(words), gram), F.lit(1), F.greatest(F.size(words) - (K - 1), F.lit(1))))
    df = df.withColumn(at, F.array_distinct(F.slice(F.transform(F.col(grams), least), F.lit(1), F.greatest(F.size(grams) - (W - 1), F.lit(1)))))
    df = df.withColumn(f"{out}_hash", F.transform(F.col(at), lambda p: F.shiftrightunsigned(F.get(F.col(grams), p.cast("int")), 3)))
    return df.drop(words, grams)


def shown(out: str) -> Column:
    """hash@position,... in text order."""
    return F.array_join(F.zip_with(F.col(f"{out}_hash"), F.col(f"{out}_at"), lambda h, p: F.concat(F.lower(F.hex(h)), F.lit("@"), p.cast("string"))), ",")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two sets of hashes; two empty ones are alike."""
    both = F.size(F.array_intersect(F.col(a), F.col(b)))
    either = F.size(F.array_distinct(F.col(a))) + F.size(F.array_distinct(F.col(b))) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both.cast("double") / either.cast("double"))


def _quantiles(n: int) -> Column:
    return F.percentile_approx("doc_id", F.array(*(F.lit(i / n) for i in range(1, n))), F.lit(10 * n))


def ranged(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with _range, the least doc_id of a row's range, and _ghost: a copy of the first row of each range (after
    the last: of all) is sent to the range before, so that every row finds its follower in its own."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long") + 8).alias("bytes"), F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("null")).first()
    want = max(2 * partitions(docs.sparkSession), -(-(size.bytes or 0) // RANGE_BYTES))
    coarse = max(2, min(want, COARSE))
    fine = -(-want // coarse)
    first = docs.agg(_quantiles(coarse).alias("q")).first().q or []
    cuts = sorted({size.least, *first}) if size.least is not None else []
    number = lambda c: F.greatest(F.size(F.filter(F.array(*(F.lit(q).cast("long") for q in cuts)).cast("array<long>"), lambda b: b <= c)), F.lit(1))
    table = docs.sparkSession.createDataFrame([(i + 1, q) for i, q in enumerate(cuts)], "part int, cut long")
    if fine > 1:
        more = docs.where("doc_id is not null").groupBy(number(F.col("doc_id")).alias("part")).agg(_quantiles(fine).alias("more"))
        table = table.join(more, "part", "left").withColumn("cuts", F.array_sort(F.array_union(F.array("cut"), F.coalesce("more", F.array().cast("array<long>")))))
    else:
        table = table.withColumn("cuts", F.array("cut"))
    # COARSE rows of as many cuts as the bytes of a COARSE-th of the table ask for.
    table = written(table.withColumn("last", F.element_at("cuts", -1)).select("part", "cuts", "last", F.lag("last").over(Window.orderBy("part")).alias("before")), "ranges")
    final = table.agg(F.max("last").alias("last")).first().last
    df = docs.withColumn("part", number(F.col("doc_id"))).join(F.broadcast(table), "part", "left")
    here = F.coalesce(F.try_element_at(F.filter("cuts", lambda b: b <= F.col("doc_id")), F.lit(-1)), F.lit(size.least).cast("long"))
    below = F.coalesce(F.try_element_at(F.filter("cuts", lambda b: b < F.col("doc_id")), F.lit(-1)), F.col("before"))
    opens = F.coalesce(F.array_contains("cuts", F.col("doc_id")), F.lit(False)) & (F.col("doc_id") > F.lit(size.least))
    least = F.lit(None if size.null else size.least).cast("long")
    none = F.array().cast("array<struct<range:bigint,ghost:boolean>>")
    at = lambda where, ghost: F.array(F.struct(where.cast("long").alias("range"), F.lit(ghost).alias("ghost")))
    places = F.concat(at(here, False), F.when(opens, at(below, True)).otherwise(none), F.when(F.col("doc_id").eqNullSafe(least), at(F.lit(final), True)).otherwise(none))
    return df.select("doc_id", "text", F.explode(places).alias("at")).select("doc_id", "text", F.col("at.range").alias("_range"), F.col("at.ghost").alias("_ghost"))


def halves_swapped(docs: DataFrame) -> DataFrame:
    """Each document, its text with the last half replaced by the next document's beginning, and how alike they are."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = picked(ranged(rows).repartition("_range"), "text", "own")
    order = Window.partitionBy("_range").orderBy("_ghost", "doc_id", "text")
    df = df.withColumns({"next_text": F.lead("text").over(order), "next_hash": F.lead("own_hash").over(order)}).where(~F.col("_ghost"))
    n = F.char_length("text")
    df = df.withColumn("n_chars", n.cast("long")).withColumn("half", F.floor(n / 2).cast("int"))
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - F.col("half")), F.substring("next_text", F.lit(1), F.col("half"))))
    df = picked(df.select("doc_id", "n_chars", "edited", "own_at", "own_hash", "next_hash"), "edited", "new")
    return df.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown("own").alias("fingerprint"), shown("new").alias("edited_fingerprint"),
        likeness("own_hash", "new_hash").alias("near_edited"), likeness("own_hash", "next_hash").alias("near_next"),
    )
