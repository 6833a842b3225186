"""Room of erased lines given to the text beside them, so that no hole is left between two stretches of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .greedy import Box, merged

#: Points between pieces of a chain, beside and above; slack of edges; farthest host; least room; a blank's width in ems, the size of text that has none.
CHAIN, ABOVE, SLACK, FARTHEST, LEAST, BLANK, SIZE = 4.0, 2.0, 2.0, 8.0, 0.5, 0.25, 10.0


def _chained(a: Box, b: Box) -> bool:
    return b[0] <= a[2] + CHAIN and a[0] <= b[2] + CHAIN and min(a[3], b[3]) - max(a[1], b[1]) > -ABOVE


def absorbed(lines: DataFrame) -> DataFrame:
    """Lines (page, det, kept, size, tail, head, x1, y1, x2, y2), det unique on a page -> kept ones that grow: (page, det, x, w, tail, head, tail_blanks, head_blanks).

    Lines not kept, chained where they touch, leave room. The kept line that ends at a chain's left takes it up to the next text in its row
    (the most overlap in height, then the rightmost); else the one that starts at the chain's right, from the text before it on (the leftmost).
    Ties go to the least det. tail and head are widths of blanks that end or start a line, null where there are none: then blanks are added.
    """
    kept = lines.where("kept")
    row = lambda a, b: f"least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)"
    order = Window.partitionBy("page").orderBy("x1", "y1", "x2", "y2")
    chains = merged(lines.where("NOT kept"), near=_chained).withColumn("chain", F.row_number().over(order)).alias("c")
    one = Window.partitionBy("page", "chain")

    touch = f"h.page = c.page AND {row('h', 'c')} > 0 AND h.x2 <= c.x1 + {SLACK} AND c.x1 - h.x2 <= {FARTHEST}"
    best = F.row_number().over(one.orderBy(F.desc("band"), F.desc("h2"), "det"))
    pick = ["c.page", "chain", "c.x1", "c.x2", "h.det", "h.y1", "h.y2"]
    left = chains.join(kept.alias("h"), F.expr(touch)).select(*pick, F.expr(row("h", "c")).alias("band"), F.col("h.x2").alias("h2"), F.expr("h.x2 - coalesce(h.tail, 0)").alias("ends"))
    left = left.withColumn("k", best).where("k = 1").alias("l")
    after = f"l.page = o.page AND o.det <> l.det AND {row('o', 'l')} > 0 AND o.x1 > l.ends + {SLACK}"
    room = left.join(kept.alias("o"), F.expr(after)).groupBy("l.page", "chain", "l.det", "l.x1", "l.x2", "l.h2").agg(F.min("o.x1").alias("stop"))
    tails = room.where(f"x1 < stop - {SLACK}").withColumn("extra", F.least("x2", "stop") - F.col("h2")).where(F.col("extra") > LEAST)

    rest = chains.join(tails.select("page", "chain"), ["page", "chain"], "left_anti").alias("c")
    touch = f"h.page = c.page AND {row('h', 'c')} > 0 AND h.x1 >= c.x2 - {SLACK} AND h.x1 - c.x2 <= {FARTHEST}"
    right = rest.join(kept.alias("h"), F.expr(touch)).select(*pick, F.col("h.x1").alias("h1"), F.expr("h.x1 + coalesce(h.head, 0)").alias("starts"))
    right = right.withColumn("k", F.row_number().over(one.orderBy("h1", "det"))).where("k = 1").alias("l")
    before = f"l.page = o.page AND o.det <> l.det AND {row('o', 'l')} > 0 AND o.x2 < l.starts - {SLACK}"
    room = right.join(kept.alias("o"), F.expr(before), "left").groupBy("l.page", "chain", "l.det", "l.x1", "l.h1").agg(F.max("o.x2").alias("from_"))
    heads = room.withColumn("extra", F.col("h1") - F.greatest("x1", "from_")).where(F.col("extra") > LEAST)

    grow = tails.select("page", "det", F.col("extra").alias("t"), F.lit(None).cast("double").alias("h")).unionByName(heads.select("page", "det", F.lit(None).cast("double").alias("t"), F.col("extra").alias("h")))
    grow = grow.groupBy("page", "det").agg(F.max("t").alias("t"), F.max("h").alias("h"))
    blanks = lambda own, extra: F.when(F.col(own).isNull() & F.col(extra).isNotNull(), F.greatest(F.lit(1), F.bround(F.col(extra) / (BLANK * F.coalesce("size", F.lit(SIZE)))).cast("int"))).otherwise(0)
    wide = lambda own, extra: F.when(F.col(extra).isNotNull(), F.round(F.coalesce(own, F.lit(0.0)) + F.col(extra), 3)).otherwise(F.col(own))
    more = F.coalesce("t", F.lit(0.0)) + F.coalesce("h", F.lit(0.0))
    return kept.join(grow, ["page", "det"]).select(
        "page", "det", F.round(F.col("x1") - F.coalesce("h", F.lit(0.0)), 3).alias("x"), F.round(F.col("x2") - F.col("x1") + more, 3).alias("w"),
        wide("tail", "t").alias("tail"), wide("head", "h").alias("head"), blanks("tail", "t").alias("tail_blanks"), blanks("head", "h").alias("head_blanks"),
    )
