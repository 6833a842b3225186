"""A bounded queue that drops what finds it full, replayed over a log of puts and takes.

The fill of a queue depends on all that came before, but what any stretch of the log does to it is one clamp, x -> min(hi, max(lo, x + add)),
and clamps compose. So stretches are summed up apart, the few sums of a pool are walked in order, and each stretch is replayed from its own
start: no task holds a pool's whole log, only a stretch of `width` in time. The waiting policy is a stream source's rate limit, not an operator.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .greedy import by_group

Clamp = tuple[int, int, int]


def after(first: Clamp, then: Clamp) -> Clamp:
    """Both clamps (lo, hi, add), one after the other."""
    lo, hi, add = then
    return min(hi, max(lo, first[0] + add)), min(hi, max(lo, first[1] + add)), first[2] + add


def admitted(log: DataFrame, size: int, width: int) -> DataFrame:
    """Log (pool, at, seq, take) -> its puts (pool, at, seq, fill, accepted).

    A row whose take is null puts one item, any other takes up to that many away, in the order of at and seq, whole numbers that are
    unique together in a pool, which is not null. fill is how many items a put finds; it is accepted if they are fewer than size.
    """
    whole = log.select("pool", F.col("at").cast("long"), F.col("seq").cast("long"), F.coalesce("take", F.lit(-1)).cast("long").alias("take"))
    cut = whole.withColumn("stretch", F.floor(F.col("at") / width)).withColumn("cell", F.concat_ws("|", "pool", "stretch"))

    def total(cell, rows: list) -> Iterator[tuple]:
        clamp: Clamp = (0, size, 0)
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            clamp = after(clamp, (0, size, -r.take))  # a put is marked by a take of -1
        yield (rows[0].pool, rows[0].stretch, *clamp)

    def starts(pool, rows: list) -> Iterator[tuple]:
        fill = 0
        for r in sorted(rows, key=lambda r: r.stretch):
            yield pool, r.stretch, fill
            fill = min(r.hi, max(r.lo, fill + r.add_))

    def replay(cell, rows: list) -> Iterator[tuple]:
        fill = rows[0].fill
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            if r.take < 0:
                yield r.pool, r.at, r.seq, fill, fill < size
            fill = min(size, max(0, fill - r.take))

    pool = dict(log.dtypes)["pool"]
    sums = by_group(cut, "cell", total, f"pool {pool}, stretch long, lo long, hi long, add_ long")
    begin = by_group(sums, "pool", starts, f"pool {pool}, stretch long, fill long")
    return by_group(cut.join(begin, ["pool", "stretch"]), "cell", replay, f"pool {pool}, at long, seq long, fill long, accepted boolean")
