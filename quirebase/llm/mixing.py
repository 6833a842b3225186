"""Mixing sources to target weights by Poisson replication.

A source whose share of the bytes is s and whose target weight is w has the mean repetition rate w / s. A document's
number of copies is the Poisson distribution of that mean, inverted at a uniform number made from a hash of the seed and
the document's id: the same in every run, on every cluster, and without a shuffle. The copies are exploded and dealt
out by a hash of (seed, id, copy), then sorted by it in each partition: a global shuffle.

The distribution is inverted in a table of its cumulative probabilities, one per source. A mean over SPLIT is the sum
of as many equal, independent parts as needed, so no probability underflows.

Defined cases: a null source is a source; null and empty texts count as one byte; documents with the same id (or a null
one) get equal numbers of copies; target weights are relative, sources without one have weight 0 and go; a null text is
kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shelved, unshelved, written

SEED, SPLIT = 17, 500.0


def uniform(seed: int, part: Column, doc: Column) -> Column:
    """52 bits of MD5 as a number from 0 to under 1."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), part.cast("string"), F.coalesce(doc.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per source: (_source, rate, parts, cdf). weights None: the same weight for every source."""
    size = F.sum(F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1))).alias("size")
    sources = docs.groupBy(F.col("source").alias("_source")).agg(size)
    if weights is not None:
        known = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_source string, weight double")
        sources = sources.join(known, sources._source.eqNullSafe(known._source), "left").select(sources._source, "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    else:
        sources = sources.withColumn("weight", F.lit(1.0))
    total = sources.agg(F.sum("size").alias("bytes"), F.sum("weight").alias("weights"))
    df = sources.crossJoin(F.broadcast(total))  # one row
    df = df.withColumn("rate", F.col("bytes").cast("double") / F.col("weights") * F.col("weight") / F.col("size"))
    df = df.withColumn("parts", F.greatest(F.ceil(F.col("rate") / SPLIT), F.lit(1)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    most = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 30).cast("int")
    start = F.exp(-F.col("mean"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), (state["c"] + p).alias("c"), F.concat(state["all"], F.array(state["c"] + p)).alias("all"))

    cdf = F.aggregate(F.sequence(F.lit(1), most), F.struct(start.alias("p"), start.alias("c"), F.array(start).alias("all")), step, lambda s: s["all"])
    return df.withColumn("cdf", cdf).select("_source", "rate", "parts", "cdf")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """docs repeated to the target weights and shuffled; copy counts a document's copies from 1 to repetitions.

    The rows are the same whatever the number of partitions; the order inside the files is by hash of (seed, id, copy, text)."""
    docs, names = shelved(docs, "doc_id", "text", "source")
    table = written(rates(docs, weights), "rates")
    df = docs.join(table, F.col("source").eqNullSafe(F.col("_source")))
    one = lambda s, j: s + F.size(F.filter("cdf", lambda c: c <= uniform(seed, j, F.col("doc_id"))))
    df = df.withColumn("repetitions", F.aggregate(F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0), one))
    df = df.select(*docs.columns, "repetitions").where("repetitions > 0")
    df = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repetitions")))).withColumn("_at", F.xxhash64(F.lit(seed), "doc_id", "copy", "text"))
    return unshelved(df.repartition("_at").sortWithinPartitions("_at"), names, "repetitions", "copy")


SQL = f"""
WITH RECURSIVE sizes AS (SELECT source, sum(greatest(coalesce(strlen(text), 0), 1)) AS size FROM documents GROUP BY source),
rates AS (SELECT source, CAST((SELECT sum(size) FROM sizes) AS DOUBLE) / CAST((SELECT count(*) FROM sizes) AS DOUBLE) * 1.0::DOUBLE / CAST(size AS DOUBLE) AS mean FROM sizes),
cdf AS (SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM rates
        UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < ceil(mean + 12 * sqrt(mean) + 30)),
tables AS (SELECT source, list(c) AS cdf FROM cdf GROUP BY source),
drawn AS (SELECT doc_id, d.source, text, CAST(len(list_filter(cdf, lambda x: x <= CAST(CAST('0x' || substr(md5('{SEED}:0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE)) AS INTEGER) AS repetitions
          FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, text, repetitions, CAST(unnest(range(1, repetitions + 1)) AS INTEGER) AS copy FROM drawn WHERE repetitions > 0
"""
