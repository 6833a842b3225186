"""Sharding by longest-processing-time scheduling.

Groups of equal texts stay together. Group sizes are summed map-side, then dealt into blocks by descending size
(the blocks are runs of the global size order). In each block the groups arrive sorted and go one by one to the
least loaded of the block's bins through a heap of `shards` entries, so a block of any size needs constant memory.
The blocks' bins (shards x blocks numbers, however many documents there are) are the items of a second, global
longest-processing-time run on the driver, which gives each bin its shard.

Defined cases: a null text counts as an empty one (size 1, and in one group with empty texts); repeated rows are
documents of their own and share their group's shard; a null doc_id is kept; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, written


def lightest(loads: list[tuple[int, int]], size: int) -> int:
    """Give `size` to the least loaded entry of the heap; its number."""
    load, number = loads[0]
    heapq.heapreplace(loads, (load + size, number))
    return number


def binned(groups: DataFrame, shards: int) -> DataFrame:
    """groups (k1, k2, size) -> (k1, k2, size, block, bin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, loads = TaskContext.get().partitionId(), [(0, i) for i in range(shards)]
        for batch in batches:
            bins = [lightest(loads, s) for s in batch.column(2).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array([block] * len(bins), pa.int32()), pa.array(bins, pa.int32())], ["k1", "k2", "size", "block", "bin"])

    order = [F.desc("size"), F.asc("k1"), F.asc("k2")]
    blocks = groups.repartitionByRange(partitions(groups.sparkSession), *order).sortWithinPartitions(*order)
    return blocks.mapInArrow(run, "k1 long, k2 long, size long, block int, bin int")


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot): sizes per shard near equal, equal texts in one shard, slots gapless."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("other"), text).alias("k2"))
    groups = written(binned(rows.groupBy("k1", "k2").agg(F.sum("size").alias("size")), shards), "bins")
    bins = groups.groupBy("block", "bin").agg(F.sum("size").alias("size")).collect()
    loads = [(0, i) for i in range(shards)]
    shard = [(b.block, b.bin, lightest(loads, b.size)) for b in sorted(bins, key=lambda b: (-b.size, b.block, b.bin))]
    #: Bounded by shards x blocks, whatever the number of documents.
    where = F.broadcast(spark.createDataFrame(shard, "block int, bin int, shard int"))
    n = 4 * partitions(spark)
    placed = rows.join(groups.join(where, ["block", "bin"]).select("k1", "k2", "shard"), ["k1", "k2"])
    placed = written(placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "k1"), F.lit(n)).cast("int")), "placed")
    counts = placed.groupBy("shard", "bucket").count().collect()
    base, seen = [], [0] * shards
    for c in sorted(counts):
        base.append((c.shard, c.bucket, seen[c.shard]))
        seen[c.shard] += c["count"]
    before = F.broadcast(spark.createDataFrame(base, "shard int, bucket int, base long"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "k1", "k2")
    return placed.withColumn("i", F.row_number().over(order)).join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("i") - 1).cast("long").alias("slot"))
