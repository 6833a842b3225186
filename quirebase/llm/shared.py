"""Helpers of the training-data operators: shared scratch tables, global buckets, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may leave it unset and gets one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="quirebase-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        folder = _OWN[0]
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """df dealt out anew, by all its columns, into as few partitions as Spark's adaptive rules find its size to need. For tables of
    narrow rows from many tasks: on a local store Hadoop starts two processes for every file, to set its mode and its checksum's."""
    return df.hint("rebalance", *df.columns)


def removed(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch of whole texts may hold; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shelved(df: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """df with every column but the `needed` ones under a name that no operator uses (also clashing ones), and all its names in order."""
    names = df.columns
    first = {c: names.index(c) for c in needed if c in names}
    return df.toDF(*(c if first.get(c) == i else f"shelved_{i}" for i, c in enumerate(names))), names


def unshelved(df: DataFrame, names: list[str], *new: str) -> DataFrame:
    """The columns that `shelved` hid under their own names, in order, and the new ones; a new one replaces an old one of its name."""
    low = [n.lower() for n in new]
    shown = [(f"shelved_{i}" if f"shelved_{i}" in df.columns else c, c) for i, c in enumerate(names) if c.lower() not in low]
    return df.select(*(F.col(k).alias(c) for k, c in shown), *new)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) as rows (node, label), nodes without an edge left out; ids of any one type with an order.

    Each round every node hooks to its least neighbour, the pointers are halved until they all lead to a root (a logarithmic
    number of times, also on a sorted path), and the edges are contracted to the roots. All of it is joins and map-side
    combined minima over written tables: no list of neighbours and no component meets in one task. Loops (a = b) and
    repeated edges are allowed.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("p"))
        hook = written(hook, "hook")
        while True:
            up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            halved = written(hook.select("u", "p").join(up, "p").select("u", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "halved")
            removed(hook)
            hook = halved
            if hook.where("moved").isEmpty():
                break
        to = hook.select("u", "p")
        if labels is None:
            found = written(to.select(F.col("u").alias("node"), F.col("p").alias("label")), "labels")
        else:
            found = written(labels.join(to.withColumnRenamed("u", "label"), "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
            removed(labels)
        labels, rest = found, edges
        for end in ("a", "b"):
            rest = rest.join(to.select(F.col("u").alias(end), F.col("p").alias("to")), end).drop(end).withColumnRenamed("to", end)
        rest = rest.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        rest = written(rest, "edges")
        removed(edges, hook)
        edges = rest
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
