"""A corpus from documents to packed token sequences: language ID, line dedup, near-dedup, mixing, packing.

STAGES are (name, function); each function takes (spark, docs, sf_dir), docs being what the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirebase.llm import langid, linededup, mixing, packing, simhash
from quirebase.llm.queries import tokenizer
from quirebase.llm.shared import shelved, unshelved, written
from quirebase.session import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages, lang being the predicted one. Text without letters goes, and text foreign to
    all: it needs more phrases a symbol than the labelled texts of its length do, and has no label that says the same language."""
    inner, names = shelved(docs, "doc_id", "text", "lang")
    keep = [c for c in inner.columns if c != "lang"]
    samples = langid.sample(inner)
    found = langid.identified(inner.withColumn("label", F.col("lang")), samples, [*keep, "label"], langid.bounds(inner, samples))
    stays = F.col("fits") | F.coalesce(F.col("label") == F.col("lang_pred"), F.lit(False))
    found = found.where((F.col("lang_pred") != "und") & stays).withColumn("lang", F.col("lang_pred"))
    return unshelved(found.select(*inner.columns), names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; n_chars follows the text."""
    inner, names = shelved(docs, "doc_id", "text", "source", "n_chars")
    out = linededup.without_boilerplate(inner, "source").withColumn("n_chars", F.char_length("text").cast("long"))
    return unshelved(out.select(*inner.columns), names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same share of the bytes."""
    inner, names = shelved(docs, "doc_id", "text", "source")
    return unshelved(mixing.mixed(inner).select(*inner.columns), names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences."""
    return packing.packed(docs, tokenizer(), 2048, 1)


STAGES = [("language ID", language), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: SQL can express neither cross-parsing, SimHash nor tokenization; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
