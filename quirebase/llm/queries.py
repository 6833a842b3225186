"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import flac, langid, linededup, mixing, packing, sharding, simhash, suffixarray, suffixtree, winnow
from .shared import written


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(written(flac.stored(table(spark, sf_dir, "documents")), "media"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.without_repeats(table(spark, sf_dir, "documents"), 35)


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixarray.without_later_repeats(table(spark, sf_dir, "documents"), 100)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(table(spark, sf_dir, "documents"), 16)
    return out.selectExpr("doc_id", "size", "text_crc32", "'bytes' as law", "shard", "slot", "cast(null as int) as grown_shard")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.without_boilerplate(table(spark, sf_dir, "documents"), "source").select("doc_id", "text", "n_lines", "n_dropped")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "repetitions", "copy")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), 3, 3)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.halves_swapped(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.id_crc(packing.packed(table(spark, sf_dir, "documents"), tokenizer(), 2048, 1))


_ALL = (op1_flac, op2_suffix_tree, op3_sharding, op4_line_dedup, op5_language, op6_mixing, op7_simhash, op8_winnowing, op9_suffix_array, op10_packing)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op4_line_dedup": linededup.SQL, "op6_mixing": mixing.SQL}
