"""Registered queries of the operators, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm import ann, archive, bestfit, decontam, hardneg, langid, lm, neardup, packing, sharding, tokens, trie, urls
from offerlake.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return register


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"))


@query("op2_url_filter", urls.oracle())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages"))


@query("op5_warc_archive", archive.oracle())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive_pages(read(spark, sf_dir, "pages"))


@query("op6_vector_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.pack_shards(read(spark, sf_dir, "documents"))


@query("op10_superminhash_neardup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


@query("op8_kneser_ney")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    return lm.score_texts(read(spark, sf_dir, "documents"), learned)


@query("op9_word_backoff_langid")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    return langid.identify(read(spark, sf_dir, "documents"), learned)


@query("op3_length_buckets")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_batches(read(spark, sf_dir, "documents"))


@query("op4_cgk_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op7_pruned_graph_ann")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


@query("op11_four_russians_negatives", hardneg.oracle())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(rows.withColumn("label", moved))


@query("op12_best_fit_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = bestfit.tokenized(read(spark, sf_dir, "documents"))
    return bestfit.pack_best_fit(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op13_prefix_trie", trie.oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(read(spark, sf_dir, "conversations")))
