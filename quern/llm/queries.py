"""Queries of the training-data operators, each over its whole table at production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, line_dedup, packing, quality, sharding, simhash, token_count, topk_index, url_filter
from .common import read_table, scratch_table

RULES = [
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
]
EVERY = 100


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pretoken_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 shards: 4 regions of 2 racks of 2 shards."""
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), sharding.Topology.balanced(4, 2, 2))


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled outcome of a page is that of the label row of its id: bad if toxic or of no quality."""
    labels = read_table(spark, sf_dir, "labels")
    bad = F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False)))
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filter.judge_pages(read_table(spark, sf_dir, "pages").select("page_id", "url"), outcomes, RULES)


def op3_pivot_distance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scratch_table(topk_index.quantized(read_table(spark, sf_dir, "embeddings")))
    return topk_index.search(topk_index.PivotIndex(rows), rows.filter(F.col("vec_id") % EVERY == 0), 10)


def op4_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), pretoken_pattern())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scratch_table(ann.usable_vectors(read_table(spark, sf_dir, "embeddings")))
    return ann.search(ann.LearnedIndex(rows), rows.filter(F.col("vec_id") % EVERY == 0), 10)


def op7_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site of a document is its source."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, F.col("source")).drop("source")


def op8_simhash_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_whole_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_matrix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), pretoken_pattern())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_hash_tree_sharding,
        op2_host_reputation,
        op3_pivot_distance_topk,
        op4_cost_balanced_packing,
        op5_mil_quality,
        op6_learned_partitions,
        op7_site_line_dedup,
        op8_simhash_vp_tree,
        op9_whole_token_count,
        op10_matrix_bpe,
    ]
    return {f.__name__: f for f in found}
