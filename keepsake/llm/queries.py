"""The queries op1 to op13 over whole tables, with SQL where DuckDB can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import bpe, divergence, filter_audit, language_id, near_duplicates, packing, quality_network, quality_rules, sharding, token_counts, topk_search, toxicity, warc
from keepsake.llm._shared import table

SHARDS = 8
QUERY_DIVISOR, TOP_K = 50, 5
TOKEN_LIMIT = 512


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, F.col("vec_id") % QUERY_DIVISOR == 0, TOP_K)


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op5_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.components(table(spark, sf_dir, "documents"))


def op8_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), TOKEN_LIMIT)


def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over instruction data: all turns of conversations, under limits of tokens, segments and loss-bearing tokens that can each bind."""
    return packing.pack_conversations(table(spark, sf_dir, "conversations"), tokenizer("word_bpe_49k.json"))


def op10_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_network.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_impact_topk, op2_rendezvous_sharding, op3_quality_rules, op4_warc_normaliser, op5_segment_tree_bpe, op6_subword_toxicity, op7_tensored_minhash, op8_prefix_token_counts, op9_vector_packing, op10_cross_parsing, op11_filter_audit, op12_byte_network, op13_source_divergence, conversation_packing)}
ORACLES = {"op1_impact_topk": topk_search.oracle(QUERY_DIVISOR, TOP_K), "op4_warc_normaliser": warc.oracle(), "op3_quality_rules": quality_rules.oracle(), "op2_rendezvous_sharding": sharding.oracle(SHARDS), "op11_filter_audit": filter_audit.oracle(), "op13_source_divergence": divergence.oracle()}
