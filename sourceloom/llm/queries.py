"""The corpus operators as queries over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality_rules


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(_documents(spark, sf_dir))


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ordinal_quality import fit_ordinal, grade_scores, grades_of

    documents = _documents(spark, sf_dir)
    model = fit_ordinal(documents, grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return grade_scores(documents, model)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, toxicity_scores

    documents = _documents(spark, sf_dir)
    model = fit_toxicity(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_scores(documents, model)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_measures

    return quality_measures(_documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_sequences

    return pack_sequences(_documents(spark, sf_dir), with_ids=False)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_digests, shuffle_into_shards

    return shard_digests(shuffle_into_shards(_documents(spark, sf_dir)))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_digests, store_texts

    return media_digests(store_texts(_documents(spark, sf_dir)))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import bpe_digests

    return bpe_digests(_documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_trie

    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_documents(spark, sf_dir))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash": op2_simhash,
    "op3_ordinal_quality": op3_ordinal_quality,
    "op4_html_text": op4_html_text,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_sharding": op8_sharding,
    "op9_media": op9_media,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_mixing": op13_mixing,
}

ORACLES: dict[str, str] = {
    "op6_quality_rules": quality_rules.oracle_sql(),
}
