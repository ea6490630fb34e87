"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprop.llm import (
    bpe_distinct,
    budget_mix,
    digest_index,
    disclosure,
    license_join,
    merkle_manifest,
    oracles,
    quality_rules,
    rule_ensemble,
    shard_minimax,
    simhash_vptree,
    source_divergence,
    token_arrow,
    toxicity_channel,
)
from lexiprop.llm.common import documents, labels


TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_arrow.write_tokens(documents(spark, sf_dir), token_arrow.new_folder(spark), tokenizer_path(), end_id=2)
    return token_arrow.read_tokens(manifest)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vptree.near_duplicates(documents(spark, sf_dir), shingle_words=4, max_bits=4)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.dedup_batch(documents(spark, sf_dir), digest_index.new_index(spark))


def op5_bpe_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_distinct.encode_documents(documents(spark, sf_dir), tokenizer_path())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity_channel.score_documents(docs, toxicity_channel.fit(docs, labels(spark, sf_dir)))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = budget_mix.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source", "source_size", "target", "taken", "copies")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_minimax.shard(documents(spark, sf_dir), shards=40)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.score_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.find_private(documents(spark, sf_dir))
    return found.withColumn("sanitised_sha256", F.sha2("sanitised", 256)).drop("sanitised")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(documents(spark, sf_dir))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan(documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(documents(spark, sf_dir))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_files": op2_token_files,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_bpe_distinct_words": op5_bpe_distinct_words,
    "op6_toxicity": op6_toxicity,
    "op7_source_mix": op7_source_mix,
    "op8_sharding": op8_sharding,
    "op9_quality_rules": op9_quality_rules,
    "op10_personal_data": op10_personal_data,
    "op11_source_divergence": op11_source_divergence,
    "op12_license_scan": op12_license_scan,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE = {
    "op4_exact_dedup": r"""
        with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
        n as (select *, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
                     row_number() over (partition by text_sha256, doc_id) as copy from d)
        select doc_id, keep_id, group_size, doc_id is not distinct from keep_id and copy = 1 as kept, text_sha256 from n
    """,
    "op11_source_divergence": oracles.SOURCE_DIVERGENCE,
    "op12_license_scan": oracles.license_scan(),
    "op13_merkle_manifest": oracles.MERKLE_MANIFEST,
}
