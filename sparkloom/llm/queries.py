"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import oracles
from sparkloom.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm import html_density

    texts = html_density.main_texts(table(spark, sf_dir, "pages"), keep=("page_id", "url"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm import license_scan

    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm import sst_shards

    manifest = sst_shards.write_shards(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return sst_shards.checksums(sst_shards.read_shards(manifest))


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm import lattice_lm

    return lattice_lm.score(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_secrets_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm import secrets_crf

    docs = table(spark, sf_dir, "documents")
    return secrets_crf.digests(secrets_crf.scan(docs, secrets_crf.fit(docs)))


def op6_pstable_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm import pstable

    found = pstable.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op7_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm import pivotal

    sized = pivotal.sizes(table(spark, sf_dir, "documents"))
    mixed = pivotal.mix(sized, pivotal.targets(sized, weights=(3, 1, 2), share=1.5, cap=2.0))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm import mcd_quality

    return mcd_quality.report(mcd_quality.judge(table(spark, sf_dir, "documents")))


def op10_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sparkloom.llm import prefix_bpe

    docs = table(spark, sf_dir, "documents")
    return prefix_bpe.digests(prefix_bpe.encode(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_html_density": oracles.OP1_SQL, "op6_pstable_embeddings": oracles.OP6_SQL, "op9_mcd_quality": oracles.OP9_SQL}
